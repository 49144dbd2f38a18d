"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of benchmark words; the text is searched word by word. For each
pattern length m a shift table says, for a block of two words, how far the search may
move on: m - 1 where the block is in no pattern, 0 where it ends one. Where it is 0, the
hash of that suffix selects the patterns to test, and comparing the bytes decides. Texts
are cut into lanes that move on together, so that the tables are read for many places
at once. Patterns of each length have tables of their own: one short item does not cost
the long windows their shifts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import blocks, fold_hash, spans_of, text_or_empty

WINDOW = 10
#: Entries of a shift table, and words that a lane of the search covers.
TABLE, LANE = 1 << 20, 256
#: Bytes of windows that one set of tables holds; a larger benchmark takes several sets, applied one after another.
SET_BYTES = 32 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes of a block of texts, its words' starts and ends, and the place of each text's first word (one more at the end)."""
    raw = [t.encode() for t in texts]
    buf = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    starts, ends = spans_of(_WORD[buf])
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return buf.tobytes(), starts, ends, np.searchsorted(starts, at)


def windows_of(text: str) -> list[bytes]:
    """Distinct windows of an item, words joined by a space; an item of fewer words is one window, none has none."""
    raw, starts, ends, _ = words_of([text])
    words = [raw[a:b] for a, b in zip(starts, ends)]
    if not words:
        return []
    return list({b" ".join(words[i : i + WINDOW]): None for i in range(max(1, len(words) - WINDOW + 1))})


def _block(h: np.ndarray) -> np.ndarray:
    """Hash of each word and the one before it."""
    return h[1:] + (h[:-1] * np.uint64(0x9E3779B97F4A7C15))


class Tables:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, m: int, patterns: list[tuple[int, bytes]]):
        self.m, self.b = m, min(2, m)
        raw, starts, ends, _ = words_of([p.decode() for _, p in patterns])
        h = fold_hash(np.frombuffer(raw, np.uint8), starts, ends).reshape(-1, m)
        keys = h if self.b == 1 else np.stack([_block(row) for row in h])
        self.shift = np.full(TABLE, m - self.b + 1, np.int64)
        for j in range(keys.shape[1]):
            np.minimum.at(self.shift, (keys[:, j] >> np.uint64(44)).astype(np.int64), keys.shape[1] - 1 - j)
        self.buckets: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for key, p in zip(keys[:, -1].tolist(), patterns):
            self.buckets[key].append(p)

    def found(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(pattern, last word) of every occurrence inside one text."""
        if len(h) < self.m:
            return []
        keys = h if self.b == 1 else np.concatenate([h[:1], _block(h)])
        shift = self.shift[keys >> np.uint64(44)]
        # lanes over the places where an occurrence may end
        lane = np.arange(self.m - 1, len(h), LANE)
        at, stop = lane.copy(), np.minimum(lane + LANE, len(h))
        hits = []
        while len(at):
            step = shift[at]
            zero = step == 0
            hits.append(at[zero])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        out = []
        places = np.concatenate(hits)
        owner = np.searchsorted(first, places, side="right")
        for end, begin in zip(places.tolist(), first[owner - 1].tolist()):
            a = end - self.m + 1
            candidates = self.buckets.get(int(keys[end]))
            if a < begin or not candidates:
                continue
            window = b" ".join([raw[s:e] for s, e in zip(starts[a : end + 1].tolist(), ends[a : end + 1].tolist())])
            out += [(number, end) for number, p in candidates if p == window]
        return out


def _search(patterns: list[tuple[int, bytes]]):
    """mapInPandas: adds the hit word ranges and pattern numbers of one set of patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length = defaultdict(list)
        for number, p in patterns:
            by_length[p.count(b" ") + 1].append((number, p))
        tables = [Tables(m, ps) for m, ps in sorted(by_length.items())]
        for batch in batches:
            texts = [text_or_empty(t) for t in batch["text"]]
            for i, j in blocks(texts):
                raw, starts, ends, first = words_of(texts[i:j])
                h = fold_hash(np.frombuffer(raw, np.uint8), starts, ends)
                spans, numbers = [[] for _ in range(j - i)], [set() for _ in range(j - i)]
                for t in tables:
                    for number, end in t.found(raw, starts, ends, h, first):
                        doc = int(np.searchsorted(first, end, side="right")) - 1
                        spans[doc].append((end - t.m + 1 - int(first[doc]), end + 1 - int(first[doc])))
                        numbers[doc].add(number)
                out = batch.iloc[i:j].copy()
                out["n_words"] = np.diff(first)
                out["_spans"] = [[*(old if old is not None else []), *({"start": a, "end": b} for a, b in merged(s))] for old, s in zip(out["_spans"], spans)]
                out["_found"] = [[*(old if old is not None else []), *sorted(n)] for old, n in zip(out["_found"], numbers)]
                yield out.astype({"doc_id": "Int64"})

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _numbered(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Distinct windows with the items that have them, dealt into sets of bounded size."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(item, w) for item, t in zip(batch["item_id"], batch["text"]) for w in windows_of(text_or_empty(t))]
            yield pd.DataFrame(rows, columns=["item_id", "window"])

    windows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(cut, "item_id string, window binary").distinct()
    size = windows.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    sets = 1 + size // SET_BYTES
    return windows.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(sets)).cast("int")), sets


def _summed(items_of: dict[int, list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for spans, found in zip(batch["_spans"], batch["_found"]):
                hit = merged([(s["start"], s["end"]) for s in spans])
                items = sorted({x for n in found for x in items_of[n]})
                rows.append((sum(b - a for a, b in hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit), [{"start": a, "end": b} for a, b in hit], items))
            out = pd.DataFrame(rows, columns=["n_hit", "n_items", "items_sha256", "contaminated", "hit_words", "item_ids"])
            out.insert(0, "n_words", batch["n_words"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return run


OUT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_words array<struct<start:int,end:int>>, item_ids array<string>"


def _in_order(windows: DataFrame) -> list[tuple[bytes, str | None]]:
    """Windows of a set with the ids of their items, one row for all items without id."""
    rows = [(bytes(r.window), r.item_id) for r in windows.select("item_id", "window").collect()]
    return sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or ""))


def _searched(docs: DataFrame, benchmark: DataFrame, carry: list[str]) -> tuple[DataFrame, dict[int, list[str]]]:
    """docs (doc_id, text and ``carry``) with n_words, hit word ranges and pattern numbers, and the items of every pattern.

    Windows reach the tasks in sets of at most about SET_BYTES, one after another.
    """
    windows, sets = _numbered(benchmark)
    now = docs.select("doc_id", "text", *carry, F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("_spans"), F.array().cast("array<int>").alias("_found"))
    items_of: dict[int, list[str]] = {}
    for part in range(sets):
        patterns: dict[bytes, int] = {}
        for window, item in _in_order(windows.where(F.col("part") == part)):
            items = items_of.setdefault(patterns.setdefault(window, len(items_of)), [])
            if item is not None:
                items.append(item)
        now = now.mapInPandas(_search([(n, w) for w, n in patterns.items()]), now.schema)
    return now, items_of


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of every document that are inside an occurrence of a benchmark window, and the items found.

    ``hit_words`` are ranges of word numbers. Null texts have no words; items without
    words are never found; a window that several items share counts for each. Windows of
    items without id make words hit and documents contaminated; such items are not among
    ``n_items`` and their digest.
    """
    now, items_of = _searched(docs, benchmark, [])
    return now.select("doc_id", "n_words", "_spans", "_found").mapInPandas(_summed(items_of), OUT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs."""
    names = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    now, _ = _searched(renamed, benchmark, list(names.values()))
    return now.where(F.size("_spans") == 0).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
