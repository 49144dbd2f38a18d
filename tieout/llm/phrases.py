"""Phrase collocations by vertical partitioning of a word suffix tree.

All suffixes of all word sequences, cut off after the longest phrase, form a tree whose
nodes are phrases. It is never held as a whole. Prefixes are counted from short to long:
a prefix under the least count is no node of interest and goes; one whose suffixes pass
the memory budget is extended by a word. What is left is dealt into groups that fit the
budget, and each group's subtree is built by itself in one task: its suffixes are sorted,
equal ones are leaves, and a node's count is the total of its leaves.

Words are 64-bit hashes of language and word inside the tree; the words themselves come
back by a join with the vocabulary. Two of V words share a hash with a chance of V^2/2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import _LOWER, blocks, cut_lineage, fold_hash, mixed, spans_of, text_or_empty

#: Suffixes of a group, and suffix prefixes of a counting bucket, of about 30 bytes each.
BUDGET = 1 << 18
#: Sums that reach the driver for the grouping, at most.
SLOTS = 1 << 20
#: Parts of a language that are ranked by themselves before they meet.
PARTS = 16
#: Bits of a filter that travels to the tasks: 2^LEAST_BITS to 2^MOST_BITS (1 to 16 MB).
LEAST_BITS, MOST_BITS = 23, 27

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _CUT.copy()
_APART[[9, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words of a block in order: hash of language and word, number of the piece, place in ``buf``."""

    code: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buf: np.ndarray
    lang: np.ndarray


def words_of(texts: list[str], langs: list[str]) -> Words:
    """A-Z lowered, pieces cut at ``[.,;:!?\\x0A-\\x0D]``, words at spaces and tabs."""
    raw = [t.encode() for t in texts]
    buf = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    start, end = spans_of(~_APART[buf])
    piece = np.cumsum(_CUT[buf], dtype=np.int64)[start] if len(start) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]
    names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
    lang = np.array([names[x] for x in langs], np.int64)[np.searchsorted(first, start, side="right") - 1] if len(start) else np.zeros(0, np.int64)
    salts = np.array([fold_hash(np.frombuffer(x.encode() + b"\x00", np.uint8), np.array([0]), np.array([len(x.encode()) + 1]))[0] for x in names], np.uint64)
    code = mixed(fold_hash(buf, start, end) * _STEP + salts[lang]) if len(start) else np.zeros(0, np.uint64)
    return Words(np.where(code == 0, np.uint64(1), code), piece, start, end, buf, lang)


def paths(code: np.ndarray, piece: np.ndarray, depth: int) -> np.ndarray:
    """(words, depth) codes from every word on; zeros beyond the end of its piece."""
    out = np.zeros((len(code), depth), np.uint64)
    for k in range(min(depth, len(code))):
        n = len(code) - k
        out[:n, k] = np.where(piece[:n] == piece[k:], code[k:], np.uint64(0))
    return out


def prefix_hash(path: np.ndarray, n: int) -> np.ndarray:
    """Hash of the first ``n`` words of every path."""
    h = np.zeros(len(path), np.uint64)
    for k in range(n):
        h = mixed(h * _STEP + path[:, k] + np.uint64(k + 1))
    return h


class Filter(NamedTuple):
    """A set of hashes as bits: it holds all that were put in, and by chance some others."""

    shift: int
    bits: bytes

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(self.shift)
        held = np.frombuffer(self.bits, np.uint64)
        return (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def filter_of(hashes: DataFrame, n: int) -> Filter:
    """Filter of column ``h``; its size follows from ``n``, the number of hashes, and is bounded."""
    size = min(MOST_BITS, max(LEAST_BITS, int(8 * n).bit_length()))
    at = F.shiftrightunsigned("h", 64 - size)
    rows = hashes.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - size}) & 63 as int))")).alias("bits"))
    held = np.zeros(1 << (size - 6), np.int64)
    found = rows.toPandas()  # 2^(MOST_BITS - 6) rows at most
    held[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return Filter(64 - size, held.tobytes())


# ---- level one: words


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, langs = [text_or_empty(t) for t in batch["text"]], [text_or_empty(x) for x in batch["lang"]]
        for a, b in blocks(texts, 2 << 20):
            w = words_of(texts[a:b], langs[a:b])
            code, first, count = np.unique(w.code, return_index=True, return_counts=True)
            if not len(code):
                continue
            names = list(dict.fromkeys(langs[a:b]))
            whole = w.buf.tobytes()
            yield pd.DataFrame({
                "lang": [names[i] for i in w.lang[first]], "h": code.view(np.int64),
                "word": [whole[i:j].decode() for i, j in zip(w.start[first], w.end[first])], "n": count,
            })


# ---- further levels: prefixes counted in buckets of hashes


def _prefix_counts(words: Filter, hot: list[np.ndarray], level: int, buckets: int):
    """Counts of the prefixes of ``level`` words in a block, packed by bucket of their hash.

    ``hot`` holds the sorted hashes of the prefixes of two, three.. words that were extended.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, langs = [text_or_empty(t) for t in batch["text"]], [text_or_empty(x) for x in batch["lang"]]
            for a, b in blocks(texts, 2 << 20):
                w = words_of(texts[a:b], langs[a:b])
                path = paths(np.where(words.holds(w.code), w.code, np.uint64(0)), w.piece, level)
                path = path[(path[:, :2] != 0).all(axis=1)]
                for k, known in enumerate(hot):
                    path = path[_among(prefix_hash(path, k + 2), known)]
                h, n = np.unique(prefix_hash(path, level), return_counts=True)
                if len(h):
                    yield _packed(h, (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), keys=h, counts=n.astype(np.int64))

    return run


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


def _packed(h: np.ndarray, bucket: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """One row per bucket of a block: columns ordered by bucket, cut and stored as bytes."""
    at = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    ends = np.append(at[1:], len(bucket))
    return pd.DataFrame({"bucket": bucket[at].astype(np.int64), **{k: [v[i:j].tobytes() for i, j in zip(at, ends)] for k, v in columns.items()}})


def _joined(frame: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(frame[name]), kind)


def _summed(least: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _joined(frame, "keys", np.uint64), _joined(frame, "counts", np.int64)
        h, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(h), np.int64)
        np.add.at(total, at, counts)
        keep = total >= least
        return pd.DataFrame({"h": h[keep].view(np.int64), "n": total[keep]})

    return run


# ---- groups and their subtrees


def _routed(words: Filter, pairs: Filter, hot: list[np.ndarray], bounds: np.ndarray, depth: int):
    """Suffixes of a block by group, equal ones once with their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, langs = [text_or_empty(t) for t in batch["text"]], [text_or_empty(x) for x in batch["lang"]]
            for a, b in blocks(texts, 2 << 20):
                w = words_of(texts[a:b], langs[a:b])
                path = paths(np.where(words.holds(w.code), w.code, np.uint64(0)), w.piece, depth)
                two = (path[:, :2] != 0).all(axis=1)
                h = np.zeros(len(path), np.uint64)
                h[two] = prefix_hash(path[two], 2)
                able = two & pairs.holds(h)
                at = np.flatnonzero(able)
                path, h = path[at], h[at]
                for k in range(2, depth):  # nothing follows a word that is no word of the tree, nor a pair under the least count
                    path[path[:, k - 1] == 0, k] = 0
                    later = at + k - 1
                    going = np.zeros(len(at), bool)
                    inside = later < len(able)
                    going[inside] = able[later[inside]]
                    path[~going, k] = 0
                for k, known in enumerate(hot):
                    more = _among(h, known)
                    h[more] = prefix_hash(path[more], k + 3)
                group = np.searchsorted(bounds, h, side="right")
                order = np.lexsort([*(path[:, k] for k in reversed(range(depth))), group])
                path, group = path[order], group[order]
                new = np.ones(len(path), bool)
                new[1:] = (path[1:] != path[:-1]).any(axis=1) | (group[1:] != group[:-1])
                heads = np.flatnonzero(new)
                if len(heads):
                    yield _packed(h, group[heads], paths=path[heads], counts=np.diff(np.append(heads, len(path))).astype(np.int64))

    return run


def _subtree(depth: int, least: int, hot: list[np.ndarray]):
    """Nodes of two and more words of a group's subtree, with the totals of their leaves.

    The leaves of an extended prefix lie in several groups; its own node is returned from
    each, whatever its total there, and the totals are summed afterwards.
    """

    def totals(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        path, counts = _joined(frame, "paths", np.uint64).reshape(-1, depth), _joined(frame, "counts", np.int64)
        order = np.lexsort([path[:, k] for k in reversed(range(depth))])
        path, counts = path[order], counts[order]
        out = []
        for d in range(2, depth + 1):
            new = np.ones(len(path), bool)
            new[1:] = (path[1:, :d] != path[:-1, :d]).any(axis=1)
            heads = np.flatnonzero(new)
            total = np.add.reduceat(counts, heads)
            keep = path[heads, d - 1] != 0
            out.append((path[heads][keep], np.full(int(keep.sum()), d), total[keep]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, d, total = totals(frame)
        keep = total >= least
        for k, known in enumerate(hot):
            own = np.flatnonzero(d == k + 2)
            keep[own] |= _among(prefix_hash(nodes[own], k + 2), known)
        nodes = np.where(np.arange(depth)[None, :] < d[:, None], nodes, np.uint64(0)).view(np.int64)
        return pd.DataFrame({"d": d[keep], "path": list(nodes[keep]), "a": total[keep]})

    return build


def _vertical(docs: DataFrame, words: Filter, n: int, least: int, depth: int, budget: int) -> tuple[DataFrame, list[np.ndarray], int]:
    """(h, n) of all pair prefixes that reach the least count, further levels of those over the budget, and the extended ones."""
    hot: list[np.ndarray] = []
    pairs = ends = None
    for level in range(2, depth + 1):
        buckets = max(64, -(-n // (4 * budget)))
        found = docs.mapInPandas(_prefix_counts(words, hot, level, buckets), "bucket bigint, keys binary, counts binary")
        counted = cut_lineage(found.groupBy("bucket").applyInPandas(_summed(least if level == 2 else 1), "h bigint, n bigint"), f"prefixes-{level}")
        if level == 2:
            pairs = counted
        over = counted.where((F.col("n") > budget) & F.lit(level < depth))
        ends = counted.where(F.col("n") <= budget) if ends is None else ends.unionByName(counted.where((F.col("n") <= budget) | F.lit(level == depth)))
        more = np.sort(over.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))  # fewer than words / budget
        if not len(more):
            break
        hot.append(more)
    return pairs, ends, hot


def _bounds(ends: DataFrame, n: int, budget: int) -> np.ndarray:
    """First hashes of the groups but the first: consecutive prefixes, by hash, of about ``budget`` suffixes."""
    bits = min(SLOTS.bit_length() - 1, max(10, (8 * n // budget).bit_length()))
    slots = ends.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("slot")).agg(F.sum("n").alias("n")).toPandas().sort_values("slot")  # SLOTS rows at most
    bounds, size = [], 0
    for slot, rows in zip(slots["slot"].tolist(), slots["n"].tolist()):
        if size and size + rows > budget:
            bounds.append(slot << (64 - bits))
            size = 0
        size += rows
    return np.array(bounds, np.uint64)


def nodes_of(docs: DataFrame, vocabulary: DataFrame, least: int, depth: int, budget: int = BUDGET) -> DataFrame:
    """(d, path, a): all phrases of two to ``depth`` words with at least ``least`` occurrences.

    ``docs`` has text and lang without nulls, ``vocabulary`` the hash and count (h, n) of
    the words that reach the least count.
    """
    n_words, n = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    budget = max(budget, n >> 20)  # so that groups and extended prefixes stay fewer than 2^20
    words = filter_of(vocabulary.select("h"), n_words)
    pairs, ends, hot = _vertical(docs, words, n, least, depth, budget)
    pair_filter = filter_of(pairs.select("h"), pairs.count())
    bounds = _bounds(ends, n, budget)
    rows = docs.mapInPandas(_routed(words, pair_filter, hot, bounds, depth), "bucket bigint, paths binary, counts binary")
    found = rows.groupBy("bucket").applyInPandas(_subtree(depth, least, hot), "d int, path array<bigint>, a bigint")
    if hot:
        found = found.groupBy("d", "path").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return cut_lineage(found, "phrase-nodes")


# ---- scores


def _cuts(depth: int) -> list[tuple[int, Column, Column]]:
    """For every k: the first k words of a phrase and the rest, as paths."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), depth)
    out = []
    for k in range(1, depth):
        first = F.slice(F.concat(F.slice("path", 1, k), zero), 1, depth)
        rest = F.slice(F.concat(F.slice("path", k + 1, depth), zero), 1, depth)
        out.append((k, first, rest))
    return out


def vocabulary_of(docs: DataFrame) -> DataFrame:
    """(lang, word, h, n): every word of every language with its occurrences."""
    counted = docs.mapInPandas(_word_counts, "lang string, h bigint, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 30, depth: int = 4, contained: int = 80, top: int = 2000, scale: int = 2_000_000, budget: int = BUDGET) -> DataFrame:
    """The first ``top`` phrases of every language.

    Texts (null: empty) become pieces and words per ``lang`` (null: ``und``, one language
    with rows that say so). Candidates are phrases of 2 to ``depth`` words with at least
    ``least`` occurrences a. A cut after k words, with l and r occurrences of its sides,
    scores floor(scale * a / (l + r)); the lowest-scoring cut counts, of equal ones the
    first. A candidate goes if a longer one holds its words in a row with
    100 * a(longer) >= contained * a. Order: score and a descending, phrase in byte order,
    ranks from 1 without gaps. Repeated rows count each time. A language without
    candidates has no row. Scores are computed in decimals, so no product overflows.
    Returns lang, rank, phrase, a, l, r, n (all words of the language) and score.
    """
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    every = cut_lineage(vocabulary_of(own), "vocabulary")
    sizes = every.groupBy("lang").agg(F.sum("n").alias("n"))  # one row per language
    vocabulary = every.where(F.col("n") >= least)
    nodes = nodes_of(own, vocabulary, least, depth, budget)
    zeros = F.array_repeat(F.lit(0).cast("bigint"), depth - 1)
    counts = nodes.select("path", "a").unionByName(vocabulary.select(F.concat(F.array("h"), zeros).alias("path"), F.col("n").alias("a")))
    cut = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest")) for k, first, rest in _cuts(depth)]), lambda x: x.k < F.col("d"))
    cuts = nodes.select("path", "d", "a", F.explode(cut).alias("c")).select("path", "d", "a", "c.*")
    sides = cuts.join(counts.toDF("first", "l"), "first").join(counts.toDF("rest", "r"), "rest")
    score = F.expr(f"cast(cast({scale} as decimal(12,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    scored = sides.withColumn("score", score).groupBy("path", "d", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # every shorter phrase inside a longer candidate, with the greatest count of those that hold it
    inner = F.flatten(F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i in range(depth - m + 1)]) for m in range(2, depth)])) if depth > 2 else None
    if inner is not None:
        inside = nodes.where("d > 2").select("path", "d", "a", F.explode(inner).alias("x")).where("x.m < d AND x.i + x.m <= d")
        padded = F.concat(F.slice("path", F.col("x.i") + 1, F.col("x.m")), F.array_repeat(F.lit(0).cast("bigint"), depth))
        held = inside.select(F.slice(padded, 1, depth).alias("path"), "a").groupBy("path").agg(F.max("a").alias("longer"))
        whole = "decimal(22,0)"
        scored = scored.join(held, "path", "left").where(F.col("longer").isNull() | (F.lit(100).cast("int") * F.col("longer").cast(whole) < F.lit(contained) * F.col("a").cast(whole)))
    left = cut_lineage(scored.select("path", "d", "a", "best.*"), "phrase-scores")
    spelled = left.select("path", F.posexplode(F.slice(F.col("path"), F.lit(1), F.col("d"))).alias("i", "h")).join(vocabulary.select("h", "lang", "word"), "h")
    phrases = spelled.groupBy("path").agg(F.first("lang").alias("lang"), F.array_join(F.array_sort(F.collect_list(F.struct("i", "word"))).getField("word"), " ").alias("phrase"))
    named = left.join(phrases, "path")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a first round in parts, so that no task holds a whole language
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    some = named.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(PARTS))).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    first = some.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    return first.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
