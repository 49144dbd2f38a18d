"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text and cuts where its top bits are zero, so a
cut depends on the bytes just before it alone: text inserted earlier shifts chunks but
does not change them. Windows of consecutive chunks, each just long enough to be a
passage, are deduplicated by digest beside the chunks; what repeated windows cover goes
and its first occurrence stays. Chunks that meet by chance make no repeated window.

The rolling hash is computed for all bytes of a block at once: the hash over 2n bytes
is the hash over n bytes plus the one n bytes earlier, shifted by n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import NO_ID, cut_lineage, per_block

#: Bytes that the gear hash sees: the bits of its 16-bit register.
REACH = 16
#: Top bits that must be zero at a cut, least distance of two cuts, longest chunk.
ZERO_BITS, LEAST, MOST = 4, 12, 256
#: Bytes that a run of repeated chunks must have to be removed, and its least number of chunks.
MIN_RUN, MIN_CHUNKS = 120, 2

_GAP = b"\xff" * REACH  # never in UTF-8; weighs nothing


def _gear() -> np.ndarray:
    """One fixed random register value per byte."""
    g = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
    g[0xFF] = 0
    return g


GEAR = _gear()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts_of(buf: np.ndarray) -> np.ndarray:
    """Positions before which the block may be cut, by content alone, on character starts."""
    h = GEAR[buf]
    n = 1
    while n < REACH:
        h[n:] += h[:-n] << np.uint16(n)  # the right side is built before it is added
        n *= 2
    at = np.flatnonzero(h < (1 << (16 - ZERO_BITS))) + 1
    at = at[at < len(buf)]
    at = at[(buf[at] & 0xC0) != 0x80]
    return at[np.diff(at, prepend=-LEAST) >= LEAST]


def chunked(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
    """UTF-8 bytes and chunk bounds of every text of a block (an empty text has one bound, 0)."""
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(_GAP + _GAP.join(raw) + _GAP, np.uint8)
    cuts, at = cuts_of(buf), REACH
    for r in raw:
        end = at + len(r)
        own = cuts[np.searchsorted(cuts, at + 1) : np.searchsorted(cuts, end)] - at
        bounds = np.concatenate([[0], own, [len(r)]]) if r else np.zeros(1, np.int64)
        if len(r) and (wide := np.diff(bounds) > MOST).any():
            bounds = _split(np.frombuffer(r, np.uint8), bounds, wide)
        yield r, bounds
        at = end + REACH


def _split(b: np.ndarray, bounds: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Cuts chunks over MOST bytes at its multiples, moved on to the next character start."""
    more = [np.arange(bounds[i] + MOST, bounds[i + 1], MOST) for i in np.flatnonzero(wide)]
    at = np.concatenate(more)
    for _ in range(3):
        at = at + ((b[np.minimum(at, len(b) - 1)] & 0xC0) == 0x80)
    return np.unique(np.concatenate([bounds, at[at < len(b)]]))


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and end (one past the last chunk) of the shortest windows from every chunk and up to every chunk.

    A window has MIN_RUN bytes and MIN_CHUNKS chunks at least. Together these windows
    cover every run of that size whole, wherever it begins and ends.
    """
    n = len(bounds) - 1
    i, e = np.arange(n), np.arange(1, n + 1)
    end = np.maximum(np.searchsorted(bounds, bounds[:-1] + MIN_RUN), i + MIN_CHUNKS)
    start = np.minimum(np.searchsorted(bounds, bounds[1:] - MIN_RUN, side="right") - 1, e - MIN_CHUNKS)
    both = np.concatenate([i[end <= n] * (n + 1) + end[end <= n], start[start >= 0] * (n + 1) + e[start >= 0]])
    return np.divmod(np.unique(both), n + 1)


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    found = [xxhash.xxh64_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
    return np.frombuffer(b"".join(found), ">i8").astype(np.int64)


def digests(raw: bytes, bounds: np.ndarray) -> np.ndarray:
    """Even digest of every chunk. A window needs its chunks too, so that no single collision removes text."""
    return _digests(raw, bounds[:-1], bounds[1:]) & -2


def window_digests(raw: bytes, bounds: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Odd digest of every window."""
    return _digests(raw, bounds[first], bounds[end]) | 1


def _occurrences(rows: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
    found = []
    for raw, bounds in chunked(texts):
        found.append(np.unique(np.concatenate([digests(raw, bounds), window_digests(raw, bounds, *windows_of(bounds))])))
    ids = np.repeat(rows["_id"].to_numpy(), [len(f) for f in found])
    return pd.DataFrame({"digest": np.concatenate(found), "_id": ids})


def _again(d: np.ndarray, known: np.ndarray) -> np.ndarray:
    """True where the text itself or an earlier document had it before."""
    _, first = np.unique(d, return_index=True)
    again = np.ones(len(d), bool)
    again[first] = False
    return again | np.isin(d, known)


def repeated_runs(raw: bytes, bounds: np.ndarray, known: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Byte spans to remove and the number of repeated chunks.

    ``known``: digests that an earlier document has. A chunk or window also repeats if the
    text itself had it before. Spans are what repeated windows cover, drawn in to whole words.
    """
    again = _again(digests(raw, bounds), known)
    i, j = windows_of(bounds)
    so_far = np.concatenate([[0], np.cumsum(again)])
    met = _again(window_digests(raw, bounds, i, j), known) & (so_far[j] - so_far[i] == j - i)
    depth = np.zeros(len(bounds), np.int64)
    np.add.at(depth, i[met], 1)
    np.add.at(depth, j[met], -1)
    edges = np.flatnonzero(np.diff((np.cumsum(depth) > 0).view(np.int8), prepend=np.int8(0)))
    spans = []
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        a, b = int(bounds[first]), int(bounds[last])
        space = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8)[a:b]])
        if a and not _SPACE[raw[a - 1]] and len(space):
            a, space = a + int(space[0]) + 1, space - int(space[0]) - 1
        if b < len(raw) and not _SPACE[raw[b]] and len(space) and space[-1] >= 0:
            b = a + int(space[-1]) + 1
        if a < b:
            spans.append((a, b))
    return spans, int(again.sum())


OUT = "text string, n_bytes bigint, n_chunks bigint, n_repeated bigint, removed_bytes bigint, removed array<struct<start:int,end:int>>, first_doc_ids array<bigint>"


def _removed(carried: list[str]):
    def build(rows: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
        out = []
        for (raw, bounds), known, first, was in zip(chunked(texts), rows["known"], rows["firsts"], rows["text"]):
            known = np.sort(np.asarray(known, np.int64)) if known is not None else np.zeros(0, np.int64)
            spans, again = repeated_runs(raw, bounds, known) if len(bounds) > 1 else ([], 0)
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            text = b"".join([*kept, raw[at:]]).decode() if isinstance(was, str) else None
            sources = sorted(set(first) - {NO_ID}) if spans and first is not None else []
            out.append((text, len(raw), len(bounds) - 1, again, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], sources))
        new = pd.DataFrame(out, columns=["text", "n_bytes", "n_chunks", "n_repeated", "removed_bytes", "removed", "first_doc_ids"])
        return pd.concat([rows[carried].reset_index(drop=True), new], axis=1)

    return per_block(build)


def deduplicated(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document, its text without passages that an earlier document (by doc_id) or itself already had.

    A passage is MIN_RUN bytes of consecutive chunks that stood there in the same order.
    Texts within one doc_id count as one document. Null texts stay null; a missing
    doc_id counts as the last one. ``removed`` holds byte spans of the old text,
    ``first_doc_ids`` the documents that keep what repeats in a text that was cut.
    ``carry``: further columns of ``docs`` to return.
    """
    base = docs.select(*carry, F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "text")
    seen = base.where(F.length("text") > 0).select("_id", "text").mapInPandas(per_block(_occurrences), "digest bigint, _id bigint")
    shared = cut_lineage(seen.groupBy("digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "_first"), "repeated-chunks")
    later = seen.join(shared, "digest").where(F.col("_id") > F.col("_first"))
    known = later.groupBy("_id").agg(F.collect_list("digest").alias("known"), F.collect_set(F.when(F.col("digest").bitwiseAND(F.lit(1)) == 1, F.col("_first"))).alias("firsts"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return base.join(known, "_id", "left").select(*carry, "text", "known", "firsts").mapInPandas(_removed(list(carry)), f"{types}, {OUT}")
