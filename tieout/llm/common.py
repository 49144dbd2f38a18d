"""Helpers the corpus operators share: documents in, blocks of text as arrays, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.sources.sinks import cut_lineage, new_path

__all__ = ["NO_ID", "blocks", "cut_lineage", "documents", "fit_share", "fold_hash", "mixed", "new_path", "spans_of", "table_of", "text_or_empty", "word_hashes"]

#: Characters of text that one numpy block holds; a longer document is a block of its own.
BLOCK_CHARS = 1 << 20

#: Stands for a missing doc_id where rows must be joined or ordered: after every real one.
NO_ID = (1 << 63) - 1

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "documents")


def text_or_empty(text: str | None) -> str:
    """Arrow hands nulls over as None or NaN, depending on the column."""
    return text if isinstance(text, str) else ""


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters; every text is in exactly one."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def per_block(build: Callable[[pd.DataFrame, list[str]], pd.DataFrame], text: str = "text"):
    """A mapInPandas function that hands ``build`` blocks of rows and their texts (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [text_or_empty(t) for t in batch[text]]
            for a, b in blocks(texts):
                yield build(batch.iloc[a:b], texts[a:b])

    return run


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over a 64-bit value."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and the inverse powers, modulo 2^64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, BLOCK_CHARS + (BLOCK_CHARS >> 1))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def fold_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for every span, from one running sum over the block.

    Spans with equal symbols have equal hashes wherever they stand.
    """
    up, down = _powers(len(symbols))
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * down[: len(symbols)], out=total[1:], dtype=np.uint64)
    return mixed((total[ends] - total[starts]) * up[ends])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text (A-Z lowered, cut at ASCII white space) and, per text, its first word's place.

    The second array has one entry more than there are texts.
    """
    raw = [t.encode() for t in texts]
    buf = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    starts, ends = spans_of(~ASCII_SPACE[buf])
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return fold_hash(buf, starts, ends), np.searchsorted(starts, at)


def fit_share(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` of the rows at random by a hash of ``key``, all of them where there are fewer.

    The share follows from one count, so that what a model is fitted on stays bounded
    at any size of the input.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / n))
