"""SimHash near-dedup through segment popcounts.

A fingerprint is cut into segments, each mapped to its number of set bits. Changing a
bit changes one count by one, so the Manhattan distance of two count vectors never
exceeds the Hamming distance of the fingerprints: what is far apart in counts need not
be compared. The join is a grid join in the space of counts: axes are dealt into groups,
and vectors within distance d of each other agree exactly on all but d groups, so they
share a cell of the grid on the remaining ones. In a cell, the Manhattan distance is
tested first and the Hamming distance decides.

Counts are held as thermometer codes (a count of c sets the c lowest bits of its
segment): the Manhattan distance is the number of bits in which two codes differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import cut_lineage, text_or_empty
from tieout.llm.components import components

WORDS, SEED, DISTANCE = 3, 42, 3
#: Groups that the 32 two-bit axes are dealt into; a cell fixes GROUPS - DISTANCE of them.
GROUPS = 6
#: Runs of a cell up to this long are compared pair by pair, longer ones by search from point to point.
SHORT = 32
#: Points of a cell that one task holds; the rest of a fuller cell is compared in blocks.
BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    """64 bits; each is 1 if it is set in over half the hashes of the text's shingles."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < WORDS:
        joined: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        joined = map(b" ".join, zip(*[words[i:] for i in range(WORDS)]))
        n = len(words) - WORDS + 1
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, joined, repeat(SEED))), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 8192):
        ones += np.unpackbits(hashes[a : a + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": [fingerprint(text_or_empty(t)) for t in batch["text"]]})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and 64-bit fingerprint (as a signed long) of every whole text; null texts count as empty."""
    return docs.select("doc_id", "text").mapInPandas(_fingerprints, "doc_id bigint, fp bigint")


def row_fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``fingerprints`` of texts that are told apart by ``keys`` instead of a doc_id."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(fp=[fingerprint(text_or_empty(t)) for t in batch["text"]])

    return rows.select(*keys, "text").mapInPandas(run, f"{kinds}, fp bigint")


_LOW = 0x5555555555555555


def thermometer(fp: Column) -> Column:
    """Set bits of each two-bit segment, sorted to its low end."""
    low, shifted = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    any_bit = fp.bitwiseOR(shifted).bitwiseAND(low)
    both = fp.bitwiseAND(shifted).bitwiseAND(low)
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def faces(distance: int = DISTANCE, groups: int = GROUPS) -> list[int]:
    """Bit masks of the axes that a cell fixes: every choice of groups - distance groups."""
    of_group = [sum(3 << (2 * a) for a in range(32) if a * groups // 32 == g) for g in range(groups)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(of_group[g] for g in kept)) for kept in combinations(range(groups), groups - distance)]


def _near(fps: np.ndarray, codes: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    ok = np.bitwise_count(codes[i] ^ codes[j]) <= distance  # Manhattan distance, the lower bound
    ok[ok] = np.bitwise_count(fps[i[ok]] ^ fps[j[ok]]) <= distance
    return ok


def _codes(fps: np.ndarray) -> np.ndarray:
    low = np.uint64(_LOW)
    shifted = fps >> np.uint64(1)
    return ((fps | shifted) & low) | ((fps & shifted & low) << np.uint64(1))


def forest(fps: np.ndarray, codes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all links within ``distance`` connect, at most one per point.

    Every point is compared with those not yet reached, so a dense group costs little
    and no group is written out as pairs.
    """
    rest, out = np.arange(len(fps)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            ok = _near(fps, codes, np.full(len(rest), p), rest, distance)
            found = rest[ok].tolist()
            out += [(p, q) for q in found]
            queue += found
            rest = rest[~ok]
    return out


CELL = ["face", "cell"]
_LINKS = "a bigint, b bigint, face int, cell bigint, fp bigint"


def _runs(keys: list[str], most: int | None, distance: int):
    """mapInPandas over rows sorted by ``keys``: links within each run of equal keys.

    Runs over ``most`` points are handed on unlinked (b is null), row by row.
    """

    def links(run: pd.DataFrame) -> pd.DataFrame:
        fps = run["fp"].to_numpy(np.int64).view(np.uint64)
        node = run["node"].to_numpy()
        codes = _codes(fps)
        key = run[keys].to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]])
        bounds = np.flatnonzero(new)
        size = np.diff(bounds)
        end = np.repeat(bounds[1:], size)
        short = np.repeat(size, size) <= SHORT
        pairs = []
        for gap in range(1, min(SHORT, int(size.max()))):
            i = np.flatnonzero(short[: len(run) - gap] & (end[: len(run) - gap] > np.arange(gap, len(run))))
            i = i[_near(fps, codes, i, i + gap, distance)]
            pairs.append(np.stack([i, i + gap], axis=1))
        for r in np.flatnonzero(size > SHORT):
            a, b = bounds[r], bounds[r + 1]
            if f := forest(fps[a:b], codes[a:b], distance):
                pairs.append(np.array(f) + a)
        p = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": node[p[:, 0]], "b": node[p[:, 1]], "face": 0, "cell": 0, "fp": 0}).astype({"b": "Int64"})

    def passed(run: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": run["node"], "b": pd.array([None] * len(run), "Int64"), "face": run["face"], "cell": run["cell"], "fp": run["fp"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        over = None  # key of the run that is being passed on
        for batch in batches:
            if batch.empty:
                continue
            if over is not None:
                same = (batch[keys] == over).all(axis=1).to_numpy()
                cut = len(batch) if same.all() else int(same.argmin())
                yield passed(batch.iloc[:cut])
                batch = batch.iloc[cut:]
                if batch.empty:
                    continue
                over = None
            held.append(batch)
            joined = pd.concat(held) if len(held) > 1 else batch
            last = (joined[keys] == joined[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(joined) - int(last.sum())
            if cut:
                yield links(joined.iloc[:cut])
            held = [joined.iloc[cut:]]
            if most and len(joined) - cut > most:
                over = joined[keys].iloc[-1]
                yield passed(held.pop())
        if held:
            yield links(pd.concat(held))

    return run


def linked(points: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (node, fp) that connect all within ``distance``."""
    cells = [F.struct(F.lit(i).alias("face"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(faces(distance, groups))]
    grid = points.withColumn("code", thermometer(F.col("fp"))).select("node", "fp", F.inline(F.array(*cells)))
    found = cut_lineage(grid.repartition(*CELL).sortWithinPartitions(*CELL, "fp").mapInPandas(_runs(CELL, block, distance), _LINKS).distinct(), "simhash-links")
    full = found.where("b is null").select("face", "cell", F.col("a").alias("node"), "fp")
    links = found.where("b is not null").select("a", "b")
    if full.isEmpty():
        return links
    # fuller cells: points in blocks, every pair of blocks a group of its own
    n = full.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) * 2 / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    parted = full.join(n, CELL).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parted = parted.select(*CELL, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "fp")
    keys = [*CELL, "p", "q"]
    more = parted.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(_runs(keys, None, distance), _LINKS)
    return links.unionByName(cut_lineage(more.select("a", "b").distinct(), "simhash-links"))


def near_classes(docs: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over fingerprints within ``distance`` bits.

    Null and empty texts have fingerprint zero and link like any other; equal texts
    always share a component. Rows of one doc_id count as one document only where their
    texts agree. A missing doc_id never names a component unless all of it lack one.
    """
    fps = cut_lineage(fingerprints(docs), "simhash")
    # nodes have ids of their own: documents without id must not meet in one node
    points = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    named = cut_lineage(points.join(fingerprint_parts(points, distance, groups, block), "fp"), "simhash-parts")
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = cut_lineage(named.join(least, "part").select("fp", "component_id"), "simhash-classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_parts(points: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(fp, part): the component of every distinct fingerprint of ``points``, named by one of its fingerprints."""
    nodes = points.select(F.col("fp").alias("node"), "fp")
    parts = components(linked(nodes, distance, groups, block))
    return nodes.join(parts, "node", "left").select("fp", F.coalesce("part", "node").alias("part"))
