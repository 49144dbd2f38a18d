"""Hard negatives by segment summaries.

A vector is cut into segments; each keeps its mean and its deviation (the length of what
is left when the mean is taken off). The inner product of two vectors lies within the sum
of their segments' mean products plus or minus the products of the deviations
(Cauchy-Schwarz). Coarse segments are compared first, finer ones where those leave a row
in question, components only where these do too. Rows and anchors meet in cells of
bounded size: a stated set of anchors against all rows, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import cut_lineage

#: Components per segment, coarse to fine; each divides the one before.
SEGMENTS = (16, 4)
#: A cell holds about a share of 1/PARTS of the rows, within these bounds, and at most MOST anchors.
PARTS, LEAST, MOST = 64, 2048, 32768
#: Anchors scored at once.
BLOCK = 256

PREPARED = "vec_id bigint, label bigint, vec binary, means binary, devs binary"


def valid(vector: str, label: str, vec_id: str = "vec_id") -> Column:
    """True for rows that take part: id, label and vector present, no null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True))


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all segments, coarse ones first; the row is as long as a multiple of the coarsest."""
    means, devs = [], []
    for size in SEGMENTS:
        cut = x.astype(np.float64).reshape(-1, size)
        m = cut.mean(axis=1)
        means.append(m)
        devs.append(np.sqrt(((cut - m[:, None]) ** 2).sum(axis=1)))
    return np.concatenate(means), np.concatenate(devs)


def _prepared(batches):
    for batch in batches:
        out = []
        for vec_id, label, comps in zip(batch["vec_id"], batch["label"], batch["comps"]):
            n = -(-max(len(comps), 1) // SEGMENTS[0]) * SEGMENTS[0]
            x = np.zeros(n, np.int32)
            x[: len(comps)] = comps
            means, devs = summaries(x)
            out.append((vec_id, label, x.tobytes(), means.tobytes(), devs.tobytes()))
        yield pd.DataFrame(out, columns=["vec_id", "label", "vec", "means", "devs"])


def prepared(rows: DataFrame) -> DataFrame:
    """Packs rows (vec_id, label, comps: whole numbers) with their segments' means and deviations."""
    size = F.greatest(F.size("comps"), F.lit(1))
    # a score of two vectors within this bound fits 62 bits
    fits = F.forall("comps", lambda x: F.abs(x) <= F.least(F.lit(float((1 << 31) - 1)), F.floor(F.sqrt(F.lit(float(1 << 62)) / size))))
    whole = F.transform("comps", lambda x: x.cast("int")).alias("comps")
    return rows.where(fits).select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), whole).mapInPandas(_prepared, PREPARED)


class _Side:
    """Packed rows of a cell as matrices, ordered by id; shorter vectors are followed by zeros."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("vec_id", kind="stable")
        self.frame, self.ids, self.labels = frame, frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64)
        raw = [np.frombuffer(v, np.int32) for v in frame["vec"]]
        self.width = max((len(x) for x in raw), default=0)
        self.raw, self.sums = raw, [(np.frombuffer(m), np.frombuffer(d)) for m, d in zip(frame["means"], frame["devs"])]

    def widened(self, width: int) -> None:
        n = len(self.raw)
        self.x = np.zeros((n, width), np.int64)
        self.means = [np.zeros((n, width // s)) for s in SEGMENTS]
        self.devs = [np.zeros((n, width // s)) for s in SEGMENTS]
        for i, (x, (m, d)) in enumerate(zip(self.raw, self.sums)):
            self.x[i, : len(x)] = x
            at = 0
            for k, s in enumerate(SEGMENTS):
                own = len(x) // s
                self.means[k][i, :own], self.devs[k][i, :own] = m[at : at + own], d[at : at + own]
                at += own
        self.f = self.x.astype(np.float64)
        self.top = int(np.abs(self.x).max(initial=0))


def _sides(rows: pd.DataFrame, anchors: pd.DataFrame) -> tuple[_Side, _Side]:
    r, a = _Side(rows), _Side(anchors)
    width = max(r.width, a.width)
    r.widened(width)
    a.widened(width)
    return r, a


def bounds(a: _Side, r: _Side, i, j, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of anchors i with rows j by the segments of a level, with room for rounding."""
    mid = SEGMENTS[level] * (a.means[level][i] @ r.means[level][j].T)
    off = a.devs[level][i] @ r.devs[level][j].T
    off += 1e-9 * (np.abs(mid) + off) + 1e-6
    return mid - off, mid + off


def scores(a: _Side, r: _Side, i, j) -> np.ndarray:
    """Exact scores: in floating point where all sums are whole numbers below 2^53, else in integers."""
    if a.top * r.top * a.x.shape[1] < 1 << 53:
        return (a.f[i] @ r.f[j].T).astype(np.int64)
    return a.x[i] @ r.x[j].T


def _greatest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest value of every row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full((len(values), 1), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1 : k]


def _firsts(score: np.ndarray, able: np.ndarray, k: int):
    """(anchor places, column places) of the k greatest able scores of every row; of ties the first column."""
    left = np.where(able, score.astype(np.float64), -np.inf) if np.abs(score).max(initial=0) < 1 << 53 else np.where(able, score.astype(object), -np.inf)
    every = np.arange(len(score))
    for _ in range(min(k, score.shape[1])):
        best = left.argmax(axis=1)
        found = left[every, best] != -np.inf
        yield every[found], best[found]
        left[every, best] = -np.inf


def _positives(k: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            r, a = _sides(rows, anchors)
            for label in np.unique(a.labels):
                own, cols = np.flatnonzero(a.labels == label), np.flatnonzero(r.labels == label)
                for at in range(0, len(own), BLOCK):
                    i, j = own[at : at + BLOCK], cols
                    for level in range(len(SEGMENTS)):
                        low, high = bounds(a, r, i, j, level)
                        self_ = a.ids[i][:, None] == r.ids[j]
                        low[self_], high[self_] = -np.inf, -np.inf
                        # the k-th greatest lower bound: a row that cannot reach it is not among the first k
                        j = j[((high >= _greatest(low, k)) & ~self_).any(axis=0)]
                    if len(j):
                        s = scores(a, r, i, j)
                        for x, y in _firsts(s, a.ids[i][:, None] != r.ids[j], k):
                            out.append(pd.DataFrame({"anchor_id": a.ids[i][x], "positive_id": r.ids[j][y], "positive_score": s[x, y]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype="int64")

    return run


def _negatives(k: int, low_share: int, high_share: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            r, a = _sides(rows, anchors)
            ids, points = list(a.frame["positive_ids"]), list(a.frame["positive_scores"])
            slots = max(map(len, ids))
            lo, hi = np.ones((len(ids), slots), object), np.zeros((len(ids), slots), object)  # a missing positive admits nothing
            for x, p in enumerate(points):
                lo[x, : len(p)] = [-(-low_share * int(v) // 100) for v in p]
                hi[x, : len(p)] = [high_share * int(v) // 100 for v in p]
            lo, hi = lo.astype(np.int64), hi.astype(np.int64)
            open_ = lo <= hi  # nothing lies between the bounds of a negative score
            for at in range(0, len(ids), BLOCK):
                i, j = np.arange(at, min(at + BLOCK, len(ids))), np.arange(len(r.ids))
                i = i[open_[i].any(axis=1)]
                least = np.where(open_[i], lo[i], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)[:, None]
                most = np.where(open_[i], hi[i], np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)[:, None]
                for level in range(len(SEGMENTS)):
                    if not len(i) or not len(j):
                        break
                    low, high = bounds(a, r, i, j, level)
                    j = j[((high >= least) & (low <= most) & (a.labels[i][:, None] != r.labels[j])).any(axis=0)]
                if not len(i) or not len(j):
                    continue
                s = scores(a, r, i, j)
                other = a.labels[i][:, None] != r.labels[j]
                for slot in range(slots):
                    able = other & (s >= lo[i, slot][:, None]) & (s <= hi[i, slot][:, None])
                    for x, y in _firsts(s, able, k):
                        out.append(pd.DataFrame({
                            "anchor_id": a.ids[i][x], "positive_id": [ids[z][slot] for z in i[x]], "negative_id": r.ids[j][y],
                            "positive_score": [points[z][slot] for z in i[x]], "negative_score": s[x, y],
                        }))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")}, dtype="int64")

    return run


def _met(rows: DataFrame, anchors: DataFrame, parts: tuple[int, int], build, schema: str) -> DataFrame:
    """Every row next to every anchor, in cells: rows of one part, anchors of one part."""
    p, q = parts
    dealt = rows.withColumn("_p", F.pmod(F.xxhash64("vec_id"), F.lit(p)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    asked = anchors.withColumn("_q", F.pmod(F.xxhash64("vec_id"), F.lit(q)).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    return dealt.groupBy("_p", "_q").cogroup(asked.groupBy("_p", "_q")).applyInPandas(build, schema)


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    ``rows`` has vec_id, label and comps (whole numbers as long, decimal or double);
    ``is_anchor`` is a condition over vec_id and label. Scores are exact inner products,
    missing components count as zero; an empty vector scores zero. Higher scores come
    first, ties by smaller vec_id. Positives are the first rows of the anchor's label,
    negatives the first of other labels with low*p <= 100*n <= high*p. An id stands for
    one row: of several, the one with the least label, then vector, counts, so repeated
    rows change nothing. Rows with a null and rows whose scores could pass 62 bits take
    no part; an anchor without positives or negatives has no rows. Returns anchor_id,
    positive_id, rank, negative_id, positive_score and negative_score.
    """
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("comps").isNotNull())
    one = known.groupBy("vec_id").agg(F.min(F.struct("label", "comps")).alias("row")).select("vec_id", "row.*")
    table = cut_lineage(prepared(one), "segment-summaries")
    asked = table.where(is_anchor)
    n, m = table.count(), asked.count()
    parts = max(1, -(-n // min(MOST, max(LEAST, n // PARTS)))), max(1, -(-m // MOST))
    found = _met(table, asked, parts, _positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("_n", F.row_number().over(by_anchor)).where(F.col("_n") <= positives)
    lists = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("_n", "positive_id", "positive_score"))).alias("x"))
    lists = lists.select(F.col("anchor_id").alias("vec_id"), F.col("x.positive_id").alias("positive_ids"), F.col("x.positive_score").alias("positive_scores"))
    known_anchors = cut_lineage(asked.join(lists, "vec_id"), "anchors")
    schema = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    near = _met(table, known_anchors, parts, _negatives(negatives, low, high), schema)
    by_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
