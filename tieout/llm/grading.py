"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's words are hashed into weights shared by all grades; ordered thresholds cut the
resulting score into grades: P(grade > k) = sigmoid(score - threshold_k). The expected
grade ranks documents, the tail probability of the top grade selects them.

The model is fitted with numpy on a bounded sample of labelled rows (FIT_ROWS, drawn by a
hash of doc_id); every document is scored on its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import fit_share, per_block, word_hashes

BITS, FIT_ROWS, STEPS, DECAY, SELECT = 16, 6000, 150, 1e-3, 0.5


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words of each text, and per entry its text; the third array counts words.

    A word is there or not, however long the text: one insult counts in a long text as in
    a short one.
    """
    h, first = word_hashes(texts)
    n = np.diff(first)
    row = np.repeat(np.arange(len(texts)), n)
    key = np.unique((row.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    return key & ((1 << BITS) - 1), key >> BITS, n


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, bucket: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        score = np.bincount(row, weights=self.weights[bucket], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def fit(bucket: np.ndarray, row: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """Maximum likelihood with weight decay by Adam; thresholds stay ordered through positive steps between them."""
    n = len(grade)
    w = np.zeros(1 << BITS)
    above = (grade[:, None] > np.arange(grades - 1)).mean(axis=0).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    theta = np.concatenate([start[:1], np.log(np.diff(start).clip(1e-2))])
    m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    for step in range(1, STEPS + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        p = Model(w, cuts).probabilities(bucket, row, n)
        edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        mass = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        up, down = slope[np.arange(n), grade] / mass, slope[np.arange(n), grade + 1] / mass
        by_score = -(up - down) / n
        by_cut = np.zeros(grades + 1)
        np.add.at(by_cut, grade, up / n)
        np.add.at(by_cut, grade + 1, -down / n)
        by_cut = by_cut[1:-1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(bucket, weights=by_score[row], minlength=len(w)) + DECAY * w, tail[:1], tail[1:] * np.exp(theta[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    return Model(w.astype(np.float32), np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def _featured(rows: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
    bucket, row, _ = features(texts)
    return pd.DataFrame({"grade": rows["grade"].to_numpy(), "buckets": np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))})


def fitted(docs: DataFrame, ratings: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Model of ``ratings`` (doc_id, grade from 0 up); None where fewer than two grades are known.

    At most about ``rows`` ratings are drawn, so what is broadcast (ids) and collected
    (buckets of distinct words) is bounded. Ratings without grade, id or document do not count.
    """
    known = ratings.where("doc_id is not null and grade is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    drawn = fit_share(known, "doc_id", rows, 17)
    met = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    found = met.select("grade", "text").mapInPandas(per_block(_featured), "grade int, buckets array<int>").toPandas()
    if found.empty or found["grade"].nunique() < 2:
        return None
    found = found.iloc[found["grade"].argsort(kind="stable")]
    sizes = found["buckets"].map(len)
    return fit(np.concatenate(found["buckets"].to_list()).astype(np.int64), np.repeat(np.arange(len(found)), sizes), found["grade"].to_numpy(np.int64), int(found["grade"].max()) + 1)


OUT = "doc_id bigint, expected_grade double, tail double, grade int, selected boolean"


def graded(docs: DataFrame, model: Model | None, select: float = SELECT) -> DataFrame:
    """Expected grade, tail probability (top grade), likeliest grade and selection of every document.

    Null texts count as empty: the thresholds alone grade them. Without a model nothing
    is known: grades and probabilities are null and every document is selected.
    """

    def build(rows: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
        out = pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64")})
        if model is None:
            return out.assign(expected_grade=np.nan, tail=np.nan, grade=pd.array([None] * len(out), "Int32"), selected=True)
        bucket, row, _ = features(texts)
        p = model.probabilities(bucket, row, len(texts))
        mass = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
        return out.assign(expected_grade=p.sum(axis=1), tail=p[:, -1], grade=mass.argmax(axis=1).astype(np.int32), selected=p[:, -1] >= select)

    return docs.select("doc_id", "text").mapInPandas(per_block(build), OUT)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades 0 to 2 from two ratings: a point for quality, a point for not being toxic; null where either is unknown."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
