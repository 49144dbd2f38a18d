"""Hard negatives: segment bounds, and the whole operator against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tieout.llm import negatives

ROWS = "vec_id bigint, label int, comps array<bigint>, score double, rank int"


def plain(rows, is_anchor, positives=5, keep=3, low=50, high=95):
    """All pairs, in whole numbers of any size. One row stands for an id: the least label, then vector."""
    known = {}
    for i, label, v, *_ in rows:
        if None not in (i, label, v):
            known[i] = min(known.get(i, (label, v)), (label, v))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in known.items():
        if not is_anchor(a):
            continue
        met = sorted((-dot(v, w), i, other == label) for i, (other, w) in known.items() if i != a)
        for s, p, _ in [m for m in met if m[2]][:positives]:
            able = [(t, n) for t, n, same in met if not same and 50 * -s <= 100 * -t <= 95 * -s] if (low, high) == (50, 95) else []
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(able[:keep], 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0.5, 7) for r in rows], ROWS)
    return sorted(map(tuple, negatives.mined(df, F.col("vec_id") % 5 == 0, **kw).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed, monkeypatch):
    """Small whole numbers, so that ties abound; several cells of rows."""
    monkeypatch.setattr(negatives, "LEAST", 40)
    monkeypatch.setattr(negatives, "PARTS", 3)
    monkeypatch.setattr(negatives, "MOST", 50)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(0, 4)), r.integers(-3, 4, 20).tolist()) for i in range(300)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(40)]  # copies of one vector
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_hard_rows(spark):
    rows = [(0, 1, [4, 0, 3]), (0, 1, [4, 0, 3]), (0, 2, [9]), (1, 1, [4, 0, 3, 5]), (2, 2, [3]), (3, None, [1]), (None, 1, [1]), (4, 1, None), (5, 2, []), (6, 3, [2, 0, 1]), (7, 1, [1]), (8, 2, [1, 1, 1])]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)
    assert mined(spark, []) == []


def test_great_numbers(spark):
    """Sums beyond 2^53 are exact; components whose scores could pass 62 bits take no part."""
    big = 1 << 29
    rows = [(0, 1, [big, 1]), (1, 1, [big + 1, 1]), (2, 1, [big, 7]), (3, 2, [big - 50_000_000, 3]), (4, 2, [big - 50_000_000, 4])]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)
    assert mined(spark, [*rows, (9, 2, [1 << 40, 0])]) == plain(rows, lambda i: i % 5 == 0)


def test_bounds_hold():
    r = np.random.default_rng(5)
    frame = lambda n: pd.DataFrame(next(negatives._prepared([pd.DataFrame({"vec_id": range(n), "label": 1, "comps": [r.integers(-200, 200, r.integers(1, 70)) for _ in range(n)]})])))
    x, a = negatives._sides(frame(60), frame(50))
    exact = negatives.scores(a, x, np.arange(50), np.arange(60))
    before = np.inf
    for level in range(len(negatives.SEGMENTS)):
        low, high = negatives.bounds(a, x, np.arange(50), np.arange(60), level)
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).mean() < before  # finer segments say more
        before = (high - low).mean()


def test_valid_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0]), (2, 1, [nan]), (3, 1, [-inf, 1.0]), (4, 1, [None]), (5, None, [1.0]), (None, 1, [1.0]), (7, 1, None), (8, 1, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    assert {r.vec_id for r in df.where(negatives.valid("embedding", "label")).collect()} == {1, 8}
