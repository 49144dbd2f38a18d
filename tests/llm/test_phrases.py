"""Collocations: the suffix tree's counts and the whole operator against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tieout.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, d int, path string, a bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, depth=4, contained=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        c = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in c.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(a, inside.get(p[i : i + m], 0))
        rows_ = []
        for p, a in c.items():
            if 100 * inside.get(p, 0) >= contained * a and p in inside:
                continue
            score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, x, 1, "p", 2) for i, (t, x) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


def sample(seed, n=150):
    r = np.random.default_rng(seed)
    words = ["A", "b", "the", "é", "漢字", "x\x00y", "n't", " q"] + [f"w{i}" for i in range(12)]
    weights = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(n):
        text = "".join(words[k] + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!? "]) for k in r.choice(len(words), r.integers(0, 60), p=weights / weights.sum()))
        out.append((text, [None, "und", "en", "de"][r.integers(0, 4)]))
    return out


HARD = [(None, "en"), ("", None), (" \t ", "en"), ("...", ""), ("one", "fr"), ("a" * 30_000, "en"), ("New York " * 40, "en"), ("new york. " * 40, "en")]


@pytest.mark.parametrize("seed, least, budget", [(1, 30, 1 << 17), (2, 8, 200), (3, 8, 60), (4, 5, 25)])
def test_plain_counting(spark, seed, least, budget):
    """From one group to prefixes that are extended to three and four words."""
    rows = sample(seed) + HARD * 2
    assert found(spark, rows, least=least, budget=budget) == plain(rows, least)


def test_other_limits(spark):
    rows = sample(9)
    assert found(spark, rows, least=5, depth=3, contained=50, top=4) == plain(rows, 5, 3, 50, 4)
    assert found(spark, rows, least=5, depth=2, top=7) == plain(rows, 5, 2, 80, 7)


def test_one_passage_in_a_third_of_all_rows(spark):
    rows = [("the very same passage stands here again and again", "en")] * 100 + sample(6, 200)
    assert found(spark, rows, budget=50) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "en")]) == []


def test_filter_holds_what_was_put_in(spark):
    h = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    held = phrases.filter_of(spark.createDataFrame([(int(x),) for x in h], "h bigint"), 5000)
    assert held.holds(h.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 5000).view(np.uint64)
    assert held.holds(others).mean() < 0.01
