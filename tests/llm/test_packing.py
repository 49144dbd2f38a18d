"""Packing: the encoder against the tokenizer, genomes against plain packing, whole results."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tieout.llm import packing, queries
from tieout.llm.common import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, length string, _row string, lot int"
TEXTS = [
    None, "", " ", "  \n ", "one", "a  b   c\n\n d", " lead", "trail  ", "it's they're  'll x", "漢字 カナ \U0001f600 é", "x\x00 \x1c y  z   w", "tab\t tab \t tab", "<|endoftext|> and <|endoftext|>",
    "word " * 5000, "nospace" * 3000, "1234567890 " * 40, "　 x 　", "a\r\n b \x85 c",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_is_the_tokenizer(tokenizer, spark):
    texts = [t or "" for t in TEXTS] + [r.text or "" for r in documents(spark, SF).collect()]
    r = np.random.default_rng(3)
    texts += ["".join(r.choice(list("ab1.' \n\t é漢\x1c"), r.integers(0, 40))) for _ in range(2000)]
    latin = [chr(c) for c in range(0x260)]
    texts += [x for c in latin for x in (f"a{c}1", f" {c}", f"{c}{c}.", f"1{c} x", f"'{c}s{c}\n", f"  {c} {c}  ")]
    encoder = packing.Encoder(queries.tokenizer_json())
    for _ in range(2):  # again from memory
        assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_tokenizer_of_another_kind_is_left_to_itself():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        encoder = packing.Encoder(f.read())
    assert not encoder.known_kind


def test_a_full_memory_keeps_what_was_met_again(tokenizer, monkeypatch):
    """Words met again stay when the memory is full, once-only ones go; too many of the former, and all go."""
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    encoder = packing.Encoder(queries.tokenizer_json())
    for k in range(12):
        texts = ["x often, again 漢字!", "x often, again 漢字!"] if k < 2 else [f"x new{k} " + " ".join(f"once{k}q{i}, r{i}" for i in range(8))]
        assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        if k in (2, 3):
            assert " often," in encoder.known and " 漢字!" in encoder.known
    assert " often," not in encoder.known and len(encoder.known) < 80
    for _ in range(3):
        encoder.encode([" ".join(f"many{i}" for i in range(30))])
    assert [x.tolist() for x in encoder.encode(["x often, many3", ""])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ("x often, many3", "")]


def test_best_fit_takes_the_fullest_bin():
    r = np.random.default_rng(4)
    for _ in range(20):
        sizes, room = r.integers(1, 60, 50), {b: int(f) for b, f in enumerate(r.integers(0, 101, 6))}
        got = packing.best_fit(sizes, np.arange(50), np.full(50, -1, np.int32), room, 100)
        free = dict(room)
        for i, size in enumerate(sizes.tolist()):
            fits = [f for f in free.values() if f >= size]
            was = free.setdefault(int(got[i]), 100)
            assert was == min(fits, default=100) and was >= size
            free[int(got[i])] = was - size


def hold(rows, texts, tokenizer, capacity=1024):
    """Every document is there once, in order and whole; no sequence is too long or has gaps."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array(ids_of(tokenizer, text), "<u4")
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.length for r in own] == ([len(ids) % capacity] if len(ids) % capacity else []) + [capacity] * (len(ids) // capacity)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_the_query_is_whole_and_near_the_least(spark, tokenizer):
    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    rows = queries.op13_packing(spark, SF).collect()
    n = hold(rows, texts, tokenizer)
    assert n <= 1.01 * packing.least_bins(np.array([r.length for r in rows]), 1024) + 1


def test_hard_rows(spark, tokenizer):
    texts = dict(enumerate(TEXTS)) | {100 + i: "one two three " * 70 for i in range(60)}
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts.items()], SCHEMA)
    hold(packing.packed(df, queries.tokenizer_json(), lot=16).collect(), texts, tokenizer)
    repeated = spark.createDataFrame([(None, "same text", "x", "y", 1)] * 50 + [(7, "same text", "x", "y", 1)] * 50, SCHEMA)
    rows = packing.packed(repeated, queries.tokenizer_json(), lot=20, keep_ids=True).collect()
    assert len(rows) == 100 and {tuple(r.ids) for r in rows} == {tuple(ids_of(tokenizer, "same text"))}
    assert packing.packed(df.limit(0), queries.tokenizer_json()).collect() == []


def least_by_trial(sizes, capacity):
    """The least number of bins, by trying all ways."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_genomes_against_all_packings():
    r = np.random.default_rng(11)
    worse = 0
    for k in range(40):
        sizes = np.sort(r.integers(10, 70, 10))[::-1].copy()
        best = least_by_trial(sizes.tolist(), 100)
        assert packing.least_bins(sizes, 100) <= best
        got = packing.evolved(sizes, [], k, 100, 6, 60)
        for g in got:
            assert np.bincount(g, weights=sizes).max() <= 100 and (g >= 0).all()
        worse += packing.worth(sizes, got[0], 100)[0] - best
    assert worse <= 2  # two of forty end one bin over the least


def test_crossover_keeps_every_piece_and_finds_better_packings():
    """Triples that fill bins exactly: best fit alone misses them, the islands come nearer."""
    r = np.random.default_rng(2)
    a, b = r.integers(250, 500, 120), r.integers(200, 260, 120)
    sizes = np.sort(np.concatenate([a, b, 1000 - a - b]))[::-1].copy()
    first = packing.started(sizes, r, True, 1000)
    before, _ = packing.worth(sizes, first, 1000)
    genomes = [first, *(packing.started(sizes, r, False, 1000) for _ in range(3))]
    for x, y in itertools.permutations(genomes, 2):
        child = packing.crossed(sizes, x, y, r, 1000)
        fill = np.bincount(child, weights=sizes)
        assert len(child) == len(sizes) and (child >= 0).all() and fill.max() <= 1000 and fill.min() > 0
    found = packing.evolved(sizes, genomes, 1, 1000, 4, 150)
    assert packing.worth(sizes, found[0], 1000) < (before, packing.worth(sizes, first, 1000)[1])
