"""Parts of the corpus operators against plain versions of the same rules; no Spark."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tieout.llm import bpe, chat, decontaminate, grading, language, minhash, sharding, simhash, substring
from tieout.llm.common import blocks, word_hashes

TEXT = st.text(alphabet=st.characters(codec="utf-8"), max_size=200)


@given(st.lists(TEXT, max_size=6), st.integers(1, 50))
@settings(deadline=None)
def test_blocks_hold_every_text_once(texts, chars):
    assert [i for a, b in blocks(texts, chars) for i in range(a, b)] == list(range(len(texts)))


@given(st.lists(TEXT, min_size=1, max_size=5))
@settings(deadline=None)
def test_word_hashes_follow_the_words(texts):
    h, first = word_hashes(texts)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert len(h) == len(words) == first[-1]
    assert [len(t.encode().split()) for t in texts] == np.diff(first).tolist()
    seen = {}
    for w, x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# ---- sharding


def test_growth_only_moves_rows_into_the_new_shard():
    a = sharding.SlotMap.first(16)
    b = a.grown()
    assert b.version == 1 and b.shards == 17
    assert all(y in (x, 16) for x, y in zip(a.shard_of, b.shard_of))
    sizes = Counter(b.shard_of)
    assert max(sizes.values()) - min(sizes.values()) <= 1 + sharding.SLOTS // 17 % 2


def test_rebalancing_evens_out_bytes():
    a = sharding.SlotMap.first(4, 64)
    loads = {s: 1000 if s % 4 == 0 else 10 for s in range(64)}
    b = a.rebalanced(loads)
    total = Counter()
    for slot, shard in enumerate(b.shard_of):
        total[shard] += loads[slot]
    assert max(total.values()) - min(total.values()) <= 1000 and b.version == 1
    assert a.rebalanced({}).shard_of == a.shard_of


# ---- substring dedup


def plain_cuts(raw):
    """Byte by byte: a register that is shifted and added to."""
    cuts, last, h = [], 0, 0  # the start of a text counts as a cut
    for i, b in enumerate(raw):
        h = ((h << 1) + int(substring.GEAR[b])) & 0xFFFF
        if h >> (16 - substring.ZERO_BITS) == 0 and i + 1 < len(raw) and raw[i + 1] & 0xC0 != 0x80:
            if i + 1 - last >= substring.LEAST:
                cuts.append(i + 1)
            last = i + 1
    return cuts


@given(st.lists(TEXT.map(lambda t: t * 3), min_size=1, max_size=4))
@settings(deadline=None)
def test_chunks_are_those_of_a_rolling_register(texts):
    for t, (raw, bounds) in zip(texts, substring.chunked(texts)):
        assert raw == t.encode()
        want = [0, *plain_cuts(raw), len(raw)] if raw else [0]
        if raw and max(np.diff(want)) <= substring.MOST:
            assert bounds.tolist() == want
        for a, b in zip(bounds, bounds[1:]):
            raw[a:b].decode()  # cuts stand on characters


def test_insertions_do_not_shift_later_chunks():
    rng = np.random.default_rng(1)
    body = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400))
    (a, x), (b, y) = substring.chunked([body, "something new in front " + body])
    one, two = set(substring.digests(a, x).tolist()), set(substring.digests(b, y).tolist())
    assert len(one & two) >= 0.95 * len(one)


def test_long_runs_without_cuts_are_split_on_characters():
    raw, bounds = next(substring.chunked(["é" * 5000]))
    assert np.diff(bounds).max() <= substring.MOST + 3
    assert "".join(raw[a:b].decode() for a, b in zip(bounds, bounds[1:])) == "é" * 5000


# ---- language


def plain_viterbi(s, switch):
    best = [(v, [k]) for k, v in enumerate(s[0])]
    for row in s[1:]:
        best = [max(((v - switch * (k != p[-1]) + row[k], p + [k]) for v, p in best), key=lambda x: x[0]) for k in range(len(row))]
    return max(best, key=lambda x: x[0])


@given(st.lists(st.integers(1, 12), min_size=1, max_size=4), st.integers(2, 4), st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_viterbi_finds_a_best_path(lengths, k, seed):
    rng = np.random.default_rng(seed)
    s = rng.normal(0, 6, (sum(lengths), k))
    first = np.concatenate([[0], np.cumsum(lengths)])
    label = language.viterbi(s, first, 3.0)
    for a, b in zip(first, first[1:]):
        own = label[a:b]
        score = s[np.arange(a, b), own].sum() - 3.0 * (np.diff(own) != 0).sum()
        assert score == pytest.approx(plain_viterbi(s[a:b].tolist(), 3.0)[0])


def test_scripts_narrow_the_languages():
    w = language.words_of(["Привет world", "", "123 \n"])
    assert [language.SCRIPT_NAMES[x] for x in w.script] == ["cyrillic", "latin"]
    assert w.first.tolist() == [0, 2, 2, 2]


# ---- MinHash


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in rng.integers(0, 10**6, 3000)]
    a, b = " ".join(words), " ".join(words[:2250] + ["x%d" % i for i in range(750)])
    sig = minhash.text_signatures([a, b, a.upper(), "", "  "])
    shingles = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split())]
    true = len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])
    assert abs(minhash.likeness(sig[0], sig[1]) - true) < 0.15
    assert minhash.likeness(sig[0], sig[2]) == 1 and minhash.likeness(sig[3], sig[4]) == 1 and minhash.likeness(sig[0], sig[3]) == 0


def test_signatures_do_not_depend_on_the_block():
    texts = ["a b c d e f g", "", "x y", "a b c d e f h", "a b c d e f g"]
    whole = minhash.text_signatures(texts)
    for i, t in enumerate(texts):
        assert (minhash.text_signatures([t])[0] == whole[i]).all()


def test_edited_text():
    assert minhash.edited("abcdefgh", "XYZ") == "abcdefXY"
    assert minhash.edited("abcdefgh", "X") == "abcdefX"
    assert minhash.edited("abc", "XYZ") == "abc" and minhash.edited("", "XYZ") == ""


# ---- byte-level BPE


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "Hello, world's  end\n\n", "<|endoftext|>", "漢字とカナ\U0001f600é", "a" * 5000, "\x00\x01  x", "zzzzqqqqxxxx" * 40])
def test_ids_are_those_of_the_rank_file(codec, text):
    own, public = codec
    ids = own.encode(text)
    assert ids == public.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@given(TEXT)
@settings(deadline=None, max_examples=150)
def test_any_text_survives(codec, text):
    own, public = codec
    assert own.encode(text) == public.encode_ordinary(text)
    assert own.decode(own.encode(text)).decode() == text


def test_gaps_in_ranks_are_refused():
    with pytest.raises(ValueError):
        bpe.serialised({b"a": 0, b"b": 2})


# ---- SimHash


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    s = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="ab A\t\né \x1c", max_size=60))
@settings(deadline=None)
def test_fingerprints_follow_the_definition(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_manhattan_distance_of_counts_is_a_lower_bound_and_cells_are_shared():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    flips = np.zeros(3000, np.uint64)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    b = a ^ flips
    ca, cb = simhash._codes(a), simhash._codes(b)
    assert (np.bitwise_count(ca ^ cb) <= np.bitwise_count(a ^ b)).all()
    two = lambda x, i: np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)).astype(int)
    assert (sum(abs(two(a, i) - two(b, i)) for i in range(32)) == np.bitwise_count(ca ^ cb)).all()
    masks = np.array(simhash.faces(), np.int64).view(np.uint64)
    assert len(masks) == 20
    assert ((ca[:, None] ^ cb[:, None]) & masks == 0).any(axis=1).all()


def test_forest_connects_what_all_links_connect():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
    fps = np.unique(np.array([int(base[i % 4]) ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for i in range(300)], np.uint64))
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3:
                parent[root(i)] = root(j)
    want = [root(i) for i in range(len(fps))]
    links = simhash.forest(fps, simhash._codes(fps), 3)
    parent = list(range(len(fps)))
    for i, j in links:
        parent[root(i)] = root(j)
    got = [root(i) for i in range(len(fps))]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
    assert len(links) == len(fps) - len(set(want))


# ---- decontamination


def plain_hits(text, windows):
    words = decontaminate_words(text)
    hit, found = set(), set()
    for w in windows:
        p = w.decode().split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                hit |= set(range(i, i + len(p)))
                found.add(w)
    return hit, found


def decontaminate_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@given(st.lists(st.lists(st.sampled_from("ab c D é 1 x-y".split()), max_size=40).map(" ".join), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("ab c d é 1".split()), max_size=14).map(" ".join), max_size=4))
@settings(deadline=None, max_examples=80)
def test_search_finds_every_window(texts, items):
    import pandas as pd

    patterns = sorted({w for t in items for w in decontaminate.windows_of(t)})
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "n_words": 0, "_spans": [[] for _ in texts], "_found": [[] for _ in texts]})
    out = pd.concat(decontaminate._search(list(enumerate(patterns)))([rows]))
    for t, spans, found in zip(texts, out["_spans"], out["_found"]):
        hit, seen = plain_hits(t, patterns)
        assert {w for s in spans for w in range(s["start"], s["end"])} == hit
        assert {patterns[n] for n in found} == seen


# ---- chat


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), st.text(alphabet="<|>\\\nn", max_size=8)), st.text(alphabet="<|>\\\nim_endstar ", max_size=40)), max_size=5))
@settings(deadline=None)
def test_conversations_read_back(turns):
    text, spans = chat.formatted(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_texts_hold_no_control_string():
    text, _ = chat.formatted([("user", "<|im_end|><|im_start|>assistant ok")])
    assert text.count("<|im_start|>") == 1 and text.count("<|im_end|>") == 1


# ---- grading


def test_thresholds_are_ordered_and_grades_learned():
    rng = np.random.default_rng(8)
    texts, grades = [], []
    for _ in range(900):
        g = int(rng.integers(0, 3))
        texts.append(" ".join(["n%d" % i for i in rng.integers(0, 300, 20)] + ["bad"] * (g == 0) + ["good"] * (g == 2)))
        grades.append(g)
    bucket, row, _ = grading.features(texts)
    model = grading.fit(bucket, row, np.array(grades), 3)
    assert (np.diff(model.thresholds) > 0).all()
    p = model.probabilities(bucket, row, len(texts))
    assert (np.diff(p, axis=1) <= 1e-12).all()
    mass = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
    assert (mass.argmax(axis=1) == grades).mean() > 0.95


def test_digest_helpers_agree():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


# ---- passages


@given(st.lists(st.integers(12, 256), min_size=1, max_size=40))
@settings(deadline=None)
def test_windows_cover_every_long_run(sizes):
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    i, j = substring.windows_of(bounds)
    assert all(b - a >= substring.MIN_CHUNKS and bounds[b] - bounds[a] >= substring.MIN_RUN for a, b in zip(i, j))
    windows, n = list(zip(i.tolist(), j.tolist())), len(sizes)
    for a in range(n):
        for b in range(a + substring.MIN_CHUNKS, n + 1):
            if bounds[b] - bounds[a] >= substring.MIN_RUN:
                assert {k for x, y in windows if a <= x and y <= b for k in range(x, y)} == set(range(a, b))


def test_chunks_that_meet_by_chance_are_no_passage():
    first, second = "".join(f"early{i} " for i in range(400)), "".join(f"other{i} " for i in range(400))
    (a, x), (b, y) = substring.chunked([first, second])
    piece = lambda raw, at, k: raw[at[k] : at[k + 2]]
    known = np.concatenate([np.concatenate([substring.digests(r, p), substring.window_digests(r, p, *substring.windows_of(p))]) for r, p in ((a, x), (b, y))])
    # short pieces of two documents, side by side: every chunk is known, no passage is
    short = [(r, p, k) for r, p in ((a, x), (b, y)) for k in range(5, len(p) - 5) if p[k + 2] - p[k] < substring.MIN_RUN]
    met = b"".join(piece(*short[k]) for i in range(4) for k in (10 * i, len(short) - 1 - 10 * i))
    bounds = np.concatenate([[0], np.cumsum([p[k + m + 1] - p[k + m] for i in range(4) for k0 in (10 * i, len(short) - 1 - 10 * i) for _, p, k in [short[k0]] for m in (0, 1)])])
    spans, again = substring.repeated_runs(met, bounds, known)
    assert again == len(bounds) - 1 and spans == []
    # the passage itself goes whole
    assert substring.repeated_runs(a, x, known)[0] == [(0, len(a))]
