"""Corpus operators in Spark: hard rows, plain versions of the same rules, and the registered queries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as reg
import corpus_pipeline
from tests.llm.test_units import plain_fingerprint
from tieout.llm import bpe, chat, components, decontaminate, grading, language, licenses, minhash, queries, sharding, simhash, stages, substring
from tieout.llm.common import documents
from tools.check import canon

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FILLER = " ".join(f"word{i}" for i in range(400))

#: Nulls in every column, empty, blank and very long texts, ties, repeated rows, a missing id.
HARD = [
    (1, "the cat sat on the mat and the dog ran off", "en", "a", 42),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "en", "a", 4),
    (5, "one", None, "b", 3),
    (None, "the cat sat on the mat and the dog ran off", "en", "b", 42),
    (None, None, None, None, None),
    (7, FILLER * 30, "en", "c", len(FILLER) * 30),
    (8, "Released under the MIT License.", "en", "c", 31),
    (8, "Released under the MIT License.", "en", "c", 31),
    (9, "漢字とカナ \U0001f600 é ß 12.5", "ja", "d", 20),
    (10, "<|endoftext|> \x00 control", "en", "d", 20),
]


@pytest.fixture(scope="module")
def hard(spark):
    # columns with names that operators also use inside
    return spark.createDataFrame(HARD, SCHEMA).withColumn("_id", F.lit("x")).withColumn("node", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("h", F.lit(3)).withColumn("score", F.lit(0.5))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog ran away from here"), (2, None), (3, ""), (None, "one"), (4, "dog ran")], "item_id bigint, text string")


def every_operator(docs, bench):
    spark = docs.sparkSession
    sized = sharding.sized(docs)
    return {
        "sized": sharding.positions(sharding.assigned(sized, sharding.SlotMap.first(16), "shard"), "shard", "slot", "virtual_slot", ["doc_id", "text_crc32", "size"]),
        "substring": substring.deduplicated(docs),
        "language": language.identified(docs, language.fitted(docs)),
        "minhash": minhash.compared(docs, 3),
        "classes": minhash.near_classes(docs),
        "bpe": bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "simhash": simhash.near_classes(docs),
        "bench": decontaminate.marked(docs, bench),
        "grading": grading.graded(docs, grading.fitted(docs, spark.createDataFrame([(1, 2), (5, 0), (None, 1), (7, None)], "doc_id bigint, grade int"))),
    }


def test_hard_rows_each_have_a_result(hard, bench):
    for name, df in every_operator(hard, bench).items():
        assert df.count() == len(HARD), name
    found = {(r.doc_id, r.license) for r in licenses.scanned(hard).collect()}
    assert found == {(8, "mit")}


def test_empty_tables_give_empty_results(empty, bench, spark):
    for name, df in every_operator(empty, bench).items():
        assert df.count() == 0, name
    assert licenses.scanned(empty).count() == 0
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digested(chat.conversations_of(chat.threads(none))).count() == 0
    assert decontaminate.marked(documents(spark, SF), spark.createDataFrame([], "item_id bigint, text string")).where("contaminated").count() == 0


def test_stages_take_hard_rows(hard, spark):
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, hard, SF).columns == stages.COLUMNS
    assert stages.byte_bpe(spark, hard, SF).count() == len(HARD)
    kept = {r.doc_id for r in stages.near_dedup(spark, hard, SF).collect()}
    assert 1 in kept and None not in kept and 5 in kept


def test_extra_rows_of_one_id_and_shard_law(hard):
    rows = sharding.assigned(sharding.sized(hard), sharding.SlotMap.first(16), "shard").collect()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())


# ---- queries against plain versions


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in documents(spark, SF).select("doc_id", "text", "lang").collect()]


def collected(spark, name):
    return [r.asDict() for r in reg.queries()[name](spark, SF).collect()]


def test_sharding_query(spark, docs):
    rows = collected(spark, "op1_sharding")
    text = {d: t or "" for d, t, _ in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_substring_query_removes_what_an_earlier_document_has(spark):
    passage = " ".join(f"passage{i}" for i in range(60))
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(50))
    rows = [(1, own(1), "en", "a", 0), (2, f"{own(2)} {passage} {own(3)}", "en", "a", 0), (3, f"{own(4)} {passage} {own(5)}", "en", "a", 0), (4, f"{passage}", "en", "a", 0)]
    got = {r.doc_id: r for r in substring.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == rows[1][1]
    for k, left in ((3, [own(4), own(5)]), (4, [])):
        rest = got[k].text
        assert all(x in rest for x in left) and got[k].first_doc_ids == [2]
        assert len(re.findall(r"passage\d+", rest)) <= 12
        raw = rows[k - 1][1].encode()
        cut = b"".join(raw[a.end : b] for a, b in zip([type("x", (), {"end": 0}), *got[k].removed], [s.start for s in got[k].removed] + [len(raw)]))
        assert cut.decode() == rest


def test_substring_keeps_texts_that_do_not_repeat(spark, docs):
    rows = collected(spark, "op2_substring_dedup")
    text = {d: t for d, t, _ in docs}
    assert len(rows) == len(text)
    for r in rows:
        assert r["n_bytes"] == len((text[r["doc_id"]] or "").encode())
        if not r["removed_bytes"]:
            assert r["text"] == text[r["doc_id"]]


def test_language_query_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in documents(spark, sf).select("doc_id", "lang").collect()}
    rows = reg.queries()["op3_language_id"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_spans_of_mixed_text(spark):
    sf = "/root/testdata/sf0.01"
    all_docs = documents(spark, sf)
    model = language.fitted(all_docs)
    longest = {r.lang: r.text for r in all_docs.where("lang in ('en', 'de')").groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    en, de = longest["en"][:600], longest["de"][:300]
    row = language.identified(spark.createDataFrame([(1, f"{en}\n{de}")], "doc_id bigint, text string"), model).first()
    assert row.lang_pred == "en" and "de" in {s.lang for s in row.spans}
    inside = sum(min(s.end, 901) - max(s.start, 601) for s in row.spans if s.lang == "de" and s.end > 601)
    assert inside > 200


def test_minhash_query(spark, docs):
    rows = {r["doc_id"]: r for r in collected(spark, "op4_minhash")}
    order = sorted(docs)
    assert set(rows) == {d for d, _, _ in docs}
    for (d, t, _), (e, n, _) in zip(order, order[1:] + order[:1]):
        t, n, r = t or "", n or "", rows[d]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(minhash.edited(t, n).encode()).hexdigest()
        sig = minhash.text_signatures([t, minhash.edited(t, n), n])
        assert [r["fingerprint"], r["edited_fingerprint"]] == minhash.hexed(sig[:2]) and rows[e]["fingerprint"] == minhash.hexed(sig[2:])[0]
        assert r["near_edited"] == minhash.likeness(sig[0], sig[1]) and r["near_next"] == minhash.likeness(sig[0], sig[2])


def test_minhash_classes_hold_near_copies_only(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:-1] + [f"tail{i}"])) for i in range(40)] + [(100, " ".join(f"z{i}" for i in range(300)))]
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {got[i] for i in range(40)} == {0} and got[100] == 100


def test_bpe_query(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in collected(spark, "op5_byte_bpe")}
    for d, t, _ in docs:
        ids = public.encode_ordinary(t or "")
        assert rows[d]["n_tokens"] == len(ids)
        assert rows[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def plain_components(fps, distance):
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(fps)
    v = np.array([fps[i] for i in ids], np.uint64)
    for i, a in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= distance):
            x, y = root(a), root(ids[i + 1 + j])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_query(spark, docs):
    rows = {r["doc_id"]: r for r in collected(spark, "op6_simhash")}
    fps = {d: plain_fingerprint(t or "") for d, t, _ in docs}
    assert {d: int(r["fingerprint"], 16) for d, r in rows.items()} == fps
    assert {d: r["component_id"] for d, r in rows.items()} == plain_components(fps, 3)


def test_full_cells_are_compared_in_blocks(spark):
    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 1 << 62))
    fps = {i: base ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for i in range(400)}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    points = spark.createDataFrame(rows, "node bigint, fp bigint").dropDuplicates(["fp"])
    kept = {r.node: fps[r.node] for r in points.collect()}
    for block in (8, 1 << 16):
        parts = {r.node: r.part for r in components.components(simhash.linked(spark.createDataFrame([(n, dict(rows)[n]) for n in kept], "node bigint, fp bigint"), block=block)).collect()}
        assert {n: parts.get(n, n) for n in kept} == plain_components(kept, 3), block


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.part for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100}


def test_license_wording_with_edits(spark):
    header = licenses.TEMPLATES["gpl-3.0-notice"]
    rows = [(1, FILLER + " " + header.upper() + " " + FILLER), (2, header.replace("program", "library")), (3, header[: len(header) // 2]), (4, "released under the mit licence"), (5, "x Released, under the MIT\nLicense y")]
    got = {(r.doc_id, r.license): r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {(1, "gpl-3.0-notice"), (2, "gpl-3.0-notice"), (5, "mit")}
    assert got[1, "gpl-3.0-notice"].first_word == 400 and got[2, "gpl-3.0-notice"].containment < 1


def test_license_scan_runs_no_python(spark):
    plan = reg.queries()["op7_license_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- reply trees


def plain_paths(parent):
    nodes = set(parent)
    up = {n: p for n, p in parent.items() if p in nodes and p != n}
    out = set()
    for leaf in nodes - set(up.values()):
        n, d = leaf, 0
        while True:
            out.add((leaf, n, d))
            if n not in up:
                break
            n, d = up[n], d + 1
    return out


def test_paths_of_branching_trees(spark):
    rng = np.random.default_rng(4)
    parent = {f"n{i}": (f"n{int(rng.integers(max(0, i - 4), i))}" if i % 50 else None) for i in range(200)} | {f"c{i}": f"c{i - 1}" if i else None for i in range(70)} | {"lost": "nowhere", "self": "self"}
    got = chat.paths(spark.createDataFrame(list(parent.items()), "node string, parent string"))
    assert {tuple(r) for r in got.collect()} == plain_paths(parent)


def test_branches_are_ranked_and_formatted(spark):
    rows = [("a", None, "t", 1.0, 1, "user", "question"), ("b", "a", "t", 0.2, 1, "assistant", "worse"), ("c", "a", "t", 0.9, 1, "assistant", "better"), ("d", "c", "t", None, 1, "user", "thanks")]
    m = spark.createDataFrame(rows, "node string, parent string, tree string, score double, conv_id bigint, role string, text string")
    got = {r.branch_rank: r for r in chat.conversations_of(m).collect()}
    assert [t for _, t in chat.read_back(got[1].formatted)] == ["question", "better", "thanks"] and [t for _, t in chat.read_back(got[2].formatted)] == ["question", "worse"]
    best = chat.conversations_of(m, best=1).collect()
    assert len(best) == 1 and best[0].formatted == got[1].formatted


def test_conversations_with_hard_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "a"), (1, None, "user", "b"), (None, 3, "assistant", "c"), (1, 5, "assistant", "<|im_end|>"), (1, 5, "assistant", "<|im_end|>")]
    got = {r.conv_id: r for r in chat.digested(chat.conversations_of(chat.threads(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))).collect()}
    assert got[1].n_turns == 5 and got[1].loss_chars == 20 and got[None].n_turns == 1


def test_quality_query_on_unseen_ratings(spark):
    sf = "/root/testdata/sf0.1"
    labels = grading.ratings_of(spark.read.parquet(f"{sf}/labels.parquet"))
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = grading.fitted(documents(spark, sf), labels.where(~unseen))
    rows = grading.graded(documents(spark, sf).join(labels.where(unseen).select("doc_id"), "doc_id"), model).withColumnRenamed("grade", "likeliest").join(labels, "doc_id").collect()
    # Half of the toxic ratings here mark texts without any toxic word, which bounds what text can tell.
    # Measured on unseen ratings when written: 0.89 right (always the top grade: 0.75), 0.96 of clean texts selected, 0.25 of the others.
    right = np.mean([r.likeliest == r.grade for r in rows])
    assert right > 0.85 and right > np.mean([r.grade == 2 for r in rows]) + 0.08
    clean = [r.selected for r in rows if r.grade == 2]
    assert np.mean(clean) > 0.93 and np.mean([r.selected for r in rows if r.grade < 2]) < 0.35


# ---- pipeline


def test_pipeline_against_a_plain_version(spark):
    """Stages one by one, each held against a plain version of its rule on the rows it got."""
    docs = documents(spark, SF)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        after = {r.doc_id: r for r in docs.collect()}
        out[name] = before, after
    before, after = out["language_id"]
    assert set(after) <= set(before) and all(any(c.isalpha() for c in r.text) for r in after.values())
    before, after = out["near_dedup"]
    ids = sorted(before)
    parts = plain_near_parts([before[d].text for d in ids])
    assert set(after) == {ids[p] for p in parts} and all(after[d].text == before[d].text for d in after)
    before, after = out["substring_dedup"]
    assert set(after) <= set(before) and all(r.n_chars == len(r.text) for r in after.values())
    before, after = out["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    padded = [b" " + w + b" " for t in items for w in decontaminate.windows_of(t)]
    for d, r in before.items():
        raw, s, e, _ = decontaminate.words_of([r.text])
        joined = b" " + b" ".join(raw[a:b] for a, b in zip(s, e)) + b" "
        assert (d in after) == (not any(w in joined for w in padded))
    before, after = out["byte_bpe"]
    assert {d: r.decoded for d, r in after.items()} == {d: r.text for d, r in before.items()}
    whole = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())
    assert whole == Counter((d, r.ids_sha256) for d, r in after.items())


def test_items_without_id_and_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, words), (3, "w2 w3")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"a {words} b", 5, "x"), (2, "a b c", 6, "y"), (3, "w2 w3", 7, "z")], "doc_id bigint, text string, n_words int, _spans string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate.marked(docs, bench).collect()}
    assert got == {1: (12, 1, ["3"], True), 2: (0, 0, [], False), 3: (2, 1, ["3"], True)}
    assert [tuple(r) for r in decontaminate.clean(docs, bench).collect()] == [(2, "a b c", 6, "y")]


# ---- oracles


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(reg.oracle_sql()[name])
    df = reg.queries()[name](spark, SF)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())


# ---- near copies by Jaccard


def plain_near_parts(texts):
    """Components over all pairs whose sets of five words have a Jaccard similarity of at least 0.8."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return part


def test_near_dedup_finds_every_near_copy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    parts = plain_near_parts([t for _, t in rows])
    assert {r.doc_id for r in stages.near_dedup(spark, docs, SF).select("doc_id").collect()} == {rows[p][0] for p in parts}


def test_texts_that_share_a_line_do_not_become_pairs(spark):
    line = " ".join(f"line{i}" for i in range(60))
    rows = [(i, f"{line} " + " ".join(f"own{i}x{k}" for k in range(45))) for i in range(120)] + [(500, f"{line} " + " ".join(f"own7x{k}" for k in range(44)))]
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i for i in range(120)} | {500: 7}


def test_a_large_group_of_near_copies(spark):
    """Copies of one text with a few changed words each: most pairs lie below 0.8, all hang on the first text."""
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(150)]

    def copy(k):
        w = list(words)
        for i in r.choice(150, 3, replace=False):
            w[i] = f"new{k}x{i}"
        return " ".join(w)

    texts = [copy(0), " ".join(words), *(copy(k) for k in range(1, 160))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_classes(rows).collect()}
    assert [got[i] for i in range(len(texts))] == plain_near_parts(texts)


def test_near_dedup_decides_row_by_row(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    one, two = text("e"), text("f")
    rows = [(None, text("a"), "en", "s", 0), (None, text("b"), "en", "s", 0), (None, text("b"), "en", "s", 0), (1, text("c"), "en", "s", 0), (None, text("c") + " more", "en", "s", 0),
            (None, text("d"), "en", "s", 0), (None, text("d") + " more", "en", "s", 0), (3, one, "en", "s", 0), (3, two, "en", "s", 0), (3, two, "en", "s", 0), (4, one, "en", "s", 0)]
    kept = Counter((r.doc_id, r.text) for r in stages.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect())
    first = min(text("d"), text("d") + " more", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert kept == Counter([(None, text("a")), (None, text("b")), (1, text("c")), (None, first), (3, one), (3, two)])


def test_near_dedup_follows_simhash_too(spark):
    """A text of one word and one that repeats it beside others: one fingerprint, few five-word shingles in common."""
    often, some = " ".join(["same"] * 400), " ".join(["same"] * 300 + [f"w{i}" for i in range(90)])
    assert bin((simhash.fingerprint(often) ^ simhash.fingerprint(some)) & (2**64 - 1)).count("1") <= 3 and set(plain_near_parts([often, some])) == {0, 1}
    rows = [(1, often, "en", "s", 0), (2, some, "en", "s", 0), (None, some, "en", "s", 0), (3, FILLER, "en", "s", 0), (3, FILLER, "en", "s", 0)]
    kept = [(r.doc_id, r.text) for r in stages.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()]
    assert sorted(kept) == [(1, often), (3, FILLER)]
