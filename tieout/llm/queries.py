"""Registered queries of the corpus operators, next to oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import bpe, chat, decontaminate, grading, language, licenses, minhash, negatives, packing, phrases, sharding, simhash, substring
from tieout.llm.common import cut_lineage, documents, new_path, table_of

SHARDS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by the law ``key``: a document's virtual slot follows from its id, the slot's shard from the map.

    Version 0 of the stored map serves 16 shards, version 1 one more. ``balanced_shard``
    is what the map's next edit, which evens out the bytes per slot, would give.
    """
    rows = cut_lineage(sharding.sized(documents(spark, sf_dir)), "sized")
    path = new_path(spark, "slot-map")
    first = sharding.SlotMap.first(SHARDS)
    for version in (first, first.grown()):
        sharding.store_map(spark, version, path)
    now, grown = sharding.load_map(spark, path, 0), sharding.load_map(spark, path, 1)
    even = now.rebalanced(sharding.slot_bytes(rows))
    out = sharding.assigned(sharding.assigned(sharding.assigned(rows, now, "shard"), grown, "grown_shard"), even, "balanced_shard")
    placed = sharding.positions(out, "shard", "slot", "virtual_slot", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard", "virtual_slot", "balanced_shard")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text less the passages that an earlier one keeps."""
    return substring.deduplicated(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and language spans of every document; the model knows none of the held-out fifth."""
    docs = documents(spark, sf_dir)
    found = language.identified(docs, language.fitted(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every document and of its edited text."""
    return minhash.compared(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    return bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents contain."""
    return licenses.scanned(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.marked(documents(spark, sf_dir), table_of(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: A conversation whose texts are control strings of the template.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id bigint, turn bigint, role string, text string")
    rows = table_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digested(chat.conversations_of(chat.threads(rows)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    docs = documents(spark, sf_dir)
    model = grading.fitted(docs, grading.ratings_of(table_of(spark, sf_dir, "labels")))
    return grading.graded(docs, model)


#: Components are 256ths, rounded down; beyond this no score fits anyway.
_FAR = float(1 << 40)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and hard negatives of every fiftieth vector, against all vectors."""
    rows = table_of(spark, sf_dir, "embeddings").where(negatives.valid("embedding", "label"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    comps = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(_FAR)), F.lit(-_FAR))))
    return negatives.mined(rows.select("vec_id", label.alias("label"), comps.alias("comps")), F.col("vec_id") % 50 == 0)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of two to four words of every language."""
    return phrases.collocations(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    return packing.packed(documents(spark, sf_dir), tokenizer_json())


def tokenizer_json() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_substring_dedup, op3_language_id, op4_minhash, op5_byte_bpe, op6_simhash, op7_license_scan, op8_decontamination, op9_chat, op10_quality, op11_hard_negatives, op12_phrases, op13_packing)
}

_WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"


def _license_oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
    cut = "SELECT {key}, i AS p, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT {key}, {words} AS w FROM {table}) t, range(1, len(w) - 3) r(i)"
    return f"""
WITH templates(license, text) AS (VALUES {rows}),
t0 AS ({cut.format(key="license", words=_WORDS_SQL, table="templates")}),
t AS (SELECT license, s, row_number() OVER (PARTITION BY license ORDER BY p) - 1 AS j, count(*) OVER (PARTITION BY license) AS n
      FROM (SELECT license, s, min(p) AS p FROM t0 GROUP BY ALL)),
d AS (SELECT doc_id, p - 1 AS p, s FROM ({cut.format(key="doc_id", words=_WORDS_SQL, table="documents")})),
met AS MATERIALIZED (SELECT d.doc_id, t.license, d.p, t.j, t.n FROM d JOIN t ON d.s = t.s),
aligned AS (SELECT DISTINCT doc_id, license, p - j AS a, n FROM met),
share AS (SELECT g.doc_id, g.license, g.a, count(DISTINCT met.j) / g.n AS containment
          FROM aligned g JOIN met ON met.doc_id = g.doc_id AND met.license = g.license AND met.p >= g.a - ceil(g.n / 4) AND met.p < g.a + g.n + ceil(g.n / 4)
          GROUP BY g.doc_id, g.license, g.a, g.n)
SELECT doc_id, license, max(containment) AS containment, arg_min(a, (-containment, a)) AS first_word, count(*) AS places
FROM share WHERE containment >= {licenses.CONTAINED} GROUP BY doc_id, license"""


_BENCH_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: Words of a phrase, spelled out level by level: the phrase of k words that begins at word i.
_LONGEST = 4


def _phrase_oracle() -> str:
    every = " UNION ALL ".join(f"SELECT lang, {k} AS d, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM pieces, range(1, len(w) - {k - 2}) r(i) WHERE len(w) >= {k}" for k in range(1, _LONGEST + 1))
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts)),
f AS MATERIALIZED (SELECT lang, d, phrase, count(*) AS a FROM ({every}) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE d = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, d, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE d > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.phrase, c.a, c.d, k, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * c.a // (l.a + r.a) AS BIGINT) AS score
         FROM c, range(1, c.d) s(k) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') AND l.d = k
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:c.d], ' ') AND r.d = c.d - k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, d) x(m), range(1, d - m + 2) y(i) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


ORACLES = {
    "op7_license_scan": _license_oracle(),
    "op8_decontamination": f"""
WITH items AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM items, range(1, greatest(len(w) - 9, 1) + 1) r(i) WHERE len(w) > 0),
docs AS MATERIALIZED (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT m FROM win),
hits AS MATERIALIZED (SELECT d.doc_id, d.i, d.m, win.item_id
         FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM docs, lengths, range(1, len(w) - m + 2) r(i)) d
         JOIN win ON win.m = d.m AND win.s = d.s),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT DISTINCT doc_id, i, m FROM hits), range(0, m) r(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(found.ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_chat": f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || role || '<|im_end|>') + 2 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op11_hard_negatives": """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
        FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, s AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5),
negatives AS (SELECT p.*, other AS negative_id, s AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other) AS rank
              FROM positives p JOIN met USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3""",
    "op12_phrases": _phrase_oracle(),
}
