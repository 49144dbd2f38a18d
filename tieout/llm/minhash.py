"""Document fingerprints by MinHash.

Texts become hashed five-word shingles; each of PERMS universal hash functions
(multiply, add, take the high half) keeps its minimum over them. Signatures are
computed for blocks of documents, one permutation at a time over all shingles of the
block. Near documents share a band of their signature; bands are joined in Spark and
the Jaccard similarity of the shingle sets decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import NO_ID, blocks, cut_lineage, mixed, text_or_empty, word_hashes
from tieout.llm.components import components

SHINGLE, PERMS, BANDS, SIMILAR = 5, 128, 32, 0.8
#: Low bits of a minimum that are compared before a pair is made; sixteen minima make a long.
BITS = 4
_EMPTY = np.uint32(0xFFFFFFFF)


def _constants(perms: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240501).integers(0, 1 << 64, (2, perms), dtype=np.uint64)
    return r[0] | np.uint64(1), r[1]


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of every text, and where each text's begin (one more at the end).

    Words are cut at ASCII white space, A-Z lowered. A text of fewer words is one
    shingle, one without words has none.
    """
    h, first = word_hashes(texts)
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    size = np.repeat(np.minimum(n, SHINGLE), count)
    s = np.zeros(len(start), np.uint64)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        s = s * np.uint64(0x9E3779B97F4A7C15) + np.where(k < size, padded[start + k], np.uint64(k + 1))
    return (mixed(s) >> np.uint64(32)).astype(np.uint32), at


def signatures(hashes: np.ndarray, at: np.ndarray, perms: int = PERMS) -> np.ndarray:
    """(texts, perms) minima; a text without shingles has the greatest value everywhere."""
    out = np.full((len(at) - 1, perms), _EMPTY, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    a, b = _constants(perms)
    x, heads = hashes.astype(np.uint64), at[:-1][some]
    y = np.empty_like(x)
    for k in range(perms):
        np.multiply(x, a[k], out=y)
        y += b[k]
        y >>= np.uint64(32)
        out[some, k] = np.minimum.reduceat(y, heads)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima: the estimate of the Jaccard similarity."""
    return (a == b).mean(axis=-1)


def text_signatures(texts: list[str], perms: int = PERMS) -> np.ndarray:
    parts = [signatures(*shingle_hashes(texts[i:j]), perms) for i, j in blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, perms), np.uint32)


def hexed(sig: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.ascontiguousarray(sig, ">u4")]


# ---- a document next to its edited text and its successor


def _splits(docs: DataFrame, parts: int) -> list[int]:
    """Ids that cut the table into about ``parts`` equal ranges: a summary of bounded size."""
    at = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", at, 10_000)).first()[0] if at else []
    return sorted(set(found or []))


def with_successor(docs: DataFrame, parts: int) -> DataFrame:
    """Rows by ranges of doc_id, each range closed by a copy of the row that follows it.

    Adds _range and _closing (true for the copy). The first row follows the last. Every
    text moves once; only the first row of each range moves twice.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    cuts = np.array(_splits(rows, parts), np.int64)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)  # rows without id stand before all others
        out[known] = np.searchsorted(cuts, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    ranged = rows.withColumn("_range", number("doc_id"))
    first = ranged.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "_tie")).alias("m")).collect()  # one row per range
    order = sorted(first)
    closes = [(order[i - 1]._range, i == 0, r.m.has, r.m.doc_id, r.m._tie, r._range) for i, r in enumerate(order)]
    heads = docs.sparkSession.createDataFrame(closes, "_to int, _last boolean, _has boolean, _id bigint, _tie_of bigint, _from int")
    same = (F.col("_range") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_tie_of"))
    marked = ranged.join(F.broadcast(heads.select("_to", "_id", "_tie_of", "_from")), same, "left")  # at most ``parts`` rows
    targets = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_closing")))).otherwise(
        F.array(F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_closing")), F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_closing")))
    )
    return marked.select("doc_id", "text", "_tie", F.inline(targets))


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many code points from the front of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(perms: int):
    def build(ids: list, texts: list[str], sig: np.ndarray) -> pd.DataFrame:
        """All rows but the last, which is the successor of the one before."""
        news = [edited(t, n) for t, n in zip(texts, texts[1:])]
        esig = text_signatures(news, perms)
        return pd.DataFrame({
            "doc_id": pd.array(ids[:-1], "Int64"), "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in news],
            "fingerprint": hexed(sig[:-1]), "edited_fingerprint": hexed(esig), "near_edited": likeness(sig[:-1], esig), "near_next": likeness(sig[:-1], sig[1:]),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # id, text and signature of the last row seen, while its successor is not known
        for batch in batches:
            ids, texts, closing = batch["doc_id"].astype("Int64").tolist(), [text_or_empty(t) for t in batch["text"]], batch["_closing"].to_numpy()
            for i, j in blocks(texts):
                at = i
                sig = text_signatures(texts[i:j], perms)
                # a closing row ends its range: nothing follows from it to the next row
                for stop in [*(np.flatnonzero(closing[i:j]) + i + 1), j]:
                    if stop == at:
                        continue
                    own_ids, own_texts, own_sig = ids[at:stop], texts[at:stop], sig[at - i : stop - i]
                    if held:
                        own_ids, own_texts, own_sig = [held[0], *own_ids], [held[1], *own_texts], np.concatenate([held[2], own_sig])
                    if len(own_ids) > 1:
                        yield build(own_ids, own_texts, own_sig)
                    held = None if closing[stop - 1] else (own_ids[-1], own_texts[-1], own_sig[-1:])
                    at = stop

    return run


def compared(docs: DataFrame, parts: int | None = None, perms: int = PERMS) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and how alike it is to that and to the next document's.

    Documents follow each other by doc_id, rows of one id by a hash of their text, rows
    without id first; the last is followed by the first. Null texts are empty; two empty
    texts are fully alike. Ranges of doc_id are ordered on their own.
    """
    parts = parts or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_successor(docs, parts)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(tasks, "_range").sortWithinPartitions("_range", "_closing", "doc_id", "_tie")
    return placed.select("doc_id", "text", "_closing").mapInPandas(_compared(perms), COMPARED)


# ---- near-duplicate classes: bands joined, Jaccard verified


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest and size of the shingle set, one hash per band of its signature and the low BITS bits of every minimum."""
    fold = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(PERMS // BANDS)], np.uint64)
    for batch in batches:
        texts = [text_or_empty(t) for t in batch["text"]]
        for i, j in blocks(texts):
            h, at = shingle_hashes(texts[i:j])
            sig = signatures(h, at)
            bands = mixed(sig.reshape(j - i, BANDS, -1).astype(np.uint64).dot(fold))
            low = (sig & np.uint32(15)).astype(np.uint64).reshape(j - i, -1, 16)
            low = np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)
            sets = [np.unique(h[a:b]) for a, b in zip(at, at[1:])]
            yield pd.DataFrame({
                "_id": batch["_id"].iloc[i:j].to_numpy(), "doc_id": batch["doc_id"].iloc[i:j].astype("Int64").to_numpy(), "key": batch["key"].iloc[i:j].to_numpy(),
                "content": [hashlib.sha256(x.tobytes()).digest()[:16] for x in sets], "size": [len(x) for x in sets], "low": list(low), "bands": list(bands.view(np.int64)),
            }).astype({"doc_id": "Int64"})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [text_or_empty(t) for t in batch["text"]]
        for i, j in blocks(texts):
            h, at = shingle_hashes(texts[i:j])
            yield pd.DataFrame({"node": batch["node"].iloc[i:j].to_numpy(), "shingles": [np.unique(h[a:b]).view(np.int32) for a, b in zip(at, at[1:])]})


def _alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have that Jaccard similarity."""
    met = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return met.where((union == 0) | (both >= similar * union)).select("a", "b")


def _may_be_alike(a: str, b: str, similar: float) -> Column:
    """False where the sizes of two sets rule the similarity out, or the low bits of their minima do.

    Of two sets that similar, each of PERMS minima differs with a chance of 1 - similar at
    most; six standard deviations more are let through (of such pairs one in 10^9 is not).
    """
    p = (1 - similar) * (1 - 0.5**BITS)
    most = int(PERMS * p + 6 * (PERMS * p * (1 - p)) ** 0.5)
    mask = F.lit(0x1111111111111111)

    def unequal(k: int) -> Column:
        x = F.col(f"{a}.low")[k].bitwiseXOR(F.col(f"{b}.low")[k])
        return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3)).bitwiseAND(mask))

    apart = reduce(Column.__add__, [unequal(k) for k in range(PERMS // 16)])
    size = F.least(f"{a}.size", f"{b}.size") >= similar * F.greatest(f"{a}.size", f"{b}.size")
    return size & (apart <= most)


def _shared(points: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, shared): how many of a point's shingles any other of these points has."""
    every = cut_lineage(sets.join(points.distinct(), "node").select("node", F.explode("shingles").alias("s")), "minhash-shingles")
    common = every.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s")
    return every.join(common, "s").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("shared"))


def text_key() -> Column:
    """Tells the texts of one doc_id apart; a null text has a key of its own."""
    return F.coalesce(F.md5("text"), F.lit(""))


def _classes(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, doc_id, key, content) and the part that each content belongs to.

    Texts with one shingle set are one point. Points of one band value are candidates. In
    each such bucket all points first meet its head, the one that shares most buckets with
    others: the text that a group was copied from, where it is there. The parts so linked
    are found, and points that are not alike to their head meet those points of the bucket
    that belong to another part. What is left out are pairs whose ends are linked already,
    so classes are those of all pairs. Three tests, none of which loses a pair beyond the
    stated chance, keep texts that only share passages from becoming pairs: sizes, low bits
    of the minima, and the number of shingles that any other candidate has at all, which
    bounds what two sets can have in common. A pair is made in its first common band only.
    Pairs count if the Jaccard similarity of their shingle sets is at least ``similar``.
    Null texts are empty, and alike.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "doc_id", text_key().alias("key"), "text")
    types = "_id bigint, doc_id bigint, key string, content binary, size int, low array<bigint>, bands array<bigint>"
    rows = cut_lineage(base.mapInPandas(_signed, types), "minhash")
    first = F.min(F.struct("_id", "key")).alias("first")
    points = cut_lineage(rows.groupBy("content").agg(first, *[F.first(c).alias(c) for c in ("size", "low", "bands")]).withColumn("node", F.xxhash64("content")), "minhash-points")
    at = ["band", "value"]
    banded = points.select("node", F.posexplode("bands").alias(*at))
    full = banded.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(banded.join(full, at), "minhash-buckets")
    wanted = cut_lineage(met.groupBy("node").agg(F.sum("n").alias("weight")).join(points.select("node", "first", "size", "low", F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands")), "node"), "minhash-wanted")
    weighed = met.select("node", *at).join(wanted.select("node", "weight", F.struct("node", "size", "low").alias("x")), "node")
    heads = weighed.groupBy(*at).agg(F.max_by("x", F.struct("weight", "node")).alias("head"))
    members = cut_lineage(weighed.select(*at, "x").join(heads, at).where("x.node != head.node"), "minhash-members")
    texts = base.join(wanted.select("first._id", "first.key", "node"), ["_id", "key"]).select("text", "node")
    sets = cut_lineage(texts.mapInPandas(_sets, "node bigint, shingles array<int>").dropDuplicates(["node"]), "minhash-sets")
    stars = members.where(_may_be_alike("head", "x", similar)).select(F.col("head.node").alias("a"), F.col("x.node").alias("b")).distinct()
    linked = cut_lineage(_alike(stars, sets, similar), "minhash-links")
    parts = components(linked)
    on = (F.col("head.node") == F.col("a")) & (F.col("x.node") == F.col("b"))
    apart = cut_lineage(members.join(linked, on, "left_anti").select(*at, F.col("x.node").alias("node")), "minhash-apart")
    # the buckets that hold such a point, but for their heads, which all have met
    open_ = cut_lineage(members.select(*at, F.col("x.node").alias("node")).join(apart.select(*at).distinct(), at, "left_semi"), "minhash-open")
    known = wanted.join(_shared(open_.select("node").unionByName(apart.select("node")), sets), "node").join(parts, "node", "left")
    known = cut_lineage(known.select("node", "size", "low", "bands", "shared", F.coalesce("part", "node").alias("part")), "minhash-known")
    point = F.struct("node", "size", "low", "bands", "shared", "part")
    left = apart.join(known, "node").select(*at, point.alias("y"))
    right = open_.join(known, "node").select(*at, point.alias("x"))
    most = F.least("l.y.shared", "r.x.shared")
    bound = most >= similar * (F.col("l.y.size") + F.col("r.x.size") - most)
    before = F.zip_with(F.slice("l.y.bands", F.lit(1), F.col("l.band")), F.slice("r.x.bands", F.lit(1), F.col("l.band")), lambda p, q: p == q)
    meets = (F.col("l.y.part") != F.col("r.x.part")) & bound & _may_be_alike("l.y", "r.x", similar) & ~F.exists(before, lambda b: b)
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.band") == F.col("r.band")) & (F.col("l.value") == F.col("r.value")) & meets)
    rest = pairs.select(F.least("y.node", "x.node").alias("a"), F.greatest("y.node", "x.node").alias("b")).distinct()
    links = linked.unionByName(_alike(rest, sets, similar))
    named = points.select("node", "content", "first").join(components(links), "node", "left").withColumn("part", F.coalesce("part", "node"))
    return rows, cut_lineage(named.select("content", "first", "part"), "minhash-parts")


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id): near-duplicate classes, named by their least doc_id."""
    rows, parts = _classes(docs, similar)
    ids = parts.groupBy("part").agg(F.min(F.nullif(F.col("first._id"), F.lit(NO_ID))).alias("class_id"))
    classes = cut_lineage(parts.join(ids, "part").select("content", "class_id"), "minhash-classes")
    return rows.select("doc_id", "content").join(classes, "content").select("doc_id", "class_id")


def row_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(_id, key, part): doc_id (NO_ID where missing), text key and near-duplicate class of every row."""
    rows, parts = _classes(docs, similar)
    return rows.join(parts.select("content", "part"), "content").select("_id", "key", "part")
