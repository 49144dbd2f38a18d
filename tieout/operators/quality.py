"""Corpus quality, anonymisation and contract-ledger checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.cleanup import sentences

# Fixed values.
MISSING = ("未提及", "无", "不适用", "不適用")
BOILERPLATE = "(?i)无余额|未发生|nil balance|no balance"
WORDING = (("over-precise amount", r"[0-9]+\.[0-9]{3,}"), ("literal zero", r"(?:CNY|人民币)0(?:\.0+)?(?:[^0-9.]|$)"),
           ("source reference", r"根据备注|in the information provided"), ("leaked placeholder", r"<[A-Z][A-Z_ ]{1,30}>"),
           ("legal name", "有限公司|有限责任公司"), ("assurance phrase", "confirmed by the bank|未见异常"))


def duplicate_lines(texts: DataFrame, key: str) -> DataFrame:
    """Lines that occur more than once in a corpus, with how often, in how many texts, and where first.

    Counted per text before the shuffle on the line's hash, so a line found in a third
    of all texts costs one row per text, and no list of locations is built.
    """
    line = F.explode(F.transform(F.split("text", "\n"), lambda s: F.trim(s)))
    per = texts.select(key, line.alias("line")).where("line <> ''").groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"))
    d = per.groupBy(F.md5("line").alias("line_id")).agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("texts"), F.min(key).alias("first_text"), F.min("line").alias("line"))
    return d.where("occurrences > 1").withColumn("boilerplate", F.rlike("line", F.lit(BOILERPLATE))).drop("line")


def wording_scan(texts: DataFrame) -> DataFrame:
    """Hits and affected texts per wording rule, in one pass over the texts."""
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count("text", F.lit(p)).alias("hits")) for n, p in WORDING])
    twice = F.struct(F.lit("repeated currency").alias("rule"), F.size(F.filter(F.split("text", "[.。]"), lambda s: F.regexp_count(s, F.lit("CNY|人民币")) >= 2)).alias("hits"))
    x = texts.select(F.explode(F.array_append(rules, twice)).alias("r")).select("r.*").where("hits > 0")
    return x.groupBy("rule").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("texts"))


def payment_arithmetic(rows: DataFrame) -> DataFrame:
    """Per contract: rows whose parts add up to the total within 0.02, and how many amounts are filled."""
    parts = F.col("rent") + F.col("mgmt_fee") + F.coalesce("other", F.lit(0))
    filled = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("rent", "mgmt_fee", "other", "total"))
    return rows.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(parts - F.col("total")) <= F.lit("0.02").cast("decimal(4,2)")).alias("consistent"),
        F.sum(filled).alias("filled"))


def ratio_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Columns that hold ratios: at least three non-zero figures, none above one."""
    nz = F.col("value") != 0
    return cells.groupBy(*keys).agg(F.count_if(nz).alias("non_zero"), F.max(F.abs("value")).alias("peak")).withColumn(
        "is_ratio", (F.col("non_zero") >= 3) & (F.col("peak") <= 1))


def verify_sums(lines: DataFrame, keys: list[str], factor: str | None = None) -> DataFrame:
    """Rows above a total re-added, before and after scaling by ``factor``."""
    scale = F.lit(factor or "1").cast("decimal(8,4)")
    is_total = F.contains(F.lower("description"), F.lit("total"))
    a = lines.groupBy(*keys).agg(F.sum(F.when(~is_total, F.col("amount"))).alias("parts"), F.max(F.when(is_total, F.col("amount"))).alias("total"),
                                 F.sum(F.when(~is_total, (F.col("amount") * scale).cast("decimal(24,2)"))).alias("scaled_parts"),
                                 F.max(F.when(is_total, (F.col("amount") * scale).cast("decimal(24,2)"))).alias("scaled_total"), F.count(F.lit(1)).alias("n"))
    return a.select(*keys, F.col("parts").cast("decimal(24,2)").alias("parts"), F.col("total").cast("decimal(24,2)").alias("total"),
                    (F.abs(F.col("parts") - F.col("total")) <= 1).alias("adds_up"),
                    (F.abs(F.col("scaled_parts") - F.col("scaled_total")) <= F.col("n")).alias("linear"))


def name_map(names: DataFrame, name: str = "name") -> DataFrame:
    """Stable pseudonyms from a hash; names whose hashes collide get a number."""
    h = F.upper(F.substring(F.md5(name), 1, 8))
    x = names.select(name).distinct().withColumn("h", h)
    n = F.row_number().over(Window.partitionBy("h").orderBy(name))
    return x.withColumn("k", n).select(name, F.concat(F.lit("Entity-"), "h", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("pseudonym"))


# Money as it is written in notes (fixed value).
MONEY = r"CNY\s*[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
NAME_EDGE = r"[^\p{L}\p{N}]"


def _scaled_money(text: Column, factor: str) -> tuple[Column, Column]:
    """Text with every amount scaled, grouped where it was grouped, and how many there were."""
    found = F.regexp_extract_all(text, F.lit(f"({MONEY})"), F.lit(1))

    def scaled(m):
        n = (F.regexp_replace(m, "[^0-9.]", "").cast("decimal(20,2)") * F.lit(factor).cast("decimal(6,3)")).cast("decimal(24,2)")
        return F.concat(F.lit("CNY"), F.when(F.contains(m, F.lit(",")), F.format_number(n, 2)).otherwise(n.cast("string")))

    pieces = F.arrays_zip(F.split(text, MONEY).alias("p"), F.transform(found, scaled).alias("m"))
    return F.array_join(F.transform(pieces, lambda z: F.concat(z["p"], F.coalesce(z["m"], F.lit("")))), ""), F.size(found)


#: Longs of the bit table that tells words of names; 64 bits each.
SLOTS = 1 << 18


def _words(text: str) -> Column:
    return F.split(F.trim(F.regexp_replace(text, NAME_EDGE + "+", " ")), " ")


def _bit_of(word: str) -> tuple[Column, Column]:
    h = F.xxhash64(word)
    return F.pmod(F.shiftright(h, 6), F.lit(SLOTS)).alias("_slot"), h.bitwiseAND(F.lit(63)).cast("int").alias("_bit")


def name_anchors(mapping: DataFrame) -> DataFrame:
    """name, pseudonym and the word of the name that the fewest names hold."""
    held = mapping.select("name", "pseudonym", F.explode(F.array_distinct(_words("name"))).alias("word"))
    rarity = held.groupBy("word").agg(F.count(F.lit(1)).alias("_names"))
    return held.join(rarity, "word").groupBy("name", "pseudonym").agg(F.min_by("word", F.struct("_names", "word")).alias("word"))


def anonymise(texts: DataFrame, key: list[str], mapping: DataFrame, factor: str, redacted: tuple[str, ...] = ()) -> DataFrame:
    """Names replaced by pseudonyms, money scaled, phrases of ``redacted`` blanked, with hit counts.

    A name is one or more words and stands between characters that are neither letters
    nor digits, so brackets and punctuation do not hide it. Longer names go first: what
    a longer one took, a shorter one inside it cannot. Each name is looked for by its
    rarest word in an equi join, so the table of names may be of any size; words of texts
    that no name is looked for by go before, told by a bit table of bounded size. A text's
    own few hits are then applied in its row.
    """
    anchors = name_anchors(mapping)
    bits = anchors.select(*_bit_of("word")).groupBy("_slot").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))).alias("_mask"))
    x = texts.select(*key, F.explode_outer(F.array(F.array_distinct(_words("text")))).alias("w")).select(*key, F.explode_outer("w").alias("word"))
    x = x.select("*", *_bit_of("word")).join(F.broadcast(bits), "_slot").where(F.getbit("_mask", F.col("_bit")) == 1)
    hits = x.select(*key, "word").join(anchors, "word").groupBy(*key).agg(F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("o"), "name", "pseudonym"))).alias("hits"))
    start = F.struct(F.col("text").alias("text"), F.lit(0).alias("n"))

    def apply(acc, h):
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), h["name"], F.lit(r"\E(?![\p{L}\p{N}])"))
        found = F.struct(F.regexp_replace(acc["text"], pattern, h["pseudonym"]).alias("text"), (acc["n"] + F.regexp_count(acc["text"], pattern)).alias("n"))
        return F.when(F.contains(acc["text"], h["name"]), found).otherwise(acc)

    none = F.array().cast("array<struct<o:int,name:string,pseudonym:string>>")
    done = F.aggregate(F.coalesce("hits", none), start, apply)
    y = texts.join(hits, key, "left").select(*key, F.explode_outer(F.array(done)).alias("d"))
    text = F.col("d.text")
    for phrase in redacted:
        text = F.regexp_replace(text, phrase, "[redacted]")
    y = y.select(*key, F.explode_outer(F.array(text)).alias("text"), F.col("d.n").alias("names"))
    out, amounts = _scaled_money(F.col("text"), factor)
    return y.select(*key, out.alias("text"), "names", amounts.alias("amounts"))


def style_profile(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Lengths, currency prefixes, unit mix and dominant decimals of a corpus."""
    t = F.col("text")
    x = texts.withColumn("n", F.length(t)).withColumn("prefixed", F.regexp_count(t, F.lit("(?:CNY|人民币)\\s*[0-9]"))).withColumn(
        "wan", F.regexp_count(t, F.lit("[0-9]万元"))).withColumn("yi", F.regexp_count(t, F.lit("[0-9]亿元"))).withColumn(
        "one_dp", F.regexp_count(t, F.lit("[0-9]\\.[0-9]万元")))
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("texts"), F.min("n").alias("shortest"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("longest"),
        F.sum("prefixed").alias("prefixed"), F.sum("wan").alias("wan"), F.sum("yi").alias("yi"), F.sum("one_dp").alias("one_decimal"))


def keyword_hits(texts: DataFrame, key: str, words: dict[str, str], most: int = 5) -> DataFrame:
    """First ``most`` lines per text and category that match the category's words."""
    cats = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(p).alias("pattern")) for n, p in words.items()])
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hit = lines.withColumn("c", F.explode(F.filter(cats, lambda c: F.rlike(F.col("line"), c["pattern"]))))
    rank = F.row_number().over(Window.partitionBy(key, "c.category").orderBy("line_no"))
    return hit.withColumn("hit_no", rank).where(F.col("hit_no") <= most).select(key, F.col("c.category").alias("category"), "hit_no", "line_no", F.length("line").alias("chars"))


def digest(texts: DataFrame, key: str, budget: int) -> DataFrame:
    """Extractive digest of each text, its paragraphs being the blocks."""
    blocks = F.filter(F.transform(F.split("text", "\n"), lambda b: F.trim(b)), lambda b: b != "")
    return digest_blocks(texts.select(key, F.posexplode(blocks).alias("block", "text")), [key], "block", budget)


def digest_blocks(texts: DataFrame, keys: list[str], block: str, budget: int) -> DataFrame:
    """Extractive digest per ``keys``: first sentences of all blocks, then all second ones, while they fit.

    ``block`` orders the texts of a digest, such as the accounts of a page. The first
    sentence always stands, one that does not fit is passed over.
    """
    x = texts.select(*keys, F.col(block).alias("block"), F.posexplode(sentences(F.col("text"), F.lit(False))).alias("rank", "s"))
    order = F.array_sort(F.collect_list(F.struct("rank", "block", "s")))
    kind = "struct<used:int,n:int,text:string>"
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit("").alias("text")).cast(kind)

    def take(acc, c):
        cost = F.length(c["s"]) + F.when(acc["n"] > 0, 1).otherwise(0)
        fits = (acc["n"] == 0) | (acc["used"] + cost <= budget)
        return F.when(fits, F.struct((acc["used"] + cost).alias("used"), (acc["n"] + 1).alias("n"),
                                     F.when(acc["n"] > 0, F.concat(acc["text"], F.lit(" "), c["s"])).otherwise(c["s"]).alias("text"))).otherwise(acc).cast(kind)

    return x.groupBy(*keys).agg(F.aggregate(order, start, take).alias("d")).select(*keys, F.col("d.n").alias("sentences"), F.col("d.text").alias("digest"))


def table_json(lines: DataFrame, keys: list[str], text_normalizer: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """One JSON document per table: fields, rows, currency and scale note; ``text_normalizer`` rewrites descriptions."""
    row = F.struct("row_idx", text_normalizer(F.col("description")).alias("description"), F.date_format("period_end", "yyyy-MM-dd").alias("period"),
                   F.col("amount").cast("string").alias("amount"))
    fields = F.array(F.lit("description"), F.lit("period"), F.lit("amount")).alias("fields")
    d = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return d.select(*keys, F.to_json(F.struct(fields, "rows", F.lit("CNY").alias("currency"), F.lit("thousand").alias("scale"))).alias("document"))


# ---- contract ledgers ------------------------------------------------------


def said_count(fields: Sequence[str]) -> Column:
    """How many of the fields say something: not blank, not a word for missing."""
    return sum((F.when(~F.coalesce(F.trim(f), F.lit("")).isin("", *MISSING), 1).otherwise(0) for f in fields), F.lit(0))


def reference_rows(rows: DataFrame, core: Sequence[str], least: int = 5) -> DataFrame:
    """Ledger rows that a person filled: at least ``least`` of the core fields say something."""
    return rows.where(said_count(core) >= least)


def number_of(c: str) -> Column:
    return F.trim(F.col(c)).try_cast("double")


def contract_fixups(rows: DataFrame) -> DataFrame:
    """Unit rates where a total was read as one; bare month counts. Whole numbers are written without a point."""
    ad, ae, af = number_of("day_rent"), number_of("day_fee"), number_of("day_total")
    wrong = (ad < 10) & (ae < 10) & (af.isNull() | (af > 10))
    months = F.regexp_extract(F.trim("free_months"), r"^(?:约|大約|大约)?\s*([0-9]+(?:\.[0-9]+)?)\s*个?月?$", 1)
    return rows.withColumn("day_total", F.when(wrong, F.regexp_replace(F.round(ad + ae, 6).cast("string"), r"\.0$", "")).otherwise(F.col("day_total"))).withColumn(
        "free_months", F.when(months != "", months).otherwise(F.col("free_months")))


def soft_equal(a: Column, b: Column) -> Column:
    """Same text, or figures within 3% below ten and 0.2% above."""
    x, y = F.trim(a).try_cast("double"), F.trim(b).try_cast("double")
    tol = F.when(F.abs(y) < 10, F.greatest(F.lit(0.01), F.abs(y) * 0.03)).otherwise(F.greatest(F.lit(1.0), F.abs(y) * 0.002))
    return F.coalesce((F.lower(F.trim(a)) == F.lower(F.trim(b))) | (F.abs(x - y) <= tol) | (F.trim(a).isin(*MISSING) & F.trim(b).isin(*MISSING)), F.lit(False))


def field_diff(extracted: DataFrame, reference: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that differ between extraction and reference, one row each."""
    pack = lambda p: F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields]).alias(p)
    j = extracted.select(key, pack("a")).join(reference.select(key, pack("b")), key)
    z = j.select(key, F.explode(F.arrays_zip("a", "b")).alias("z")).select(key, F.col("z.a.field").alias("field"), F.col("z.a.v").alias("extracted"), F.col("z.b.v").alias("reference"))
    return z.withColumn("equal", soft_equal(F.col("extracted"), F.col("reference")))


def merge_reviews(base: DataFrame, review: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Reviewed values overlay the base where they say something; they never erase; changes are counted."""
    r = review.select(key, *[F.col(f).alias(f"r_{f}") for f in fields])
    j = base.join(r, key, "full_outer")
    said = lambda f: F.col(f"r_{f}").isNotNull() & (F.trim(f"r_{f}") != "") & (F.col(f"r_{f}") != MISSING[0])
    new = {f: F.when(said(f), F.col(f"r_{f}")).otherwise(F.col(f)) for f in fields}
    changed = sum(F.when(~F.equal_null(new[f], F.col(f)), 1).otherwise(0) for f in fields)
    return j.select(key, *[new[f].alias(f) for f in fields], changed.alias("changes"))


def merge_payments(base: DataFrame, review: DataFrame, keys: list[str], parts: tuple[str, ...] = ("rent", "mgmt_fee"),
                   extra: tuple[str, ...] = ("other",), total: str = "total", slack: str = "0.02") -> DataFrame:
    """Reviewed amounts overlay the row's own where they say something and never erase.

    A review that breaks a sum which held is not taken where the row has amounts of its
    own (``rejected``). Rows that one side alone has stay as they are; null amounts say nothing.
    """
    amounts = [*parts, *extra, total]
    j = base.select(*keys, *amounts).join(review.select(*keys, *[F.col(c).alias(f"r_{c}") for c in amounts]), keys, "full_outer")
    taken = {c: F.coalesce(f"r_{c}", c) for c in amounts}

    def holds(value):
        added = sum((value(c) for c in parts[1:]), value(parts[0]))
        added = sum((F.coalesce(value(c), F.lit(0)) for c in extra), added)
        return F.abs(added - value(total)) <= F.lit(slack).cast("decimal(4,2)")

    broken = F.coalesce(holds(F.col), F.lit(False)) & ~F.coalesce(holds(taken.get), F.lit(True))
    return j.select(*keys, *[F.when(broken, F.coalesce(c, f"r_{c}")).otherwise(taken[c]).alias(c) for c in amounts], broken.alias("rejected"))


def resolve_columns(rows: DataFrame, key: str, header: DataFrame, default: str = MISSING[0]) -> DataFrame:
    """Free field names (letter, header, header without blanks) to ledger columns; missing ones get the default.

    ``rows``: key, fields map<string,string>. ``header``: letter, title.
    """
    names = F.array(F.struct(F.lit(0).alias("tier"), F.col("letter").alias("name")), F.struct(F.lit(1).alias("tier"), F.col("title").alias("name")),
                    F.struct(F.lit(2).alias("tier"), F.replace("title", F.lit(" "), F.lit("")).alias("name")))
    dim = header.select("letter", F.explode(names).alias("n")).select("letter", "n.tier", "n.name").dropDuplicates(["letter", "name"])
    x = rows.select(key, F.explode("fields").alias("name", "value")).join(dim, "name")
    got = x.groupBy(key, "letter").agg(F.min_by("value", "tier").alias("value"))
    wide = got.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("letter", "value"))).alias("m"))
    letters = [r.letter for r in header.select("letter").distinct().collect()]  # the ledger's own columns: they become columns of the result
    m = rows.select(key).join(wide, key, "left")
    return m.select(key, *[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(default)).alias(n) for n in sorted(letters)])


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    kinds = ["supported", "contradict", "not on pages", "missing ok", "other"]
    return verdicts.groupBy("source_file").agg(*[F.count_if(F.col("verdict") == k).alias(k.replace(" ", "_")) for k in kinds],
                                               F.array_join(F.array_sort(F.collect_set(F.when(F.col("verdict") == "contradict", F.col("field")))), ",").alias("contradicted"))
