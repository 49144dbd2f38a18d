"""Commentary: clauses, quoted figures and dates, grounding against the source, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions import blocks
from tieout.functions.prose import AMOUNT_TYPE, has_causal_language, quoted_dates, with_amounts, with_numbers

ATTEMPT = ["entity_id", "account", "yr", "attempt"]
# A clause ends after these; '.', ',' and '，' between digits do not count (fixed values).
CLAUSE_END = "(?<=[;。；！？!?])|(?<=[.,，])(?!(?<=[0-9][.,，])[0-9])"
BLANKS = " \t\n\x0b\f\r"
BOUNDARY_CHARS = " \t\r\n\"'`.,;:!?，。；：、！？「」『』（）()"
# Verdict confidences and the highlight gate (fixed values).
CONF_NUMBER_WRONG, CONF_BACKED, CONF_MODEL_FLAG, CONF_DEFAULT, GATE = 0.9, 1.0, 0.7, 0.5, 0.6
# Amounts tie within max(500, 5%) (fixed values).
FLAT_BAND, RELATIVE_BAND = 500, "0.05"
SCALE_FACTORS = (("1000", "1000x too small"), ("0.001", "1000x too large"),
                 ("10000", "10000x too small"), ("0.0001", "10000x too large"))


def clauses(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per clause with 0-based half-open offsets; ``clause`` is exactly that slice."""
    # starts are folded once per text and travel with their clause; outer, as a plain explode infers a filter that repeats the split
    x = texts.withColumn("_p", F.explode_outer(F.array(F.split(F.col(text), CLAUSE_END))))
    ends = F.aggregate("_p", F.array(F.lit(0)), lambda a, p: F.array_append(a, F.element_at(a, -1) + F.length(p)))
    x = x.select("*", F.posexplode_outer(F.arrays_zip(F.col("_p").alias("part"), F.slice(ends, F.lit(1), F.size("_p")).alias("at"))).alias("_i", "_z"))
    x = x.where("_i IS NOT NULL").withColumn("_part", F.col("_z.part")).withColumn("_at", F.col("_z.at"))
    body = F.btrim("_part", F.lit(BLANKS))
    lead = F.length("_part") - F.length(F.ltrim("_part", F.lit(BLANKS)))
    x = x.withColumn("clause", body).where("clause <> ''").withColumn("start", F.col("_at") + lead).withColumn(
        "end", F.col("start") + F.length("clause"))
    return x.select(*[c for c in texts.columns if c != text], F.col("_i").alias("clause_no"), "start", "end", "clause")


def clause_amounts(clause_rows: DataFrame) -> DataFrame:
    """One row per quoted amount; clauses without a digit are passed over unparsed."""
    digits = clause_rows.where(F.rlike("clause", F.lit("[0-9]")))
    # outer: a plain explode infers a filter that would run all passes nested in one expression
    found = with_amounts(digits, "clause", "_amounts")
    return found.withColumn("amount", F.explode_outer("_amounts")).where("amount IS NOT NULL").drop("_amounts")


def adjacent_sums(lines: DataFrame, keys: list[str], longest: int = 4) -> DataFrame:
    """Sums of every run of 2..longest neighbouring rows of each (keys) group."""
    x = blocks.dense_index(lines, keys, "row_idx", "pos")

    def sums(w) -> dict[str, Column]:
        out, total = {}, F.col("amount")
        for n in range(2, longest + 1):
            total = total + F.lead("amount", n - 1).over(w)
            out[f"s{n}"] = total.cast("decimal(22,2)")
        return out

    x = blocks.with_following(x, keys, "pos", longest - 1, sums)
    runs = F.array(*[F.struct(F.lit(n).alias("run"), F.col(f"s{n}").alias("total")) for n in range(2, longest + 1)])
    return x.select(*keys, "row_idx", F.explode(runs).alias("r")).select(*keys, "row_idx", "r.run", "r.total").where(
        "total IS NOT NULL")


def source_pool(lines: DataFrame, remarks: DataFrame, chart: DataFrame, months: DataFrame) -> DataFrame:
    """The distinct ``source_values``."""
    return source_values(lines, remarks, chart, months).distinct()


def source_values(lines: DataFrame, remarks: DataFrame, chart: DataFrame, months: DataFrame) -> DataFrame:
    """Magnitudes that may ground a figure, per entity and statement type.

    Cells, column totals, runs of 2-4 rows, note numbers and annualised note
    numbers. Accounts of one statement share a pool, so siblings need no join;
    unmapped accounts keep their own.
    """
    keys = ["entity_id", "account", "period_end"]
    value = lambda df, c: df.select("entity_id", "account", F.abs(c).cast(AMOUNT_TYPE).alias("value"))
    totals = lines.groupBy(*keys).agg(F.sum("amount").alias("v"))
    numbered = with_numbers(remarks.where(F.rlike("note", F.lit("[0-9]"))).select("entity_id", "account", "note"), "note", "_v")
    # outer: a plain explode infers a filter that reads the notes again
    notes = numbered.select("entity_id", "account", F.posexplode_outer("_v").alias("_i", "v")).where("_i IS NOT NULL").select("entity_id", "account", "v").distinct()
    both = F.when(F.col("months").isNull(), F.array("v")).otherwise(F.array("v", (F.col("v") * 12 / F.col("months")).cast(AMOUNT_TYPE)))
    noted = notes.join(months, ["entity_id", "account"], "left").select("entity_id", "account", F.explode(both).alias("v"))
    pool = (value(lines, F.col("amount")).unionByName(value(totals, F.col("v")))
            .unionByName(value(adjacent_sums(lines, keys), F.col("total"))).unionByName(value(noted, F.col("v"))))
    return with_pool(pool, chart).select("entity_id", "pool", "value")


def with_pool(df: DataFrame, chart: DataFrame) -> DataFrame:
    kinds = chart.select(F.col("tab_name").alias("account"), F.col("statement_type").alias("_kind"))
    return df.join(kinds, "account", "left").withColumn("pool", F.coalesce("_kind", "account")).drop("_kind")


def value_bucket(a: Column, flat: int = FLAT_BAND, ratio: float = float(RELATIVE_BAND)) -> Column:
    """The one bucket of a source magnitude: flat steps while max(flat, ratio) is flat, geometric steps beyond."""
    wide = F.floor(F.ln(a.cast("double")) / F.ln(F.lit(1.0 + ratio)))
    return F.when(a <= flat / ratio, F.struct(F.lit(0).alias("scale"), F.floor(a / flat).cast("bigint").alias("bucket"))).otherwise(
        F.struct(F.lit(1).alias("scale"), wide.alias("bucket")))


def band_buckets(t: Column, flat: int = FLAT_BAND, ratio: float = float(RELATIVE_BAND)) -> Column:
    """Every bucket whose sources may tie to a target: three flat ones, five geometric ones near the seam and above."""
    small = F.floor(t / flat).cast("bigint")
    wide = F.floor(F.ln(F.greatest(t.cast("double"), F.lit(1.0))) / F.ln(F.lit(1.0 + ratio)))
    near = F.when(t <= flat / ratio * 1.1, F.transform(F.sequence(small - 1, small + 1), lambda b: F.struct(F.lit(0).alias("scale"), b.alias("bucket"))))
    far = F.when(t >= flat / ratio * 0.9, F.transform(F.sequence(wide - 2, wide + 2), lambda b: F.struct(F.lit(1).alias("scale"), b.alias("bucket"))))
    return F.concat(F.coalesce(near, F.slice(far, 1, 0)), F.coalesce(far, F.slice(near, 1, 0)))


def in_band(t: Column, a: Column) -> Column:
    """Tie within max(500, 5% of the source); a zero source ties only to a figure that rounds to zero."""
    width = F.greatest(F.lit(FLAT_BAND).cast("decimal(28,4)"), (a * F.lit(RELATIVE_BAND).cast("decimal(3,2)")).cast("decimal(28,4)"))
    return F.when(a == 0, F.bround(t, 0) == 0).otherwise(F.abs(t - a) <= width)


def pool_bucket(a: Column) -> Column:
    """The one bucket of a magnitude (a double): steps grow with it and are over twice as wide as the band around it."""
    return F.floor(F.log1p(F.greatest(a, F.lit(0.0)) / (FLAT_BAND / float(RELATIVE_BAND))) / math.log1p(4.4 * float(RELATIVE_BAND))).cast("int")


def target_buckets(t: Column) -> Column:
    """The buckets, mostly one and never over two, between the least and the largest source that may tie to a target (a double)."""
    flat, ratio = FLAT_BAND + 1.0, float(RELATIVE_BAND) + 1e-6  # wider than the band by more than any rounding
    least, most = F.least(t - flat, t / (1 + ratio)), F.greatest(t + flat, t / (1 - ratio))
    return F.sequence(pool_bucket(least), pool_bucket(most))


def matched_targets(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """The distinct (entity_id, pool, target) that tie to some pool value.

    A band join as an equi join: pool values carry one bucket, targets the one or two
    that their band touches, and the exact test decides where doubles are near enough. Both
    sides are distinct, and the bucket is part of the key, so one busy pool still spreads over
    many tasks unless both sides lie in buckets of the entity.
    """
    t = targets.select("entity_id", "pool", "target").distinct().withColumn("_t", F.col("target").cast("double"))
    b = t.withColumn("b", F.explode(target_buckets(F.col("_t"))))
    p = pool.withColumn("_v", F.col("value").cast("double")).withColumn("b", pool_bucket(F.col("_v")))
    near = F.abs(F.col("_t") - F.col("_v")) <= F.greatest(F.lit(FLAT_BAND + 1.0), F.col("_v") * (float(RELATIVE_BAND) + 1e-6))
    hit = b.join(p, ["entity_id", "pool", "b"]).where(near & in_band(F.col("target"), F.col("value")))
    return hit.groupBy("entity_id", "pool", "target").agg(F.min("value").alias("source_value"))


def ground_amounts(amount_rows: DataFrame, pool: DataFrame, chart: DataFrame) -> DataFrame:
    """Each quoted amount with ``grounded``."""
    x = with_pool(amount_rows, chart).withColumn("target", F.abs("amount"))
    hits = matched_targets(x, pool).select("entity_id", "pool", "target", F.lit(True).alias("grounded"))
    return x.join(hits, ["entity_id", "pool", "target"], "left").withColumn(
        "grounded", F.coalesce("grounded", F.lit(False))).drop("target")


def scale_errors(grounded: DataFrame, pool: DataFrame) -> DataFrame:
    """Ungrounded amounts that tie once multiplied by a power of ten; the first factor that works."""
    factors = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).cast("decimal(9,4)").alias("f"), F.lit(n).alias("finding"))
                        for i, (f, n) in enumerate(SCALE_FACTORS)])
    bad = grounded.where("NOT grounded AND amount <> 0").withColumn("x", F.explode(factors)).withColumn(
        "target", (F.abs("amount") * F.col("x.f")).cast(AMOUNT_TYPE))
    hits = matched_targets(bad, pool)
    keys = [*ATTEMPT, "clause_no", "amount"]
    return bad.join(hits, ["entity_id", "pool", "target"]).groupBy(*keys).agg(
        F.min_by("x.finding", "x.i").alias("finding"), F.min_by("target", "x.i").alias("scaled"))


def clause_key(text: Column) -> Column:
    """Spaces out, lower case, boundary punctuation off: the form reviews are matched on."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.btrim(F.lower(text), F.lit(BOUNDARY_CHARS))


def with_reviews(clause_rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each clause with ``model_supported`` and ``model_category`` of the review with the longest containment overlap (earliest on ties).

    The reviews of an attempt meet its clauses as one list, so clauses are dealt by attempt once.
    """
    r = reviews.select(*ATTEMPT, F.struct(F.lower("category").alias("category"), "supported", "review_no", clause_key(F.col("clause")).alias("k")).alias("r")).where("r.k <> ''")
    listed = r.groupBy(*ATTEMPT).agg(F.collect_list("r").alias("_rs"))
    x = clause_rows.join(listed, ATTEMPT, "left")
    x = x.withColumn("_k", F.when(F.col("_rs").isNotNull(), F.nullif(clause_key(F.col("clause")), F.lit(""))))
    hits = F.filter("_rs", lambda r: F.contains(F.col("_k"), r["k"]) | F.contains(r["k"], F.col("_k")))
    best = F.array_max(F.transform(hits, lambda r: F.struct(
        F.least(F.length("_k"), F.length(r["k"])).alias("n"), (-r["review_no"]).alias("no"), r["supported"].alias("supported"), r["category"].alias("category"))))
    x = x.withColumn("_m", best)
    return x.select(*clause_rows.columns, F.col("_m.supported").alias("model_supported"), F.col("_m.category").alias("model_category"))


def combine_verdicts(clause_rows: DataFrame, grounded: DataFrame, reviews: DataFrame, gate: float = GATE) -> DataFrame:
    """Arithmetic first, then the model's reading, then causal wording; weak flags are dropped at the gate.

    Everything about an attempt meets its clauses by attempt, so rows are dealt once and stay so for what follows.
    """
    det = grounded.groupBy(*ATTEMPT).agg(
        F.collect_set("clause_no").alias("_seen"), F.collect_set(F.when(~F.col("grounded"), F.col("clause_no"))).alias("_wrong"))
    x = with_reviews(clause_rows, reviews).join(det, ATTEMPT, "left")
    x = x.withColumn("all_grounded", F.when(F.array_contains("_wrong", F.col("clause_no")), False).when(F.array_contains("_seen", F.col("clause_no")), True))
    flagged = F.col("model_category").isin("reasoning", "hallucination") & ~F.col("model_supported")
    plain = F.col("all_grounded").isNull() & ~F.coalesce(flagged, F.lit(False))
    x = x.withColumn("_causal", F.when(plain, has_causal_language(F.col("clause"))))
    category = (
        F.when(~F.col("all_grounded"), "hallucination")
        .when(F.col("all_grounded") & (F.col("model_category") == "reasoning") & ~F.col("model_supported"), "reasoning")
        .when(F.col("all_grounded"), "data-backed")
        .when(flagged, F.col("model_category"))
        .when(F.col("_causal"), "reasoning").otherwise("data-backed"))
    conf = (F.when(~F.col("all_grounded"), CONF_NUMBER_WRONG)
            .when(F.col("all_grounded"), F.when(F.col("category") == "reasoning", CONF_MODEL_FLAG).otherwise(CONF_BACKED))
            .when(flagged, CONF_MODEL_FLAG)
            .when(F.col("_causal"), CONF_DEFAULT).otherwise(CONF_BACKED))
    x = x.withColumn("category", category).withColumn("conf", conf)
    weak = (F.col("category") != "data-backed") & (F.col("conf") < gate)
    x = x.withColumn("category", F.when(weak, "data-backed").otherwise(F.col("category")))
    return x.withColumn("supported", F.col("category") == "data-backed").select(
        *ATTEMPT, "clause_no", "start", "end", "clause", "category", "supported")


def unknown_dates(texts: DataFrame, source_dates: DataFrame) -> DataFrame:
    """Dates a text quotes that its account's source never mentions; silent where the source has none."""
    quoted = texts.withColumn("date_key", F.explode(quoted_dates(F.col("text"))))
    known = source_dates.select("entity_id", "account", "date_key").distinct()
    have = known.select("entity_id", "account").distinct()
    return (quoted.join(have, ["entity_id", "account"], "left_semi")
            .join(known, ["entity_id", "account", "date_key"], "left_anti").drop("text"))


def highlight_spans(texts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed clauses located in their text: first free occurrence each, overlaps skipped.

    The reviews of one text are folded inside that text's own row.
    """
    per = reviews.groupBy(*ATTEMPT).agg(F.sort_array(F.collect_list(F.struct("clause_no", "clause", "category"))).alias("rs"))
    x = texts.join(per, ATTEMPT)
    kind = "array<struct<start:int,end:int,category:string>>"

    def locate_free(acc, r):
        def nxt(pos, _):
            used = F.array_contains(F.transform(acc, lambda s: s["start"] + 1), pos)
            return F.when((pos > 0) & used, F.call_function("locate", r["clause"], F.col("text"), pos + 1)).otherwise(pos)
        start = F.call_function("locate", r["clause"], F.col("text"), F.lit(1))
        pos = F.aggregate(F.sequence(F.lit(0), F.size(acc)), start, nxt)
        span = F.struct((pos - 1).alias("start"), (pos - 1 + F.length(r["clause"])).alias("end"), r["category"].alias("category"))
        return F.when(pos > 0, F.concat(acc, F.array(span))).otherwise(acc).cast(kind)

    def keep(acc, s):
        last_end = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        return F.when(s["start"] >= last_end, F.concat(acc, F.array(s))).otherwise(acc).cast(kind)

    empty = F.array().cast(kind)
    placed = F.array_sort(F.aggregate("rs", empty, locate_free))
    x = x.withColumn("placed", placed).withColumn("spans", F.aggregate("placed", empty, keep))
    return x.select(*ATTEMPT, F.posexplode("spans").alias("span_no", "s")).select(*ATTEMPT, "span_no", "s.*")


def defective(verdicts: DataFrame, most: int | None = 5) -> tuple[DataFrame, DataFrame]:
    """Retriable clauses, and one feedback text per attempt quoting the first ``most`` of them (None: all).

    An attempt without such a clause is fed back all its unsupported ones.
    """
    wrong = F.col("category") == "hallucination"
    any_wrong = F.bool_or(wrong).over(Window.partitionBy(*ATTEMPT))
    bad = verdicts.where("NOT supported").withColumn("_any", any_wrong).where(wrong | ~F.col("_any")).drop("_any")
    rank = F.row_number().over(Window.partitionBy(*ATTEMPT).orderBy("clause_no"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("clause_no", "clause"))),
                        lambda x: F.concat(F.lit('- "'), x["clause"], F.lit('"')))
    feedback = bad.withColumn("r", rank).where(F.lit(True) if most is None else F.col("r") <= most).groupBy(*ATTEMPT).agg(F.array_join(lines, "\n").alias("feedback"))
    return bad.where(wrong), feedback


def arbiter(verdicts: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Whether the last attempt needs a retry, and which attempt to keep: fewest defects, latest on ties."""
    per = verdicts.groupBy(*ATTEMPT).agg(
        F.count(F.lit(1)).alias("clauses"), F.count_if(~F.col("supported")).alias("unsupported"),
        F.count_if(~F.col("supported") & (F.col("category") == "hallucination")).alias("defects"))
    needed = (F.col("defects") > 0) | (F.col("unsupported") / F.col("clauses") > threshold)
    return per.groupBy("entity_id", "account", "yr").agg(
        F.max_by(needed, "attempt").alias("retry_needed"), F.max("attempt").alias("last_attempt"),
        F.min_by("attempt", F.struct("defects", -F.col("attempt"))).alias("best_attempt"),
        F.min("defects").alias("best_defects")).withColumn(
        "chosen", F.when(F.col("retry_needed"), F.col("best_attempt")).otherwise(F.col("last_attempt")))


def final_text(stages: DataFrame) -> DataFrame:
    """Text of the latest stage that is not blank."""
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    return stages.where(full).groupBy("account").agg(
        F.max_by("text", "stage_no").alias("text"), F.max("stage_no").alias("stage_no"))


def needs_review(texts: DataFrame, reviews: DataFrame) -> DataFrame:
    return texts.join(reviews.select(*ATTEMPT).distinct(), ATTEMPT, "left_anti")


def attach_remarks(lines: DataFrame, remarks: DataFrame) -> DataFrame:
    """Display lines with their distinct remarks joined by `` || ``."""
    notes = remarks.select("entity_id", "account", "yr", "note").distinct().groupBy("entity_id", "account", "yr").agg(
        F.array_join(F.sort_array(F.collect_list("note")), " || ").alias("remarks"))
    return lines.join(notes, ["entity_id", "account", "yr"], "left")


# Assurance wording and the words that back it (fixed values).
CLAIMS = (
    ("work performed", r"([^。；;]*(?:我(?:方|们)(?:已)?(?:获取|取得|核对|检查|查看|复核|比对)|已核对至|核对至|经(?:将|对)[^。；;]{0,20}核对)[^。；;]*)",
     ("核对", "检查", "查看", "复核", "比对", "获取", "取得", "对账单", "agreed", "checked")),
    ("negative assurance", r"([^。；;]*(?:未(?:发现|见)(?:明显|显著|重大)?(?:差异|异常)|无重大(?:差异|异常)|未见异常)[^。；;]*)",
     ("未发现", "未见", "无重大", "无异常", "未有差异", "no difference", "no material")),
    ("management attribution", r"([^。；;]*管理层(?:表示|称|提供|确认|解释)[^。；;]*)", ("管理层", "管报", "management")),
)


def claim_grounding(texts: DataFrame, remarks: DataFrame) -> DataFrame:
    """Assurance claims, each with whether the account's own remarks hold an evidence word."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("found"))
                      for k, p, _ in CLAIMS])
    claims = texts.withColumn("c", F.explode(kinds)).select(
        "entity_id", "account", "yr", "c.kind", F.explode("c.found").alias("claim")).where("length(trim(claim)) >= 6")
    note = F.col("note")
    seen = [F.max(F.rlike(note, F.lit("|".join(words)))).alias(kind) for kind, _, words in CLAIMS]
    evidence = remarks.groupBy("entity_id", "account").agg(*seen)
    backed = F.coalesce(*[F.when(F.col("kind") == kind, F.col(f"`{kind}`")) for kind, _, _ in CLAIMS], F.lit(False))
    return claims.join(evidence, ["entity_id", "account"], "left").select(
        "entity_id", "account", "yr", "kind", F.trim("claim").alias("claim"), backed.alias("backed"))


def remark_reach(remarks: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether a third of a remark's distinctive tokens show up in the account's texts of that year, attempt by attempt."""
    toks = F.array_distinct(F.regexp_extract_all("note", F.lit("([一-鿿]{2,}|[A-Za-z]{4,})"), F.lit(1)))
    r = remarks.select("entity_id", "account", "yr", "source", "note").withColumn("tokens", toks)
    j = r.join(texts.select(*ATTEMPT, "text"), ["entity_id", "account", "yr"])
    hits = F.size(F.filter("tokens", lambda t: F.contains(F.col("text"), t)))
    n = F.size("tokens")
    return j.select(*ATTEMPT, "source", "note", n.alias("tokens"), hits.alias("hits"),
                    ((n > 0) & (hits >= F.greatest(F.lit(1), F.floor(n / 3)))).alias("reached"))


# Composition sentences (fixed values).
# Each takes an amount with its unit as the first group.
ENUM_ITEM = r"[1-9]）\s*[^；;]*?(-?[0-9,]+(?:\.[0-9]+)?\s*(?:万元|亿元|元))"
ENUM_RUN = "(?:主要(?:包括|包含|为|系)|包括|包含)([^。]*)"
RUN_AMOUNT = r"(-?[0-9,]+(?:\.[0-9]+)?\s*(?:万元|亿元|元))"
RESIDUAL = r"其余[^。；;]{0,40}?((?:负|-)?\s*[0-9,]+(?:\.[0-9]+)?\s*(?:万元|亿元|元))"
STATED = r"(?:合计|总额|余额合?计?)\s*(?:为)?\s*([0-9,]+(?:\.[0-9]+)?\s*(?:万元|亿元|元))"


def _money(amount: Column) -> Column:
    """An amount with its unit in base units."""
    scale = F.when(F.endswith(amount, F.lit("亿元")), 100000000).when(F.endswith(amount, F.lit("万元")), 10000).otherwise(1).cast("decimal(9,0)")
    return (F.translate(amount, "," + BLANKS + "万亿元", "").try_cast("decimal(18,2)") * scale).cast("decimal(28,2)")


def composition_check(texts: DataFrame) -> DataFrame:
    """Do the enumerated items reach the stated total (1% slack); if not, unit error, double count or shortfall."""
    t = F.col("text")
    once = lambda c: F.explode_outer(F.array(c))  # noqa: E731 - a generator of one row, so that no later step repeats the patterns

    def amounts(src: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(src, F.lit(pattern), F.lit(1)), _money)

    x = texts.select("*", once(F.struct(amounts(t, ENUM_ITEM).alias("listed"), F.regexp_extract(t, RESIDUAL, 1).alias("rest"), F.regexp_extract(t, STATED, 1).alias("stated"))).alias("_f"))
    found, rest, stated = F.col("_f.listed"), F.col("_f.rest"), F.col("_f.stated")
    negative = rest.startswith("负") | rest.startswith("-")
    x = x.select("*", once(F.struct(
        F.when(F.size(found) > 0, found).otherwise(amounts(F.regexp_extract(t, ENUM_RUN, 1), RUN_AMOUNT)).alias("items"),
        F.when(rest != "", (_money(F.translate(rest, "负-", "")) * F.when(negative, -1).otherwise(1)).cast("decimal(28,2)")).alias("rest"),
        F.when(stated != "", _money(stated)).alias("stated"))).alias("_g")).select(*texts.columns, "_g.*")
    seen = F.exists("items", lambda i: F.abs(i) == F.abs(F.col("rest")))
    total = F.col("stated")
    x = x.withColumn("items", once(F.when(F.col("rest").isNotNull() & ~seen, F.concat("items", F.array("rest"))).otherwise(F.col("items"))))
    x = x.withColumn("stated", total).where("stated > 0 AND size(items) >= 2").withColumn(
        "listed", F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda a, i: (a + i).cast("decimal(28,2)")))
    ratio = F.col("listed").cast("double") / F.col("stated").cast("double")
    gap = F.abs(F.col("stated") - F.col("listed"))
    close = lambda m: F.abs(ratio - m) / m <= 0.05
    finding = (F.when(gap.cast("double") / F.col("stated").cast("double") <= 0.01, "adds up").when(close(10.0), "unit error 10x")
               .when(close(100.0), "unit error 100x").when(close(0.1), "unit error 1/10")
               .when(F.abs(ratio - 2.0) <= 0.05, "parent and children").otherwise("shortfall"))
    return x.select("entity_id", "account", "yr", F.size("items").alias("items"), "stated", "listed", finding.alias("finding"))


# Tie-out vocabulary (fixed values).
WORKING_WORDS = ("check", "对账单", "對賬單", "对帐单", "差异", "差異", "difference", "diff", "recon")


def split_working_notes(remarks: DataFrame) -> DataFrame:
    """Remarks with a class: nothing but a tie-out marker, a working note with content, or prose.

    What is left once tie-out words, the account's name, dates, figures and marks are gone decides.
    """
    low = F.lower(F.trim("note"))
    working = F.rlike(low, F.lit("|".join(WORKING_WORDS)))
    rest = F.regexp_replace(low, "|".join(WORKING_WORDS), " ")
    rest = F.replace(rest, F.lower("account"), F.lit(" "))
    for p in (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"-?[0-9,]+\.?[0-9]*", r"[|:;,()\[\]/\\.\-_+*%&#@!?'\"]+"):
        rest = F.regexp_replace(rest, p, " ")
    empty = F.length(F.trim(rest)) < 2
    return remarks.withColumn("note_class", F.when(working & empty, "artefact").when(working, "working").otherwise("prose"))
