"""Trends, movements, variances, compositions and report selections over schedule lines.

Rows are first folded to one record per schedule line holding its few periods;
everything after that works on arrays inside the record or on partial
aggregates per account. Windows are used for ranking only, with a rank limit
that Spark applies before the shuffle, so a very wide account does not end up
whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.labels import clean_placeholders, contains_any, row_type
from tieout.functions.numbers import amount_display, display_unit

ACCOUNT = ["entity_id", "account"]
LINE = ["entity_id", "account", "row_idx", "description"]
# Fixed values.
FOCUS_WORDS = ("total", "合计", "总计", "subtotal", "sub-total", "sub total")
CONTRA_MARKERS = ("累计折旧", "累计摊销", "减值准备", "跌价准备", "坏账准备")
ADJUSTMENT_MARKERS = ("管理层调整", "示意性调整", "adjustment", "Adjustment")
VARIANCE_PCT, DISPROPORTION_PP, BASE_SHARE, EXTRA_PAIRS = 30.0, 30.0, 0.01, 2
TABLE_PRIORITY = ("OI", "OC", "Tax and Surcharges", "GA", "Selling cost", "Fin Exp",
                  "NCA", "AR", "AP", "Advances", "OP", "OR", "Tax payable", "IA")
MIN_TABLE_ROWS, MAX_TABLES = 3, 5


def account_periods(lines: DataFrame, keys=ACCOUNT) -> DataFrame:
    """Distinct periods per account, oldest first (a handful of dates)."""
    return lines.groupBy(*keys).agg(F.sort_array(F.collect_set("period_end")).alias("periods"))


def line_series(lines: DataFrame) -> DataFrame:
    """One record per schedule line: ``periods`` of its account and ``values`` with gaps as 0."""
    folded = lines.groupBy(*LINE).agg(
        F.map_from_entries(F.collect_list(F.struct("period_end", "amount"))).alias("m"))
    return folded.join(account_periods(lines), ACCOUNT).withColumn(
        "values", F.transform("periods", lambda p: F.coalesce(
            F.try_element_at("m", p), F.lit(0).cast("decimal(20,2)")))).drop("m")


def _steps(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 1, F.zip_with(F.slice(values, 2, n - 1), F.slice(values, 1, n - 1), lambda b, a: b - a))


def _first_at(arr: Column, value: Column) -> Column:
    return F.array_position(arr, value).cast("int")


def trend_summary(lines: DataFrame) -> DataFrame:
    """Direction, net change and largest steps of the focus line of each account.

    Focus: first total-like line, else the last line with a value, else the last line.
    """
    series = line_series(lines)
    rec = F.struct("description", "periods", "values")
    low = F.lower("description")
    weight = F.aggregate("values", F.lit(0).cast("decimal(30,2)"), lambda a, v: (a + F.abs(v)).cast("decimal(30,2)"))
    focus = series.groupBy(*ACCOUNT).agg(
        F.min_by(rec, F.when(contains_any(low, FOCUS_WORDS), F.col("row_idx"))).alias("a"),
        F.max_by(rec, F.when(weight > 0, F.col("row_idx"))).alias("b"),
        F.max_by(rec, F.col("row_idx")).alias("c"),
    ).select(*ACCOUNT, F.coalesce("a", "b", "c").alias("f")).where(F.size("f.periods") >= 2)
    out = focus.withColumn("d", _steps(F.col("f.values")))
    up, down = F.array_max("d"), F.array_min("d")
    pos, neg = F.exists("d", lambda x: x > 0), F.exists("d", lambda x: x < 0)
    p, v, n = F.col("f.periods"), F.col("f.values"), F.size("f.periods")

    def step(value: Column, keep: Column, name: str) -> list[Column]:
        at = _first_at(F.col("d"), value)
        return [F.when(keep, F.element_at(p, at)).alias(f"{name}_from"),
                F.when(keep, F.element_at(p, at + 1)).alias(f"{name}_to"),
                F.when(keep, value).alias(f"{name}_delta")]

    return out.select(
        *ACCOUNT, F.col("f.description").alias("focus_description"),
        F.when(pos & neg, "volatile").when(pos, "rising").when(neg, "falling").otherwise("flat").alias("series_direction"),
        F.element_at(p, 1).alias("start_period"), F.element_at(p, n).alias("end_period"),
        F.element_at(v, 1).alias("start_value"), F.element_at(v, n).alias("end_value"),
        (F.element_at(v, n) - F.element_at(v, 1)).alias("net_change"),
        *step(up, up > 0, "increase"), *step(down, down < 0, "decrease"))


def significant_movements(lines: DataFrame, top: int = 3) -> DataFrame:
    """Each line's largest step, kept where it is >= 25% of the account's movement or >= 30% of its own base."""
    s = line_series(lines).where(F.size("periods") >= 2).withColumn("d", _steps(F.col("values")))
    s = s.withColumn("size", F.array_max(F.transform("d", lambda x: F.abs(x)))).where("size > 0")
    at = _first_at(F.transform("d", lambda x: F.abs(x)), F.col("size"))
    s = s.select(*LINE, "size", F.element_at("periods", at).alias("from_period"),
                 F.element_at("periods", at + 1).alias("to_period"), F.element_at("values", at).alias("from_value"),
                 F.element_at("values", at + 1).alias("to_value"), F.element_at("d", at).alias("delta"))
    moved = s.groupBy(*ACCOUNT).agg(F.sum("size").alias("moved"))
    s = s.join(moved, ACCOUNT)
    share = F.col("size").cast("double") / F.col("moved").cast("double") * 100
    base = F.abs("from_value").cast("double")
    pct = F.when(base >= 0.01, F.round(F.col("delta").cast("double") / base * 100, 1))
    s = s.withColumn("share", share).withColumn("percent_change", pct).withColumn(
        "exceeds_materiality", F.coalesce(F.abs(F.col("percent_change")) >= VARIANCE_PCT, F.lit(False)))
    s = s.where((F.col("share") >= 25) | F.col("exceeds_materiality"))
    rank = F.row_number().over(Window.partitionBy(*ACCOUNT).orderBy(F.desc("size"), "row_idx"))
    prev, curr = F.col("from_value"), F.col("to_value")
    return s.withColumn("rank", rank).where(F.col("rank") <= top).select(
        *ACCOUNT, "rank", "description", "from_period", "to_period", "from_value", "to_value", "delta",
        F.when((prev == 0) & (curr > 0), "new_increase").when((prev == 0) & (curr < 0), "new_decrease")
        .when(curr > prev, "increase").when(curr < prev, "decrease").otherwise("flat").alias("direction"),
        F.round("share", 1).alias("percent_of_total_change"), "percent_change", "exceeds_materiality")


def part_year(lines: DataFrame, keys=ACCOUNT) -> DataFrame:
    """Months covered by a part-year latest period, and the annualising factor.

    The financial year end is the month-day that most of the other periods share.
    """
    p = account_periods(lines, keys).where(F.size("periods") >= 2)
    eff, prev = F.element_at("periods", -1), F.element_at("periods", -2)
    md = lambda c: F.month(c) * 100 + F.dayofmonth(c)
    p = p.withColumn("effective", eff).where(md(eff) != md(prev))
    anchor = (
        p.select(*keys, "effective", F.explode("periods").alias("d")).where(md(F.col("d")) != md(F.col("effective")))
        .groupBy(*keys, "effective").agg(F.mode(md(F.col("d")), True).alias("anchor"))
    )
    shifted = F.pmod(F.month("effective") - F.floor(F.col("anchor") / 100), F.lit(12)).cast("int")
    months = F.when(shifted <= 0, F.month("effective")).otherwise(shifted)
    return anchor.withColumn("months", months).where("months < 12").select(
        *keys, F.col("effective").alias("period_end"), (F.col("anchor") / 100).cast("int").alias("anchor_month"),
        (F.col("anchor") % 100).cast("int").alias("anchor_day"), "months")


def annualise(lines: DataFrame, keys=ACCOUNT) -> DataFrame:
    """Part-year figures scaled to twelve months."""
    return lines.join(part_year(lines, keys), [*keys, "period_end"]).withColumn(
        "annualised", (F.col("amount") * 12 / F.col("months")).cast("decimal(20,2)"))


def total_series(lines: DataFrame) -> DataFrame:
    """One record per account: periods and the total line's values (column sums where there is none)."""
    per = lines.withColumn("kind", row_type(F.col("description"))).groupBy(*ACCOUNT, "period_end").agg(
        F.max_by("amount", F.when(F.col("kind").isin("total", "subtotal"), F.col("row_idx"))).alias("t"),
        F.sum("amount").cast("decimal(20,2)").alias("s"))
    pairs = F.sort_array(F.collect_list(F.struct("period_end", F.coalesce("t", "s").alias("v"))))
    return per.groupBy(*ACCOUNT).agg(pairs.alias("series"))


def full_series(lines: DataFrame) -> DataFrame:
    """``total_series`` without a part-year tail (kept where only two periods exist)."""
    s = total_series(lines).join(part_year(lines).select(*ACCOUNT, "months"), ACCOUNT, "left")
    cut = F.col("months").isNotNull() & (F.size("series") > 2)
    return s.withColumn("series", F.when(cut, F.slice("series", 1, F.size("series") - 1)).otherwise(F.col("series")))


def _pct(prev: Column, curr: Column, scale: Column) -> Column:
    p, c, s = (x.cast("double") for x in (prev, curr, scale))
    return F.when((F.abs(p) >= s * BASE_SHARE) & (p * c >= 0) & (p != 0), (c - p) / F.abs(p) * 100)


def material_variance(lines: DataFrame, revenue_account: str, income_accounts: list[str]) -> DataFrame:
    """Findings per account: latest material move, sign flip, nil latest, disproportion to revenue, earlier moves."""
    s = full_series(lines).where(F.size("series") >= 2)
    s = s.withColumn("scale", F.array_max(F.transform("series", lambda x: F.abs(x["v"])))).where("scale > 0")
    n = F.size("series")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
        i.alias("i"), F.element_at("series", i)["period_end"].alias("from_period"),
        F.element_at("series", i + 1)["period_end"].alias("to_period"),
        F.element_at("series", i)["v"].alias("from_value"), F.element_at("series", i + 1)["v"].alias("to_value")))
    e = s.select(*ACCOUNT, "scale", n.alias("n"), F.explode(pairs).alias("p")).select(*ACCOUNT, "scale", "n", "p.*")
    big_base = F.abs("from_value") >= F.col("scale").cast("double") * BASE_SHARE
    e = e.withColumn("flip", big_base & (F.col("from_value") * F.col("to_value") < 0)).withColumn(
        "pct", _pct(F.col("from_value"), F.col("to_value"), F.col("scale"))).withColumn(
        "latest", F.col("i") == F.col("n") - 1)
    growth = e.where(F.col("latest") & (F.col("account") == revenue_account)).select(
        "entity_id", F.when(F.abs(F.col("from_value")) >= F.col("scale").cast("double") * BASE_SHARE,
                            (F.col("to_value").cast("double") - F.col("from_value").cast("double"))
                            / F.abs("from_value").cast("double") * 100).alias("revenue_pct"))
    big = F.coalesce(F.abs("pct") >= VARIANCE_PCT, F.lit(False))
    hit = big | F.col("flip")
    rank = F.row_number().over(Window.partitionBy(*ACCOUNT, "latest", "hit").orderBy("i"))
    e = e.withColumn("hit", hit).withColumn("rank", rank).join(growth, "entity_id", "left")
    gap = F.col("pct") - F.col("revenue_pct")
    disproportion = (F.col("latest") & F.col("account").isin(income_accounts) & (F.col("account") != revenue_account)
                     & (F.abs(gap) >= DISPROPORTION_PP))
    nil = F.col("latest") & (F.col("to_value") == 0) & (F.col("from_value") != 0)
    kinds = F.filter(F.array(
        F.when(F.col("latest") & big, "material"), F.when(F.col("latest") & F.col("flip"), "sign_flip"),
        F.when(nil, "nil_latest"), F.when(disproportion, "disproportion"),
        F.when(~F.col("latest") & F.col("hit") & (F.col("rank") <= EXTRA_PAIRS),
               F.when(F.col("flip"), "earlier_flip").otherwise("earlier_material"))), lambda k: k.isNotNull())
    return e.withColumn("finding", F.explode(kinds)).select(
        *ACCOUNT, "finding", "from_period", "to_period", "from_value", "to_value",
        F.round("pct", 4).alias("pct"), F.when(F.col("finding") == "disproportion", F.round(gap, 4)).alias("gap_pp"))


def fallback_lines(lines: DataFrame) -> DataFrame:
    """A data-only sentence per account at its latest period."""
    per = lines.groupBy(*ACCOUNT, "period_end").agg(F.sum("amount").cast("decimal(20,2)").alias("total"))
    top = per.groupBy(*ACCOUNT).agg(
        F.max_by("total", "period_end").alias("total"), F.max("period_end").alias("period_end"))
    day = F.concat(F.year("period_end").cast("string"), F.lit("年"), F.month("period_end").cast("string"), F.lit("月"),
                   F.dayofmonth("period_end").cast("string"), F.lit("日"))
    return top.where("total <> 0").withColumn("line", F.concat(
        F.lit("截至"), day, F.lit("余额合计"), amount_display(F.col("total"), "Chi"), F.lit("。"))).select(
        *ACCOUNT, "period_end", "total", "line")


# ---- filters -------------------------------------------------------------

def drop_detail_rows(lines: DataFrame) -> DataFrame:
    d = F.col("description")
    keep = (row_type(d) != "breakdown") & ~F.rlike(d, F.lit("_|^\\s{2,}|其中[：:]"))
    return lines.where(keep).withColumn("description", clean_placeholders(d)).where("description <> ''")


def drop_zero_rows(lines: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Lines kept whole when any period is non-zero, or when they are totals."""
    active = lines.groupBy(*LINE).agg(F.max(F.abs("amount")).alias("peak"))
    keep = active.where((F.col("peak") >= F.lit(tolerance).cast("decimal(4,2)"))
                        | row_type(F.col("description")).isin("total", "subtotal")).select(*LINE)
    return lines.join(keep, LINE, "left_semi")


def significant_accounts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*ACCOUNT).agg(F.max(F.abs("amount")).alias("peak")).where("peak >= 0.01").select(*ACCOUNT, "peak")


def drop_zero_periods(statement: DataFrame) -> DataFrame:
    """All-zero lines go first; then all-zero income-statement periods, and the same balance-sheet
    periods where those are zero too; nothing goes if no income-statement period would be left."""
    live = statement.groupBy("entity_id", "statement_type", "description").agg(
        F.max(F.abs("amount")).alias("m")).where("m > 0").drop("m")
    s = statement.join(live, ["entity_id", "statement_type", "description"], "left_semi")
    per = s.groupBy("entity_id", "period_end").agg(
        F.max(F.when(F.col("statement_type") == "IS", F.abs("amount"))).alias("is_peak"),
        F.max(F.when(F.col("statement_type") == "BS", F.abs("amount"))).alias("bs_peak"))
    left = per.groupBy("entity_id").agg(F.max(F.col("is_peak") > 0).alias("some_left"))
    flags = per.join(left, "entity_id").withColumn("zero", F.coalesce(F.col("some_left"), F.lit(False)) & (F.col("is_peak") == 0))
    drop = (F.col("zero") & ((F.col("statement_type") == "IS") | (F.coalesce("bs_peak", F.lit(0)) == 0)))
    return s.join(flags, ["entity_id", "period_end"]).where(~F.coalesce(drop, F.lit(False))).select(*statement.columns)


def visible_rows(lines: DataFrame, visible: DataFrame, components: DataFrame) -> DataFrame:
    """Lines shown in the main table plus component lines; the account as it is where none would stay."""
    wanted = visible.select(*ACCOUNT, "description").union(components.select(*ACCOUNT, "description")).distinct()
    kept = lines.join(wanted, [*ACCOUNT, "description"], "left_semi")
    empty = lines.join(kept.select(*ACCOUNT).distinct(), ACCOUNT, "left_anti")
    return kept.unionByName(empty)


# ---- reshapes and statements --------------------------------------------

def years_of(lines: DataFrame) -> list[int]:
    """The years that lines have, in order; each becomes a column."""
    return sorted(r.yr for r in lines.where("yr IS NOT NULL").select("yr").distinct().collect())


def period_matrix(lines: DataFrame, years: list[int] | None = None) -> DataFrame:
    """One row per line, one column per year: those named, or all that the lines have."""
    years = years_of(lines) if years is None else years
    ids = ["entity_id", "account", "description"]
    if not years:
        return lines.select(*ids).distinct()
    wide = lines.groupBy(*ids).pivot("yr", years).agg(F.first("amount", ignorenulls=True))
    return wide.select(*ids, *[F.col(str(y)).alias(f"fy{y}") for y in years])


def unpivot_periods(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Long lines from all period columns: every column but ``ids``. A matrix without periods has no lines."""
    periods = [c for c in wide.columns if c not in ids]
    if not periods:
        return wide.select(*ids, F.lit("").alias("period"), F.lit(0).cast("decimal(20,2)").alias("amount")).where(F.lit(False))
    return wide.unpivot(ids, periods, "period", "amount").where("amount IS NOT NULL")


def synthesise_statement(totals: DataFrame, chart: DataFrame, grand_totals: dict[str, tuple[str, ...]]) -> DataFrame:
    """Statement built from account totals at the date most accounts have.

    Rows: accounts, one subtotal per category (left out where a grand total has that
    category alone), grand totals, and net profit where both sides exist.
    """
    dim = chart.select(F.col("tab_name").alias("account"), "statement_type", "category", "line_no")
    t = totals.join(dim, "account")
    votes = t.groupBy("entity_id", "statement_type", "period_end").agg(F.count(F.lit(1)).alias("n"))
    target = votes.groupBy("entity_id", "statement_type").agg(
        F.max_by("period_end", F.struct("n", "period_end")).alias("period_end"))
    t = t.join(target, ["entity_id", "statement_type", "period_end"])
    key = ["entity_id", "statement_type", "period_end"]
    rows = t.select(*key, "category", F.col("account").alias("description"), "amount", F.lit(0).alias("level"))
    by_cat = t.groupBy(*key, "category").agg(F.sum("amount").cast("decimal(20,2)").alias("amount"))
    label = F.concat(F.lit("Total "), F.lower(F.substring("category", 1, 1)), F.expr("substring(category, 2)"))
    sole = [cats[0] for cats in grand_totals.values() if len(cats) == 1]
    subs = by_cat.where(~F.col("category").isin(*(sole or [""]))).select(
        *key, "category", label.alias("description"), "amount", F.lit(1).alias("level"))
    groups = F.create_map(*[x for name, cats in grand_totals.items() for c in cats for x in (F.lit(c), F.lit(name))])
    grand = by_cat.withColumn("description", F.try_element_at(groups, F.col("category"))).where("description IS NOT NULL").groupBy(
        *key, "description").agg(F.sum("amount").cast("decimal(20,2)").alias("amount")).select(
        *key, F.lit(None).cast("string").alias("category"), "description", "amount", F.lit(2).alias("level"))
    net = by_cat.where("statement_type = 'IS'").groupBy(*key).agg(
        F.sum(F.when(F.col("category") == "Revenue", F.col("amount"))).alias("r"),
        F.sum(F.when(F.col("category") == "Expenses", F.col("amount"))).alias("x")).where(
        "r IS NOT NULL AND x IS NOT NULL").select(
        *key, F.lit(None).cast("string").alias("category"), F.lit("Net profit").alias("description"),
        (F.col("r") - F.col("x")).cast("decimal(20,2)").alias("amount"), F.lit(3).alias("level"))
    return rows.unionByName(subs).unionByName(grand).unionByName(net)


def category_headings(ordered: DataFrame) -> DataFrame:
    """A heading row before the first line of each category, once per category.

    ``ordered``: entity_id, position, label, category (null for totals). The first
    line of a category is found by aggregation, so no ordered window is needed.
    """
    first = ordered.where("category IS NOT NULL").groupBy("entity_id", "category").agg(
        F.min_by("label", "position").alias("first_label"), F.min("position").alias("position"))
    heads = first.where(F.col("first_label") != F.col("category")).select(
        "entity_id", (F.col("position") - 0.5).cast("double").alias("sort_key"), F.col("category").alias("label"),
        F.lit(True).alias("is_heading"))
    return ordered.select("entity_id", F.col("position").cast("double").alias("sort_key"), "label",
                          F.lit(False).alias("is_heading")).unionByName(heads)


def variants(lines: DataFrame, income_accounts: list[str]) -> DataFrame:
    """default, original, annualised and analysis views, each with and without detail rows, as one long table.

    One pass over the lines: the views a row belongs to are an array that is exploded.
    """
    latest = lines.groupBy(*ACCOUNT).agg(F.max("period_end").alias("latest"))
    part = part_year(lines.where(F.col("account").isin(income_accounts))).select(*ACCOUNT, "months")
    x = lines.join(latest, ACCOUNT).join(part, ACCOUNT, "left")
    at_latest = F.col("period_end") == F.col("latest")
    scaled = (F.col("amount") * 12 / F.col("months")).cast("decimal(20,2)")
    views = F.filter(F.array(
        F.when(at_latest, F.struct(F.lit("default").alias("variant"), F.coalesce(scaled, "amount").alias("value"))),
        F.when(at_latest, F.struct(F.lit("original").alias("variant"), F.col("amount").alias("value"))),
        F.when(at_latest & F.col("months").isNotNull(), F.struct(F.lit("annualised").alias("variant"), scaled.alias("value"))),
        F.struct(F.lit("analysis").alias("variant"), F.col("amount").alias("value"))), lambda v: v.isNotNull())
    scopes = F.when(row_type(F.col("description")) == "breakdown", F.array(F.lit("detail"))).otherwise(
        F.array(F.lit("detail"), F.lit("display")))
    return x.withColumn("v", F.explode(views)).withColumn("scope", F.explode(scopes)).select(
        *ACCOUNT, "row_idx", "description", "period_end", "v.variant", "scope", F.col("v.value").alias("value"))


# ---- composition ---------------------------------------------------------

def latest_two(lines: DataFrame) -> DataFrame:
    """Component lines with their figures at the account's last two periods."""
    p = account_periods(lines).select(*ACCOUNT, F.element_at("periods", -1).alias("latest"),
                                      F.get("periods", F.size("periods") - 2).alias("prior"))
    at = lambda c: F.coalesce(F.sum(F.when(F.col("period_end") == F.col(c), F.col("amount"))), F.lit(0)).cast("decimal(20,2)")
    return (lines.where(~row_type(F.col("description")).isin("total", "subtotal")).join(p, ACCOUNT)
            .where(F.col("period_end").isin(F.col("latest"), F.col("prior")))
            .groupBy(*LINE, "latest", "prior").agg(at("latest").alias("curr"), at("prior").alias("prev")))


def composition_residual(lines: DataFrame, contra=CONTRA_MARKERS, adjustment=ADJUSTMENT_MARKERS) -> DataFrame:
    """Top three components, the remainder as an amount, and the gross / contra / adjustment split."""
    c = latest_two(lines).where("curr <> 0")
    d = F.col("description")
    bucket = F.when(contains_any(d, contra), "contra").when(contains_any(d, adjustment), "adjustment").otherwise("gross")
    part = lambda name: F.sum(F.when(bucket == name, F.col("curr"))).cast("decimal(20,2)")
    sums = c.groupBy(*ACCOUNT, "latest").agg(
        F.count(F.lit(1)).alias("components"), F.sum("curr").cast("decimal(20,2)").alias("total"),
        part("gross").alias("gross"), part("contra").alias("contra"), part("adjustment").alias("adjustment"))
    rank = F.row_number().over(Window.partitionBy(*ACCOUNT).orderBy(F.desc(F.abs("curr")), "row_idx"))
    top = c.withColumn("rank", rank).where("rank <= 3").groupBy(*ACCOUNT).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "description"))),
                                 lambda x: x["description"]), ", ").alias("top3"),
        F.sum("curr").cast("decimal(20,2)").alias("top3_sum"))
    return sums.join(top, ACCOUNT).where("components > 1").select(
        *ACCOUNT, "latest", "components", "total", "top3",
        F.when(F.col("components") > 3, F.col("total") - F.col("top3_sum")).cast("decimal(20,2)").alias("remainder"),
        "gross", "contra", "adjustment")


def composition_insight(lines: DataFrame) -> DataFrame:
    """One finding per account, first that applies: one component carries the movement (>= 60% of a
    >= 10% move); a component appeared or stopped (10% floor); concentration (top1 >= 50% or top3 >= 80%)."""
    c = latest_two(lines)
    delta = F.col("curr") - F.col("prev")
    a = c.groupBy(*ACCOUNT, "latest", "prior").agg(
        F.sum("curr").alias("tc"), F.sum("prev").alias("tp"),
        F.max_by(F.struct("description", delta.alias("delta")), F.struct(F.abs(delta), -F.col("row_idx"))).alias("mover"),
        F.max(F.greatest(F.abs("curr"), F.abs("prev"))).alias("peak"),
        F.max_by("description", F.struct(F.when(F.col("curr") > 0, F.col("curr")), -F.col("row_idx"))).alias("top_label"),
        F.max("curr").alias("top1"), F.count_if(F.col("curr") > 0).alias("n_pos"))
    floor = F.col("peak") * F.lit("0.1").cast("decimal(2,1)")
    changed = c.join(a.select(*ACCOUNT, "peak"), ACCOUNT).withColumn("event", F.when(
        (F.abs("prev") < floor) & (F.abs("curr") >= floor), "appeared").when(
        (F.abs("curr") < floor) & (F.abs("prev") >= floor), "stopped")).where("event IS NOT NULL AND peak > 0").groupBy(*ACCOUNT).agg(
        F.min_by(F.struct("event", "description"), "row_idx").alias("ev"))
    rank = F.row_number().over(Window.partitionBy(*ACCOUNT).orderBy(F.desc("curr"), "row_idx"))
    top3 = c.where("curr > 0").withColumn("r", rank).where("r <= 3").groupBy(*ACCOUNT).agg(F.sum("curr").alias("top3"))
    x = a.join(changed, ACCOUNT, "left").join(top3, ACCOUNT, "left")
    move = F.col("tc") - F.col("tp")
    dbl = lambda col: col.cast("double")
    share = F.try_divide(dbl(F.col("mover.delta")), dbl(move))
    has_prior = F.col("prior").isNotNull()
    moved = has_prior & (F.abs(move) * 10 >= F.greatest(F.abs("tc"), F.abs("tp"))) & (F.greatest(F.abs("tc"), F.abs("tp")) > 0) & (share >= 0.6)
    s1 = F.try_divide(dbl(F.col("top1")), dbl(F.col("tc")))
    s3 = F.try_divide(dbl(F.col("top3")), dbl(F.col("tc")))
    kind = (F.when(moved, "movement").when(has_prior & F.col("ev").isNotNull(), F.col("ev.event"))
            .when((F.col("tc") > 0) & (s1 >= 0.5), "top1")
            .when((F.col("tc") > 0) & (F.col("n_pos") >= 4) & (s3 >= 0.8), "top3"))
    return x.withColumn("insight", kind).where("insight IS NOT NULL").select(
        *ACCOUNT, "insight",
        F.when(F.col("insight") == "movement", F.col("mover.description"))
        .when(F.col("insight").isin("appeared", "stopped"), F.col("ev.description"))
        .when(F.col("insight") == "top1", F.col("top_label")).alias("component"),
        F.round(F.when(F.col("insight") == "movement", share).when(F.col("insight") == "top1", s1)
                .when(F.col("insight") == "top3", s3), 6).alias("share"))


def revenue_ratios(totals: DataFrame, chart: DataFrame, revenue_account: str, receivable_keys: list[str]) -> DataFrame:
    """Receivables in days of revenue; income-statement lines as a share of revenue and how it moved.

    ``totals``: entity_id, account, period_end, amount for full periods only.
    """
    rev = totals.where(F.col("account") == revenue_account)
    p = rev.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("period_end", "amount"))).alias("r")).where(
        "size(r) >= 2").select("entity_id", F.element_at("r", -1).alias("now"), F.element_at("r", -2).alias("before")).where(
        "now.amount > 0")
    x = totals.where(F.col("account") != revenue_account).join(p, "entity_id").where(
        F.col("period_end").isin(F.col("now.period_end"), F.col("before.period_end")))
    x = x.groupBy("entity_id", "account", "now", "before").agg(
        F.sum(F.when(F.col("period_end") == F.col("now.period_end"), F.col("amount"))).alias("own"),
        F.sum(F.when(F.col("period_end") == F.col("before.period_end"), F.col("amount"))).alias("own_prev"))
    x = x.join(chart.select(F.col("tab_name").alias("account"), "mapping_key", "statement_type"), "account")
    size = F.abs("own").cast("double")
    days = size / F.col("now.amount").cast("double") * 365.0
    share = size / F.col("now.amount").cast("double") * 100
    prev_share = F.when((F.col("before.amount") > 0) & (F.abs("own_prev") > 0),
                        F.abs("own_prev").cast("double") / F.col("before.amount").cast("double") * 100)
    is_recv = (F.col("statement_type") == "BS") & F.col("mapping_key").isin(receivable_keys)
    moved = F.abs(share - prev_share) >= F.greatest(F.lit(2.0), prev_share * 0.2)
    return x.where("own IS NOT NULL AND own <> 0").select(
        "entity_id", "account", F.when(is_recv, "days_of_revenue").otherwise("share_of_revenue").alias("ratio"),
        F.round(F.when(is_recv, days).otherwise(share), 4).alias("value"),
        F.round(F.when(~is_recv, prev_share), 4).alias("prior_value"),
        F.when(~is_recv & moved, F.when(share > prev_share, "rose").otherwise("fell")).alias("movement"),
        F.col("statement_type"),
    ).where(((F.col("ratio") == "days_of_revenue") & (F.col("value") > 0) & (F.col("value") < 1095))
            | ((F.col("statement_type") == "IS") & F.col("value").between(0.5, 500))).drop("statement_type")


def topn_with_other(lines: DataFrame, n: int = 5) -> DataFrame:
    """Latest figures: the n-1 largest components, the rest as ``Other``; all n where there are no more."""
    c = latest_two(lines).where("curr <> 0")
    counts = c.groupBy(*ACCOUNT).agg(F.count(F.lit(1)).alias("items"))
    rank = F.row_number().over(Window.partitionBy(*ACCOUNT).orderBy(F.desc(F.abs("curr")), "row_idx"))
    top = c.withColumn("rank", rank).where(F.col("rank") <= n).join(counts, ACCOUNT)
    shown = top.where((F.col("items") <= n) | (F.col("rank") < n)).select(*ACCOUNT, "rank", F.col("description").alias("label"),
                                                                        F.col("curr").alias("value"))
    rest = (c.groupBy(*ACCOUNT).agg(F.sum("curr").alias("all"))
            .join(shown.groupBy(*ACCOUNT).agg(F.sum("value").alias("kept")), ACCOUNT)
            .join(counts.where(F.col("items") > n), ACCOUNT)
            .select(*ACCOUNT, F.lit(n).alias("rank"), F.lit("Other").alias("label"),
                    (F.col("all") - F.col("kept")).cast("decimal(20,2)").alias("value")))
    return shown.unionByName(rest)


def variance_sweep(lines: DataFrame, income_accounts: list[str], revenue_account: str, substantive: DataFrame) -> DataFrame:
    """Per entity and account type: flagged and starved accounts, and revenue growth, with portfolio totals.

    ``substantive``: distinct (entity_id, account) that have explanatory notes.
    """
    s = full_series(lines.where(F.col("account").isin(income_accounts))).where("size(series) >= 2")
    s = s.withColumn("scale", F.array_max(F.transform("series", lambda x: F.abs(x["v"]))))
    idx = F.sequence(F.lit(1), F.size("series") - 1)
    a = lambda i: F.element_at("series", i)["v"]
    moves = F.transform(idx, lambda i: F.when(
        (a(i) != 0) & (F.abs(a(i)).cast("double") >= F.col("scale").cast("double") * BASE_SHARE),
        (a(i + 1).cast("double") - a(i).cast("double")) / F.abs(a(i)).cast("double") * 100))
    s = s.withColumn("moves", moves).withColumn("big", F.exists("moves", lambda m: F.abs(m) >= VARIANCE_PCT))
    s = s.join(substantive.select(*ACCOUNT, F.lit(True).alias("explained")), ACCOUNT, "left").withColumn(
        "explained", F.coalesce("explained", F.lit(False))).withColumn("big", F.coalesce("big", F.lit(False)))
    growth = F.when(F.col("account") == revenue_account, F.element_at("moves", -1))
    return s.withColumn("growth", growth).rollup("entity_id", "account").agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("big") & F.col("explained")).alias("flagged"),
        F.count_if(F.col("big") & ~F.col("explained")).alias("starved"),
        F.count_if(~F.col("explained")).alias("without_notes"),
        F.round(F.max("growth"), 4).alias("revenue_growth"), F.grouping_id().alias("level"))


# ---- display -------------------------------------------------------------

def account_display(lines: DataFrame, language: str) -> DataFrame:
    """One unit per account from its largest figure, then bare figures in that unit."""
    peak = lines.groupBy(*ACCOUNT).agg(F.max(F.abs("amount")).alias("peak"))
    x = lines.join(peak, ACCOUNT)
    divisor, label, decimals = display_unit(F.col("peak"), language)
    return x.withColumn("unit", label).withColumn("divisor", divisor).withColumn("decimals", decimals).withColumn(
        "shown", F.when(F.col("decimals") == 2, (F.col("amount") / F.col("divisor")).cast("decimal(24,2)"))
        .when(F.col("decimals") == 1, (F.col("amount") / F.col("divisor")).cast("decimal(24,1)"))
        .otherwise(F.col("amount").cast("decimal(20,0)")).cast("decimal(24,2)")).drop("peak")


# Relabelling of negative retained earnings (fixed values).
NEGATIVE_LABELS = {
    "Chi": (("未分配利润", "未弥补亏损"), ("留存收益", "累计亏损"), ("盈余公积", "亏损")),
    "Eng": (("Retained Earnings", "Accumulated Losses"), ("retained earnings", "accumulated losses"),
            ("Accumulated Profit", "Accumulated Losses")),
}


def relabel_negative(rows: DataFrame, language: str, label: str = "description", value: str = "amount") -> DataFrame:
    new, shown = F.col(label), F.col(value)
    hit = F.lit(False)
    for old, text in reversed(NEGATIVE_LABELS[language]):
        found = F.contains(F.col(label), F.lit(old)) & (F.col(value) < 0)
        new = F.when(found, F.replace(F.col(label), F.lit(old), F.lit(text))).otherwise(new)
        hit = hit | found
    shown = F.when(hit, F.abs(F.col(value))).otherwise(shown)
    return rows.withColumn("display_label", new).withColumn("display_value", shown)


def table_budget(tables: DataFrame, priority=TABLE_PRIORITY, min_rows: int = MIN_TABLE_ROWS, keep: int = MAX_TABLES) -> DataFrame:
    """Which account tables a report keeps: entity_id, account, mapping_key, statement_type, components, position."""
    ranks = F.create_map(*[x for i, k in enumerate(priority) for x in (F.lit(k.lower()), F.lit(i))])
    key = F.lower(F.coalesce("mapping_key", "account"))
    order = [F.when(F.col("statement_type") == "IS", 0).when(F.col("statement_type") == "BS", 1).otherwise(2),
             F.coalesce(F.try_element_at(ranks, key), F.lit(len(priority))), F.desc("components"), key]
    big = F.col("components") >= min_rows
    rank = F.row_number().over(Window.partitionBy("entity_id", big).orderBy(*order))
    return tables.withColumn("rank", F.when(big, rank)).withColumn("decision", F.when(~big, "too few components").when(
        F.col("rank") <= keep, "kept").otherwise("over budget")).select(
        "entity_id", "account", "components", "decision", "position", "rank")
