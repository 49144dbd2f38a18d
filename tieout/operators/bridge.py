"""Price-area-days revenue bridges over monthly operating figures.

``metric_month`` holds one row per entity, phase and active month. Idle months
have no row, so operating days come from the entity's own month calendar.
Groups here are phases by years, bounded by the calendar once the ledger has
been aggregated; the ledger itself is only touched by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASE = ["entity_id", "phase"]
PARTIAL_YEAR_DAYS = 350  # fixed value
# Factor names in bridge labels (fixed values), tested in this order.
FACTOR_WORDS = (("days", ("运营天数", "運營天數", "运营天", "運營天", "天数", "天數")),
                ("price", ("单价", "單價")), ("area", ("出租率", "面积", "面積")))
FACTOR_SUFFIX = {"price": "单价变动", "area": "出租率/面积变动", "days": "运营天数变动"}


def _dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def phase_records(metric: DataFrame) -> DataFrame:
    """One record per phase: its active months, the entity's month calendar, and the month it began.

    Months are numbered year * 12 + month. Both arrays are as long as the calendar
    at most, so all yearly and trailing figures come from this one join.
    """
    m = (F.col("yr") * 12 + F.col("mo")).cast("int")
    active = (F.col("area") != 0) | (F.col("revenue") != 0)
    phases = metric.groupBy(*PHASE).agg(
        F.min(F.when(active, m)).alias("start"),
        F.collect_list(F.struct(m.alias("m"), "area", "revenue")).alias("months"))
    calendar = metric.groupBy("entity_id", m.alias("m")).agg(F.max("days").alias("days")).groupBy("entity_id").agg(
        F.sort_array(F.collect_list(F.struct("m", "days"))).alias("calendar"))
    return phases.where("start IS NOT NULL").join(calendar, "entity_id")


def _span(lo: Column, hi: Column) -> list[Column]:
    """Revenue, mean positive area, days since the start, and unit rent over months lo..hi."""
    money = "decimal(24,2)"
    zero = F.lit(0).cast(money)
    inside = F.filter("months", lambda x: (x["m"] >= lo) & (x["m"] <= hi))
    let = F.filter(inside, lambda x: x["area"] > 0)
    revenue = _dbl(F.aggregate(inside, zero, lambda t, x: (t + x["revenue"]).cast(money)))
    area = F.when(F.size(let) > 0, _dbl(F.aggregate(let, zero, lambda t, x: (t + x["area"]).cast(money))) / F.size(let)).otherwise(0.0)
    days = F.aggregate(F.filter("calendar", lambda x: (x["m"] >= F.greatest(lo, F.col("start"))) & (x["m"] <= hi)),
                       F.lit(0).cast("bigint"), lambda t, x: t + x["days"])
    return [revenue.alias("revenue"), area.alias("area"), days.alias("days")]


def _with_rent(df: DataFrame) -> DataFrame:
    return df.withColumn("unit_rent", F.when((F.col("area") != 0) & (F.col("days") != 0),
                                             F.col("revenue") / F.col("area") / F.col("days")).otherwise(0.0))


def periods_of(records: DataFrame) -> DataFrame:
    """Calendar years of every phase, then the trailing twelve months where none of them is missing."""
    last = F.element_at("calendar", -1)["m"]
    year = lambda m: F.floor((m - 1) / 12).cast("int")
    years = F.transform(F.array_distinct(F.transform("calendar", lambda x: year(x["m"]))), lambda y: F.struct(
        y.alias("yr"), F.lit(False).alias("is_ltm"), (y * 12 + 1).alias("lo"), (y * 12 + 12).alias("hi")))
    complete = F.size(F.filter("calendar", lambda x: x["m"] > last - 12)) == 12
    tail = F.when(complete, F.array(F.struct(year(last).alias("yr"), F.lit(True).alias("is_ltm"),
                                             (last - 11).alias("lo"), last.alias("hi")))).otherwise(F.slice(years, 1, 0))
    x = records.withColumn("p", F.explode(F.concat(years, tail)))
    lo, hi = F.col("p.lo"), F.col("p.hi")
    return _with_rent(x.select(*PHASE, "p.yr", "p.is_ltm", "p.hi", *_span(lo, hi)))


def annual_series(metric: DataFrame) -> DataFrame:
    """Revenue sum, mean area over positive months, days since the phase began, and unit rent, per calendar year."""
    return periods_of(phase_records(metric)).where("NOT is_ltm").drop("is_ltm", "hi")


def ltm(metric: DataFrame) -> DataFrame:
    """The trailing twelve months up to the latest month with data; nothing where a month is missing."""
    x = periods_of(phase_records(metric)).where("is_ltm")
    month = lambda m: (F.pmod(m - 1, F.lit(12)) + 1).cast("int")
    year = lambda m: F.floor((m - 1) / 12).cast("int")
    hi, lo = F.col("hi"), F.col("hi") - 11
    text = lambda c: c.cast("string")
    label = F.concat(text(year(lo)), F.lit("年"), text(month(lo)), F.lit("月至"), text(year(hi)), F.lit("年"),
                     text(month(hi)), F.lit("月收入"))
    return x.select(*PHASE, "revenue", "area", "days", "unit_rent", year(hi).alias("end_year"),
                    month(hi).alias("end_month"), label.alias("label"))


def transitions(metric: DataFrame) -> DataFrame:
    """Consecutive full years per phase; last full year to LTM where the latest year is partial.

    Windows are per entity or per phase of one entity, over years: a few dozen rows each.
    """
    x = periods_of(phase_records(metric))
    entity = Window.partitionBy("entity_id")
    x = x.withColumn("max_yr", F.max(F.when(~F.col("is_ltm"), F.col("yr"))).over(entity))
    x = x.withColumn("tail_days", F.max(F.when((F.col("yr") == F.col("max_yr")) & ~F.col("is_ltm"), F.col("days"))).over(entity))
    partial = (F.col("tail_days") > 0) & (F.col("tail_days") < PARTIAL_YEAR_DAYS)
    x = x.where(F.when(F.col("is_ltm"), partial).otherwise(~partial | (F.col("yr") < F.col("max_yr"))))
    values = ("revenue", "area", "days", "unit_rent")
    nxt = F.lead(F.struct("yr", "is_ltm", *values)).over(Window.partitionBy(*PHASE).orderBy("yr", "is_ltm"))
    return x.withColumn("b", nxt).where("b IS NOT NULL").select(
        *PHASE, F.col("yr").alias("year_a"), F.col("b.yr").alias("year_b"), F.col("b.is_ltm").alias("is_ltm"),
        *[F.col(v).alias(f"{v}_a") for v in values], *[F.col(f"b.{v}").alias(f"{v}_b") for v in values])


def with_factors(pairs: DataFrame) -> DataFrame:
    """Price, area and days effects in thousands."""
    return (pairs
            .withColumn("price", (F.col("unit_rent_b") - F.col("unit_rent_a")) * F.col("area_a") * F.col("days_a") / 1000)
            .withColumn("area", F.col("unit_rent_b") * (F.col("area_b") - F.col("area_a")) * F.col("days_a") / 1000)
            .withColumn("days", F.col("unit_rent_b") * F.col("area_b") * (F.col("days_b") - F.col("days_a")) / 1000))


def bridge_items(pairs: DataFrame) -> DataFrame:
    """Start total, three factors per phase, end total, numbered in display order; values to 4 decimals.

    The first phase of a transition also emits its start total and the last one its
    end total, so the pairs are read once.
    """
    key = ["entity_id", "year_a", "year_b", "is_ltm"]
    whole, ordered = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("phase")
    money = lambda c: F.sum(F.col(c).cast("decimal(24,2)")).over(whole) / 1000
    x = with_factors(pairs).select(
        *key, "phase", "price", "area", "days", F.row_number().over(ordered).alias("k"),
        F.count(F.lit(1)).over(whole).alias("n"), money("revenue_a").alias("s"), money("revenue_b").alias("e"))

    def item(no: Column, label: Column, kind: str, value: Column) -> Column:
        return F.struct(no.cast("int").alias("item_no"), label.alias("label"), F.lit(kind).alias("kind"),
                        value.cast("decimal(20,4)").alias("value"))

    end_label = F.when(F.col("is_ltm"), F.lit("LTM收入")).otherwise(F.concat(F.col("year_b").cast("string"), F.lit("年收入")))
    items = [item((F.col("k") - 1) * 3 + i + 2, F.concat("phase", F.lit(FACTOR_SUFFIX[n])), "delta", F.round(n, 4))
             for i, n in enumerate(("price", "area", "days"))]
    items.append(F.when(F.col("k") == 1, item(F.lit(1), F.concat(F.col("year_a").cast("string"), F.lit("年收入")), "total", F.col("s"))))
    items.append(F.when(F.col("k") == F.col("n"), item(F.col("n") * 3 + 2, end_label, "total", F.col("e"))))
    return x.select(*key, F.explode(F.filter(F.array(*items), lambda i: i.isNotNull())).alias("i")).select(*key, "i.*")


def waterfall(items: DataFrame) -> DataFrame:
    """Stacked-bar series: a running total that starts again at every total item."""
    key = ["entity_id", "year_a", "year_b", "is_ltm"]
    w = Window.partitionBy(*key).orderBy("item_no")
    is_total = F.col("kind") == "total"
    x = items.withColumn("leg", F.sum(F.when(is_total, 1).otherwise(0)).over(w))
    run = F.sum("value").over(Window.partitionBy(*key, "leg").orderBy("item_no"))
    x = x.withColumn("running", run)
    zero = F.lit(0).cast("decimal(20,4)")
    before = F.col("running") - F.col("value")
    return x.select(*key, "item_no", "label",
                    F.when(is_total, zero).when(F.col("value") >= 0, before).otherwise(F.col("running")).cast("decimal(24,4)").alias("base"),
                    F.when(is_total, F.col("value")).otherwise(zero).alias("total"),
                    F.when(~is_total & (F.col("value") >= 0), F.col("value")).otherwise(zero).alias("increase"),
                    F.when(~is_total & (F.col("value") < 0), -F.col("value")).otherwise(zero).alias("decrease"))


def residuals(items: DataFrame) -> DataFrame:
    """Start plus factors against the end total; tie within max(5, 2%)."""
    key = ["entity_id", "year_a", "year_b", "is_ltm"]
    r = items.groupBy(*key).agg(
        F.min_by("value", "item_no").alias("start"), F.max_by("value", "item_no").alias("end"),
        F.sum(F.when(F.col("kind") == "delta", F.col("value"))).cast("decimal(24,4)").alias("factors"))
    gap = F.col("start") + F.col("factors") - F.col("end")
    return r.withColumn("residual", gap.cast("decimal(24,4)")).withColumn(
        "ties", F.abs("residual") < F.greatest(F.lit(5.0), F.abs(_dbl("end")) * 0.02))


def bridge_audit(items: DataFrame, used: DataFrame, recomputed: DataFrame, residual_limit: float) -> DataFrame:
    """Per transition: phases whose inputs do not re-derive, the residual in %, and a verdict."""
    key = ["entity_id", "year_a", "year_b", "is_ltm"]
    r = recomputed.select(*PHASE, "yr", F.col("revenue").alias("r2"), F.col("area").alias("a2"), F.col("days").alias("d2"))

    def off(side: str) -> DataFrame:
        s = used.where(~F.col("is_ltm") | F.lit(side == "a")).join(
            r.withColumnRenamed("yr", f"year_{side}"), [*PHASE, f"year_{side}"], "left")
        bad = ((F.abs(F.col(f"revenue_{side}") - F.col("r2")) > 1.0) | (F.abs(F.col(f"area_{side}") - F.col("a2")) > 0.01)
               | (F.abs(F.col(f"days_{side}") - F.col("d2")) > 0.5) | F.col("r2").isNull())
        return s.select(*key, bad.cast("int").alias("bad"))

    bad = off("a").unionByName(off("b")).groupBy(*key).agg(F.sum("bad").alias("mismatches"))
    out = residuals(items).join(bad, key)
    pct = F.when(F.col("end") != 0, _dbl("residual") / _dbl("end") * 100).otherwise(0.0)
    return out.select(*key, "mismatches", F.round(pct, 6).alias("residual_pct"),
                      F.when((F.col("mismatches") == 0) & (F.abs(pct) <= residual_limit), "ok").otherwise("check").alias("verdict"))


def phase_cross_check(annual: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Sum of phases per year against the sheet's own total rows; best candidate and whether it is within 1%."""
    mine = annual.groupBy("entity_id", "yr").agg(F.sum(F.col("revenue").cast("decimal(24,2)")).alias("mine")).where(F.abs("mine") >= 1)
    total = F.col("total")
    x = mine.join(aggregates, ["entity_id", "yr"]).withColumn(
        "pct", F.when(F.abs(total) > 1, (_dbl(total) - _dbl("mine")) / _dbl(total)))
    best = F.min_by(F.struct("label", "total", "pct"), F.struct(F.coalesce(F.abs("pct"), F.lit(float("inf"))), "row_idx"))
    return x.groupBy("entity_id", "yr", "mine").agg(best.alias("b")).select(
        "entity_id", "yr", "mine", "b.label", "b.total", F.round("b.pct", 6).alias("pct"),
        F.coalesce(F.abs("b.pct") < 0.01, F.lit(False)).alias("ok"))


def classify_label(label: Column) -> tuple[Column, Column]:
    """(phase, factor) of a bridge item label such as ``干仓单价增加``."""
    phase, factor = label, F.lit(None).cast("string")
    for name, words in reversed(FACTOR_WORDS):
        for word in reversed(words):
            hit = F.contains(label, F.lit(word))
            phase = F.when(hit, F.regexp_replace(F.trim(F.substring_index(label, word, 1)), "(运营|運營)$", "")).otherwise(phase)
            factor = F.when(hit, F.lit(name)).otherwise(factor)
    return phase, factor


def compare_bridges(manual: DataFrame, computed: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Hand-built against computed factors, by phase and factor; items on one side only stay."""
    key = ["entity_id", "year_a", "year_b", "phase", "factor"]

    def side(df: DataFrame, name: str) -> DataFrame:
        phase, factor = classify_label(F.col("label"))
        return df.where("kind = 'delta'").withColumn("phase", phase).withColumn("factor", factor).groupBy(*key).agg(
            F.sum("value").cast("decimal(24,4)").alias(name))

    x = side(manual, "manual").join(side(computed, "computed"), key, "full_outer")
    diff = F.col("manual") - F.col("computed")
    return x.withColumn("diff", diff).withColumn("status", F.when(F.col("manual").isNull(), "computed only").when(
        F.col("computed").isNull(), "manual only").when(F.abs(diff) <= tolerance, "equal").otherwise("differs"))
