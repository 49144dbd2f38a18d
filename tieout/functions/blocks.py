"""Ordered operations over groups that may be arbitrarily large.

A plain window sorts a whole group in one task. Here a group is cut into ranges
of its integer order column; each range is ordered on its own, and one small
record per range carries the state across. Only those records, some thousands
of rows fewer than the data, are ever ordered per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.sources.sinks import cut_lineage

RANGE = 4096


def _ranged(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(order) / width))


def dense_index(df: DataFrame, keys: list[str], order: str, name: str, width: int = RANGE) -> DataFrame:
    """1-based position of each row of its group by ``order`` (unique within the group)."""
    x = _ranged(df, order, width)
    counts = x.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return x.join(starts, [*keys, "_range"]).withColumn(name, (local + F.col("_start")).cast("bigint")).drop("_range", "_start")


def fill_forward(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = RANGE) -> DataFrame:
    """Latest non-null ``value`` at or before each row."""
    x = _ranged(df, order, width)
    last = x.groupBy(*keys, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    carried = F.last("_last", True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carry = last.select(*keys, "_range", carried.alias("_carry"))
    local = F.last(value, True).over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return x.join(carry, [*keys, "_range"]).withColumn(name, F.coalesce(local, F.col("_carry"))).drop("_range", "_carry")


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = RANGE) -> DataFrame:
    """Sum of ``value`` over the group's rows up to and including each row."""
    return running_sums(df, keys, order, {name: value}, width)


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = RANGE) -> DataFrame:
    """For each named expression, its sum over the group's rows up to and including each row."""
    return running(df, keys, order, values, {}, width)


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], tops: dict[str, Column], width: int = RANGE) -> DataFrame:
    """``running_sums`` and ``running_max`` in one pass, so that a plan holds ``df`` twice instead of four times."""
    x = _ranged(df.select("*", *[v.alias(f"_v_{n}") for n, v in (sums | tops).items()]), order, width)
    parts = x.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_p_{n}") for n in tops])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_range", *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums],
                          *[F.max(f"_p_{n}").over(before).alias(f"_start_{n}") for n in tops])
    local = Window.partitionBy(*keys, "_range").orderBy(order)
    here, above = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(starts, [*keys, "_range"])
    return x.select(*df.columns, *[(F.sum(f"_v_{n}").over(here) + F.col(f"_start_{n}")).alias(n) for n in sums],
                    *[F.greatest(F.max(f"_v_{n}").over(above), F.col(f"_start_{n}")).alias(n) for n in tops])


def with_following(df: DataFrame, keys: list[str], index: str, reach: int, make, width: int = RANGE) -> DataFrame:
    """Apply ``make(window)`` where each row must see up to ``reach`` rows after it.

    Every range also receives the first ``reach`` rows of the next one, so rows of a
    range find their followers locally; the borrowed copies are dropped again.
    ``index`` is a dense position; ``make`` returns {column name: expression}.
    """
    own = F.floor((F.col(index) - 1) / width)
    lent = F.when(((F.col(index) - 1) % width < reach) & (own > 0), own - 1)
    homes = F.filter(F.array(own, lent), lambda h: h.isNotNull())
    x = df.withColumn("_own", own).withColumn("_home", F.explode(homes))
    w = Window.partitionBy(*keys, "_home").orderBy(index)
    cols = make(w)
    return x.select("*", *[expr.alias(n) for n, expr in cols.items()]).where(F.col("_home") == F.col("_own")).drop("_own", "_home")


def running_max(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = RANGE) -> DataFrame:
    """For each named expression, its maximum over the rows before each row."""
    return running(df, keys, order, {}, values, width)


def claim_intervals(df: DataFrame, keys: list[str], start: str, end: str, reach: int) -> DataFrame:
    """Left to right, keep an interval unless its start lies inside one kept before.

    Intervals span at most ``reach`` positions, so a start that no earlier interval
    covers begins a new island; islands are independent and folded one by one.
    """
    x = blocks_order(df, keys, start)
    covers = lambda w: {"_cover": F.max(end).over(w.rowsBetween(-reach, -1))}
    x = with_preceding(x, keys, "_pos", reach, covers)
    x = x.withColumn("_cut", F.when(F.col("_cover").isNull() | (F.col("_cover") < F.col(start)), F.col("_pos")))
    x = fill_forward(x, keys, "_pos", "_cut", "_island")
    pair = F.struct(F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    kind = "array<struct<s:bigint,e:bigint>>"
    def keep(acc, i):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(-1).cast("bigint"))
        return F.when(i["s"] > last, F.concat(acc, F.array(i))).otherwise(acc).cast(kind)
    kept = x.groupBy(*keys, "_island").agg(F.aggregate(F.sort_array(F.collect_list(pair)), F.array().cast(kind), keep).alias("_k"))
    return kept.select(*keys, F.explode("_k").alias("_i")).select(*keys, F.col("_i.s").alias(start), F.col("_i.e").alias(end))


def claim_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``claim_intervals`` for intervals of any length: (keys, start) of those kept.

    ``start`` is unique within its group. A start that no earlier interval covers is
    kept; from there each kept interval leads to the first start beyond its end. These
    steps are doubled round by round, so a chain of n intervals takes log2(n) rounds.
    """
    x = running_max(df.select(*keys, start, end), keys, start, {"_cover": F.col(end)})
    x = cut_lineage(x.withColumn("_free", F.col("_cover").isNull() | (F.col("_cover") < F.col(start))), "spans")
    # read from the far end: a start at an even place, the question what follows an end at the odd one after it
    here = x.select(*keys, start, (-2 * F.col(start)).alias("_at"), F.struct(F.col(start).alias("s"), F.col("_free").alias("free")).alias("_here"))
    asks = x.select(*keys, start, (-2 * F.col(end) - 1).alias("_at"), F.lit(None).cast(here.schema["_here"].dataType).alias("_here"))
    seen = fill_forward(here.unionByName(asks), keys, "_at", "_here", "_next").where(F.col("_here").isNull())
    step = cut_lineage(seen.where(~F.col("_next.free")).select(*keys, start, F.col("_next.s").alias("_to")), "span-steps")
    kept = x.where("_free").select(*keys, start)
    while not (more := kept.join(step, [*keys, start]).select(*keys, F.col("_to").alias(start))).isEmpty():
        kept = cut_lineage(kept.unionByName(more).distinct(), "spans-kept")
        step = cut_lineage(step.join(step.select(*keys, F.col(start).alias("_to"), F.col("_to").alias("_on")), [*keys, "_to"]).select(*keys, start, F.col("_on").alias("_to")), "span-steps")
    return kept


def blocks_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return dense_index(df, keys, order, "_pos")


def with_preceding(df: DataFrame, keys: list[str], index: str, reach: int, make, width: int = RANGE) -> DataFrame:
    """``with_following`` for rows that must see up to ``reach`` rows before them."""
    own = F.floor((F.col(index) - 1) / width)
    lent = F.when((F.col(index) - 1) % width >= width - reach, own + 1)
    homes = F.filter(F.array(own, lent), lambda h: h.isNotNull())
    x = df.withColumn("_own", own).withColumn("_home", F.explode(homes))
    cols = make(Window.partitionBy(*keys, "_home").orderBy(index))
    return x.select("*", *[e.alias(n) for n, e in cols.items()]).where(F.col("_home") == F.col("_own")).drop("_own", "_home")
