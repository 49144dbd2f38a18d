"""Parents and parts among schedule rows: by sums, by indent, and across periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions import blocks
from tieout.functions.labels import row_type
from tieout.sources.sinks import cut_lineage

# Fixed values.
MAX_PARTS, NEST_REACH, TIE = 19, 8, "0.005"


def _tolerance(v: Column, ratio: str = TIE) -> Column:
    return F.greatest(F.lit(1).cast("decimal(26,5)"), (F.abs(v) * F.lit(ratio).cast("decimal(4,3)")).cast("decimal(26,5)"))


def implicit_breakdowns(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are parts of a parent above them: the parent equals the running sum of two or more smaller rows.

    Only where a sheet has no total rows. Earlier parents claim rows first.
    Returns (keys, parent_row, row_idx).
    """
    x = lines.withColumn("kind", row_type(F.col("description")))
    totals = x.where(F.col("kind").isin("total", "subtotal")).select(*keys).distinct()
    x = blocks.dense_index(x.join(totals, keys, "left_anti"), keys, "row_idx", "pos")
    nxt = lambda w: {"nxt": F.collect_list(F.struct("amount", "kind", "row_idx")).over(w.rowsBetween(1, MAX_PARTS))}
    x = blocks.with_following(x, keys, "pos", MAX_PARTS, nxt)
    x = x.where((F.col("kind") == "detail") & (F.abs("amount") >= 1))
    state = "struct<sum:decimal(26,2),n:int,hit:int,open:boolean>"
    start = F.struct(F.lit(0).cast("decimal(26,2)").alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("hit"), F.lit(True).alias("open")).cast(state)

    def step(acc, c):
        v = F.coalesce(c["amount"], F.lit(0).cast("decimal(20,2)"))
        fits = acc["open"] & (c["kind"] == "detail") & (F.abs(v) < F.abs(F.col("amount")))
        total = (acc["sum"] + v).cast("decimal(26,2)")
        n = acc["n"] + 1
        hit = fits & (n >= 2) & (F.abs(total - F.col("amount")) <= _tolerance(F.col("amount")))
        return F.when(~fits, F.struct(acc["sum"].alias("sum"), acc["n"].alias("n"), acc["hit"].alias("hit"), F.lit(False).alias("open"))).otherwise(
            F.struct(total.alias("sum"), n.alias("n"), F.when(hit, n).otherwise(acc["hit"]).alias("hit"), (~hit).alias("open"))).cast(state)

    # outer: the fold is worked out once; the parts' rows travel with their parent
    x = x.select(*keys, "pos", "row_idx", "nxt", F.explode_outer(F.array(F.aggregate("nxt", start, step)["hit"])).alias("hit")).where("hit > 0").select(
        *keys, F.col("pos").alias("first"), (F.col("pos") + F.col("hit")).alias("last"), F.col("row_idx").alias("parent_row"), F.slice("nxt.row_idx", F.lit(1), F.col("hit")).alias("parts"))
    x = cut_lineage(x, "breakdowns")
    kept = blocks.claim_intervals(x.select(*keys, "first", "last"), keys, "first", "last", MAX_PARTS)
    return x.join(kept, [*keys, "first", "last"]).select(*keys, "parent_row", F.explode("parts").alias("row_idx"))


def indent_parents(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with ``parent_row``: the nearest row above with a smaller indent.

    The last row of every level that occurs is carried down as one column each; the
    parent is the latest of the smaller levels. Levels come from the data; the file
    format bounds them (250 in a spreadsheet).
    """
    found = sorted(r[0] for r in lines.select("indent").where("indent IS NOT NULL").distinct().collect())
    if not found:
        return lines.withColumn("parent_row", F.lit(None).cast(lines.schema["row_idx"].dataType))
    levels = {f"l{k}": F.when(F.col("indent") == i, F.col("row_idx")) for k, i in enumerate(found)}
    x = blocks.running_max(lines, keys, "row_idx", levels)
    above = [F.when(F.col("indent") > i, F.col(f"l{k}")) for k, i in enumerate(found)]
    parent = F.greatest(*above) if len(above) > 1 else above[0]
    return x.withColumn("parent_row", parent).drop(*levels)


def indent_rollups(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per parent: confirmed by its own value, mismatched, confirmed by a total row elsewhere, or a label only.

    Totals of value-less parents are looked up by value with a bucketed equi join.
    """
    from tieout.operators.clauses import band_buckets, value_bucket

    x = indent_parents(lines, keys)
    kids = x.where("parent_row IS NOT NULL").groupBy(*keys, "parent_row").agg(
        F.count(F.lit(1)).alias("children"), F.count("amount").alias("valued"), F.sum("amount").cast("decimal(24,2)").alias("child_sum"))
    parents = lines.select(*keys, F.col("row_idx").alias("parent_row"), F.col("amount").alias("parent_value"), F.col("description"))
    p = kids.join(parents, [*keys, "parent_row"])
    first = (F.when(F.col("parent_value").isNull(), "label").when(F.col("valued") < F.col("children"), "incomplete")
             .when(F.abs(F.col("parent_value") - F.col("child_sum")) <= _tolerance(F.col("parent_value")), "confirmed").otherwise("mismatch"))
    p = p.withColumn("status", first)
    orphan = p.where("status = 'label' AND abs(child_sum) >= 1").select(*keys, "parent_row", "child_sum").withColumn(
        "b", value_bucket(F.abs("child_sum"), 1, 0.005))
    totals = lines.where(row_type(F.col("description")).isin("total", "subtotal") & F.col("amount").isNotNull()).select(
        *keys, F.col("amount").alias("total")).withColumn("b", F.explode(band_buckets(F.abs("total"), 1, 0.005)))
    hit = orphan.join(totals, [*keys, "b"]).where(F.abs(F.col("total") - F.col("child_sum")) <= _tolerance(F.col("child_sum")))
    hit = hit.groupBy(*keys, "parent_row").agg(F.min("total").alias("lo"), F.max("total").alias("hi")).where("lo = hi").select(
        *keys, "parent_row", F.lit(True).alias("by_total"))
    return p.join(hit, [*keys, "parent_row"], "left").withColumn(
        "status", F.when(F.col("by_total"), "confirmed by total").otherwise(F.col("status"))).select(
        *keys, "parent_row", "description", "children", "parent_value", "child_sum", "status")


def nest_components(lines: DataFrame, keys: list[str], tolerance: str = "0.020") -> DataFrame:
    """Components whose next 2..8 rows add up to them in every period they have.

    ``lines``: keys, row_idx, period_end, amount. Returns (keys, parent_row, row_idx).
    """
    folded = lines.groupBy(*keys, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("period_end", "amount"))).alias("m"))
    x = blocks.dense_index(folded, keys, "row_idx", "pos")
    nxt = lambda w: {"nxt": F.collect_list("m").over(w.rowsBetween(1, NEST_REACH))}
    x = blocks.with_following(x, keys, "pos", NEST_REACH, nxt)
    zero = F.lit(0).cast("decimal(26,2)")

    def ties(n: int) -> Column:
        part = F.slice("nxt", 1, n)
        return (F.size("nxt") >= n) & F.forall(F.map_keys("m"), lambda p: F.abs(
            F.aggregate(part, zero, lambda a, c: (a + F.coalesce(F.try_element_at(c, p), F.lit(0).cast("decimal(20,2)"))).cast("decimal(26,2)"))
            - F.try_element_at("m", p)) <= _tolerance(F.try_element_at("m", p), tolerance))

    size = F.coalesce(*[F.when(ties(n), n) for n in range(2, NEST_REACH + 1)])
    c = x.withColumn("size", size).where("size IS NOT NULL").select(*keys, F.col("pos").alias("first"), (F.col("pos") + F.col("size")).alias("last"))
    kept = blocks.claim_intervals(c, keys, "first", "last", NEST_REACH)
    rows = x.select(*keys, "pos", "row_idx")
    parts = kept.withColumn("pos", F.explode(F.sequence(F.col("first") + 1, F.col("last")))).join(rows, [*keys, "pos"])
    return parts.join(rows.select(*keys, F.col("pos").alias("first"), F.col("row_idx").alias("parent_row")), [*keys, "first"]).select(
        *keys, "parent_row", "row_idx")
