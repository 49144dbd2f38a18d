"""Run-log statistics: stages, caps, failure runs, and what each stage changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions import blocks

BULLETS = "➢|■|•|- "
ADVISORY = "(?i)建议|應注意|应关注|建議|You should|we recommend|recommend that"
NUMBERS = r"(-?[0-9,]+\.?[0-9]*)"
FAILURE_LIMIT = 4


def stage_stats(log: DataFrame) -> DataFrame:
    """Per stage and overall: items, seconds, cap use, empty, near-cap, over-cap and estimated-token items."""
    use = F.when(F.col("expected_max") > 0, F.col("completion_tokens") / F.col("expected_max")).otherwise(0.0)
    x = log.withColumn("use", use)
    return x.rollup("stage").agg(
        F.count(F.lit(1)).alias("items"), F.sum("duration_s").cast("decimal(22,2)").alias("seconds"),
        F.round(F.sum("duration_s").cast("double") / F.count(F.lit(1)), 6).alias("avg_seconds"),
        F.round(F.sum(F.col("completion_tokens")) / F.sum("expected_max"), 6).alias("cap_use"),
        F.count_if(F.col("output_chars") == 0).alias("empty"), F.count_if(F.col("use") >= 0.95).alias("near_cap"),
        F.count_if(F.col("use") > 1.0).alias("over_cap"),
        F.count_if(F.col("token_source") != "provider_usage").alias("estimated"),
        F.sum("total_tokens").alias("total_tokens"))


def failure_runs(log: DataFrame, limit: int = FAILURE_LIMIT) -> DataFrame:
    """Runs of at least ``limit`` failures in a row per stage, by log sequence.

    A stage may hold any share of the log, so its successes are counted range by
    range; a run is then a plain aggregation on (stage, successes so far).
    """
    x = blocks.running_sum(log.select("stage", "event_id", "ts", "ok"), ["stage"], "event_id", F.col("ok"), "successes")
    return x.where("ok = 0").groupBy("stage", "successes").agg(
        F.count(F.lit(1)).alias("failures"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where(F.col("failures") >= limit).drop("successes")


def stage_changes(stages: DataFrame) -> DataFrame:
    """What each stage did to the text of the stage before it.

    The previous stage comes from an equi join on (account, position), so a busy
    account spreads over tasks.
    """
    x = blocks.dense_index(stages.select("account", "stage_no", "text"), ["account"], "stage_no", "pos")
    before = x.select("account", (F.col("pos") + 1).alias("pos"), F.col("text").alias("before"))
    j = x.withColumnRenamed("text", "after").join(before, ["account", "pos"])
    nums = lambda c: F.regexp_extract_all(c, F.lit(NUMBERS), F.lit(1))
    bullets = lambda c: F.regexp_count(F.col(c), F.lit(BULLETS))
    size = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    delta = size("after") - size("before")
    tags = F.filter(F.array(
        F.when(nums("before") != nums("after"), "numbers changed"),
        F.when(bullets("before") > bullets("after"), "bullets stripped").when(bullets("after") > bullets("before"), "bullets added"),
        F.when(F.rlike("before", F.lit(ADVISORY)) & ~F.rlike("after", F.lit(ADVISORY)), "advisory removed"),
        F.when(delta < -20, "shortened").when(delta > 20, "lengthened")), lambda t: t.isNotNull())
    return j.select("account", "stage_no", delta.cast("bigint").alias("length_change"),
                    F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("cosmetic only")))).alias("change"))


def windowed_stats(log: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Stage statistics per event-time window; the same expression serves batch and stream."""
    return log.groupBy(F.window("ts", size, slide), "stage").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("ok") == 0).alias("failures"),
        F.sum("duration_s").cast("decimal(20,2)").alias("seconds"), F.sum("completion_tokens").alias("tokens")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "stage", "items", "failures",
        "seconds", "tokens")
