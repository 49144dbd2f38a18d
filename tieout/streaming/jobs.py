"""Structured Streaming jobs. Each one drains what has arrived and stops; checkpoints live in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tieout.operators.reconcile import DIFF, IMMATERIAL, MATCH, NOT_FOUND, TOLERANCE
from tieout.operators.runlog import windowed_stats
from tieout.sources.sinks import new_path


def arriving(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """Parquet files of one name landing in ``folder``, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", 64).parquet(folder)


def drain_batches(stream: DataFrame, per_batch, name: str) -> str:
    """Run ``per_batch(df)`` for every micro-batch and keep its rows; replays overwrite their own batch folder."""
    spark = stream.sparkSession
    out, mark = new_path(spark, name), new_path(spark, f"{name}-checkpoint")

    def write(df: DataFrame, batch_id: int) -> None:
        per_batch(df).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return out


def drain_append(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    out, mark = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


BREAKER_OUT = "stage string, event_id bigint, failures bigint"


def _count_failures(key, batches, state: GroupState):
    """Carry the current run of failures of one stage; emit the event that trips the breaker."""
    run = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("event_id")
    ok = rows["ok"].to_numpy() == 1
    # Failures since the last success, for all rows at once.
    idx = pd.Series(range(1, len(rows) + 1))
    last_ok = idx.where(pd.Series(ok)).ffill()
    length = (idx - last_ok.fillna(-run)).where(~pd.Series(ok), 0).astype("int64")
    state.update((int(length.iloc[-1]) if len(length) else run,))
    hit = (length == BREAKER_LIMIT).to_numpy()
    yield pd.DataFrame({"stage": key[0], "event_id": rows["event_id"].to_numpy()[hit], "failures": length.to_numpy()[hit]})


BREAKER_LIMIT = 4


def breaker(log_stream: DataFrame) -> DataFrame:
    """Events at which a stage reaches the failure limit, with the run carried across micro-batches.

    The per-stage state is one counter; what one task sees is a stage's share of a
    single micro-batch, which ``maxFilesPerTrigger`` bounds.
    """
    return log_stream.select("stage", "event_id", "ok").groupBy("stage").applyInPandasWithState(
        _count_failures, BREAKER_OUT, "run bigint", "append", GroupStateTimeout.NoTimeout)


def stage_windows(log_stream: DataFrame, kind: str = "tumbling", delay: str = "1 day") -> DataFrame:
    """Stage statistics per closed window; repeated and late events are dropped."""
    x = log_stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    if kind == "tumbling":
        return windowed_stats(x, "1 hour")
    if kind == "sliding":
        return windowed_stats(x, "2 hours", "1 hour")
    return x.groupBy(F.session_window("ts", "10 minutes"), "stage").agg(F.count(F.lit(1)).alias("items")).select(
        F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), "stage", "items")


TOTALS = ["statement", "schedule", "statement_lines", "schedule_lines"]
KEYED_TOTALS = "entity_id bigint, account string, " + ", ".join(f"{c} bigint" for c in TOTALS)


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Totals per key of each Arrow batch, so a key with most lines sends one row a batch to its state."""
    for batch in batches:
        yield batch.groupby(["entity_id", "account"], as_index=False)[TOTALS].sum()


def _balance(key, batches, state: GroupState):
    """Add what arrived to a key's totals; tell its reconciliation anew."""
    *totals, change = state.get if state.exists else (0, 0, 0, 0, 0)
    for batch in batches:
        totals = [a + int(b) for a, b in zip(totals, batch[TOTALS].sum())]
    state.update((*totals, change + 1))
    statement, schedule, _, schedule_lines = totals
    gap = abs(statement - schedule)
    if not schedule_lines:
        status = NOT_FOUND
    elif gap <= 100 * TOLERANCE:
        status = MATCH
    else:
        status = IMMATERIAL if 200 * gap <= abs(statement) else DIFF
    yield pd.DataFrame([(*key, *totals, gap, status, change + 1)], columns=["entity_id", "account", *TOTALS, "gap", "status", "change"])


def balances(lines: DataFrame) -> DataFrame:
    """Arriving lines to the reconciliations they change, one row per touched key and micro-batch.

    ``lines``: entity_id, account, side (statement or schedule) and cents, an integer; null
    cents count as zero, lines without entity, account or a known side have no balance and are
    left out. The state of a key is four totals and a change number, so a micro-batch costs
    what it brought: nothing that came before is read again. A row with the highest
    ``change`` of its key holds the key's present state.
    """
    known = lines.where("entity_id IS NOT NULL AND account IS NOT NULL AND side IN ('statement', 'schedule')")
    cents = F.coalesce(F.col("cents"), F.lit(0)).cast("bigint")
    sided = known.select(F.col("entity_id").cast("bigint"), F.col("account").cast("string"),
                         *[F.when(F.col("side") == s, cents).otherwise(0).alias(s) for s in ("statement", "schedule")],
                         *[(F.col("side") == s).cast("bigint").alias(f"{s}_lines") for s in ("statement", "schedule")])
    return sided.mapInPandas(_folded, KEYED_TOTALS).groupBy("entity_id", "account").applyInPandasWithState(
        _balance, KEYED_TOTALS + ", gap bigint, status string, change bigint", ", ".join(f"{c} bigint" for c in [*TOTALS, "change"]),
        "append", GroupStateTimeout.NoTimeout)


def present(changes: DataFrame) -> DataFrame:
    """The last reconciliation of every key."""
    rest = [c for c in changes.columns if c not in ("entity_id", "account", "change")]
    return changes.groupBy("entity_id", "account").agg(F.max_by(F.struct(*rest), "change").alias("x")).select("entity_id", "account", "x.*")
