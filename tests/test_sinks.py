"""Sinks and sources of files: order, retries, removal, arriving logs."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tieout.operators import cells as K
from tieout.operators import reconcile as R
from tieout.sources import runlog, sinks


def test_lines_keep_their_order_over_files(spark):
    """One document with most lines is spread over files, whose names keep the order."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 < 2, "long").otherwise("short").alias("doc"), F.col("id").alias("at"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    path = sinks.new_path(spark, "lines")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):  # a second write replaces the first
            sinks.write_lines(rows.orderBy(F.rand(3)), path, ["doc"], ["at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sinks.is_committed(spark, path)
    for doc, keep in (("long", lambda i: i % 3 < 2), ("short", lambda i: i % 3 == 2)):
        files = sorted(Path(path, f"doc={doc}").glob("part-*"))
        assert [x for f in files for x in f.read_text().splitlines()] == [f"line {i}" for i in range(6000) if keep(i)]
    assert len(list(Path(path, "doc=long").glob("part-*"))) > 1
    assert sinks.remove(spark, path) and not Path(path).exists() and not sinks.remove(spark, path) and not sinks.is_committed(spark, path)
    with pytest.raises(ValueError):
        sinks.remove(spark, "/elsewhere/lines")


def test_json_keeps_values_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1, "1.50", "x"), ("a", None, None, 'q"\n'), ("b", 2, "-3.00", None)], "k string, n int, v string, t string").withColumn("v", F.col("v").cast("decimal(20,2)"))
    path = sinks.new_path(spark, "json")
    sinks.write_partitioned(rows, path, ["k"], kind="json")
    got = spark.read.schema(rows.schema).json(path)
    assert sorted(map(tuple, got.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_logs_below_a_folder_and_arriving(spark, tmp_path):
    line = ("INFO [write] Processed: Cash | Duration: 1.50s | Model: m | Prompt chars: 1 | Output chars: 2 | Tokens used: 3 | Prompt tokens: 4 | Completion tokens: 5 | "
            "Total tokens: 6 | Estimated prompt tokens: 7 | Estimated output tokens: 8 | Expected max output tokens: 9 | Token source: est")
    for i, folder in enumerate(("a", "a/b", "c")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "processing.log").write_text("\n".join([line] * (i + 1)) + "\nheartbeat\n")
        (tmp_path / folder / "other.log").write_text(line)
    rows = runlog.parse_logs(runlog.read_logs(spark, str(tmp_path))).collect()
    assert len(rows) == 6 and len({r.file for r in rows}) == 3 and {r.total_tokens for r in rows} == {6}
    out, mark = sinks.new_path(spark, "logs"), sinks.new_path(spark, "logs-mark")
    for _ in range(2):  # the second run finds nothing new
        q = runlog.parse_logs(runlog.arriving_logs(spark, str(tmp_path), files=1)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_column_letters(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 728, 729, 16384]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n int").select(K.column_letters(F.col("n"))).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAZ", "ABA", "XFD"]


def test_account_total_tiers(spark):
    lines = spark.createDataFrame([(1, 0, "Cash", 5), (1, 9, "Total", -7), (2, 0, "Cash", 5), (2, 1, "Total", -7), (3, 0, "Cash", 5), (4, 0, "Cash", 0), (5, 0, "Cash", 5)], "k int, row_idx int, description string, amount int")
    stored = spark.createDataFrame([(1, 11), (5, 0), (6, 12)], "k int, stored_total int")
    auxiliary = spark.createDataFrame([(1, 3), (2, 4), (7, 8)], "k int, auxiliary_total int")
    got = {r.k: r.total for r in R.account_total(lines, ["k"], auxiliary, stored).collect()}
    assert got == {1: 11, 2: -4, 3: 5, 4: None, 5: 0, 6: 12, 7: 8}
    assert {r.k: r.total for r in R.account_total(lines, ["k"], stored=stored).collect()} == {1: 11, 2: -7, 3: 5, 4: None, 5: 0, 6: 12}


def test_late_lines_change_a_reconciliation(spark):
    """Lines arrive in three files, a batch each; the state carries totals, the last row of a key is the batch result."""
    from tieout.streaming import jobs

    schema = "entity_id bigint, account string, side string, cents bigint"
    arrivals = [
        [(1, "Cash", "statement", 100_000), (2, "Cash", "statement", 50), (None, "Cash", "schedule", 5), (1, None, "schedule", 5), (1, "Cash", "note", 5)],
        [(1, "Cash", "schedule", 60_000), (3, "Debt", "schedule", None)],
        [(1, "Cash", "schedule", 39_600), (1, "Cash", "schedule", 100), (2, "Cash", "schedule", 150)] + [(4, "Hot", s, 1) for s in ("statement", "schedule")] * 15_000,
    ]
    folder = sinks.new_path(spark, "arrivals")
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    changes = jobs.drain_append(jobs.balances(stream), "balances")
    seen = {}
    for r in changes.orderBy("change").collect():
        seen.setdefault((r.entity_id, r.account), []).append((r.statement, r.schedule, r.status))
    assert seen[1, "Cash"] == [(100_000, 0, R.NOT_FOUND), (100_000, 60_000, R.DIFF), (100_000, 99_700, R.IMMATERIAL)]
    assert seen[2, "Cash"] == [(50, 0, R.NOT_FOUND), (50, 150, R.MATCH)]
    assert seen[3, "Debt"] == [(0, 0, R.MATCH)] and seen[4, "Hot"] == [(15_000, 15_000, R.MATCH)] and len(seen) == 4
    last = {(r.entity_id, r.account): (r.statement, r.schedule, r.statement_lines, r.schedule_lines) for r in jobs.present(changes).collect()}
    assert last == {(1, "Cash"): (100_000, 99_700, 1, 3), (2, "Cash"): (50, 150, 1, 1), (3, "Debt"): (0, 0, 0, 1), (4, "Hot"): (15_000, 15_000, 15_000, 15_000)}
