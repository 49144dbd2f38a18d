"""Run-log and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.functions.prose import estimated_tokens
from tieout.operators import reconcile as R
from tieout.operators import runlog as L
from tieout.plans.recon import RECON
from tieout.plans.registry import query
from tieout.sources import sinks
from tieout.sources.runlog import arriving_logs, parse_logs, read_logs
from tieout.sources.views import read_base
from tieout.streaming import jobs as S

PARSED = """SELECT event_id, stage, concat('account ', account) AS account, CAST(duration_s AS DECIMAL(12,2)) AS duration_s, concat('model-', event_type) AS model,
 CAST(completion_tokens * 40 AS BIGINT) AS prompt_chars, CAST(CASE WHEN ok = 0 THEN 0 ELSE completion_tokens * 4 END AS BIGINT) AS output_chars, CAST(completion_tokens * 11 AS BIGINT) AS tokens_used,
 CAST(completion_tokens * 10 AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens, CAST(completion_tokens * 11 AS BIGINT) AS total_tokens,
 CAST(completion_tokens * 10 AS BIGINT) AS est_prompt_tokens, CAST(completion_tokens AS BIGINT) AS est_output_tokens, CAST(token_cap AS BIGINT) AS expected_max,
 CASE WHEN event_type = 'click' THEN 'estimated' ELSE 'provider_usage' END AS token_source FROM run_log WHERE event_type <> 'signup'"""


@query("run_log_parse", PARSED)
def _(t):
    return parse_logs(t.run_log_line)


RUN_TOTALS = "WITH p AS (" + PARSED + """) SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 8 END AS run, stage, count(*) AS items, sum(duration_s) AS seconds, CAST(sum(total_tokens) AS BIGINT) AS tokens
FROM p GROUP BY ALL"""


def log_tree(t) -> str:
    """The log as a tree of text files, one folder per run; the first run holds a third of all lines."""
    path = sinks.new_path(t.spark, "run-logs")
    run = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 8)
    sinks.write_lines(t.run_log_line.withColumn("run", run), path, ["run"], ["event_id"])
    return path


def run_totals(rows):
    run = F.regexp_extract("file", r"run=(\d+)/", 1).cast("bigint").alias("run")
    return parse_logs(rows).groupBy(run, "stage").agg(F.count(F.lit(1)).alias("items"), F.sum("duration_s").alias("seconds"), F.sum("total_tokens").alias("tokens"))


@query("run_log_files", RUN_TOTALS)
def _(t):
    """Logs written as a tree of text files, found below its folder and parsed."""
    return run_totals(read_logs(t.spark, log_tree(t), "part-*"))


@query("run_log_stream", RUN_TOTALS)
def _(t):
    """The same tree read as arriving files, two at a time."""
    return run_totals(S.drain_append(arriving_logs(t.spark, log_tree(t), "part-*", 2), "run-log-lines"))


@query("stage_stats", "WITH p AS (" + PARSED + """), u AS (SELECT *, CASE WHEN expected_max > 0 THEN completion_tokens / expected_max ELSE 0 END AS use FROM p)
SELECT stage, count(*) AS items, sum(duration_s) AS seconds, round(CAST(sum(duration_s) AS DOUBLE) / count(*), 6) AS avg_seconds, round(sum(completion_tokens) / sum(expected_max), 6) AS cap_use,
  count(*) FILTER (output_chars = 0) AS empty, count(*) FILTER (use >= 0.95) AS near_cap, count(*) FILTER (use > 1.0) AS over_cap,
  count(*) FILTER (token_source <> 'provider_usage') AS estimated, sum(total_tokens) AS total_tokens FROM u GROUP BY ROLLUP (stage)""")
def _(t):
    return L.stage_stats(parse_logs(t.run_log_line))


@query("failure_runs", """WITH x AS (SELECT *, sum(ok) OVER (PARTITION BY stage ORDER BY event_id) AS g FROM run_log)
SELECT stage, count(*) AS failures, min(event_id) AS first_event, max(event_id) AS last_event, min(ts) AS first_ts, max(ts) AS last_ts
FROM x WHERE ok = 0 GROUP BY stage, g HAVING count(*) >= 4""")
def _(t):
    return L.failure_runs(t.run_log)


@query("stage_change", r"""WITH x AS (SELECT account, stage_no, text AS a, lag(text) OVER (PARTITION BY account ORDER BY stage_no) AS b FROM stage_text),
y AS (SELECT *, length(regexp_replace(a, '\s+', '', 'g')) - length(regexp_replace(b, '\s+', '', 'g')) AS d,
  len(regexp_extract_all(b, '➢|■|•|- ')) AS bb, len(regexp_extract_all(a, '➢|■|•|- ')) AS ab FROM x WHERE b IS NOT NULL),
z AS (SELECT account, stage_no, d, list_filter([CASE WHEN regexp_extract_all(b, '(-?[0-9,]+\.?[0-9]*)', 1) <> regexp_extract_all(a, '(-?[0-9,]+\.?[0-9]*)', 1) THEN 'numbers changed' END,
   CASE WHEN bb > ab THEN 'bullets stripped' WHEN ab > bb THEN 'bullets added' END,
   CASE WHEN regexp_matches(b, '建议|應注意|应关注|建議|You should|we recommend|recommend that', 'i') AND NOT regexp_matches(a, '建议|應注意|应关注|建議|You should|we recommend|recommend that', 'i') THEN 'advisory removed' END,
   CASE WHEN d < -20 THEN 'shortened' WHEN d > 20 THEN 'lengthened' END], lambda t: t IS NOT NULL) AS tags FROM y)
SELECT account, stage_no, CAST(d AS BIGINT) AS length_change, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['cosmetic only'] END) AS change FROM z""")
def _(t):
    return L.stage_changes(t.stage_text)


WIN = """SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, stage, count(*) AS items, count(*) FILTER (ok = 0) AS failures,
 CAST(sum(duration_s) AS DECIMAL(20,2)) AS seconds, CAST(sum(completion_tokens) AS BIGINT) AS tokens FROM run_log GROUP BY ALL"""


@query("windowed_stage_stats", WIN)
def _(t):
    return L.windowed_stats(t.run_log)


@query("token_estimate", "SELECT account, stage_no, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM stage_text")
def _(t):
    return t.stage_text.select("account", "stage_no", estimated_tokens(F.col("text")).alias("tokens"))


def log_stream(t):
    """The events file as a stream, shaped like ``run_log``."""
    raw = S.arriving(t.spark, t.sf_dir, "events.parquet", read_base(t.spark, t.sf_dir, "events").schema)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("stage_"), (F.col("user_id") % 4).cast("string")).alias("stage"),
                      F.col("value").cast("decimal(10,2)").alias("duration_s"),
                      F.when(F.col("event_type") == "error", 0).otherwise(1).alias("ok"),
                      F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("completion_tokens"))


@query("stream_stage_stats", "SELECT * FROM (" + WIN + ") WHERE window_end <= (SELECT max(ts) FROM run_log) - INTERVAL 1 DAY")
def _(t):
    return S.drain_append(S.stage_windows(log_stream(t)), "stage-windows")


CLOSED = "WHERE window_end <= (SELECT max(ts) FROM run_log) - INTERVAL 1 DAY"


@query("stream_sliding_stats", """WITH e AS (SELECT r.*, date_trunc('hour', ts) - o.o * INTERVAL 1 HOUR AS window_start FROM run_log r, (VALUES (0), (1)) o(o)),
w AS (SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, stage, count(*) AS items, count(*) FILTER (ok = 0) AS failures,
 CAST(sum(duration_s) AS DECIMAL(20,2)) AS seconds, CAST(sum(completion_tokens) AS BIGINT) AS tokens FROM e GROUP BY ALL) SELECT * FROM w """ + CLOSED)
def _(t):
    return S.drain_append(S.stage_windows(log_stream(t), "sliding"), "sliding-windows")


@query("stream_session_stats", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY stage ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM run_log),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY stage ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT min(ts) AS window_start, max(ts) + INTERVAL 10 MINUTE AS window_end, stage, count(*) AS items FROM h GROUP BY stage, k) SELECT * FROM w """ + CLOSED)
def _(t):
    return S.drain_append(S.stage_windows(log_stream(t), "session"), "session-windows")


@query("stream_breaker", """WITH x AS (SELECT *, sum(ok) OVER (PARTITION BY stage ORDER BY event_id) AS g FROM run_log),
y AS (SELECT stage, event_id, row_number() OVER (PARTITION BY stage, g ORDER BY event_id) AS failures FROM x WHERE ok = 0)
SELECT stage, event_id, failures FROM y WHERE failures = 4""")
def _(t):
    return S.drain_append(S.breaker(log_stream(t)), "breaker")


@query("stream_reconcile", "WITH " + RECON + "SELECT r.*, x.amount AS prior_tab FROM recon r LEFT JOIN schedule_line x ON x.entity_id = r.entity_id AND x.account = r.tab_account AND x.period_end = r.prior_date")
def _(t):
    """Entities arrive as supplier rows; each micro-batch reconciles the entities it brought."""
    arrivals = S.arriving(t.spark, t.sf_dir, "supplier.parquet", read_base(t.spark, t.sf_dir, "supplier").schema).select(
        F.col("s_suppkey").cast("bigint").alias("entity_id"))

    def per_batch(batch):
        ids = batch.distinct()
        return R.reconcile(t.statement_full.join(ids, "entity_id", "left_semi"),
                           t.schedule_line.join(ids, "entity_id", "left_semi"), t.account_alias)

    return t.spark.read.parquet(S.drain_batches(arrivals, per_batch, "stream-recon")).drop("batch")


@query("stream_balances", """WITH l AS (SELECT CAST(l_suppkey AS BIGINT) AS entity_id, l_returnflag AS account, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  l_quantity > l_suppkey % 8 AND NOT (l_returnflag = 'N' AND l_suppkey % 11 = 0) AS scheduled FROM lineitem),
b AS (SELECT entity_id, account, CAST(sum(cents) AS BIGINT) AS statement, CAST(coalesce(sum(cents) FILTER (scheduled), 0) AS BIGINT) AS schedule,
  count(*) AS statement_lines, count(*) FILTER (scheduled) AS schedule_lines FROM l GROUP BY ALL)
SELECT *, abs(statement - schedule) AS gap, CASE WHEN schedule_lines = 0 THEN '⚠️ Not Found' WHEN abs(statement - schedule) <= 100 THEN '✅ Match'
  WHEN 200 * abs(statement - schedule) <= abs(statement) THEN '✅ Immaterial' ELSE '❌ Diff' END AS status FROM b""")
def _(t):
    """Ledger lines arrive; the schedule side lacks small lines of most entities and one account of some."""
    raw = S.arriving(t.spark, t.sf_dir, "lineitem.parquet", read_base(t.spark, t.sf_dir, "lineitem").schema)
    scheduled = F.expr("l_quantity > l_suppkey % 8 AND NOT (l_returnflag = 'N' AND l_suppkey % 11 = 0)")
    sides = F.when(scheduled, F.array(F.lit("statement"), F.lit("schedule"))).otherwise(F.array(F.lit("statement")))
    lines = raw.select(F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("account"),
                       F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.explode(sides).alias("side"))
    return S.present(S.drain_append(S.balances(lines), "stream-balances"))
