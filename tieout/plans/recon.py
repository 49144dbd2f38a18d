"""Reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.operators import reconcile as R
from tieout.plans.registry import query
from tieout.sources import sinks

SKIP_SQL = """(lower(trim(d)) LIKE 'total %' OR regexp_matches(lower(trim(d)),
 'subtotal|sub-total|sub total|gross profit|gross loss|operating profit|operating loss|before taxation|net profit|net loss'))"""

RECON = """
per AS (SELECT entity_id, statement_type, max(period_end) AS date FROM statement_full GROUP BY ALL),
pri AS (SELECT s.entity_id, s.statement_type, max(s.period_end) AS prior_date FROM statement_full s JOIN per p
        ON p.entity_id = s.entity_id AND p.statement_type = s.statement_type AND s.period_end < p.date GROUP BY ALL),
ln AS (SELECT s.entity_id, s.entity, s.statement_type, s.description, p.date, q.prior_date,
         coalesce(sum(CASE WHEN s.period_end = p.date THEN s.amount END), 0) AS value,
         coalesce(sum(CASE WHEN s.period_end = q.prior_date THEN s.amount END), 0) AS prior_value
       FROM statement_full s JOIN per p USING (entity_id, statement_type) LEFT JOIN pri q USING (entity_id, statement_type)
       GROUP BY ALL),
mp AS (SELECT l.*, a.mapping_key, a.category, a.tab_name,
         d.account AS direct_tab, t.account AS alias_tab
       FROM ln l LEFT JOIN account_alias a ON lower(l.description) IN (lower(a.tab_name), lower(a.statement_label))
       LEFT JOIN (SELECT DISTINCT entity_id, account FROM schedule_line) d ON d.entity_id = l.entity_id AND lower(d.account) = lower(l.description)
       LEFT JOIN (SELECT DISTINCT entity_id, account FROM schedule_line) t ON t.entity_id = l.entity_id AND t.account = a.tab_name),
st AS (SELECT m.*, CASE WHEN value = 0 AND (prior_date IS NULL OR prior_value = 0) THEN 'Zero source'
          WHEN """ + SKIP_SQL.replace("(d)", "(description)") + """ THEN 'Skipped'
          WHEN direct_tab IS NOT NULL AND mapping_key IS NULL THEN 'Tab-only match'
          WHEN coalesce(direct_tab, alias_tab) IS NOT NULL THEN 'Mapped'
          WHEN mapping_key IS NOT NULL THEN 'Mapped but missing tab' ELSE 'Missing mapping' END AS mapping_status FROM mp m),
tv AS (SELECT s.*, CASE WHEN mapping_status NOT IN ('Zero source', 'Skipped') THEN coalesce(direct_tab, alias_tab) END AS tab,
         mapping_status NOT IN ('Zero source', 'Skipped') AS compared,
         statement_type = 'IS' AND (coalesce(category, '') = 'Expenses' OR regexp_matches(lower(description), 'loss|expense|cost')) AS magnitude FROM st s),
tj AS (SELECT v.*, coalesce(x.amount, CASE WHEN value = 0 AND prior_value <> 0 AND tab IS NOT NULL THEN 0 END) AS tv
       FROM tv v LEFT JOIN schedule_line x ON x.entity_id = v.entity_id AND x.account = v.tab AND x.period_end = v.date),
cmp AS (SELECT *, CASE WHEN magnitude THEN abs(value) ELSE value END AS src, CASE WHEN magnitude THEN abs(tv) ELSE tv END AS tt FROM tj),
recon AS (SELECT entity_id, entity, statement_type, description AS financials_account, date, CAST(value AS DECIMAL(20,2)) AS financials_value,
   CASE WHEN compared THEN coalesce(tab, 'Not Found') ELSE '-' END AS tab_account,
   CASE WHEN compared THEN CAST(coalesce(tv, 0) AS DECIMAL(20,2)) END AS tab_value,
   CASE WHEN compared THEN CAST(abs(src - tt) AS DECIMAL(20,2)) END AS diff,
   CASE WHEN NOT compared THEN '-' WHEN tt IS NULL THEN '⚠️ Not Found'
        WHEN abs(src - tt) <= 1 THEN CASE WHEN value = 0 AND prior_value <> 0 THEN '⚠️ Match' ELSE '✅ Match' END
        WHEN src <> 0 AND abs(src - tt) <= abs(src) * CAST(0.005 AS DECIMAL(4,3)) THEN '✅ Immaterial' ELSE '❌ Diff' END AS match,
   CASE WHEN compared THEN coalesce(mapping_key, '-') ELSE '-' END AS mapping_key, mapping_status,
   prior_date, CAST(prior_value AS DECIMAL(20,2)) AS prior_value, magnitude FROM cmp)
"""
INTERIM = """,
rescued AS (SELECT r.* REPLACE (CASE WHEN r.match = '❌ Diff'
   AND (year(r.date) - year(r.prior_date)) * 12 + month(r.date) - month(r.prior_date) BETWEEN 1 AND 9
   AND x.amount IS NOT NULL
   AND (abs(CASE WHEN magnitude THEN abs(prior_value) ELSE prior_value END - CASE WHEN magnitude THEN abs(x.amount) ELSE x.amount END) <= 1
     OR (prior_value <> 0 AND abs(CASE WHEN magnitude THEN abs(prior_value) ELSE prior_value END - CASE WHEN magnitude THEN abs(x.amount) ELSE x.amount END)
         <= abs(prior_value) * CAST(0.005 AS DECIMAL(4,3)))) THEN '⚠️ Interim Diff (prior period matches)' ELSE r.match END AS match), x.amount AS prior_tab
   FROM recon r LEFT JOIN schedule_line x ON x.entity_id = r.entity_id AND x.account = r.tab_account AND x.period_end = r.prior_date)
"""


def recon_of(t):
    return R.reconcile(t.statement_full, t.schedule_line, t.account_alias)


@query("reconcile", "WITH " + RECON + "SELECT r.*, x.amount AS prior_tab FROM recon r LEFT JOIN schedule_line x ON x.entity_id = r.entity_id AND x.account = r.tab_account AND x.period_end = r.prior_date")
def _(t):
    return recon_of(t)


@query("reconcile_interim", "WITH " + RECON + INTERIM + "SELECT * FROM rescued")
def _(t):
    return R.rescue_interim(recon_of(t))


@query("recon_metrics", "WITH " + RECON + """SELECT statement_type, match, count(*) AS rows,
  CAST(grouping(statement_type) * 2 + grouping(match) AS BIGINT) AS level FROM recon GROUP BY ROLLUP (statement_type, match)""")
def _(t):
    return R.status_counts(recon_of(t))


@query("recon_display", "WITH " + RECON + """SELECT entity_id, financials_account, mapping_key,
  CASE mapping_status WHEN 'Missing mapping' THEN '⚠️ Map' WHEN 'Tab-only match' THEN '⚠️ Tab'
       WHEN 'Mapped but missing tab' THEN '⚠️ No tab' ELSE match END AS match, date, financials_value, tab_account, tab_value, diff,
  mapping_status IN ('Missing mapping', 'Tab-only match', 'Mapped but missing tab') AS warned
FROM recon WHERE mapping_status <> 'Zero source'""")
def _(t):
    return R.display_rows(recon_of(t))


@query("eligible_accounts", "WITH " + RECON + """SELECT entity_id, account, CAST(min(priority) AS INT) AS priority FROM (
  SELECT r.entity_id, r.tab_account AS account, 1 AS priority FROM recon r
  WHERE (r.match IN ('✅ Match', '⚠️ Match', '✅ Immaterial') OR (r.statement_type = 'IS' AND r.match = '❌ Diff'))
    AND EXISTS (SELECT 1 FROM schedule_line s WHERE s.entity_id = r.entity_id AND s.account = r.tab_account)
  UNION ALL SELECT entity_id, account, 2 FROM schedule_line WHERE amount <> 0) GROUP BY 1, 2""")
def _(t):
    return R.eligible_accounts(recon_of(t), t.schedule_line)


@query("alias_dim", """SELECT a.mapping_key, a.statement_type, a.category, a.line_no, x.ord, x.alias, lower(x.alias) AS alias_norm, count(s.p_partkey) AS uses
FROM account_alias a, LATERAL (VALUES (0, a.mapping_key), (1, a.tab_name), (2, a.statement_label)) AS x(ord, alias)
LEFT JOIN part s ON s.p_type = x.alias GROUP BY ALL""")
def _(t):
    used = t.part.groupBy(F.col("p_type").alias("alias")).agg(F.count("p_partkey").alias("uses"))
    return R.exploded_aliases(t.account_alias).join(used, "alias", "left").fillna(0, ["uses"])


@query("alias_join", """SELECT n.account_name, coalesce(a.mapping_key, '') AS mapping_key, coalesce(a.statement_type, '') AS account_type,
  coalesce(a.statement_type, 'other') AS classification,
  CASE WHEN a.mapping_key IS NULL THEN 'No key or alias matched this account name.'
       ELSE concat('Mapped to ', a.statement_type, ' via ''', a.mapping_key, '''.') END AS reason
FROM (SELECT DISTINCT account AS account_name FROM ledger_line UNION SELECT DISTINCT description FROM statement_full) n
LEFT JOIN account_alias a ON n.account_name = a.mapping_key OR lower(n.account_name) IN (lower(a.tab_name), lower(a.statement_label))""")
def _(t):
    names = t.ledger_line.select(F.col("account").alias("account_name")).distinct().union(
        t.statement_full.select("description").distinct())
    return R.resolve_aliases(names, t.account_alias)


@query("account_total", """SELECT entity_id, account, period_end,
  coalesce(p.amount, CASE WHEN d.t IS NOT NULL AND d.t <> 0 AND (d.t > 0) <> (x.amount > 0) THEN abs(x.amount) * CAST(sign(d.t) AS INT) ELSE x.amount END, d.t, d.f) AS total
FROM (SELECT entity_id, account, period_end,
        arg_min(amount, row_idx) FILTER (row_idx = 7) AS t,
        arg_min(amount, row_idx) FILTER (row_idx IN (1, 2, 3, 5, 7) AND amount <> 0) AS f
      FROM detail_line GROUP BY ALL) d
FULL JOIN (SELECT entity_id, account, period_end, amount FROM schedule_line WHERE yr % 2 = 0) x USING (entity_id, account, period_end)
FULL JOIN (SELECT entity_id, account, period_end, CAST(-amount - 1000 AS DECIMAL(20,2)) AS amount FROM schedule_line WHERE yr % 4 = 0) p USING (entity_id, account, period_end)""")
def _(t):
    """Totals of all accounts: stored in every fourth year, with a check total in every second one."""
    auxiliary = t.schedule_line.where("yr % 2 = 0").withColumnRenamed("amount", "auxiliary_total")
    stored = t.schedule_line.where("yr % 4 = 0").withColumn("stored_total", (-F.col("amount") - 1000).cast("decimal(20,2)"))
    return R.account_total(t.detail_line, ["entity_id", "account", "period_end"], auxiliary, stored)


@query("report_order", """SELECT entity_id, account, mapping_key, statement_type, category,
  row_number() OVER (PARTITION BY entity_id ORDER BY CASE statement_type WHEN 'BS' THEN 0 WHEN 'IS' THEN 1 ELSE 2 END, coalesce(line_no, 9999), account) AS position
FROM (SELECT DISTINCT entity_id, account FROM schedule_line) s LEFT JOIN account_alias a ON a.tab_name = s.account""")
def _(t):
    return R.report_order(t.schedule_line.select("entity_id", "account").distinct(), t.account_alias)


@query("ordered_distinct", """SELECT entity_id, trim(description) AS description, min(row_idx) AS first_position FROM detail_line
WHERE trim(description) <> '' GROUP BY 1, 2""")
def _(t):
    return R.first_occurrences(t.detail_line, ["entity_id"], "description", "row_idx")


@query("sink_json_roundtrip", "WITH " + RECON + "SELECT statement_type, match, count(*) AS n, CAST(sum(financials_value) AS DECIMAL(24,2)) AS value FROM recon GROUP BY ALL")
def _(t):
    path = sinks.new_path(t.spark, "recon-json")
    rows = recon_of(t)
    sinks.write_partitioned(rows, path, ["statement_type"], kind="json")
    return t.spark.read.schema(rows.schema).json(path).groupBy("statement_type", "match").agg(
        F.count(F.lit(1)).alias("n"), F.sum("financials_value").cast("decimal(24,2)").alias("value"))


@query("sink_roundtrip", "WITH " + RECON + "SELECT statement_type, match, count(*) AS n, sum(financials_value) AS value FROM recon GROUP BY ALL")
def _(t):
    path = sinks.new_path(t.spark, "recon")
    sinks.write_partitioned(recon_of(t), path, ["statement_type"])
    return t.spark.read.parquet(path).groupBy("statement_type", "match").agg(
        F.count(F.lit(1)).alias("n"), F.sum("financials_value").alias("value"))
