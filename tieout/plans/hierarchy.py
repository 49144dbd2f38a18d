"""Parent and part queries."""

from __future__ import annotations

from tieout.operators import hierarchy as H
from tieout.plans.registry import query

K = ["entity_id", "account", "yr"]


CLAIM = """nx AS (SELECT a.k, a.p, a.last, min(b.p) AS nextp FROM e a LEFT JOIN e b ON b.k = a.k AND b.p > a.last GROUP BY a.k, a.p, a.last),
sel AS (SELECT k, p, last, nextp FROM nx a WHERE p = (SELECT min(p) FROM nx b WHERE b.k = a.k) UNION ALL SELECT n.k, n.p, n.last, n.nextp FROM sel s JOIN nx n ON n.k = s.k AND n.p = s.nextp)"""


@query("implicit_breakdown", """WITH x AS (SELECT concat(entity_id, '|', account, '|', yr) AS k, * FROM implicit_line),
s AS (SELECT p.k, p.row_idx AS p, j.row_idx AS j, p.amount, sum(c.amount) AS t, max(c.amount) AS m FROM x p JOIN x j ON j.k = p.k AND j.row_idx >= p.row_idx + 2 JOIN x c ON c.k = p.k AND c.row_idx > p.row_idx AND c.row_idx <= j.row_idx
  WHERE abs(p.amount) >= 1 GROUP BY p.k, p.row_idx, j.row_idx, p.amount),
e AS (SELECT k, p, min(j) AS last FROM s WHERE m < amount AND abs(t - amount) <= greatest(1, amount * 0.005) GROUP BY k, p),
""" + CLAIM + """
SELECT l.entity_id, l.account, l.yr, s.p AS parent_row, l.row_idx FROM sel s JOIN x l ON l.k = s.k AND l.row_idx > s.p AND l.row_idx <= s.last""")
def _(t):
    return H.implicit_breakdowns(t.implicit_line, K)


ROLL = """r AS (SELECT entity_id, account, yr, arg_max(amount, -row_idx) FILTER (row_idx = 0) AS v0, sum(amount) FILTER (row_idx IN (1, 2)) AS s0, sum(amount) FILTER (row_idx IN (4, 5)) AS s3, max(amount) FILTER (row_idx = 6) AS t FROM indent_line GROUP BY ALL),
ro AS (SELECT entity_id, account, yr, 0 AS parent_row, 'Accepted' AS description, 2 AS children, v0 AS parent_value, CAST(s0 AS DECIMAL(24,2)) AS child_sum, CASE WHEN abs(v0 - s0) <= greatest(1, abs(v0) * 0.005) THEN 'confirmed' ELSE 'mismatch' END AS status FROM r
 UNION ALL SELECT entity_id, account, yr, 3, 'Other items', 2, NULL, CAST(s3 AS DECIMAL(24,2)), CASE WHEN abs(s3) >= 1 AND abs(t - s3) <= greatest(1, abs(s3) * 0.005) THEN 'confirmed by total' ELSE 'label' END FROM r)"""


@query("indent_hierarchy", "WITH " + ROLL + " SELECT * FROM ro")
def _(t):
    return H.indent_rollups(t.indent_line, K)


@query("indent_audit", "WITH " + ROLL + " SELECT entity_id, account, status, count(*) AS parents, sum(children) AS children FROM ro GROUP BY ALL")
def _(t):
    from pyspark.sql import functions as F
    return H.indent_rollups(t.indent_line, K).groupBy("entity_id", "account", "status").agg(
        F.count(F.lit(1)).alias("parents"), F.sum("children").alias("children"))


@query("nest_components", """WITH x AS (SELECT concat(entity_id, '|', account) AS k, * FROM implicit_line),
b AS (SELECT p.k, p.row_idx AS p, n.n, p.yr, p.amount, sum(c.amount) AS t FROM x p JOIN (SELECT unnest(range(2, 9)) AS n) n ON p.row_idx + n.n <= 7
  JOIN x c ON c.k = p.k AND c.yr = p.yr AND c.row_idx > p.row_idx AND c.row_idx <= p.row_idx + n.n GROUP BY p.k, p.row_idx, n.n, p.yr, p.amount),
o AS (SELECT k, p, n FROM b GROUP BY k, p, n HAVING bool_and(abs(t - amount) <= greatest(1, amount * 0.02))),
e AS (SELECT k, p, p + min(n) AS last FROM o GROUP BY k, p),
""" + CLAIM + """
SELECT DISTINCT l.entity_id, l.account, s.p AS parent_row, l.row_idx FROM sel s JOIN x l ON l.k = s.k AND l.row_idx > s.p AND l.row_idx <= s.last""")
def _(t):
    from pyspark.sql import functions as F
    x = t.implicit_line.withColumn("period_end", F.make_date(F.col("yr"), F.lit(6), F.lit(30)))
    return H.nest_components(x, ["entity_id", "account"])
