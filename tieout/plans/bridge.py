"""Bridge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.operators import bridge as B
from tieout.plans.registry import query

ANNUAL = """
st AS (SELECT entity_id, phase, min(yr * 12 + mo) AS start FROM metric_month WHERE area <> 0 OR revenue <> 0 GROUP BY ALL),
cal AS (SELECT DISTINCT entity_id, yr, mo, days FROM metric_month),
dy AS (SELECT s.entity_id, s.phase, c.yr, coalesce(sum(c.days) FILTER (c.yr * 12 + c.mo >= s.start), 0) AS days FROM st s JOIN cal c USING (entity_id) GROUP BY ALL),
ms AS (SELECT entity_id, phase, yr, sum(revenue) AS rev, sum(area) FILTER (area > 0) AS asum, count(*) FILTER (area > 0) AS an FROM metric_month GROUP BY ALL),
an0 AS (SELECT d.entity_id, d.phase, d.yr, coalesce(CAST(CAST(rev AS DECIMAL(24,2)) AS DOUBLE), 0.0) AS revenue,
   CASE WHEN coalesce(an, 0) > 0 THEN CAST(CAST(asum AS DECIMAL(24,2)) AS DOUBLE) / an ELSE 0.0 END AS area, CAST(d.days AS BIGINT) AS days FROM dy d LEFT JOIN ms USING (entity_id, phase, yr)),
ann AS (SELECT *, CASE WHEN area <> 0 AND days <> 0 THEN revenue / area / days ELSE 0.0 END AS unit_rent FROM an0)
"""
LTM = """,
lst AS (SELECT entity_id, max(yr * 12 + mo) AS last FROM metric_month GROUP BY ALL),
cm AS (SELECT c.*, l.last FROM cal c JOIN lst l USING (entity_id) WHERE c.yr * 12 + c.mo > l.last - 12),
sp AS (SELECT entity_id, last FROM cm GROUP BY ALL HAVING count(*) = 12),
ld AS (SELECT s.entity_id, s.phase, p.last, coalesce(sum(c.days) FILTER (c.yr * 12 + c.mo >= s.start), 0) AS days FROM st s JOIN sp p USING (entity_id) JOIN cm c USING (entity_id) GROUP BY ALL),
lm AS (SELECT m.entity_id, m.phase, sum(revenue) AS rev, sum(area) FILTER (area > 0) AS asum, count(*) FILTER (area > 0) AS an FROM metric_month m JOIN lst l USING (entity_id) WHERE m.yr * 12 + m.mo > l.last - 12 GROUP BY ALL),
l0 AS (SELECT d.entity_id, d.phase, d.last, coalesce(CAST(CAST(rev AS DECIMAL(24,2)) AS DOUBLE), 0.0) AS revenue,
   CASE WHEN coalesce(an, 0) > 0 THEN CAST(CAST(asum AS DECIMAL(24,2)) AS DOUBLE) / an ELSE 0.0 END AS area, CAST(d.days AS BIGINT) AS days FROM ld d LEFT JOIN lm USING (entity_id, phase)),
lt AS (SELECT entity_id, phase, revenue, area, days, CASE WHEN area <> 0 AND days <> 0 THEN revenue / area / days ELSE 0.0 END AS unit_rent,
   CAST((last - 1) // 12 AS INT) AS end_year, CAST((last - 1) % 12 + 1 AS INT) AS end_month,
   concat((last - 12) // 12, '年', (last - 12) % 12 + 1, '月至', (last - 1) // 12, '年', (last - 1) % 12 + 1, '月收入') AS label FROM l0)
"""
PAIRS = """,
tl AS (SELECT a.entity_id, max(a.yr) AS max_yr, max(a.days) FILTER (a.yr = x.my) AS d FROM ann a JOIN (SELECT entity_id, max(yr) AS my FROM ann GROUP BY ALL) x USING (entity_id) GROUP BY a.entity_id),
fu AS (SELECT a.*, (d > 0 AND d < 350) AS partial FROM ann a JOIN tl t USING (entity_id) WHERE NOT (d > 0 AND d < 350) OR a.yr < t.max_yr),
nx AS (SELECT entity_id, yr, lag(yr) OVER (PARTITION BY entity_id ORDER BY yr) AS year_a FROM (SELECT DISTINCT entity_id, yr FROM fu)),
pr AS (SELECT a.entity_id, a.phase, a.yr AS year_a, b.yr AS year_b, false AS is_ltm, a.revenue AS revenue_a, a.area AS area_a, a.days AS days_a, a.unit_rent AS unit_rent_a,
    b.revenue AS revenue_b, b.area AS area_b, b.days AS days_b, b.unit_rent AS unit_rent_b
  FROM fu a JOIN nx n ON n.entity_id = a.entity_id AND n.year_a = a.yr JOIN fu b ON b.entity_id = a.entity_id AND b.phase = a.phase AND b.yr = n.yr
  UNION ALL SELECT a.entity_id, a.phase, a.yr, l.end_year, true, a.revenue, a.area, a.days, a.unit_rent, l.revenue, l.area, l.days, l.unit_rent
  FROM fu a JOIN (SELECT entity_id, max(yr) AS y FROM fu WHERE partial GROUP BY ALL) m ON m.entity_id = a.entity_id AND m.y = a.yr JOIN lt l ON l.entity_id = a.entity_id AND l.phase = a.phase),
fx AS (SELECT *, (unit_rent_b - unit_rent_a) * area_a * days_a / 1000 AS price, unit_rent_b * (area_b - area_a) * days_a / 1000 AS area, unit_rent_b * area_b * (days_b - days_a) / 1000 AS days,
   dense_rank() OVER (PARTITION BY entity_id, year_a, year_b, is_ltm ORDER BY phase) AS k FROM pr),
it AS (SELECT entity_id, year_a, year_b, is_ltm, CAST((k - 1) * 3 + 2 AS INT) AS item_no, concat(phase, '单价变动') AS label, 'delta' AS kind, CAST(round(price, 4) AS DECIMAL(20,4)) AS value FROM fx
  UNION ALL SELECT entity_id, year_a, year_b, is_ltm, CAST((k - 1) * 3 + 3 AS INT), concat(phase, '出租率/面积变动'), 'delta', CAST(round(area, 4) AS DECIMAL(20,4)) FROM fx
  UNION ALL SELECT entity_id, year_a, year_b, is_ltm, CAST((k - 1) * 3 + 4 AS INT), concat(phase, '运营天数变动'), 'delta', CAST(round(days, 4) AS DECIMAL(20,4)) FROM fx
  UNION ALL SELECT entity_id, year_a, year_b, is_ltm, 1, concat(year_a, '年收入'), 'total', CAST(sum(CAST(revenue_a AS DECIMAL(24,2))) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(20,4)) FROM fx GROUP BY 1, 2, 3, 4
  UNION ALL SELECT entity_id, year_a, year_b, is_ltm, CAST(max(k) * 3 + 2 AS INT), CASE WHEN is_ltm THEN 'LTM收入' ELSE concat(year_b, '年收入') END, 'total',
    CAST(sum(CAST(revenue_b AS DECIMAL(24,2))) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(20,4)) FROM fx GROUP BY 1, 2, 3, 4)
"""


def items_of(t):
    pairs = B.transitions(t.metric_month)
    return pairs, B.bridge_items(pairs)


@query("annual_series", "WITH " + ANNUAL + "SELECT * FROM ann")
def _(t):
    return B.annual_series(t.metric_month)


@query("ltm", "WITH " + ANNUAL + LTM + "SELECT * FROM lt")
def _(t):
    return B.ltm(t.metric_month)


@query("bridge", "WITH " + ANNUAL + LTM + PAIRS + "SELECT * FROM it")
def _(t):
    return items_of(t)[1]


@query("waterfall", "WITH " + ANNUAL + LTM + PAIRS + """, lg AS (SELECT *, sum(CASE WHEN kind = 'total' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, year_a, year_b, is_ltm ORDER BY item_no) AS leg FROM it),
rn AS (SELECT *, sum(value) OVER (PARTITION BY entity_id, year_a, year_b, is_ltm, leg ORDER BY item_no) AS running FROM lg)
SELECT entity_id, year_a, year_b, is_ltm, item_no, label, CAST(CASE WHEN kind = 'total' THEN 0 WHEN value >= 0 THEN running - value ELSE running END AS DECIMAL(24,4)) AS base,
  CASE WHEN kind = 'total' THEN value ELSE 0 END AS total, CASE WHEN kind = 'delta' AND value >= 0 THEN value ELSE 0 END AS increase, CASE WHEN kind = 'delta' AND value < 0 THEN -value ELSE 0 END AS decrease FROM rn""")
def _(t):
    return B.waterfall(items_of(t)[1])


RES = """, rs AS (SELECT entity_id, year_a, year_b, is_ltm, arg_min(value, item_no) AS s, arg_max(value, item_no) AS e, sum(value) FILTER (kind = 'delta') AS f FROM it GROUP BY ALL)"""


@query("bridge_residuals", "WITH " + ANNUAL + LTM + PAIRS + RES + """SELECT entity_id, year_a, year_b, is_ltm, s AS start, e AS "end", CAST(f AS DECIMAL(24,4)) AS factors, CAST(s + f - e AS DECIMAL(24,4)) AS residual,
  abs(s + f - e) < greatest(5.0, abs(CAST(e AS DOUBLE)) * 0.02) AS ties FROM rs""")
def _(t):
    return B.residuals(items_of(t)[1])


@query("bridge_audit", "WITH " + ANNUAL + LTM + PAIRS + RES + """SELECT r.entity_id, r.year_a, r.year_b, r.is_ltm,
  (SELECT count(*) FROM pr p WHERE p.entity_id = r.entity_id AND p.year_a = r.year_a AND p.year_b = r.year_b AND p.is_ltm = r.is_ltm AND p.phase = 'PROMO') * CASE WHEN r.is_ltm THEN 1 ELSE 2 END AS mismatches,
  round(CASE WHEN e <> 0 THEN CAST(CAST(s + f - e AS DECIMAL(24,4)) AS DOUBLE) / CAST(e AS DOUBLE) * 100 ELSE 0 END, 6) AS residual_pct,
  CASE WHEN NOT EXISTS (SELECT 1 FROM pr p WHERE p.entity_id = r.entity_id AND p.year_a = r.year_a AND p.year_b = r.year_b AND p.is_ltm = r.is_ltm AND p.phase = 'PROMO')
    AND abs(CASE WHEN e <> 0 THEN CAST(CAST(s + f - e AS DECIMAL(24,4)) AS DOUBLE) / CAST(e AS DOUBLE) * 100 ELSE 0 END) <= 2.0 THEN 'ok' ELSE 'check' END AS verdict FROM rs r""")
def _(t):
    """One phase is re-derived from a ledger that lost it, so that the audit has something to find."""
    pairs, items = items_of(t)
    again = B.annual_series(t.metric_month).where("phase <> 'PROMO'")
    return B.bridge_audit(items, pairs, again, 2.0)


@query("phase_cross_check", "WITH " + ANNUAL + """,
mine AS (SELECT entity_id, yr, sum(CAST(revenue AS DECIMAL(24,2))) AS mine FROM ann GROUP BY ALL HAVING abs(sum(CAST(revenue AS DECIMAL(24,2)))) >= 1),
lg AS (SELECT entity_id, yr, CAST(sum(amount) AS DECIMAL(20,2)) AS gross, CAST(sum(CASE WHEN flag = 'R' THEN 0 ELSE amount END) AS DECIMAL(20,2)) AS net FROM ledger_line GROUP BY ALL),
ca AS (SELECT entity_id, yr, 40 AS row_idx, 'Total net revenue' AS label, net AS total FROM lg UNION ALL SELECT entity_id, yr, 41, 'Total rental revenue', gross FROM lg),
x AS (SELECT m.entity_id, m.yr, mine, label, total, row_idx, CASE WHEN abs(total) > 1 THEN (CAST(total AS DOUBLE) - CAST(mine AS DOUBLE)) / CAST(total AS DOUBLE) END AS pct FROM mine m JOIN ca USING (entity_id, yr)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, yr ORDER BY coalesce(abs(pct), 'inf'::DOUBLE), row_idx) AS k FROM x)
SELECT entity_id, yr, mine, label, total, round(pct, 6) AS pct, coalesce(abs(pct) < 0.01, false) AS ok FROM r WHERE k = 1""")
def _(t):
    per = t.ledger_line.groupBy("entity_id", "yr").agg(
        F.sum("amount").cast("decimal(20,2)").alias("gross"),
        F.sum(F.when(F.col("flag") == "R", 0).otherwise(F.col("amount"))).cast("decimal(20,2)").alias("net"))
    rows = F.array(F.struct(F.lit(40).alias("row_idx"), F.lit("Total net revenue").alias("label"), F.col("net").alias("total")),
                   F.struct(F.lit(41).alias("row_idx"), F.lit("Total rental revenue").alias("label"), F.col("gross").alias("total")))
    return B.phase_cross_check(B.annual_series(t.metric_month),
                               per.select("entity_id", "yr", F.explode(rows).alias("r")).select("entity_id", "yr", "r.*"))


@query("bridge_compare", "WITH " + ANNUAL + LTM + PAIRS + """,
f AS (SELECT entity_id, year_a, year_b, phase, u.factor, CAST(round(CASE u.factor WHEN 'price' THEN price WHEN 'area' THEN area ELSE days END, 4) AS DECIMAL(20,4)) AS value
  FROM fx, (VALUES ('price'), ('area'), ('days')) u(factor) WHERE NOT is_ltm),
c AS (SELECT *, CASE WHEN phase = 'SMALL' THEN NULL WHEN phase = 'LARGE' THEN CAST(round(value, -1) AS DECIMAL(24,4)) ELSE CAST(round(value, 0) AS DECIMAL(24,4)) END AS manual FROM f)
SELECT entity_id, year_a, year_b, phase, factor, manual, value AS computed, manual - value AS diff,
  CASE WHEN manual IS NULL THEN 'computed only' WHEN abs(manual - value) <= 0.5 THEN 'equal' ELSE 'differs' END AS status FROM c""")
def _(t):
    """The hand-built side is the computed one rounded, without one phase."""
    computed = items_of(t)[1].where("NOT is_ltm")
    rounded = F.when(F.col("label").startswith("LARGE"), F.round("value", -1)).otherwise(F.round("value", 0))
    manual = computed.where("NOT startswith(label, 'SMALL')").withColumn("value", rounded.cast("decimal(20,4)"))
    return B.compare_bridges(manual, computed)
