"""Trend, variance and composition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.operators import analysis as A
from tieout.plans.registry import query

IS_ACCOUNTS = ["STANDARD", "LARGE", "PROMO", "ECONOMY"]
IS_SQL = "('STANDARD', 'LARGE', 'PROMO', 'ECONOMY')"
KIND = """CASE WHEN starts_with(lower(description), 'of which') THEN 'breakdown' WHEN contains(lower(description), 'total') THEN 'total'
 WHEN regexp_matches(description, '^[0-9]{6,}') THEN 'breakdown' ELSE 'detail' END"""

DENSE = """
per AS (SELECT DISTINCT entity_id, account, period_end FROM detail_line),
rws AS (SELECT DISTINCT entity_id, account, row_idx, description FROM detail_line),
ser AS (SELECT r.*, p.period_end, coalesce(d.amount, 0) AS v,
   lag(coalesce(d.amount, 0)) OVER w AS pv, lag(p.period_end) OVER w AS pp
  FROM rws r JOIN per p USING (entity_id, account) LEFT JOIN detail_line d USING (entity_id, account, row_idx, description, period_end)
  WINDOW w AS (PARTITION BY r.entity_id, r.account, r.row_idx ORDER BY p.period_end))
"""
TAIL = """
tot AS (SELECT entity_id, account, period_end, coalesce(arg_max(amount, row_idx) FILTER (row_idx = 7), sum(amount)) AS v FROM detail_line GROUP BY ALL),
ends AS (SELECT entity_id, account, max(period_end) AS eff, count(*) AS n FROM tot GROUP BY ALL),
prv AS (SELECT t.entity_id, t.account, max(t.period_end) AS prv FROM tot t JOIN ends e USING (entity_id, account) WHERE t.period_end < e.eff GROUP BY ALL),
anc AS (SELECT t.entity_id, t.account, e.eff, mode(month(t.period_end) * 100 + day(t.period_end)) AS a
  FROM tot t JOIN ends e USING (entity_id, account) JOIN prv p USING (entity_id, account)
  WHERE month(t.period_end) * 100 + day(t.period_end) <> month(e.eff) * 100 + day(e.eff)
    AND month(p.prv) * 100 + day(p.prv) <> month(e.eff) * 100 + day(e.eff) GROUP BY ALL),
py AS (SELECT entity_id, account, eff AS period_end, CAST(a // 100 AS INT) AS anchor_month, CAST(a % 100 AS INT) AS anchor_day,
   CAST(CASE WHEN (month(eff) - a // 100 + 12) % 12 <= 0 THEN month(eff) ELSE (month(eff) - a // 100 + 12) % 12 END AS INT) AS months FROM anc),
ful AS (SELECT t.entity_id, t.account, t.period_end, t.v, row_number() OVER w AS i, lag(t.period_end) OVER w AS pp, lag(t.v) OVER w AS pv,
   count(*) OVER (PARTITION BY t.entity_id, t.account) AS n, max(abs(t.v)) OVER (PARTITION BY t.entity_id, t.account) AS scale
  FROM tot t JOIN ends e USING (entity_id, account) LEFT JOIN py USING (entity_id, account)
  WHERE py.months IS NULL OR e.n <= 2 OR t.period_end < e.eff
  WINDOW w AS (PARTITION BY t.entity_id, t.account ORDER BY t.period_end))
"""


@query("trend_summary", "WITH " + DENSE + """, f AS (SELECT * FROM ser WHERE row_idx = 7),
a AS (SELECT entity_id, account, arg_min(description, period_end) AS focus_description,
  CASE WHEN bool_or(v > pv) AND bool_or(v < pv) THEN 'volatile' WHEN bool_or(v > pv) THEN 'rising' WHEN bool_or(v < pv) THEN 'falling' ELSE 'flat' END AS series_direction,
  min(period_end) AS start_period, max(period_end) AS end_period, arg_min(v, period_end) AS start_value, arg_max(v, period_end) AS end_value,
  arg_max(v, period_end) - arg_min(v, period_end) AS net_change, max(v - pv) AS up, min(v - pv) AS down, count(*) AS n FROM f GROUP BY 1, 2)
SELECT a.entity_id, a.account, focus_description, series_direction, start_period, end_period, start_value, end_value, net_change,
  CASE WHEN up > 0 THEN (SELECT min(pp) FROM f WHERE f.entity_id = a.entity_id AND f.account = a.account AND f.v - f.pv = a.up) END AS increase_from,
  CASE WHEN up > 0 THEN (SELECT min(period_end) FROM f WHERE f.entity_id = a.entity_id AND f.account = a.account AND f.v - f.pv = a.up) END AS increase_to,
  CASE WHEN up > 0 THEN up END AS increase_delta,
  CASE WHEN down < 0 THEN (SELECT min(pp) FROM f WHERE f.entity_id = a.entity_id AND f.account = a.account AND f.v - f.pv = a.down) END AS decrease_from,
  CASE WHEN down < 0 THEN (SELECT min(period_end) FROM f WHERE f.entity_id = a.entity_id AND f.account = a.account AND f.v - f.pv = a.down) END AS decrease_to,
  CASE WHEN down < 0 THEN down END AS decrease_delta FROM a WHERE n >= 2""")
def _(t):
    return A.trend_summary(t.detail_line)


@query("significant_movements", "WITH " + DENSE + """,
b AS (SELECT *, abs(v - pv) AS size, row_number() OVER (PARTITION BY entity_id, account, row_idx ORDER BY abs(v - pv) DESC, period_end) AS k FROM ser WHERE pv IS NOT NULL),
c AS (SELECT *, sum(size) OVER (PARTITION BY entity_id, account) AS moved FROM b WHERE k = 1 AND size > 0),
d AS (SELECT *, CAST(size AS DOUBLE) / CAST(moved AS DOUBLE) * 100 AS share,
   CASE WHEN abs(CAST(pv AS DOUBLE)) >= 0.01 THEN round(CAST(v - pv AS DOUBLE) / abs(CAST(pv AS DOUBLE)) * 100, 1) END AS percent_change FROM c),
e AS (SELECT *, coalesce(abs(percent_change) >= 30, false) AS exceeds_materiality FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY entity_id, account ORDER BY size DESC, row_idx) AS rank FROM e WHERE share >= 25 OR exceeds_materiality)
SELECT entity_id, account, rank, description, pp AS from_period, period_end AS to_period, pv AS from_value, v AS to_value, v - pv AS delta,
  CASE WHEN pv = 0 AND v > 0 THEN 'new_increase' WHEN pv = 0 AND v < 0 THEN 'new_decrease' WHEN v > pv THEN 'increase' WHEN v < pv THEN 'decrease' ELSE 'flat' END AS direction,
  round(share, 1) AS percent_of_total_change, percent_change, exceeds_materiality FROM g WHERE rank <= 3""")
def _(t):
    return A.significant_movements(t.detail_line)


@query("annualise", "WITH " + TAIL + """SELECT d.entity_id, d.account, d.period_end, d.entity, d.portfolio, d.yr, d.row_idx, d.description, d.amount,
  p.anchor_month, p.anchor_day, p.months, CAST(d.amount * 12 / p.months AS DECIMAL(20,2)) AS annualised
FROM detail_line d JOIN py p USING (entity_id, account, period_end) WHERE d.account IN """ + IS_SQL)
def _(t):
    return A.annualise(t.detail_line.where(F.col("account").isin(IS_ACCOUNTS)))


@query("material_variance", "WITH " + TAIL + """,
e AS (SELECT *, i = n AS latest, abs(pv) >= CAST(scale AS DOUBLE) * 0.01 AND pv * v < 0 AS flip,
  CASE WHEN abs(CAST(pv AS DOUBLE)) >= CAST(scale AS DOUBLE) * 0.01 AND CAST(pv AS DOUBLE) * CAST(v AS DOUBLE) >= 0 AND pv <> 0
       THEN (CAST(v AS DOUBLE) - CAST(pv AS DOUBLE)) / abs(CAST(pv AS DOUBLE)) * 100 END AS pct FROM ful WHERE pv IS NOT NULL AND scale > 0),
g AS (SELECT entity_id, CASE WHEN abs(pv) >= CAST(scale AS DOUBLE) * 0.01 THEN (CAST(v AS DOUBLE) - CAST(pv AS DOUBLE)) / abs(CAST(pv AS DOUBLE)) * 100 END AS rp
  FROM e WHERE latest AND account = 'STANDARD'),
h AS (SELECT e.*, g.rp, pct - g.rp AS gap, coalesce(abs(pct) >= 30, false) OR flip AS hit FROM e LEFT JOIN g USING (entity_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, account, latest, hit ORDER BY i) AS r FROM h),
u AS (SELECT *, 'material' AS finding FROM k WHERE latest AND abs(pct) >= 30
  UNION ALL SELECT *, 'sign_flip' FROM k WHERE latest AND flip
  UNION ALL SELECT *, 'nil_latest' FROM k WHERE latest AND v = 0 AND pv <> 0
  UNION ALL SELECT *, 'disproportion' FROM k WHERE latest AND account IN """ + IS_SQL + """ AND account <> 'STANDARD' AND abs(gap) >= 30
  UNION ALL SELECT *, CASE WHEN flip THEN 'earlier_flip' ELSE 'earlier_material' END FROM k WHERE NOT latest AND hit AND r <= 2)
SELECT entity_id, account, finding, pp AS from_period, period_end AS to_period, pv AS from_value, v AS to_value, round(pct, 4) AS pct,
  CASE WHEN finding = 'disproportion' THEN round(gap, 4) END AS gap_pp FROM u""")
def _(t):
    return A.material_variance(t.detail_line, "STANDARD", IS_ACCOUNTS)


@query("fallback_line", """WITH p AS (SELECT entity_id, account, period_end, CAST(sum(amount) AS DECIMAL(20,2)) AS total FROM detail_line GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY entity_id, account ORDER BY period_end DESC) AS r FROM p)
SELECT entity_id, account, period_end, total, concat('截至', year(period_end), '年', month(period_end), '月', day(period_end), '日余额合计',
  CASE WHEN total < 0 THEN '-' ELSE '' END,
  CASE WHEN abs(total) < 10000 THEN concat(format('{:,}', CAST(round(abs(total), 0) AS BIGINT)), '元')
       WHEN abs(total) / 10000.0 >= 10000 THEN concat(printf('%.2f', CAST(abs(total) AS DOUBLE) / 10000 / 10000), '亿元')
       ELSE concat(printf('%.1f', CAST(abs(total) AS DOUBLE) / 10000), '万元') END, '。') AS line FROM q WHERE r = 1 AND total <> 0""")
def _(t):
    return A.fallback_lines(t.detail_line)


@query("drop_detail_rows", "SELECT * FROM detail_line WHERE " + KIND + " <> 'breakdown'")
def _(t):
    return A.drop_detail_rows(t.detail_line)


ZEROED = "SELECT * REPLACE (CASE WHEN abs(amount) < 100000 THEN CAST(0 AS DECIMAL(20,2)) ELSE amount END AS amount) FROM detail_line"


def zeroed(t):
    """Lines with small figures taken as nil, so that the zero rules have work to do."""
    return t.detail_line.withColumn("amount", F.when(F.abs("amount") < 100000, F.lit(0)).otherwise(
        F.col("amount")).cast("decimal(20,2)"))


@query("drop_zero_rows", "WITH z AS (" + ZEROED + """) SELECT z.* FROM z JOIN (SELECT entity_id, account, row_idx FROM z GROUP BY ALL
  HAVING max(abs(amount)) >= 0.01 OR bool_or(contains(lower(description), 'total'))) k USING (entity_id, account, row_idx)""")
def _(t):
    return A.drop_zero_rows(zeroed(t))


@query("significant_accounts", "WITH z AS (" + ZEROED + ") SELECT entity_id, account, max(abs(amount)) AS peak FROM z GROUP BY ALL HAVING max(abs(amount)) >= 0.01")
def _(t):
    return A.significant_accounts(zeroed(t))


@query("drop_zero_periods", """WITH l AS (SELECT * FROM statement_full s WHERE EXISTS (SELECT 1 FROM statement_full x WHERE x.entity_id = s.entity_id
   AND x.statement_type = s.statement_type AND x.description = s.description AND x.amount <> 0)),
p AS (SELECT entity_id, period_end, max(abs(amount)) FILTER (statement_type = 'IS') AS ip, max(abs(amount)) FILTER (statement_type = 'BS') AS bp FROM l GROUP BY ALL),
g AS (SELECT entity_id, coalesce(bool_or(ip > 0), false) AS some_left FROM p GROUP BY ALL)
SELECT l.* FROM l JOIN p USING (entity_id, period_end) JOIN g USING (entity_id)
WHERE NOT coalesce(some_left AND ip = 0 AND (statement_type = 'IS' OR coalesce(bp, 0) = 0), false)""")
def _(t):
    return A.drop_zero_periods(t.statement_full)


# Lines of each account's latest year.
LATEST = "(SELECT * FROM detail_line SEMI JOIN (SELECT entity_id, account, max(yr) AS yr FROM detail_line GROUP BY ALL) USING (entity_id, account, yr))"


def at_latest(t):
    last = t.detail_line.groupBy("entity_id", "account").agg(F.max("yr").alias("yr"))
    return t.detail_line.join(last, ["entity_id", "account", "yr"], "left_semi")


@query("visible_rows", """WITH vis AS (SELECT DISTINCT entity_id, account, description FROM """ + LATEST + """ WHERE """ + KIND + """ <> 'breakdown'),
com AS (SELECT DISTINCT entity_id, account, description FROM detail_line WHERE """ + KIND + """ = 'breakdown'),
k AS (SELECT d.* FROM detail_line d SEMI JOIN (SELECT * FROM vis UNION SELECT * FROM com) w USING (entity_id, account, description))
SELECT * FROM k UNION ALL SELECT d.* FROM detail_line d ANTI JOIN k USING (entity_id, account)""")
def _(t):
    d = t.detail_line
    kind = A.row_type(F.col("description"))
    return A.visible_rows(d, at_latest(t).where(kind != "breakdown"), d.where(kind == "breakdown"))


@query("period_matrix", """WITH m AS (SELECT entity_id, account, description, concat('fy', yr) AS fy, amount FROM detail_line)
SELECT * FROM (PIVOT m ON fy IN ('fy1995', 'fy1996', 'fy1997', 'fy1998', 'fy1999', 'fy2000', 'fy2001', 'fy2002') USING max(amount) GROUP BY entity_id, account, description)""")
def _(t):
    return A.period_matrix(t.detail_line)


@query("unpivot_periods", "SELECT entity_id, account, description, concat('fy', yr) AS period, amount FROM detail_line")
def _(t):
    return A.unpivot_periods(A.period_matrix(t.detail_line), ["entity_id", "account", "description"])


GRAND = {"Total assets": ("Current assets", "Non-current assets"), "Total equity": ("Equity",)}


@query("synth_statement", """WITH t AS (SELECT s.entity_id, a.statement_type, s.period_end, a.category, s.account, s.amount FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account),
v AS (SELECT entity_id, statement_type, period_end, count(*) AS n FROM t GROUP BY ALL),
d AS (SELECT entity_id, statement_type, max(period_end) AS period_end FROM v x WHERE n = (SELECT max(n) FROM v y WHERE y.entity_id = x.entity_id AND y.statement_type = x.statement_type) GROUP BY ALL),
k AS (SELECT t.* FROM t JOIN d USING (entity_id, statement_type, period_end)),
c AS (SELECT entity_id, statement_type, period_end, category, CAST(sum(amount) AS DECIMAL(20,2)) AS amount FROM k GROUP BY ALL)
SELECT entity_id, statement_type, period_end, category, account AS description, amount, 0 AS level FROM k
UNION ALL SELECT entity_id, statement_type, period_end, category, concat('Total ', lower(category[1]), category[2:]), amount, 1 FROM c
UNION ALL SELECT entity_id, statement_type, period_end, NULL, 'Total assets', sum(amount), 2 FROM c WHERE category = 'Current assets' GROUP BY ALL
UNION ALL SELECT entity_id, statement_type, period_end, NULL, 'Net profit', sum(amount) FILTER (category = 'Revenue') - sum(amount) FILTER (category = 'Expenses'), 3
  FROM c WHERE statement_type = 'IS' GROUP BY ALL HAVING count(*) FILTER (category = 'Revenue') > 0 AND count(*) FILTER (category = 'Expenses') > 0""")
def _(t):
    return A.synthesise_statement(t.schedule_line, t.account_alias, GRAND)


@query("category_headings", """WITH o AS (SELECT s.entity_id, s.account AS label, a.category, row_number() OVER (PARTITION BY s.entity_id
  ORDER BY CASE statement_type WHEN 'BS' THEN 0 WHEN 'IS' THEN 1 ELSE 2 END, coalesce(line_no, 9999), s.account) AS position
  FROM (SELECT DISTINCT entity_id, account FROM schedule_line) s LEFT JOIN account_alias a ON a.tab_name = s.account)
SELECT entity_id, CAST(position AS DOUBLE) AS sort_key, label, false AS is_heading FROM o
UNION ALL SELECT entity_id, min(position) - 0.5, category, true FROM o WHERE category IS NOT NULL GROUP BY entity_id, category""")
def _(t):
    from tieout.operators.reconcile import report_order
    o = report_order(t.schedule_line.select("entity_id", "account").distinct(), t.account_alias)
    return A.category_headings(o.withColumnRenamed("account", "label"))


@query("variants", "WITH " + TAIL + """, l AS (SELECT d.entity_id, d.account, d.row_idx, d.description, d.period_end, d.amount, e.eff = d.period_end AS at_latest,
   CASE WHEN d.account IN """ + IS_SQL + """ THEN p.months END AS months FROM detail_line d JOIN ends e USING (entity_id, account) LEFT JOIN py p USING (entity_id, account)),
v AS (SELECT *, 'analysis' AS variant, amount AS value FROM l
 UNION ALL SELECT *, 'original', amount FROM l WHERE at_latest
 UNION ALL SELECT *, 'default', coalesce(CAST(amount * 12 / months AS DECIMAL(20,2)), amount) FROM l WHERE at_latest
 UNION ALL SELECT *, 'annualised', CAST(amount * 12 / months AS DECIMAL(20,2)) FROM l WHERE at_latest AND months IS NOT NULL)
SELECT entity_id, account, row_idx, description, period_end, variant, s.scope, value FROM v, (VALUES ('detail'), ('display')) s(scope)
WHERE s.scope = 'detail' OR """ + KIND + " <> 'breakdown'")
def _(t):
    return A.variants(t.detail_line, IS_ACCOUNTS)


TWO = """
p AS (SELECT entity_id, account, max(period_end) AS latest, max(period_end, 2)[2] AS prior FROM detail_line GROUP BY ALL),
pd AS (SELECT entity_id, account, latest, (SELECT max(period_end) FROM detail_line d WHERE d.entity_id = p.entity_id AND d.account = p.account AND d.period_end < p.latest) AS prior
  FROM (SELECT entity_id, account, max(period_end) AS latest FROM detail_line GROUP BY ALL) p),
cc AS (SELECT d.entity_id, d.account, d.row_idx, d.description, p.latest, p.prior,
   coalesce(sum(amount) FILTER (period_end = latest), 0) AS curr, coalesce(sum(amount) FILTER (period_end = prior), 0) AS prev
  FROM detail_line d JOIN pd p USING (entity_id, account) WHERE row_idx <> 7 AND (period_end = latest OR period_end = prior) GROUP BY ALL)
"""
TWO = TWO[TWO.index("pd AS"):]


@query("composition_residual", "WITH " + TWO + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, account ORDER BY abs(curr) DESC, row_idx) AS k FROM cc WHERE curr <> 0)
SELECT entity_id, account, latest, count(*) AS components, CAST(sum(curr) AS DECIMAL(20,2)) AS total,
  string_agg(description, ', ' ORDER BY k) FILTER (k <= 3) AS top3,
  CASE WHEN count(*) > 3 THEN CAST(sum(curr) FILTER (k > 3) AS DECIMAL(20,2)) END AS remainder,
  sum(curr) FILTER (NOT contains(description, 'Returned') AND NOT contains(description, 'Returns')) AS gross,
  sum(curr) FILTER (contains(description, 'Returned') OR contains(description, 'Returns')) AS contra, CAST(NULL AS DECIMAL(20,2)) AS adjustment
FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(t):
    return A.composition_residual(t.detail_line, contra=(*A.CONTRA_MARKERS, "Returned", "Returns"))


@query("composition_insight", "WITH " + TWO + """,
a AS (SELECT entity_id, account, latest, prior, sum(curr) AS tc, sum(prev) AS tp, max(abs(curr - prev)) AS md, max(greatest(abs(curr), abs(prev))) AS peak,
   max(curr) AS top1, count(*) FILTER (curr > 0) AS n_pos FROM cc GROUP BY ALL),
m AS (SELECT c.entity_id, c.account, arg_min(c.description, c.row_idx) AS mover, arg_min(c.curr - c.prev, c.row_idx) AS delta FROM cc c JOIN a USING (entity_id, account) WHERE abs(c.curr - c.prev) = a.md GROUP BY 1, 2),
ev AS (SELECT c.entity_id, c.account, arg_min(CASE WHEN abs(prev) < peak * 0.1 THEN 'appeared' ELSE 'stopped' END, c.row_idx) AS event, arg_min(c.description, c.row_idx) AS who
  FROM cc c JOIN a USING (entity_id, account) WHERE peak > 0 AND (abs(prev) < peak * 0.1) <> (abs(curr) < peak * 0.1) GROUP BY 1, 2),
tl AS (SELECT c.entity_id, c.account, arg_min(c.description, c.row_idx) AS top_label FROM cc c JOIN a USING (entity_id, account) WHERE c.curr = a.top1 GROUP BY 1, 2),
t3 AS (SELECT entity_id, account, sum(curr) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, account ORDER BY curr DESC, row_idx) AS r FROM cc WHERE curr > 0) WHERE r <= 3 GROUP BY ALL),
x AS (SELECT *, CAST(delta AS DOUBLE) / nullif(CAST(tc - tp AS DOUBLE), 0) AS sh, CAST(top1 AS DOUBLE) / nullif(CAST(tc AS DOUBLE), 0) AS s1, CAST(top3 AS DOUBLE) / nullif(CAST(tc AS DOUBLE), 0) AS s3
  FROM a JOIN m USING (entity_id, account) LEFT JOIN ev USING (entity_id, account) LEFT JOIN tl USING (entity_id, account) LEFT JOIN t3 USING (entity_id, account)),
z AS (SELECT *, CASE WHEN prior IS NOT NULL AND abs(tc - tp) * 10 >= greatest(abs(tc), abs(tp)) AND greatest(abs(tc), abs(tp)) > 0 AND sh >= 0.6 THEN 'movement'
  WHEN prior IS NOT NULL AND event IS NOT NULL THEN event WHEN tc > 0 AND s1 >= 0.5 THEN 'top1' WHEN tc > 0 AND n_pos >= 4 AND s3 >= 0.8 THEN 'top3' END AS insight FROM x)
SELECT entity_id, account, insight, CASE insight WHEN 'movement' THEN mover WHEN 'top1' THEN top_label WHEN 'top3' THEN NULL ELSE who END AS component,
  round(CASE insight WHEN 'movement' THEN sh WHEN 'top1' THEN s1 WHEN 'top3' THEN s3 END, 6) AS share FROM z WHERE insight IS NOT NULL""")
def _(t):
    return A.composition_insight(t.detail_line)


@query("revenue_ratios", "WITH " + TAIL + """,
s AS (SELECT * FROM schedule_line ANTI JOIN (SELECT entity_id, period_end FROM py WHERE account = 'STANDARD' AND months < 12) USING (entity_id, period_end)),
r AS (SELECT entity_id, period_end, amount, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS k FROM s WHERE account = 'STANDARD'),
p AS (SELECT n.entity_id, n.period_end AS now, n.amount AS rev, b.period_end AS bef, b.amount AS brev FROM r n JOIN r b ON b.entity_id = n.entity_id AND n.k = 1 AND b.k = 2 WHERE n.amount > 0),
x AS (SELECT s.entity_id, s.account, a.mapping_key, a.statement_type, rev, brev, sum(s.amount) FILTER (s.period_end = now) AS own, sum(s.amount) FILTER (s.period_end = bef) AS own_prev
  FROM s JOIN p USING (entity_id) JOIN account_alias a ON a.tab_name = s.account WHERE s.account <> 'STANDARD' AND s.period_end IN (now, bef) GROUP BY ALL),
y AS (SELECT *, statement_type = 'BS' AND mapping_key = 'AR' AS recv, abs(CAST(own AS DOUBLE)) / CAST(rev AS DOUBLE) * 365 AS days, abs(CAST(own AS DOUBLE)) / CAST(rev AS DOUBLE) * 100 AS share,
  CASE WHEN brev > 0 AND abs(own_prev) > 0 THEN abs(CAST(own_prev AS DOUBLE)) / CAST(brev AS DOUBLE) * 100 END AS pshare FROM x WHERE own IS NOT NULL AND own <> 0)
SELECT entity_id, account, CASE WHEN recv THEN 'days_of_revenue' ELSE 'share_of_revenue' END AS ratio, round(CASE WHEN recv THEN days ELSE share END, 4) AS value,
  CASE WHEN NOT recv THEN round(pshare, 4) END AS prior_value,
  CASE WHEN NOT recv AND abs(share - pshare) >= greatest(2.0, pshare * 0.2) THEN CASE WHEN share > pshare THEN 'rose' ELSE 'fell' END END AS movement
FROM y WHERE (recv AND days > 0 AND days < 1095) OR (statement_type = 'IS' AND share BETWEEN 0.5 AND 500)""")
def _(t):
    """Full periods only: an entity's part year of revenue is left out."""
    part = A.part_year(t.detail_line.where("account = 'STANDARD'")).select("entity_id", "period_end")
    return A.revenue_ratios(t.schedule_line.join(part, ["entity_id", "period_end"], "left_anti"), t.account_alias, "STANDARD", ["AR"])


@query("topn_other", "WITH " + TWO + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, account ORDER BY abs(curr) DESC, row_idx) AS k, count(*) OVER (PARTITION BY entity_id, account) AS items FROM cc WHERE curr <> 0)
SELECT entity_id, account, CAST(k AS INT) AS rank, description AS label, CAST(curr AS DECIMAL(20,2)) AS value FROM r WHERE items <= 5 OR k < 5
UNION ALL SELECT entity_id, account, 5, 'Other', CAST(sum(curr) AS DECIMAL(20,2)) FROM r WHERE items > 5 AND k >= 5 GROUP BY 1, 2""")
def _(t):
    return A.topn_with_other(t.detail_line)


@query("variance_sweep", "WITH " + TAIL + """,
mv AS (SELECT *, CASE WHEN pv <> 0 AND abs(CAST(pv AS DOUBLE)) >= CAST(scale AS DOUBLE) * 0.01 THEN (CAST(v AS DOUBLE) - CAST(pv AS DOUBLE)) / abs(CAST(pv AS DOUBLE)) * 100 END AS m FROM ful WHERE pv IS NOT NULL AND account IN """ + IS_SQL + """),
ac AS (SELECT entity_id, account, coalesce(bool_or(abs(m) >= 30), false) AS big, max(m) FILTER (i = n AND account = 'STANDARD') AS growth FROM mv GROUP BY ALL),
ex AS (SELECT DISTINCT entity_id, account FROM remark WHERE source = 'rhs_columns' AND note <> 'Check'),
j AS (SELECT ac.*, ex.account IS NOT NULL AS explained FROM ac LEFT JOIN ex USING (entity_id, account))
SELECT entity_id, account, count(*) AS accounts, count(*) FILTER (big AND explained) AS flagged, count(*) FILTER (big AND NOT explained) AS starved,
  count(*) FILTER (NOT explained) AS without_notes, round(max(growth), 4) AS revenue_growth, CAST(grouping(entity_id) * 2 + grouping(account) AS BIGINT) AS level
FROM j GROUP BY ROLLUP (entity_id, account)""")
def _(t):
    notes = t.remark.where("source = 'rhs_columns' AND note <> 'Check'").select("entity_id", "account").distinct()
    return A.variance_sweep(t.detail_line, IS_ACCOUNTS, "STANDARD", notes)


@query("account_display_unit", """SELECT d.*, CASE WHEN peak >= 100000000 THEN '人民币亿元' WHEN peak >= 10000 THEN '人民币万元' ELSE '人民币元' END AS unit,
  CASE WHEN peak >= 100000000 THEN 100000000 WHEN peak >= 10000 THEN 10000 ELSE 1 END AS divisor,
  CASE WHEN peak >= 100000000 THEN 2 WHEN peak >= 10000 THEN 1 ELSE 0 END AS decimals,
  CAST(CASE WHEN peak >= 100000000 THEN round(CAST(amount AS DOUBLE) / 100000000, 2) WHEN peak >= 10000 THEN round(CAST(amount AS DOUBLE) / 10000, 1) ELSE round(amount, 0) END AS DECIMAL(24,2)) AS shown
FROM detail_line d JOIN (SELECT entity_id, account, max(abs(amount)) AS peak FROM detail_line GROUP BY ALL) USING (entity_id, account)""")
def _(t):
    return A.account_display(t.detail_line, "Chi")


@query("fn_relabel_negative", """WITH d AS (SELECT entity_id, account, yr, row_idx, amount, CASE row_idx WHEN 5 THEN 'Retained Earnings' WHEN 6 THEN 'Closing retained earnings' ELSE description END AS description FROM detail_line)
SELECT *, CASE WHEN amount < 0 THEN replace(replace(description, 'Retained Earnings', 'Accumulated Losses'), 'retained earnings', 'accumulated losses') ELSE description END AS display_label,
  CASE WHEN amount < 0 AND contains(lower(description), 'retained earnings') THEN abs(amount) ELSE amount END AS display_value FROM d""")
def _(t):
    d = t.detail_line.select("entity_id", "account", "yr", "row_idx", "amount", F.when(F.col("row_idx") == 5, "Retained Earnings").when(
        F.col("row_idx") == 6, "Closing retained earnings").otherwise(F.col("description")).alias("description"))
    return A.relabel_negative(d, "Eng")


@query("display_projection", """SELECT entity_id, account, description, period_end, CASE WHEN amount = 0 THEN '0' ELSE printf('%.1f', CAST(amount AS DOUBLE) / 10000) END AS shown
FROM detail_line""")
def _(t):
    shown = F.when(F.col("amount") == 0, "0").otherwise(F.format_string("%.1f", F.col("amount").cast("double") / 10000))
    return t.detail_line.select("entity_id", "account", "description", "period_end", shown.alias("shown"))


@query("table_budget", """WITH c AS (SELECT entity_id, account, count(DISTINCT description) FILTER (row_idx <> 7 AND abs(amount) > 150000) AS components FROM """ + LATEST + """ GROUP BY ALL),
o AS (SELECT c.*, a.mapping_key, a.statement_type, row_number() OVER (PARTITION BY c.entity_id ORDER BY CASE statement_type WHEN 'BS' THEN 0 WHEN 'IS' THEN 1 ELSE 2 END, coalesce(line_no, 9999), c.account) AS position
  FROM c LEFT JOIN account_alias a ON a.tab_name = c.account),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, components >= 3 ORDER BY CASE statement_type WHEN 'IS' THEN 0 WHEN 'BS' THEN 1 ELSE 2 END,
   CASE lower(mapping_key) WHEN 'oi' THEN 0 WHEN 'oc' THEN 1 WHEN 'ga' THEN 3 WHEN 'ar' THEN 7 ELSE 14 END, components DESC, lower(coalesce(mapping_key, account))) AS r FROM o)
SELECT entity_id, account, components, CASE WHEN components < 3 THEN 'too few components' WHEN r <= 5 THEN 'kept' ELSE 'over budget' END AS decision, position,
  CASE WHEN components >= 3 THEN r END AS rank FROM k""")
def _(t):
    from tieout.operators.reconcile import report_order
    shown = (F.col("row_idx") != 7) & (F.abs("amount") > 150000)
    c = at_latest(t).groupBy("entity_id", "account").agg(
        F.count_distinct(F.when(shown, F.col("description"))).alias("components"))
    order = report_order(c.select("entity_id", "account"), t.account_alias)
    return A.table_budget(c.join(order, ["entity_id", "account"]))
