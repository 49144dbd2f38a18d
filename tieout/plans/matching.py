"""Matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.functions.similarity import seq_ratio
from tieout.operators import matching as M
from tieout.plans.registry import query

# Aliases the sheet labels are matched to (fixed values).
ALIASES = (("rings", "Small rings"), ("bolts", "Bolt, red"), ("gears", "hot gear"), ("rods", "cold rod"), ("anvils", "Other anvil"), ("widgets", "new widget"))


def aliases(t):
    return t.spark.createDataFrame(list(ALIASES), "mapping_key string, alias string")


def fuzzy_of(t):
    return t.shared("fuzzy", lambda: M.fuzzy_candidates(t.sheet_label, aliases(t)))


@query("mapping_overlay", """WITH b AS (SELECT mapping_key, statement_type, category, tab_name FROM account_alias WHERE mapping_key <> 'GA'),
d AS (SELECT DISTINCT p_type AS mapping_key, 'IS' AS statement_type, 'Revenue' AS category, p_type AS tab_name FROM part WHERE p_type NOT IN (SELECT tab_name FROM account_alias))
SELECT * FROM b UNION ALL SELECT * FROM d UNION ALL SELECT 'GA', 'IS', 'Other expenses', 'PROMO'""")
def _(t):
    base = t.account_alias.select("mapping_key", "statement_type", "category", "tab_name")
    found = t.part.select("p_type").distinct().join(base.select(F.col("tab_name").alias("p_type")), "p_type", "left_anti").select(
        F.col("p_type").alias("mapping_key"), F.lit("IS").alias("statement_type"), F.lit("Revenue").alias("category"), F.col("p_type").alias("tab_name"))
    manual = base.where("mapping_key = 'GA'").withColumn("category", F.lit("Other expenses"))
    return M.overlay(base, found.unionByName(manual))


@query("fuzzy_candidates")
def _(t):
    return M.fuzzy_candidates(t.sheet_label, aliases(t))


@query("assign_one_to_one")
def _(t):
    return M.assign_one_to_one(fuzzy_of(t))


@query("unresolved_sheets")
def _(t):
    used = M.assign_one_to_one(fuzzy_of(t)).select("workbook_id", "sheet_name")
    return t.sheet_label.select("workbook_id", "sheet_name").join(used, ["workbook_id", "sheet_name"], "left_anti")


RANK = """
st AS (SELECT s.entity_id, a.mapping_key, s.period_end, abs(s.amount) AS st FROM statement_line s JOIN account_alias a ON a.tab_name = s.account),
cd AS (SELECT DISTINCT s.entity_id, a.mapping_key, x.tab AS sheet, x.score FROM statement_line s JOIN account_alias a ON a.tab_name = s.account JOIN account_alias n ON n.line_no = a.line_no % 5 + 1, LATERAL (VALUES (a.tab_name, 60.0), (n.tab_name, 62.0)) x(tab, score)),
jn AS (SELECT c.*, st.st, abs(s.amount) AS tt, abs(st.st - abs(s.amount)) AS gap FROM cd c LEFT JOIN st USING (entity_id, mapping_key) LEFT JOIN schedule_line s ON s.entity_id = c.entity_id AND s.account = c.sheet AND s.period_end = st.period_end),
ag AS (SELECT entity_id, mapping_key, sheet, score, count(*) FILTER (gap <= greatest(1, st * 0.005)) AS matches, count(tt) AS periods, avg(CASE WHEN gap <= 1 THEN 0.0::DOUBLE WHEN st <> 0 THEN CAST(gap AS DOUBLE) / CAST(st AS DOUBLE) ELSE 1.0 END) AS g FROM jn GROUP BY ALL)
"""


@query("rank_candidates", "WITH " + RANK[1:] + """SELECT entity_id, mapping_key, sheet, CAST(score AS DOUBLE) AS score, matches, periods, round(g, 6) AS avg_gap,
  row_number() OVER (PARTITION BY entity_id, mapping_key ORDER BY matches DESC, round(g, 6) ASC NULLS LAST, score DESC, sheet) AS rank FROM ag""")
def ranked(t):
    chart = t.account_alias
    nxt = chart.select(((F.col("line_no") + 3) % 5 + 1).alias("line_no"), F.col("tab_name").alias("next_tab"))
    st = t.statement_line.join(chart.select(F.col("tab_name").alias("account"), "mapping_key", "line_no"), "account")
    cand = st.join(nxt, "line_no").select("entity_id", "mapping_key", "account", "next_tab").distinct().withColumn("c", F.explode(F.array(
        F.struct(F.col("account").alias("sheet"), F.lit(60.0).alias("score")), F.struct(F.col("next_tab").alias("sheet"), F.lit(62.0).alias("score"))))).select(
        "entity_id", "mapping_key", "c.*")
    return M.rank_candidates(cand, st, t.schedule_line.withColumnRenamed("account", "sheet"))


@query("candidate_decisions", "WITH " + RANK[1:] + r""",
rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id, mapping_key ORDER BY matches DESC, round(g, 6) ASC NULLS LAST, score DESC, sheet) AS rank FROM ag),
m AS (SELECT rk.entity_id, rk.mapping_key, CASE WHEN rk.entity_id % 5 = 0 THEN concat(sheet, ' v2') ELSE sheet END AS sheet, score + CASE WHEN rk.entity_id % 4 = 0 THEN 30 * (sheet = tab_name)::INT ELSE 0 END AS score,
   CASE WHEN rk.entity_id % 7 = 0 THEN 0 ELSE matches END AS matches, CASE WHEN rk.entity_id % 7 = 0 THEN 0 ELSE periods END AS periods, CASE WHEN rk.entity_id % 7 <> 0 AND periods > 0 THEN round(g, 6) END AS gap, rank,
   CASE WHEN rk.entity_id % 2 = 0 THEN rk.mapping_key ELSE sheet END AS alias, rk.entity_id % 3 = 0 AND sheet = tab_name AS exact FROM rk JOIN account_alias c ON c.mapping_key = rk.mapping_key),
p AS (SELECT a.*, b.entity_id IS NULL AS alone, a.score - b.score AS lead, b.gap - a.gap AS ahead, b.matches AS matches2, b.periods AS periods2, b.alias AS alias2, b.exact AS exact2,
   (SELECT bool_or(regexp_matches(sheet, '\bv\d+\b|version|\bcopy\b', 'i')) FROM m v WHERE v.entity_id = a.entity_id AND v.mapping_key = a.mapping_key AND v.rank <= 3) AS versions
   FROM m a LEFT JOIN m b ON b.entity_id = a.entity_id AND b.mapping_key = a.mapping_key AND b.rank = 2 WHERE a.rank = 1),
d AS (SELECT *, CASE WHEN alone THEN 'only candidate' WHEN exact AND NOT exact2 THEN 'exact alias' WHEN periods > 0 AND matches > matches2 THEN 'more periods tie'
   WHEN matches = matches2 AND (ahead >= 0.02 OR (ahead >= 0.005 AND lead >= 5) OR (abs(ahead) <= 0.001 AND lead >= 20)) THEN 'smaller gap'
   WHEN periods = 0 AND periods2 = 0 AND lead > 3 AND NOT (versions AND alias = alias2) THEN 'score' WHEN periods = 0 AND periods2 = 0 AND lead > 3 THEN 'several versions' ELSE 'too close' END AS reason FROM p)
SELECT k.entity_id, k.mapping_key, d.sheet, CASE WHEN d.entity_id IS NULL THEN 'rejected' WHEN reason IN ('several versions', 'too close') THEN 'ambiguous' ELSE 'accepted' END AS decision, coalesce(reason, 'no candidate') AS reason
FROM (SELECT DISTINCT entity_id, coalesce(mapping_key, s.account) AS mapping_key FROM statement_line s LEFT JOIN account_alias a ON a.tab_name = s.account) k LEFT JOIN d USING (entity_id, mapping_key)""")
def _(t):
    """Which first candidates are taken; figures, versions and exact names vary with the entity."""
    chart = t.account_alias
    e = F.col("entity_id")
    unseen = e % 7 == 0
    own = F.col("sheet") == F.col("tab_name")
    x = ranked(t).join(chart.select("mapping_key", "tab_name"), "mapping_key").select(
        "entity_id", "mapping_key", "rank", F.when(e % 5 == 0, F.concat("sheet", F.lit(" v2"))).otherwise(F.col("sheet")).alias("sheet"),
        (F.col("score") + F.when((e % 4 == 0) & own, 30).otherwise(0)).alias("score"), F.when(unseen, 0).otherwise(F.col("matches")).alias("matches"),
        F.when(unseen, 0).otherwise(F.col("periods")).alias("periods"), "avg_gap", F.when(e % 2 == 0, F.col("mapping_key")).otherwise(F.col("sheet")).alias("matched_alias"), ((e % 3 == 0) & own).alias("exact"))
    keys = t.statement_line.join(chart.select(F.col("tab_name").alias("account"), "mapping_key"), "account", "left").select("entity_id", F.coalesce("mapping_key", "account").alias("mapping_key")).distinct()
    return M.decide_candidates(x, keys, ["entity_id", "mapping_key"])


@query("dynamic_discovery", """SELECT s.entity_id, s.description, s.account AS sheet, s.period_end, s.amount FROM statement_line s JOIN schedule_line t USING (entity_id, account, period_end)
WHERE NOT EXISTS (SELECT 1 FROM account_alias a WHERE a.tab_name = s.account) AND abs(abs(s.amount) - abs(t.amount)) <= greatest(1, abs(s.amount) * 0.005)""")
def _(t):
    """Lines without a mapping against unused tabs of the same name, where the figures confirm it."""
    free = t.statement_line.join(t.account_alias.select(F.col("tab_name").alias("account")), "account", "left_anti")
    tabs = t.schedule_line.select("entity_id", "account", "period_end", F.col("amount").alias("tab_amount"))
    band = F.greatest(F.lit(1).cast("decimal(24,5)"), (F.abs("amount") * F.lit("0.005").cast("decimal(4,3)")).cast("decimal(24,5)"))
    return free.join(tabs, ["entity_id", "account", "period_end"]).where(F.abs(F.abs("amount") - F.abs("tab_amount")) <= band).select(
        "entity_id", "description", F.col("account").alias("sheet"), "period_end", "amount")


@query("override_issues", """WITH r AS (SELECT p_brand AS workbook_id, p_name AS sheet_name, CASE WHEN contains(p_name, 'ring') THEN 'OI' ELSE 'XX' END AS mapping_key FROM part WHERE contains(p_name, 'small') GROUP BY ALL
   UNION SELECT p_brand, p_name, 'AR' FROM part WHERE p_name = 'small ring' UNION SELECT DISTINCT p_brand, 'no such tab', 'OC' FROM part)
SELECT workbook_id, sheet_name, mapping_key, CASE WHEN mapping_key = 'XX' THEN 'unknown key' WHEN sheet_name = 'no such tab' THEN 'invalid sheet'
  WHEN mapping_key <> min(mapping_key) FILTER (mapping_key <> 'XX') OVER (PARTITION BY workbook_id, sheet_name) THEN 'conflict' ELSE 'applied' END AS issue FROM r""")
def _(t):
    p = t.part.select(F.col("p_brand").alias("workbook_id"), F.col("p_name").alias("sheet_name")).distinct()
    small = p.where(F.contains("sheet_name", F.lit("small")))
    asks = small.withColumn("mapping_key", F.when(F.contains("sheet_name", F.lit("ring")), "OI").otherwise("XX")).union(
        p.where("sheet_name = 'small ring'").withColumn("mapping_key", F.lit("AR"))).union(
        p.select("workbook_id").distinct().select("workbook_id", F.lit("no such tab"), F.lit("OC"))).distinct()
    return M.override_issues(asks, p, t.account_alias)


@query("summary_sheet", """WITH p AS (SELECT DISTINCT n_name AS workbook_id, s_name AS sheet, 'financial_schedule' AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT n_name, 'Financials', 'financial_summary' FROM nation)
SELECT workbook_id, 'Financials' AS sheet, 150 AS score, count(*) AS options FROM p GROUP BY 1""")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("workbook_id"))
    tabs = t.supplier.join(n, "s_nationkey").select("workbook_id", F.col("s_name").alias("sheet"), F.lit("financial_schedule").alias("kind")).distinct()
    return M.summary_sheet(tabs.unionByName(n.select("workbook_id", F.lit("Financials").alias("sheet"), F.lit("financial_summary").alias("kind"))))


@query("rollup_match")
def _(t):
    """Roll-up tabs are named after the entities' nations and regions."""
    r = t.nation.select(F.col("n_regionkey").alias("portfolio"), F.concat(F.lit("Roll-up "), F.replace("n_name", F.lit("_"), F.lit(" "))).alias("sheet_name"))
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("portfolio"), "n_name")
    e = t.supplier.join(n, "s_nationkey").select("portfolio", F.concat_ws(" ", F.replace("n_name", F.lit("_"), F.lit(" ")), "s_name").alias("entity"))
    return M.rollup_match(e, r)


@query("seq_ratio")
def _(t):
    """Similarity of distinct sheet labels and aliases whose last word the label has."""
    labels = t.sheet_label.select("sheet_name").distinct().select("sheet_name", F.explode(F.array_distinct(F.split("sheet_name", "[^A-Za-z0-9]+"))).alias("word"))
    last = aliases(t).select("alias", F.substring_index(F.lower("alias"), " ", -1).alias("word")).distinct()
    pairs = labels.join(last, "word").select("sheet_name", "alias").distinct()
    return pairs.withColumn("ratio", F.round(seq_ratio("sheet_name", "alias"), 6))
