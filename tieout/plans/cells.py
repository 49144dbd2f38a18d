"""Cell-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.operators import cells as X
from tieout.plans.registry import query
from tieout.sources import sinks

IS_DATE = "regexp_matches(cell_text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')"
IS_NUM = "regexp_matches(cell_text, '^-?[0-9]+\\.[0-9]+$')"
KT = "CASE WHEN contains(lower(description), 'total') THEN 'total' ELSE 'detail' END"
# Main lines of the cell sheets, straight from the ledger: accounts and total by year, in full units.
LINES = """
ln AS (SELECT portfolio AS workbook_id, entity AS sheet, 2 + a.line_no AS row_idx, yr - 1994 AS col_idx, account AS description, 'detail' AS row_type, CAST(CASE WHEN yr < 1997 THEN 'Mgt acc' ELSE 'Indicative adjusted' END AS VARCHAR) AS stage,
   period_end, CAST(amount * 1000 AS DECIMAL(24,0)) AS amount FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
 UNION ALL SELECT portfolio, entity, 9, yr - 1994, 'Total', 'total', CASE WHEN yr < 1997 THEN 'Mgt acc' ELSE 'Indicative adjusted' END, period_end, CAST(sum(amount) * 1000 AS DECIMAL(24,0)) FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
   GROUP BY ALL)
"""


def cells_of(t, name="cells"):
    """Typed cells, in a file for each bucket of the ledger: a sheet is put together from many small reads of them."""
    return t.shared(f"typed {name}", lambda: X.typed(getattr(t, name)).coalesce(t.buckets()))


def heads(t, name="cells"):
    """Header rows and description column: one row per sheet each."""
    return (t.shared(f"headers {name}", lambda: X.header_rows(cells_of(t, name))),
            t.shared(f"desc {name}", lambda: X.description_column(cells_of(t, name))))


def ends_of(t):
    return t.shared("ends", lambda: X.main_end(cells_of(t), heads(t)[1], heads(t)[0]))


def lines_of(t):
    return t.shared("cell_lines", lambda: X.normalise(cells_of(t), *heads(t), ends_of(t)))


@query("cells_scan", f"""SELECT workbook_id, sheet, row_idx, col_idx, cell_text, indent, hidden, CASE WHEN {IS_NUM} THEN CAST(cell_text AS DECIMAL(20,2)) END AS number, CASE WHEN {IS_DATE} THEN CAST(cell_text AS DATE) END AS date,
  CASE WHEN cell_text IN ('Mgt acc', 'Indicative adjusted') THEN cell_text END AS stage, cell_text = 'CNY''000' AS unit FROM cells WHERE trim(cell_text) <> ''""")
def _(t):
    return cells_of(t).drop("dated")


@query("used_range", "SELECT workbook_id, sheet, min(row_idx) AS first_row, max(row_idx) AS last_row, min(col_idx) AS first_col, max(col_idx) AS last_col FROM cells WHERE trim(cell_text) <> '' GROUP BY ALL")
def _(t):
    return X.used_range(cells_of(t))


@query("sheet_text_export", f"""WITH g AS (SELECT workbook_id, sheet, row_idx, c.c AS col_idx FROM (SELECT DISTINCT workbook_id, sheet, row_idx FROM cells) r, (SELECT unnest(range(0, 20)) AS c) c),
u AS (SELECT workbook_id, sheet, max(col_idx) AS last_col FROM cells GROUP BY ALL)
SELECT g.workbook_id, g.sheet, g.row_idx, concat('| ', g.row_idx + 1, ' | ', string_agg(coalesce(CASE WHEN {IS_NUM} THEN regexp_replace(regexp_replace(cell_text, '0+$', ''), '\\.$', '') ELSE trim(cell_text) END, ''), ' | ' ORDER BY g.col_idx), ' |') AS line
FROM g JOIN u USING (workbook_id, sheet) LEFT JOIN cells c USING (workbook_id, sheet, row_idx, col_idx) WHERE g.col_idx <= u.last_col GROUP BY 1, 2, 3""")
def _(t):
    return X.text_lines(cells_of(t))


@query("sheet_text_files", f"""WITH lines AS (SELECT workbook_id, sheet, line FROM (WITH g AS (SELECT workbook_id, sheet, row_idx, c.c AS col_idx FROM (SELECT DISTINCT workbook_id, sheet, row_idx FROM cells) r, (SELECT unnest(range(0, 20)) AS c) c),
u AS (SELECT workbook_id, sheet, max(col_idx) AS last_col FROM cells GROUP BY ALL)
SELECT g.workbook_id, g.sheet, g.row_idx, concat('| ', g.row_idx + 1, ' | ', string_agg(coalesce(CASE WHEN {IS_NUM} THEN regexp_replace(regexp_replace(cell_text, '0+$', ''), '\\.$', '') ELSE trim(cell_text) END, ''), ' | ' ORDER BY g.col_idx), ' |') AS line
FROM g JOIN u USING (workbook_id, sheet) LEFT JOIN cells c USING (workbook_id, sheet, row_idx, col_idx) WHERE g.col_idx <= u.last_col GROUP BY 1, 2, 3)
 UNION ALL SELECT workbook_id, sheet, unnest([concat('===== SHEET: ', sheet, ' ====='), concat('USED_RANGE: A1:', chr(CAST(65 + last_col AS INT)), last_row + 1),
   concat('| ExcelRow | ', array_to_string(list_transform(range(0, last_col + 1), lambda c: concat('Col', chr(CAST(65 + c AS INT)))), ' | '), ' |')])
 FROM (SELECT workbook_id, sheet, max(col_idx) AS last_col, max(row_idx) AS last_row FROM cells GROUP BY ALL) x)
SELECT workbook_id, line, count(*) AS n FROM lines GROUP BY ALL""")
def _(t):
    """Workbooks written as text files, one folder each, and read back line by line."""
    path = sinks.new_path(t.spark, "sheet-text")
    sinks.write_lines(X.sheet_export(cells_of(t)), path, ["workbook_id"], ["sheet", "row_idx"])
    return t.spark.read.text(path).groupBy("workbook_id", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("sheet_preview", "SELECT workbook_id, sheet, count(*) FILTER (trim(cell_text) <> '') AS filled, bool_or(hidden) AS hidden, count(*) FILTER (trim(cell_text) <> '') > 0 AND NOT bool_or(hidden) AS offered FROM cells WHERE row_idx < 12 GROUP BY 1, 2")
def _(t):
    return X.preview(t.cells)


@query("file_meta", """SELECT s_suppkey AS entity_id, CASE s_nationkey % 4 WHEN 3 THEN NULL ELSE CASE s_nationkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END END AS portfolio,
  CASE s_nationkey % 4 WHEN 3 THEN NULL WHEN 2 THEN true ELSE false END AS is_rollup, CASE WHEN s_nationkey % 4 IN (0, 1) THEN s_name END AS entity_name FROM supplier""")
def _(t):
    n = F.col("s_nationkey")
    roman = F.when(n % 3 == 0, "I").when(n % 3 == 1, "II").otherwise("III")
    name = F.when(n % 4 == 3, F.concat("s_name", F.lit(".xlsx"))).otherwise(F.concat(F.lit("Project Alpha.Portfolio "), roman, F.when(n % 4 == 2, F.lit(".主表.xlsx")).otherwise(
        F.concat(F.when(n % 4 == 1, F.lit(".databook. ")).otherwise(F.lit(".")), F.col("s_name"), F.lit(".xlsx")))))
    stem = F.regexp_replace(name, r"(?i)\.xlsx$", "")
    pat = r"(?i)Portfolio\s+(I{1,3})\b(.*)$"
    p = F.nullif(F.upper(F.regexp_extract(stem, pat, 1)), F.lit(""))
    rest = F.trim(F.regexp_replace(F.regexp_extract(stem, pat, 2), r"^\.+", ""))
    rollup = F.contains(rest, F.lit("主表"))
    entity = F.nullif(F.regexp_replace(F.regexp_replace(rest, r"(?i)^databook\.?\s*", ""), r"^[ .]+|[ .]+$", ""), F.lit(""))
    return t.supplier.select(F.col("s_suppkey").alias("entity_id"), p.alias("portfolio"), F.when(p.isNotNull(), rollup).alias("is_rollup"),
                             F.when(p.isNotNull() & ~rollup, entity).alias("entity_name"))


@query("header_rows", "SELECT DISTINCT workbook_id, sheet, 1 AS stage_row, 2 AS date_row FROM cells")
def _(t):
    return X.header_rows(cells_of(t))


@query("description_column", "SELECT workbook_id, sheet, min(col_idx) AS desc_col FROM cells WHERE cell_text = 'CNY''000' GROUP BY 1, 2")
def _(t):
    return X.description_column(cells_of(t))


@query("ffill_stage", f"""SELECT c.workbook_id, c.sheet, c.col_idx, max(CAST(CASE WHEN {IS_DATE} THEN cell_text END AS DATE)) AS date, CASE WHEN c.col_idx = 0 OR c.col_idx = 10 THEN NULL WHEN c.col_idx < 3 THEN 'Mgt acc' ELSE 'Indicative adjusted' END AS stage
FROM cells c WHERE row_idx IN (1, 2) GROUP BY 1, 2, 3""")
def _(t):
    return X.filled_stages(cells_of(t), heads(t)[0])


@query("dedupe_columns", f"SELECT workbook_id, sheet, CASE WHEN col_idx < 3 THEN 'Mgt acc' ELSE 'Indicative adjusted' END AS stage, CAST(cell_text AS DATE) AS date, min(col_idx) AS col_idx FROM cells WHERE row_idx = 2 AND {IS_DATE} GROUP BY ALL")
def _(t):
    return X.dedupe_columns(X.filled_stages(cells_of(t), heads(t)[0]))


@query("value_columns", f"""WITH b AS (SELECT workbook_id, sheet, col_idx, count(*) FILTER ({IS_NUM}) AS numbers, count(*) FILTER (NOT {IS_NUM}) AS texts FROM cells WHERE row_idx >= 3 GROUP BY ALL)
SELECT d.workbook_id, d.sheet, d.col_idx, CAST(d.cell_text AS DATE) AS date, coalesce(numbers, 0) AS numbers, coalesce(texts, 0) AS texts, coalesce(m.cell_text = 'Indicative adjusted', false) AS marked
FROM cells d LEFT JOIN b USING (workbook_id, sheet, col_idx) LEFT JOIN cells m ON m.workbook_id = d.workbook_id AND m.sheet = d.sheet AND m.col_idx = d.col_idx AND m.row_idx = 1
WHERE d.row_idx = 2 AND regexp_matches(d.cell_text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND d.col_idx > 0 AND (coalesce(m.cell_text = 'Indicative adjusted', false) OR (numbers >= 1 AND numbers >= texts AND texts <= 2) OR coalesce(numbers + texts, 0) = 0)""")
def _(t):
    return X.value_columns(cells_of(t), *heads(t))


@query("best_header", """SELECT workbook_id, sheet, 2 AS date_row, 1 AS marker_row, count(*) FILTER (row_idx = 1 AND cell_text = 'Indicative adjusted') AS marked, count(*) FILTER (row_idx = 2 AND col_idx > 0) AS dates, count(*) FILTER (row_idx = 2 AND col_idx > 0) AS columns
FROM cells GROUP BY 1, 2""")
def _(t):
    return X.best_header(cells_of(t), *heads(t))


@query("header_columns", f"""WITH c AS MATERIALIZED (SELECT *, {IS_NUM} AS num, CASE WHEN {IS_DATE} THEN CAST(cell_text AS DATE) END AS date, cell_text = 'Indicative adjusted' AS marked FROM header_cells),
p AS MATERIALIZED (SELECT c.workbook_id, c.sheet, c.row_idx, c.col_idx, c.date, count(b.num) FILTER (b.num) AS n, count(b.num) FILTER (NOT b.num) AS x
  FROM c LEFT JOIN c b ON b.workbook_id = c.workbook_id AND b.sheet = c.sheet AND b.col_idx = c.col_idx AND b.row_idx > c.row_idx WHERE c.date IS NOT NULL AND c.col_idx > 0 GROUP BY ALL),
staged AS (SELECT DISTINCT workbook_id, sheet FROM c WHERE marked),
s0 AS (SELECT p.*, coalesce(m.marked, false) AS marked FROM p SEMI JOIN staged USING (workbook_id, sheet) LEFT JOIN c m ON m.workbook_id = p.workbook_id AND m.sheet = p.sheet AND m.col_idx = p.col_idx AND m.row_idx = p.row_idx - 1
  WHERE coalesce(m.marked, false) OR n + x = 0 OR (n >= 1 AND n >= x AND x <= 2)),
s1 AS (SELECT *, min(col_idx) FILTER (marked) OVER w AS lo, max(col_idx) FILTER (marked) OVER w AS hi FROM s0 WINDOW w AS (PARTITION BY workbook_id, sheet)),
tier AS (SELECT p.*, t.tier FROM p ANTI JOIN staged USING (workbook_id, sheet), (VALUES (1, 0.4, 2), (2, 0.3, 3)) t(tier, least, most) WHERE n >= 1 AND n / (n + x) >= least AND x <= most),
best AS (SELECT * FROM (SELECT workbook_id, sheet, tier, row_idx, count(*) AS k FROM tier GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY tier, k DESC, row_idx) = 1)
SELECT workbook_id, sheet, row_idx AS date_row, row_idx - 1 AS marker_row, 0 AS tier, date, min(col_idx) AS col_idx FROM s1 WHERE col_idx BETWEEN lo AND hi GROUP BY ALL
UNION ALL SELECT workbook_id, sheet, row_idx, NULL, tier, date, min(col_idx) FROM tier SEMI JOIN best USING (workbook_id, sheet, tier, row_idx) GROUP BY ALL""")
def _(t):
    """Value columns of sheets with and without a stage row."""
    return X.header_columns(cells_of(t, "header_cells"), *heads(t, "header_cells"))


@query("section_bounds", """SELECT DISTINCT workbook_id, sheet, s.section, s.start_row, s.end_row FROM statement_cells, (VALUES ('BS', 0, 6), ('IS', 7, 15)) s(section, start_row, end_row)""")
def _(t):
    return X.section_bounds(cells_of(t, "statement_cells"))


@query("extract_statement", f"""WITH v AS (SELECT workbook_id, sheet, CASE WHEN row_idx < 7 THEN 'BS' ELSE 'IS' END AS section, row_idx, col_idx, CAST(round_even(CAST(cell_text AS DECIMAL(24,2)) * 1000, 0) AS DECIMAL(24,0)) AS amount FROM statement_cells WHERE {IS_NUM} AND row_idx < 15),
l AS (SELECT workbook_id, sheet, row_idx, cell_text AS description FROM statement_cells WHERE col_idx = 0), d AS (SELECT workbook_id, sheet, col_idx, CAST(cell_text AS DATE) AS period_end FROM statement_cells WHERE row_idx = 1 AND {IS_DATE})
SELECT v.workbook_id, v.sheet, v.section, v.row_idx, description, period_end, amount FROM v JOIN l USING (workbook_id, sheet, row_idx) JOIN d USING (workbook_id, sheet, col_idx)
WHERE EXISTS (SELECT 1 FROM v z WHERE z.workbook_id = v.workbook_id AND z.sheet = v.sheet AND z.row_idx = v.row_idx AND z.amount <> 0)""")
def _(t):
    return X.extract_statement(cells_of(t, "statement_cells"), t.shared("bounds", lambda: X.section_bounds(cells_of(t, "statement_cells"))), heads(t, "statement_cells")[1])


@query("sheet_profile", """SELECT workbook_id, sheet, 'financial_schedule' AS kind, arg_min(cell_text, col_idx) FILTER (row_idx = 0) AS title, 1 AS stage_row, 2 AS date_row, string_agg(DISTINCT CASE WHEN cell_text IN ('Mgt acc', 'Indicative adjusted') THEN cell_text END, ', ' ORDER BY CASE WHEN cell_text IN ('Mgt acc', 'Indicative adjusted') THEN cell_text END) AS stage_labels,
  'CNY''000' AS unit_markers, bool_or(cell_text = 'Indicative adjusted') AS has_indicative, 'single' AS scope FROM cells GROUP BY 1, 2""")
def _(t):
    return X.sheet_profile(cells_of(t), heads(t)[0])


@query("entity_blocks", """SELECT workbook_id, sheet, sheet AS entity, 1 AS stage_row, CAST(NULL AS INT) AS end_row, concat('Schedule - ', sheet) AS title, 22 AS score, true AS strict FROM cells GROUP BY ALL""")
def _(t):
    return X.entity_blocks(cells_of(t), cells_of(t).select("workbook_id", "sheet", F.col("sheet").alias("entity")).distinct())


@query("rollforward", """SELECT portfolio AS workbook_id, concat('Assets ', entity) AS sheet, lower(account) AS component, period_end, amount FROM schedule_line JOIN account_alias ON tab_name = account
WHERE entity_id IN (SELECT entity_id FROM schedule_line GROUP BY 1 HAVING count(DISTINCT yr) >= 2)""")
def _(t):
    return X.rollforward(cells_of(t, "rollforward_cells"), heads(t, "rollforward_cells")[1])


@query("label_ffill", """WITH r AS (SELECT workbook_id, sheet, row_idx, max(cell_text) FILTER (col_idx = 0) AS own FROM cells GROUP BY ALL)
SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY workbook_id, sheet ORDER BY row_idx) AS label FROM r""")
def _(t):
    return X.label_fill(cells_of(t), heads(t)[1])


@query("normalize_schedules", "WITH " + LINES + "SELECT * FROM ln")
def _(t):
    return lines_of(t)


@query("projection_choice", "WITH " + LINES + """, c AS (SELECT workbook_id, sheet, stage, period_end, sum(abs(amount)) AS size FROM ln GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY CASE WHEN stage = 'Indicative adjusted' THEN 1 ELSE 0 END DESC, period_end DESC) AS k FROM c)
SELECT workbook_id, sheet, stage AS effective_stage, period_end AS effective_date, size, CASE WHEN stage = 'Indicative adjusted' THEN '-' ELSE 'Fallback from Indicative adjusted to Mgt acc' END AS flag FROM r WHERE k = 1""")
def _(t):
    return X.projection_choice(lines_of(t))


@query("detail_tables", "WITH " + LINES + """SELECT workbook_id, sheet, 20 AS head, count(DISTINCT period_end) AS tied, 0 AS differs, count(DISTINCT row_idx) FILTER (row_type = 'detail') AS rows FROM ln GROUP BY 1, 2""")
def _(t):
    return X.detail_tables(cells_of(t), ends_of(t), lines_of(t))


@query("detail_from_breakdown", """WITH b AS (SELECT entity_id, account, row_idx, description FROM detail_line WHERE row_idx IN (4, 6) GROUP BY ALL)
SELECT *, false AS heading, count(*) OVER (PARTITION BY entity_id, account) AS valued FROM b QUALIFY count(*) OVER (PARTITION BY entity_id, account) >= 2""")
def _(t):
    return X.detail_from_breakdown(t.detail_line, ["entity_id", "account"])


@query("aux_totals", "SELECT portfolio AS workbook_id, entity AS sheet, period_end, CAST(sum(amount) * 1000 AS DECIMAL(24,0)) AS total FROM schedule_line GROUP BY 1, 2, 3")
def _(t):
    return X.auxiliary_totals(cells_of(t), lines_of(t))


@query("supporting_notes", """SELECT workbook_id, sheet, concat(l.cell_text, ' | ', n.cell_text) AS note, row_idx, row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY row_idx) AS note_no FROM cells n JOIN cells l USING (workbook_id, sheet, row_idx)
WHERE n.col_idx = 10 AND l.col_idx = 0 AND row_idx > 2""")
def _(t):
    return X.supporting_notes(cells_of(t), *heads(t), ends_of(t), lines_of(t))


@query("adjacent_columns", "SELECT workbook_id, sheet, col_idx, count(*) AS filled, 'Remarks' AS header FROM cells WHERE col_idx = 10 AND row_idx BETWEEN 3 AND 9 GROUP BY 1, 2, 3")
def _(t):
    return X.adjacent_columns(cells_of(t), heads(t)[0], ends_of(t), lines_of(t))


@query("row_type_counts", """SELECT entity_id, account, yr, count(*) FILTER (row_idx IN (1, 2, 3, 5)) AS detail, count(*) FILTER (row_idx IN (4, 6)) AS breakdown, 0 AS subtotal, count(*) FILTER (row_idx = 7) AS total, count(*) AS rows FROM detail_line GROUP BY 1, 2, 3""")
def _(t):
    return X.row_type_counts(t.detail_line, ["entity_id", "account", "yr"])


@query("language_vote", """WITH s AS (SELECT workbook_id, sheet, bool_or(regexp_matches(cell_text, '[一-鿿]')) AS cjk, bool_or(contains(lower(cell_text), 'balance sheet')) AS bs, bool_or(contains(lower(cell_text), 'income statement')) AS inc
  FROM (SELECT workbook_id, sheet, row_idx, cell_text FROM statement_cells UNION ALL SELECT workbook_id, sheet, row_idx, cell_text FROM cells) WHERE row_idx < 20 GROUP BY ALL)
SELECT workbook_id, count(*) FILTER (cjk) AS chi, count(*) FILTER (NOT cjk) AS eng, CASE WHEN count(*) FILTER (cjk) > count(*) FILTER (NOT cjk) THEN 'Chi' ELSE 'Eng' END AS language, CASE WHEN bool_or(bs) AND bool_or(inc) THEN 'full' ELSE 'none' END AS mode FROM s GROUP BY 1""")
def _(t):
    c = ["workbook_id", "sheet", "row_idx", "cell_text"]
    return X.language_vote(cells_of(t, "statement_cells").select(*c).unionByName(cells_of(t).select(*c)))


@query("entity_candidates", """SELECT workbook_id, sheet AS name, count(*) AS seen, 'sheet,title' AS sources FROM (SELECT DISTINCT workbook_id, sheet FROM cells UNION ALL SELECT workbook_id, sheet FROM cells WHERE row_idx = 0) GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t):
    return X.entity_candidates(cells_of(t))


@query("unit_coverage", "SELECT workbook_id, sheet, min(row_idx) FILTER (contains(lower(cell_text), 'cny''000')) AS marker_row, CASE WHEN min(row_idx) FILTER (contains(lower(cell_text), 'cny''000')) < 8 THEN 'top' ELSE 'later' END AS coverage FROM cells GROUP BY 1, 2")
def _(t):
    return X.unit_coverage(cells_of(t))


SCALE = "CASE WHEN entity_id % 5 = 0 THEN 1 WHEN entity_id % 5 = 1 THEN 1000 WHEN entity_id % 5 = 2 THEN 1000000 WHEN entity_id % 5 = 3 THEN 0 END"
PRINTED = "CASE WHEN entity_id % 4 = 0 THEN 'CNY''000' WHEN entity_id % 4 = 1 THEN '人民币千元' WHEN entity_id % 4 = 2 THEN 'CNY' END"


@query("value_scale", f"""WITH s AS (SELECT entity_id, statement_type, period_end, CAST(amount AS DECIMAL(20,2)) / 1 AS a, {SCALE} AS f FROM statement_full),
l AS (SELECT entity_id, statement_type, max(period_end) AS period_end FROM s GROUP BY ALL),
m AS (SELECT entity_id, statement_type, period_end, max(CASE WHEN f = 0 THEN 0 ELSE abs(round(a / f, 2)) END) AS largest FROM s JOIN l USING (entity_id, statement_type, period_end) GROUP BY ALL),
c AS (SELECT entity_id, statement_type, period_end, {PRINTED} AS unit, CASE WHEN largest > 0 THEN largest END AS v FROM m),
d AS (SELECT *, CASE WHEN v >= 1000000 THEN 'units' WHEN v >= 1000 THEN 'thousands' WHEN v > 0 THEN 'small' END AS scale FROM c)
SELECT entity_id, statement_type, unit, period_end, CAST(v AS DECIMAL(20,2)) AS largest, scale,
  CASE WHEN unit IS NOT NULL AND scale <> 'small' THEN (unit <> 'CNY') = (scale = 'units') END AS mismatch FROM d""")
def _(t):
    """Statements in whole units, thousands, millions, zeros and blanks under printed units of three kinds or none."""
    keys = ["entity_id", "statement_type"]
    factor = F.expr(SCALE)
    amount = F.when(factor == 0, F.lit(0)).otherwise(F.round(F.col("amount") / factor, 2)).cast("decimal(20,2)")
    printed = t.statement_full.select(*keys).distinct().withColumn("unit", F.expr(PRINTED.replace("CNY''000", "CNY\\'000")))
    return X.value_scale(t.statement_full.select(*keys, "period_end", amount.alias("amount")), printed, keys)


@query("stage_label_audit", "SELECT workbook_id, sheet, 1 AS stage_row, count(*) FILTER (row_idx = 1) AS labels, count(*) FILTER (row_idx = 1 AND cell_text = 'Remarks') AS unrecognised, count(*) FILTER (row_idx = 1 AND cell_text = 'Remarks') AS undated FROM cells GROUP BY 1, 2")
def _(t):
    return X.stage_label_audit(cells_of(t))


@query("scaling_audit", "WITH " + LINES + "SELECT workbook_id, sheet, count(*) AS compared, 0 AS off, CAST(0 AS DECIMAL(24,2)) AS largest_gap FROM ln GROUP BY 1, 2")
def _(t):
    return X.scaling_audit(cells_of(t), lines_of(t))


@query("row_survival", """SELECT workbook_id, sheet, row_idx, max(cell_text) FILTER (col_idx = 0) AS label, CASE WHEN row_idx <= 9 THEN 'kept' ELSE 'below the table' END AS outcome FROM cells WHERE row_idx > 2 GROUP BY 1, 2, 3""")
def _(t):
    return X.row_survival(cells_of(t), *heads(t), ends_of(t), lines_of(t))


@query("label_set_search", """WITH w AS (SELECT DISTINCT n_name AS list_id, n_name AS workbook_id, tab_name AS label FROM nation, account_alias WHERE tab_name IN ('SMALL', 'PROMO', 'MEDIUM')),
h AS (SELECT list_id, c.workbook_id, sheet, label, min(row_idx) AS r FROM cells c JOIN w ON w.workbook_id = c.workbook_id AND w.label = trim(c.cell_text) WHERE col_idx < 4 GROUP BY ALL),
s AS (SELECT list_id, workbook_id, sheet, count(*) AS hits, min(r) AS first_row FROM h GROUP BY ALL HAVING count(*) >= 2)
SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY hits DESC, first_row, sheet) AS rank FROM s""")
def _(t):
    labels = F.explode(F.array(F.lit("SMALL"), F.lit("PROMO"), F.lit("MEDIUM")))
    wanted = t.nation.select(F.col("n_name").alias("list_id"), F.col("n_name").alias("workbook_id"), labels.alias("label"))
    return X.label_set_search(cells_of(t), wanted)


@query("bridge_blocks", """WITH y AS (SELECT entity, portfolio, yr, CAST(sum(amount) AS DECIMAL(20,2)) AS total, CAST(sum(amount) - 1000 AS DECIMAL(20,2)) AS step FROM schedule_line GROUP BY ALL),
t AS (SELECT entity, portfolio, CAST(sum(amount) AS DECIMAL(20,2)) AS s, CAST(sum(amount) / 2 AS DECIMAL(20,2)) AS h FROM schedule_line GROUP BY ALL),
i AS (SELECT portfolio AS workbook_id, concat('Bridge ', entity) AS sheet, 0 AS head, 2 AS base_col, yr - 1994 AS row_idx, CASE yr WHEN 1995 THEN 'Start' WHEN 2002 THEN 'End' ELSE concat('Move ', yr) END AS label,
   CASE WHEN yr IN (1995, 2002) THEN 'total' ELSE 'delta' END AS kind, CASE WHEN yr IN (1995, 2002) THEN total ELSE step END AS value FROM y
 UNION ALL SELECT portfolio, concat('Bridge ', entity), 20, 6, 21, 'Opening', 'total', s FROM t UNION ALL SELECT portfolio, concat('Bridge ', entity), 20, 6, 22, 'Rise', 'delta', h FROM t UNION ALL SELECT portfolio, concat('Bridge ', entity), 20, 6, 23, 'Closing', 'total', s + h FROM t),
k AS (SELECT workbook_id, sheet, head, arg_min(value, row_idx) + sum(value) FILTER (kind = 'delta') AS rebuilt, arg_max(value, row_idx) AS e FROM i GROUP BY 1, 2, 3)
SELECT i.*, abs(rebuilt - e) < greatest(1.0, abs(CAST(e AS DOUBLE)) * 0.005) AS check_ok FROM i JOIN k USING (workbook_id, sheet, head)""")
def _(t):
    return X.bridge_blocks(cells_of(t, "bridge_cells"))


@query("period_blocks", """WITH n AS (SELECT portfolio AS workbook_id, entity AS sheet, count(DISTINCT yr) AS periods, count(DISTINCT account) FILTER (account <> 'ECONOMY') AS accts, max(a.line_no) AS top FROM schedule_line s LEFT JOIN account_alias a ON a.tab_name = s.account GROUP BY 1, 2)
SELECT workbook_id, sheet, 0 AS label_col, 2 AS head, periods, accts + 1 AS data_rows, 9 AS last_row, concat('Schedule - ', sheet) AS title FROM n WHERE periods >= 2
UNION ALL SELECT workbook_id, sheet, 0, 20, periods, accts, 20 + top, '示意性调整后 - detail of accounts in this book' FROM n WHERE periods >= 2 AND accts >= 2""")
def _(t):
    return X.period_blocks(cells_of(t))


@query("journal_blocks", """WITH e AS (SELECT portfolio AS workbook_id, concat('Journal ', entity) AS sheet, account, headed, row_at, lag(account) OVER (PARTITION BY portfolio, entity, headed ORDER BY row_at) AS before FROM journal_line)
SELECT workbook_id, sheet, 0 AS label_col, 0 AS head, CAST(3 AS BIGINT) AS periods, 3 * count(*) AS data_rows, CAST(max(row_at) + 2 AS INT) AS last_row, CAST(NULL AS VARCHAR) AS title FROM e WHERE headed GROUP BY ALL
UNION ALL SELECT workbook_id, sheet, 0, row_at, 2, 2, row_at + 2, 'Tax ' || lower(before) FROM e WHERE NOT headed AND (row_at - 1001) % 6 = 0""")
def _(t):
    """Blocks of journals whose rows are dated themselves."""
    return X.period_blocks(cells_of(t, "journal_cells"))


@query("phase_blocks", """WITH b AS (SELECT entity, phase, k, row_number() OVER (PARTITION BY entity ORDER BY k) AS n, count(*) OVER (PARTITION BY entity) AS blocks FROM (SELECT DISTINCT entity, phase, k FROM ph)),
tg AS (SELECT entity, k AS tag_row, tag, count(*) AS size, count(*) OVER (PARTITION BY entity) AS tags FROM phase_tag GROUP BY entity, k, tag HAVING count(*) >= 4),
o AS (SELECT ph.entity, ph.k, tg.tag, tag_row, size, count(*) AS overlap FROM ph JOIN phase_tag USING (entity, yr) JOIN tg ON tg.entity = ph.entity AND tg.tag_row = phase_tag.k WHERE ph.area <> 0 OR ph.revenue <> 0 GROUP BY ALL),
best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY entity, k ORDER BY overlap DESC, size, tag_row) = 1),
x AS (SELECT b.entity, n, b.k, CASE WHEN c.tags IS NULL THEN phase WHEN c.tags = blocks THEN concat('T', substr(phase, 1, 3)) ELSE coalesce(best.tag, concat('Phase ', n)) END AS base
  FROM b LEFT JOIN (SELECT DISTINCT entity, tags FROM tg) c ON c.entity = b.entity LEFT JOIN best ON best.entity = b.entity AND best.k = b.k),
y AS (SELECT *, row_number() OVER (PARTITION BY entity, base ORDER BY n) AS again FROM x)
SELECT entity AS sheet, n, CASE WHEN again = 1 THEN base ELSE concat(base, ' (', again, ')') END AS label,
  CAST(10 + k * 6 AS INT) AS occupancy_row, CAST(11 + k * 6 AS INT) AS area_row, CAST(12 + k * 6 AS INT) AS rent_row, CAST(13 + k * 6 AS INT) AS revenue_row FROM y""")
def _(t):
    return X.phase_blocks(t.phase_cells)
