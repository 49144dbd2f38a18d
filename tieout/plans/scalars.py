"""Column-expression queries: each runs one family of rules over a whole table column."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.functions import cleanup as K
from tieout.functions import dates as D
from tieout.functions import labels as L
from tieout.functions import numbers as N
from tieout.functions import prose as P
from tieout.plans.registry import query

c = F.col


@query("fn_coerce_numeric", """WITH x AS (SELECT *, trim(replace(replace(replace(replace(replace(trim(cell_text), ',', ''), '，', ''), ')', ''), '(', '-'), ' ', '')) AS n FROM amount_text)
SELECT entity_id, account, yr, row_idx, cell_text, CASE WHEN regexp_matches(n, '^[+-]?[0-9]+\\.?[0-9]*$') THEN CAST(n AS DOUBLE) END AS value,
  regexp_replace(trim(cell_text), '([0-9])[，,]([0-9])', '\\1\\2', 'g') AS parseable FROM x""")
def _(t):
    return t.amount_text.select("entity_id", "account", "yr", "row_idx", "cell_text", N.coerce_numeric(c("cell_text")).alias("value"),
                                N.parseable_number_text(c("cell_text")).alias("parseable"))


CORPUS = """(SELECT concat('doc ', doc_id) AS id, text FROM documents UNION ALL SELECT concat('note ', entity_id, ' ', account, ' ', yr, ' ', attempt), text FROM commentary_gen)"""


def corpus(t):
    docs = t.documents.select(F.concat(F.lit("doc "), c("doc_id").cast("string")).alias("id"), "text")
    return docs.unionByName(t.commentary_gen.select(F.concat_ws(" ", F.lit("note"), *[c(k).cast("string") for k in ("entity_id", "account", "yr", "attempt")]).alias("id"), "text"))


@query("fn_script_share", f"""SELECT id, regexp_matches(text, '[一-鿿]') AS cjk, CASE WHEN length(text) = 0 THEN 0.0 ELSE CAST(length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS DOUBLE) / length(text) END AS share,
  coalesce(CAST(length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS DOUBLE) / nullif(length(text), 0), 0) > 0.3 AS mostly FROM {CORPUS}""")
def _(t):
    return corpus(t).select("id", P.has_cjk(c("text")).alias("cjk"), P.cjk_share(c("text")).alias("share"), (P.cjk_share(c("text")) > 0.3).alias("mostly"))


@query("fn_punct", f"SELECT id, md5(translate(text, '，、。．', ',,..')) AS digest, md5(translate(text, '，、', ',,')) AS stops_kept FROM {CORPUS}")
def _(t):
    return corpus(t).select("id", F.md5(P.ascii_punctuation(c("text"))).alias("digest"), F.md5(P.ascii_punctuation(c("text"), True)).alias("stops_kept"))


@query("fn_period_end", """SELECT entity_id, account, yr, label, CASE account WHEN 'STANDARD' THEN make_date(2000 + yr % 100, 12, 31) WHEN 'LARGE' THEN last_day(make_date(2000 + yr % 100, month(period_end), 1))
  WHEN 'PROMO' THEN period_end WHEN 'SMALL' THEN last_day(make_date(yr, month(period_end), 1)) WHEN 'MEDIUM' THEN make_date(yr, 12, 31) END AS period FROM period_text""")
def _(t):
    return t.period_text.select("entity_id", "account", "yr", "label", D.period_end(c("label")).alias("period"))


@query("fn_parse_date", """WITH x AS (SELECT *, CASE account WHEN 'STANDARD' THEN make_date(2000 + yr % 100, 12, 31) WHEN 'LARGE' THEN last_day(make_date(2000 + yr % 100, month(period_end), 1))
  WHEN 'PROMO' THEN period_end WHEN 'SMALL' THEN last_day(make_date(yr, month(period_end), 1)) WHEN 'MEDIUM' THEN make_date(yr, 12, 31)
  ELSE CASE WHEN contains(label, '-') THEN CAST(label AS DATE) ELSE DATE '1899-12-30' + CAST(label AS INT) END END AS loose FROM (SELECT *, CASE WHEN account = 'ECONOMY' THEN label ELSE NULL END AS q FROM period_text))
SELECT entity_id, account, yr, label, loose, CASE WHEN regexp_matches(label, '^[0-9]+$') THEN NULL ELSE loose END AS strict FROM x""")
def _(t):
    return t.period_text.select("entity_id", "account", "yr", "label", D.parse_date(c("label")).alias("loose"), D.parse_date(c("label"), False).alias("strict"))


@query("fn_period_label", """WITH x AS (SELECT *, CASE WHEN month(period_end) = 6 AND day(period_end) = 30 THEN NULL ELSE (month(period_end) - 6 + 12) % 12 END AS m,
  year(period_end) + CASE WHEN month(period_end) > 6 THEN 1 ELSE 0 END AS y FROM schedule_line)
SELECT entity_id, account, yr, CASE WHEN m IS NULL THEN concat('FY', lpad(CAST(y % 100 AS VARCHAR), 2, '0')) ELSE concat(m, 'M', lpad(CAST(y % 100 AS VARCHAR), 2, '0')) END AS eng,
  CASE WHEN m IS NULL THEN concat(y, '年度') ELSE concat(y, '年1-', m, '月') END AS chi FROM x""")
def _(t):
    args = (c("period_end"), F.lit(6), F.lit(30))
    return t.schedule_line.select("entity_id", "account", "yr", D.period_label(*args, "Eng").alias("eng"), D.period_label(*args, "Chi").alias("chi"))


@query("fn_label_norm", r"""WITH x AS (SELECT label_id, trim(regexp_replace(replace(regexp_replace(replace(lower(label), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), 'receivables', 'receivable'), '\s+', ' ', 'g')) AS f,
  trim(regexp_replace(regexp_replace(lower(label), '[：:（）()]', '', 'g'), '\s+', ' ', 'g')) AS a, raw_label FROM label_text)
SELECT label_id, replace(f, 'expenses', 'expense') AS fuzzy, a AS alias, CAST(len(list_distinct(string_split(replace(f, 'expenses', 'expense'), ' '))) AS INT) AS tokens, regexp_matches(raw_label, '^[一-鿿]+$') AS compact FROM x""")
def _(t):
    return t.label_text.select("label_id", L.fuzzy_form(c("label")).alias("fuzzy"), L.alias_form(c("label")).alias("alias"),
                               F.size(L.token_set(c("label"))).alias("tokens"), L.is_compact_cjk(c("raw_label")).alias("compact"))


@query("fn_label_clean", r"""WITH x AS (SELECT label_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_label, '_status|_type', '', 'gi'), '_name|_code', '', 'gi'), 'leasing_', '租赁', 'gi'), 'status_', '', 'gi'), '_\w+_\w+', '', 'g') AS y FROM label_text)
SELECT label_id, trim(CASE WHEN regexp_matches(y, '[a-zA-Z_]{3,}') THEN regexp_replace(y, '[a-zA-Z]+_[a-zA-Z_]+', '', 'g') ELSE y END) AS cleaned FROM x""")
def _(t):
    return t.label_text.select("label_id", L.clean_placeholders(c("raw_label")).alias("cleaned"))


@query("fn_stage", """SELECT workbook_id, sheet, row_idx, col_idx, CASE WHEN length(cell_text) > 35 THEN NULL WHEN contains(lower(cell_text), 'indicative adjusted') THEN 'Indicative adjusted'
  WHEN contains(lower(cell_text), 'audited') THEN 'Audited' WHEN contains(lower(cell_text), 'mgt acc') THEN 'Mgt acc' END AS stage FROM cells""")
def _(t):
    return t.cells.select("workbook_id", "sheet", "row_idx", "col_idx", L.stage_of(c("cell_text")).alias("stage"))


@query("fn_unit_multiplier", "SELECT workbook_id, sheet, row_idx, col_idx, CASE WHEN contains(lower(cell_text), 'cny''000') THEN 1000 ELSE 1 END AS multiplier, contains(lower(cell_text), 'cny''000') AS marker FROM cells")
def _(t):
    return t.cells.select("workbook_id", "sheet", "row_idx", "col_idx", L.unit_multiplier(c("cell_text")).alias("multiplier"), L.has_unit_marker(c("cell_text")).alias("marker"))


@query("fn_row_type", """SELECT entity_id, account, yr, row_idx, CASE row_idx WHEN 4 THEN 'breakdown' WHEN 6 THEN 'breakdown' WHEN 7 THEN 'total' ELSE 'detail' END AS row_type, row_idx = 7 AS skip FROM detail_line""")
def _(t):
    return t.detail_line.select("entity_id", "account", "yr", "row_idx", L.row_type(c("description")).alias("row_type"), L.is_skip_label(c("description")).alias("skip"))


@query("fn_category", """SELECT DISTINCT entity_id, statement_type, description, CASE WHEN statement_type = 'IS' THEN CASE WHEN regexp_matches(lower(description), 'income|revenue|sale|gain') THEN 'Revenue' ELSE 'Expenses' END
  ELSE 'Current assets' END AS category FROM statement_line""")
def _(t):
    return t.statement_line.select("entity_id", "statement_type", "description").distinct().withColumn("category", L.category_of(c("description"), c("statement_type")))


@query("fn_amount_display", """SELECT entity_id, account, yr, row_idx, CASE WHEN amount = 0 THEN '0' ELSE concat(CASE WHEN amount < 0 THEN '-' ELSE '' END,
  CASE WHEN abs(amount) < 10000 THEN concat(format('{:,}', CAST(round(abs(amount), 0) AS BIGINT)), '元') ELSE concat(printf('%.1f', CAST(abs(amount) AS DOUBLE) / 10000), '万元') END) END AS chi,
  CASE WHEN amount = 0 THEN '0' ELSE concat('CNY', CASE WHEN amount < 0 THEN '-' ELSE '' END, CASE WHEN abs(amount) < 1000000 THEN format('{:,}', CAST(round(abs(amount), 0) AS BIGINT)) ELSE concat(printf('%.1f', CAST(abs(amount) AS DOUBLE) / 1000000), ' million') END) END AS eng
FROM detail_line""")
def _(t):
    return t.detail_line.select("entity_id", "account", "yr", "row_idx", N.amount_display(c("amount"), "Chi").alias("chi"), N.amount_display(c("amount"), "Eng").alias("eng"))


# Names of statement lines and categories (fixed values).
LINE_NAMES = (("Total current assets", "流动资产合计"), ("Standard revenue", "营业收入"), ("operating cost", "营业成本"), ("Cash at bank", "货币资金"))


@query("translate_lines", """WITH d AS (SELECT * FROM (VALUES ('Total current assets', '流动资产合计'), ('Standard revenue', '营业收入'), ('operating cost', '营业成本'), ('Cash at bank', '货币资金')) d(src, zh))
SELECT s.entity_id, s.yr, s.statement_type, s.description, coalesce(a.zh, b.zh, s.description) AS translated FROM statement_full s LEFT JOIN d a ON a.src = s.description
LEFT JOIN d b ON lower(b.src) = lower(replace(trim(s.description), '’', ''''))""")
def _(t):
    dim = t.spark.createDataFrame(list(LINE_NAMES), "src string, zh string")
    s = t.statement_full.withColumn("_key", F.lower(F.replace(F.trim("description"), F.lit("’"), F.lit("'"))))
    exact = dim.select(c("src").alias("description"), c("zh").alias("a"))
    loose = dim.select(F.lower("src").alias("_key"), c("zh").alias("b"))
    return s.join(exact, "description", "left").join(loose, "_key", "left").select(
        "entity_id", "yr", "statement_type", "description", F.coalesce("a", "b", "description").alias("translated"))


@query("rate_context", """WITH x AS (SELECT entity_id, phase, yr, mo, regexp_extract_all(text, 'CNY([0-9.]*[0-9])', 1) AS a FROM rate_text)
SELECT entity_id, phase, yr, mo, n.n AS number_no, CAST(a[n.n + 1] AS DECIMAL(22,4)) AS value, n.n < 2 AS is_rate FROM x, (VALUES (0), (1), (2)) n(n)""")
def _(t):
    number = r"[0-9][0-9,]*(?:\.[0-9]+)?"
    # a number with what follows it up to the end of its sentence, a look ahead so that the next number is found inside
    pattern = P.CURRENCY + rf"\s*(?=({number}[^.。\n]*(?:\.(?=[0-9])[^.。\n]*)*[.。\n]?)){number}"
    rate = r"(?i)per\s+(?:square|sq\.?|sqm|sq\s*m)\s*(?:metre|meter|m\b)?|/\s*(?:sq\.?\s*m|sqm)|psm\b"
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    # outer, as a plain explode infers a filter that repeats the pattern
    return t.rate_text.select("entity_id", "phase", "yr", "mo", F.posexplode_outer(found).alias("number_no", "z")).where("z IS NOT NULL").select(
        "entity_id", "phase", "yr", "mo", "number_no", F.regexp_replace(F.regexp_extract("z", f"^{number}", 0), ",", "").cast("decimal(22,4)").alias("value"), F.rlike("z", F.lit(rate)).alias("is_rate"))


@query("clean_output", r"""SELECT conv_id, turn, md5(trim(CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '' ELSE text END)) AS digest FROM conversations""")
def _(t):
    return t.model_output.select("conv_id", "turn", F.md5(K.clean_output(c("text"))).alias("digest"))


@query("house_style")
def _(t):
    kind = F.when(c("account").isin("SMALL", "MEDIUM"), "BS").otherwise("IS")
    text = F.concat(c("text"), F.when(c("attempt") == 1, F.lit("余额为0元。*浙江某某物业管理有限公司调整-12.5万元。")).otherwise(F.lit("根据备注说明，tie-out无差异。")))
    return t.commentary_gen.select("entity_id", "account", "yr", "attempt", K.house_style(text, kind).alias("text"))


@query("english_style")
def _(t):
    text = F.concat("text", F.lit(" Fees were CNY 78.2K of CNY7.96 million. Rent was CNY0.0 million, remained relatively stable. The <ENTITY NAME> item."))
    return t.commentary_gen.select("entity_id", "account", "yr", "attempt", K.english_style(text).alias("text"))


@query("blocked_text", """SELECT 'page' AS kind, page_id AS id, regexp_matches(lower(html), '<!doctype html|<html|ac_block_page|form.submit\\(\\)|request_uri') AS blocked, trim(html) <> '' AS meaningful FROM pages
UNION ALL SELECT 'document', doc_id, regexp_matches(lower(text), '<!doctype html|<html|ac_block_page|form.submit\\(\\)|request_uri'), trim(text) <> '' FROM documents""")
def _(t):
    rows = t.pages.select(F.lit("page").alias("kind"), c("page_id").alias("id"), c("html").alias("x")).unionByName(
        t.documents.select(F.lit("document").alias("kind"), c("doc_id").alias("id"), c("text").alias("x")))
    return rows.select("kind", "id", K.is_blocked(c("x")).alias("blocked"), K.has_meaning(c("x")).alias("meaningful"))


@query("json_repair")
def _(t):
    """Validator answers with smart quotes, trailing commas or no object at all; what cannot be read is marked."""
    raw = F.concat(F.lit("```json\n{“final_content”: \""), F.regexp_replace("text", '["\\\\\n]', " "), F.lit("\", \"clause_reviews\": [{\"clause\": \"a\", \"supported\": \"yes\",},]}\n```"))
    raw = F.when(c("role") == "system", c("text")).otherwise(raw)
    schema = "final_content string, clause_reviews array<struct<clause:string,supported:string,category:string,reason:string>>, _corrupt_record string"
    x = t.stage_text.withColumn("j", F.from_json(K.repair_json(raw), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    ok = c("j.final_content").isNotNull() & c("j._corrupt_record").isNull()
    review = F.get("j.clause_reviews", F.lit(0))
    supported = F.lower(F.trim(review["supported"])).isin("true", "yes", "supported", "1")
    category = F.coalesce(F.when(F.lower(review["category"]).isin("data-backed", "reasoning", "hallucination"), F.lower(review["category"])),
                          F.when(supported, "data-backed").otherwise("reasoning"))
    return x.select("account", "stage_no", F.when(ok, "parsed").otherwise("quarantined").alias("route"), F.size("j.clause_reviews").alias("reviews"),
                    F.when(ok, supported).alias("supported"), F.when(ok, category).alias("category"))


@query("sentence_split", r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?;])\s+', '\1␞', 'g'), '␞') AS p FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM d)
SELECT doc_id, CAST(i.i - 1 AS INT) AS sentence_no, CAST(length(s[i.i]) AS INT) AS chars, len(regexp_extract_all(s[i.i], '[0-9][0-9,.\-]*%?|USD|HKD|RMB|CNY|EUR|JPY|\$', 0, 'i')) >= 2 AS numeric_heavy FROM s, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) i""")
def _(t):
    x = t.documents.select("doc_id", F.posexplode(K.sentences(c("text"), F.lit(False))).alias("sentence_no", "s"))
    return x.select("doc_id", "sentence_no", F.length("s").alias("chars"), K.is_numeric_heavy(c("s")).alias("numeric_heavy"))


@query("name_split", """WITH x AS (SELECT e.entity_id, regexp_replace(label, '^2024-06-30 - ', '') AS name FROM entity_text e)
SELECT entity_id, name, CASE WHEN contains(name, 'Supplier') THEN '南通' END AS cjk_name, CASE WHEN contains(name, 'Supplier') THEN trim(regexp_replace(regexp_replace(replace(name, '南通', ''), '[()]', ' ', 'g'), '\\s+', ' ', 'g')) END AS latin_name, true AS plausible FROM x""")
def _(t):
    name = K.strip_leading_date(c("label"))
    cjk, latin = K.split_bilingual(name)
    return t.entity_text.select("entity_id", name.alias("name"), cjk.alias("cjk_name"), latin.alias("latin_name"), K.is_likely_entity(name).alias("plausible"))
