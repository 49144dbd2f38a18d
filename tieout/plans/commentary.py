"""Commentary queries: clauses, grounding, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.functions import prose
from tieout.functions.dates import parse_date
from tieout.operators import analysis as A
from tieout.operators import clauses as C
from tieout.plans.recon import INTERIM, RECON, recon_of  # noqa: F401
from tieout.plans.registry import query

IS_ACCOUNTS = ["STANDARD", "LARGE", "PROMO", "ECONOMY"]


def clause_sql(src: str, keys: str) -> str:
    """Clauses of ``src`` without look-around: separators between digits are masked, then unmasked."""
    masked = "text"
    for ch, mark in ((r"\.", "①"), (",", "②"), ("，", "③")):
        for _ in range(2):
            masked = rf"regexp_replace({masked}, '([0-9]){ch}([0-9])', '\1{mark}\2', 'g')"
    cut = rf"string_split(regexp_replace({masked}, '([.;。；！？!?,，])', '\1␞', 'g'), '␞')"
    return f"""
pt AS (SELECT {keys}, unnest({cut}) AS p, generate_subscripts({cut}, 1) - 1 AS clause_no FROM {src}),
pu AS (SELECT {keys}, clause_no, replace(replace(replace(p, '①', '.'), '②', ','), '③', '，') AS p FROM pt),
pw AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY {keys} ORDER BY clause_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM pu),
cl AS (SELECT {keys}, CAST(clause_no AS INT) AS clause_no, CAST(base + length(p) - length(regexp_replace(p, '^\\s+', '')) AS INT) AS start,
   CAST(base + length(p) - length(regexp_replace(p, '^\\s+', '')) + length(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS INT) AS "end",
   regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS clause FROM pw WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> '')
"""


def amounts_sql(text: str) -> str:
    work, parts = text, []
    for _, pattern, scale in prose.AMOUNT_PASSES:
        pat, flag = (pattern[4:], "'gi'") if pattern.startswith("(?i)") else (pattern, "'g'")
        opt = ", 'i'" if flag == "'gi'" else ""
        parts.append(f"list_transform(regexp_extract_all({work}, '{pat}', 1{opt}), lambda x: CAST(CAST(replace(x, ',', '') AS DECIMAL(22,4)) * {scale} AS DECIMAL(28,4)))")
        work = f"regexp_replace({work}, '{pat}', '  ', {flag})"
    return "list_concat(" + ", ".join([parts[0], "list_concat(" + ", ".join([parts[1], "list_concat(" + ", ".join(
        [parts[2], f"list_concat({parts[3]}, {parts[4]})"]) + ")"]) + ")"]) + ")"


KEYS = "entity_id, account, yr, attempt"
CL = clause_sql("commentary_gen", KEYS)
AM = f""",
am AS (SELECT {KEYS}, clause_no, start, "end", clause, unnest({amounts_sql("clause")}) AS amount FROM cl)
"""
PY = """,
pe AS (SELECT entity_id, account, max(period_end) AS eff FROM detail_line GROUP BY ALL),
pm AS (SELECT d.entity_id, d.account, d.eff, (SELECT max(period_end) FROM detail_line x WHERE x.entity_id = d.entity_id AND x.account = d.account AND x.period_end < d.eff) AS prv FROM pe d),
pa AS (SELECT m.entity_id, m.account, m.eff, mode(month(t.period_end)) AS am FROM pm m JOIN (SELECT DISTINCT entity_id, account, period_end FROM detail_line) t USING (entity_id, account)
   WHERE (month(t.period_end), day(t.period_end)) <> (month(m.eff), day(m.eff)) AND (month(m.prv), day(m.prv)) <> (month(m.eff), day(m.eff)) GROUP BY ALL),
mo AS (SELECT entity_id, account, CASE WHEN (month(eff) - am + 12) % 12 <= 0 THEN month(eff) ELSE (month(eff) - am + 12) % 12 END AS months FROM pa)
"""
POOL = PY + f""",
sn AS (SELECT entity_id, account, period_end, amount, lead(amount, 1) OVER w AS a1, lead(amount, 2) OVER w AS a2, lead(amount, 3) OVER w AS a3, row_idx FROM detail_line
   WINDOW w AS (PARTITION BY entity_id, account, period_end ORDER BY row_idx)),
adj AS (SELECT entity_id, account, period_end, row_idx, 2 AS run, CAST(amount + a1 AS DECIMAL(22,2)) AS total FROM sn WHERE a1 IS NOT NULL
  UNION ALL SELECT entity_id, account, period_end, row_idx, 3, CAST(amount + a1 + a2 AS DECIMAL(22,2)) FROM sn WHERE a2 IS NOT NULL
  UNION ALL SELECT entity_id, account, period_end, row_idx, 4, CAST(amount + a1 + a2 + a3 AS DECIMAL(22,2)) FROM sn WHERE a3 IS NOT NULL),
nn AS (SELECT DISTINCT entity_id, account, unnest(list_concat({amounts_sql("note")}, list_transform(regexp_extract_all(note, '({prose.BARE_NUMBER})', 1), lambda x: CAST(replace(x, ',', '') AS DECIMAL(28,4))))) AS v FROM remark),
po AS (SELECT entity_id, account, CAST(abs(amount) AS DECIMAL(28,4)) AS value FROM detail_line
  UNION ALL SELECT entity_id, account, CAST(abs(sum(amount)) AS DECIMAL(28,4)) FROM detail_line GROUP BY entity_id, account, period_end
  UNION ALL SELECT entity_id, account, CAST(abs(total) AS DECIMAL(28,4)) FROM adj
  UNION ALL SELECT entity_id, account, abs(v) FROM nn
  UNION ALL SELECT entity_id, account, CAST(abs(v * 12 / months) AS DECIMAL(28,4)) FROM nn JOIN mo USING (entity_id, account) WHERE account IN ('STANDARD', 'LARGE', 'PROMO', 'ECONOMY')),
pool AS (SELECT DISTINCT entity_id, coalesce(statement_type, account) AS pool, value FROM po LEFT JOIN account_alias a ON a.tab_name = po.account)
"""
BAND = "CASE WHEN value = 0 THEN round_even(t, 0) = 0 ELSE abs(t - value) <= greatest(500, value * 0.05) END"
GROUND = f""",
ta AS (SELECT am.*, coalesce(statement_type, account) AS pool FROM am LEFT JOIN account_alias a ON a.tab_name = am.account),
tg AS (SELECT DISTINCT entity_id, pool, abs(amount) AS t FROM ta),
hi AS (SELECT DISTINCT entity_id, pool, t FROM tg JOIN pool USING (entity_id, pool) WHERE {BAND}),
gr AS (SELECT ta.*, hi.t IS NOT NULL AS grounded FROM ta LEFT JOIN hi ON hi.entity_id = ta.entity_id AND hi.pool = ta.pool AND hi.t = abs(ta.amount))
"""
CK = r"""trim(lower(regexp_replace({}, '\s+', '', 'g')), '""" + C.BOUNDARY_CHARS.replace("'", "''") + "')"
CAUSAL = prose.CAUSAL[4:]
VERDICT = f""",
rv AS (SELECT {KEYS}, clause_no, model_supported, model_category FROM (
   SELECT c.entity_id, c.account, c.yr, c.attempt, c.clause_no, r.supported AS model_supported, lower(r.category) AS model_category,
     row_number() OVER (PARTITION BY c.entity_id, c.account, c.yr, c.attempt, c.clause_no ORDER BY least(length(c.k), length(r.k)) DESC, review_no) AS n
   FROM (SELECT *, {CK.format('clause')} AS k FROM cl) c JOIN (SELECT *, {CK.format('clause')} AS k FROM model_review) r USING ({KEYS})
   WHERE c.k <> '' AND r.k <> '' AND (contains(c.k, r.k) OR contains(r.k, c.k))) WHERE n = 1),
dt AS (SELECT {KEYS}, clause_no, bool_and(grounded) AS ok FROM gr GROUP BY ALL),
v0 AS (SELECT c.*, CASE WHEN NOT ok THEN 'hallucination' WHEN ok AND model_category = 'reasoning' AND NOT model_supported THEN 'reasoning' WHEN ok THEN 'data-backed'
   WHEN model_category IN ('reasoning', 'hallucination') AND NOT model_supported THEN model_category ELSE 'data-backed' END AS category
  FROM cl c LEFT JOIN dt USING ({KEYS}, clause_no) LEFT JOIN rv USING ({KEYS}, clause_no)),
vd AS (SELECT *, category = 'data-backed' AS supported FROM v0)
"""


def clauses_of(t):
    return t.shared("clauses", lambda: C.clauses(t.commentary_gen.drop("entity")), "entity_id")


def amounts_of(t):
    return t.shared("amounts", lambda: C.clause_amounts(clauses_of(t)), "entity_id")


def pool_of(t):
    d = t.detail_line
    months = A.part_year(d.where(F.col("account").isin(IS_ACCOUNTS))).select("entity_id", "account", "months")
    return t.shared("source_pool", lambda: C.source_values(d, t.remark, t.account_alias, months).repartition(t.buckets(), "entity_id").distinct(), "entity_id")


def grounded_of(t):
    return t.shared("grounded", lambda: C.ground_amounts(amounts_of(t), pool_of(t), t.account_alias), "entity_id")


def verdicts_of(t):
    return t.shared("verdicts", lambda: C.combine_verdicts(clauses_of(t), grounded_of(t), t.model_review), "entity_id")


@query("clauses", "WITH " + CL[1:] + "SELECT * FROM cl")
def _(t):
    return clauses_of(t)


@query("extract_amounts", "WITH " + CL[1:] + AM + "SELECT * FROM am")
def _(t):
    return amounts_of(t)


@query("adjacent_sums", "WITH x AS (SELECT 1)" + POOL + "SELECT * FROM adj")
def _(t):
    return C.adjacent_sums(t.detail_line, ["entity_id", "account", "period_end"])


@query("source_pool", "WITH x AS (SELECT 1)" + POOL + "SELECT * FROM pool")
def _(t):
    return pool_of(t)


@query("ground_amounts", "WITH " + CL[1:] + AM + POOL + GROUND + "SELECT * FROM gr")
def _(t):
    return grounded_of(t)


@query("scale_errors", "WITH " + CL[1:] + AM + POOL + GROUND + f""",
fc AS (SELECT * FROM (VALUES (0, CAST(1000 AS DECIMAL(9,4)), '1000x too small'), (1, 0.001, '1000x too large'), (2, 10000, '10000x too small'), (3, 0.0001, '10000x too large')) f(i, f, finding)),
bt AS (SELECT g.*, i, finding, CAST(abs(amount) * f AS DECIMAL(28,4)) AS t FROM gr g, fc WHERE NOT grounded AND amount <> 0),
dh AS (SELECT DISTINCT entity_id, pool, t FROM (SELECT DISTINCT entity_id, pool, t FROM bt) JOIN pool USING (entity_id, pool) WHERE {BAND})
SELECT {KEYS}, clause_no, amount, arg_min(finding, i) AS finding, arg_min(t, i) AS scaled FROM bt JOIN dh USING (entity_id, pool, t) GROUP BY {KEYS}, clause_no, amount""")
def _(t):
    return t.shared("scale_errors", lambda: C.scale_errors(grounded_of(t), pool_of(t)), "entity_id")


@query("combine_verdicts", "WITH " + CL[1:] + AM + POOL + GROUND + VERDICT + "SELECT * FROM vd")
def _(t):
    return verdicts_of(t)


@query("defective_clauses", "WITH " + CL[1:] + AM + POOL + GROUND + VERDICT + f"""SELECT {KEYS}, string_agg(concat('- "', clause, '"'), chr(10) ORDER BY clause_no) FILTER (k <= 5) AS feedback
FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY clause_no) AS k FROM (SELECT *, bool_or(category = 'hallucination') OVER (PARTITION BY {KEYS}) AS w FROM vd WHERE NOT supported) WHERE category = 'hallucination' OR NOT w) GROUP BY {KEYS}""")
def _(t):
    return C.defective(verdicts_of(t))[1]


@query("arbiter", "WITH " + CL[1:] + AM + POOL + GROUND + VERDICT + f""",
pr AS (SELECT {KEYS}, count(*) AS n, count(*) FILTER (NOT supported) AS u, count(*) FILTER (category = 'hallucination') AS d FROM vd GROUP BY ALL)
SELECT entity_id, account, yr, arg_max(d > 0 OR u / n > 0.3, attempt) AS retry_needed, max(attempt) AS last_attempt,
  arg_min(attempt, d * 10 - attempt) AS best_attempt, min(d) AS best_defects,
  CASE WHEN arg_max(d > 0 OR u / n > 0.3, attempt) THEN arg_min(attempt, d * 10 - attempt) ELSE max(attempt) END AS chosen FROM pr GROUP BY 1, 2, 3""")
def _(t):
    return C.arbiter(verdicts_of(t))


@query("highlight_spans", "WITH " + CL[1:] + AM + POOL + GROUND + VERDICT + f"""SELECT {KEYS}, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY start) - 1 AS INT) AS span_no, start, "end", category
FROM vd WHERE NOT supported""")
def _(t):
    return C.highlight_spans(t.commentary_gen, verdicts_of(t).where("NOT supported"))


@query("extract_dates", f"""WITH d AS (SELECT {KEYS}, unnest(regexp_extract_all(text, '([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})', 1)) AS x FROM commentary_gen)
SELECT DISTINCT {KEYS}, CAST(x AS DATE) AS quoted FROM d""")
def _(t):
    return t.commentary_gen.withColumn("k", F.explode(prose.quoted_dates(F.col("text")))).select(
        *C.ATTEMPT, F.col("k").try_cast("date").alias("quoted"))


@query("unknown_dates", f"""WITH k AS (SELECT DISTINCT entity_id, account, CASE WHEN entity_id % 2 = 0 THEN period_end + 1 ELSE period_end END AS period_end FROM schedule_line),
q AS (SELECT DISTINCT entity_id, entity, {KEYS.replace('entity_id, ', '')}, CAST(unnest(regexp_extract_all(text, '([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})', 1)) AS DATE) AS d FROM commentary_gen)
SELECT entity_id, entity, account, yr, attempt, concat(year(d), '-', month(d), '-', day(d)) AS date_key FROM q SEMI JOIN k USING (entity_id, account)
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.entity_id = q.entity_id AND k.account = q.account AND k.period_end = q.d)""")
def _(t):
    """The source of every other entity is dated a day later, so it knows none of the dates quoted."""
    d = F.when(F.col("entity_id") % 2 == 0, F.date_add("period_end", 1)).otherwise(F.col("period_end"))
    known = t.schedule_line.select("entity_id", "account", F.concat_ws(
        "-", F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")).alias("date_key"))
    return C.unknown_dates(t.commentary_gen, known)


INF = "regexp_matches(replace(text, 'no reason is given in the information provided', ''), '" + "|".join(prose.INFERENCE_CJK) + "') OR regexp_matches(lower(replace(text, 'no reason is given in the information provided', '')), '" + "|".join(prose.INFERENCE_ENG) + "')"


@query("causal_claims", f"SELECT {KEYS}, regexp_matches(text, '{CAUSAL}', 'i') AS causal, {INF} AS inference FROM commentary_gen")
def _(t):
    x = F.col("text")
    return t.commentary_gen.select(*C.ATTEMPT, prose.has_causal_language(x).alias("causal"), prose.asserts_inference(x).alias("inference"))


@query("composition_check", """WITH p AS (SELECT *, list_transform(regexp_extract_all(text, '[1-9]）[^；;]*?(-?[0-9.]+)万元', 1), lambda x: CAST(x AS DECIMAL(18,2)) * 10000) AS it,
  CAST(regexp_extract(text, '合计([0-9.]+)万元', 1) AS DECIMAL(18,2)) * 10000 AS st, CASE WHEN contains(text, '其余') THEN CAST(regexp_extract(text, '其余([0-9.]+)万元', 1) AS DECIMAL(18,2)) * 10000 END AS rest FROM composition_text),
q AS (SELECT *, CASE WHEN rest IS NOT NULL AND NOT list_contains(it, rest) THEN list_append(it, rest) ELSE it END AS al FROM p),
r AS (SELECT *, CAST(list_sum(al) AS DECIMAL(28,2)) AS listed FROM q WHERE st > 0),
z AS (SELECT *, CAST(listed AS DOUBLE) / CAST(st AS DOUBLE) AS ratio FROM r)
SELECT entity_id, account, yr, CAST(len(al) AS INT) AS items, CAST(st AS DECIMAL(28,2)) AS stated, listed,
  CASE WHEN CAST(abs(st - listed) AS DOUBLE) / CAST(st AS DOUBLE) <= 0.01 THEN 'adds up' WHEN abs(ratio - 10.0) / 10.0 <= 0.05 THEN 'unit error 10x' WHEN abs(ratio - 100.0) / 100.0 <= 0.05 THEN 'unit error 100x'
    WHEN abs(ratio - 0.1) / 0.1 <= 0.05 THEN 'unit error 1/10' WHEN abs(ratio - 2.0) <= 0.05 THEN 'parent and children' ELSE 'shortfall' END AS finding FROM z""")
def _(t):
    return C.composition_check(t.composition_text)


@query("final_text", "SELECT account, arg_max(text, stage_no) AS text, max(stage_no) AS stage_no FROM stage_text WHERE trim(coalesce(text, '')) <> '' GROUP BY account")
def _(t):
    return C.final_text(t.stage_text)


@query("needs_review", f"SELECT * FROM commentary_gen ANTI JOIN model_review USING ({KEYS})")
def _(t):
    return C.needs_review(t.commentary_gen, t.model_review)


@query("attach_remarks", """SELECT s.entity_id, s.account, s.yr, s.entity, s.portfolio, s.period_end, s.amount, r.remarks FROM schedule_line s LEFT JOIN (
  SELECT entity_id, account, yr, string_agg(note, ' || ' ORDER BY note) AS remarks FROM (SELECT DISTINCT entity_id, account, yr, note FROM remark) GROUP BY ALL) r USING (entity_id, account, yr)""")
def _(t):
    return C.attach_remarks(t.schedule_line, t.remark)


@query("claim_grounding", """WITH k AS (SELECT * FROM (VALUES ('work performed', '核对|检查|查看|复核|比对|获取|取得|对账单|agreed|checked'),
   ('negative assurance', '未发现|未见|无重大|无异常|未有差异|no difference|no material'), ('management attribution', '管理层|管报|management')) k(kind, words)),
c AS (SELECT entity_id, account, yr, 'work performed' AS kind, '我方已核对银行对账单' AS claim FROM claim_text WHERE contains(text, '我方已核对银行对账单')
 UNION ALL SELECT entity_id, account, yr, 'management attribution', '管理层表示该余额为时间性差异' FROM claim_text WHERE contains(text, '管理层表示')
 UNION ALL SELECT entity_id, account, yr, 'negative assurance', '经核对未发现重大差异' FROM claim_text WHERE contains(text, '未发现重大差异'))
SELECT c.*, EXISTS (SELECT 1 FROM remark r JOIN k ON k.kind = c.kind WHERE r.entity_id = c.entity_id AND r.account = c.account AND regexp_matches(r.note, k.words)) AS backed FROM c""")
def _(t):
    return C.claim_grounding(t.claim_text, t.remark)


@query("remark_reach", """WITH r AS (SELECT entity_id, account, yr, source, note, list_distinct(regexp_extract_all(note, '([一-鿿]{2,}|[A-Za-z]{4,})', 1)) AS tk FROM remark),
j AS (SELECT r.*, c.attempt, len(list_filter(tk, lambda x: contains(c.text, x))) AS h FROM r JOIN commentary_gen c ON c.entity_id = r.entity_id AND c.account = r.account AND c.yr = r.yr)
SELECT entity_id, account, yr, attempt, source, note, CAST(len(tk) AS INT) AS tokens, CAST(h AS INT) AS hits, len(tk) > 0 AND h >= greatest(1, len(tk) // 3) AS reached FROM j""")
def _(t):
    return C.remark_reach(t.remark, t.commentary_gen)


def note_values_of(t):
    """Values a note quotes: per segment, what follows its last colon; bare dates are no values."""
    seg = F.explode(F.transform(F.split("note", r"\|"), lambda s: F.trim(s)))
    x = t.remark.select("entity_id", "account", "yr", "note", seg.alias("s"))
    has = F.contains(F.col("s"), F.lit(":"))
    part = F.when(has, F.substring_index("s", ":", -1)).when(parse_date(F.col("s")).isNotNull(), "").otherwise(F.col("s"))
    raw = F.explode(F.regexp_extract_all(part, F.lit(r"(-?[0-9,]+(?:\.[0-9]+)?)"), F.lit(1)))
    return x.select("entity_id", "account", "yr", "note", raw.alias("raw")).withColumn(
        "value", F.regexp_replace("raw", ",", "").try_cast("decimal(22,2)")).where("value IS NOT NULL").drop("raw")


NOTES = """
sg AS (SELECT entity_id, account, yr, note, trim(unnest(string_split(note, '|'))) AS s FROM remark),
nv AS (SELECT entity_id, account, yr, note, CAST(replace(unnest(regexp_extract_all(CASE WHEN contains(s, ':') THEN string_split(s, ':')[-1] ELSE s END, '(-?[0-9,]+(?:\\.[0-9]+)?)', 1)), ',', '') AS DECIMAL(22,2)) AS value FROM sg)
"""


@query("note_values", "WITH " + NOTES[1:] + "SELECT * FROM nv")
def _(t):
    return note_values_of(t)


@query("notes_explain_diff", "WITH " + RECON + ", " + NOTES[1:] + """SELECT DISTINCT r.entity_id, r.tab_account AS account, r.diff, n.note FROM recon r JOIN nv n ON n.entity_id = r.entity_id AND n.account = r.tab_account
WHERE r.match = '❌ Diff' AND abs(abs(n.value) - r.diff) <= greatest(1, r.diff * 0.005)""")
def _(t):
    from tieout.operators.reconcile import notes_explaining_diffs
    return notes_explaining_diffs(recon_of(t), note_values_of(t))


@query("working_notes", """SELECT *, CASE WHEN starts_with(note, 'Check') THEN 'artefact' WHEN contains(note, 'difference') THEN 'working' ELSE 'prose' END AS note_class FROM remark""")
def _(t):
    return C.split_working_notes(t.remark)
