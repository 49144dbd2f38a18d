"""Corpus, ledger and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.operators import quality as Q
from tieout.plans.recon import RECON, recon_of
from tieout.plans.registry import query

LEDGER_FIELDS = ["project", "industry", "rent_total", "free_months", "day_rent", "day_fee", "day_total"]
#: Those of them that are core columns of the reference's template (N, O, AD, AE, AF); project and industry are not.
LEDGER_CORE = ["rent_total", "free_months", "day_rent", "day_fee", "day_total"]


@query("duplicate_lines", r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT md5(line) AS line_id, count(*) AS occurrences, count(DISTINCT doc_id) AS texts, min(doc_id) AS first_text, regexp_matches(min(line), '无余额|未发生|nil balance|no balance', 'i') AS boilerplate FROM l WHERE line <> '' GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return Q.duplicate_lines(t.documents, "doc_id")


@query("wording_scan", "WITH x AS (SELECT text FROM commentary_gen UNION ALL SELECT text FROM documents), " + "h AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, len(regexp_extract_all(text, '{p}')) AS hits FROM x" for n, p in Q.WORDING) + """ UNION ALL SELECT 'repeated currency', len(list_filter(string_split_regex(text, '[.。]'), lambda s: len(regexp_extract_all(s, 'CNY|人民币')) >= 2)) FROM x)
SELECT rule, sum(hits) AS hits, count(*) AS texts FROM h WHERE hits > 0 GROUP BY 1""")
def _(t):
    return Q.wording_scan(t.commentary_gen.select("text").unionByName(t.documents.select("text")))


@query("payment_arithmetic", """SELECT contract_id, count(*) AS rows, count(*) FILTER (abs(rent + mgmt_fee + coalesce(other, 0) - total) <= 0.02) AS consistent, sum(3 + CASE WHEN other IS NOT NULL THEN 1 ELSE 0 END) AS filled FROM payment_row GROUP BY 1""")
def _(t):
    return Q.payment_arithmetic(t.payment_row)


@query("ratio_columns", """WITH c AS (SELECT l_suppkey AS entity_id, 'discount' AS col, CAST(l_discount AS DECIMAL(18,2)) AS value FROM lineitem UNION ALL SELECT l_suppkey, 'tax', CAST(l_tax AS DECIMAL(18,2)) FROM lineitem UNION ALL SELECT l_suppkey, 'quantity', CAST(l_quantity AS DECIMAL(18,2)) FROM lineitem)
SELECT entity_id, col, count(*) FILTER (value <> 0) AS non_zero, max(abs(value)) AS peak, count(*) FILTER (value <> 0) >= 3 AND max(abs(value)) <= 1 AS is_ratio FROM c GROUP BY 1, 2""")
def _(t):
    m = lambda c: F.col(c).cast("decimal(18,2)")
    x = t.lineitem.select(F.col("l_suppkey").alias("entity_id"), m("l_discount").alias("discount"), m("l_tax").alias("tax"), m("l_quantity").alias("quantity"))
    return Q.ratio_columns(x.unpivot(["entity_id"], ["discount", "tax", "quantity"], "col", "value"), ["entity_id", "col"])


@query("verify_sums", """SELECT entity_id, account, yr, CAST(sum(amount) FILTER (row_idx <> 7) AS DECIMAL(24,2)) AS parts, CAST(max(amount) FILTER (row_idx = 7) AS DECIMAL(24,2)) AS total,
  abs(sum(amount) FILTER (row_idx <> 7) - max(amount) FILTER (row_idx = 7)) <= 1 AS adds_up, true AS linear FROM detail_line GROUP BY 1, 2, 3""")
def _(t):
    return Q.verify_sums(t.detail_line, ["entity_id", "account", "yr"], "1.3700")


NAME_FORMS = ("{}", "{} Trading", "{} Trading Ltd")


@query("anonymise", """WITH s AS (SELECT l.*, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS v, s.s_name || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN ' Trading' ELSE ' Trading Ltd' END AS name, s.s_name FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('Paid Entity-', upper(substr(md5(name), 1, 8)), ', amount CNY', CASE WHEN v >= 1000 THEN format('{:,.2f}', CAST(CAST(v * 1.370 AS DECIMAL(24,2)) AS DOUBLE)) ELSE CAST(CAST(v * 1.370 AS DECIMAL(24,2)) AS VARCHAR) END, ' in full (Entity-', upper(substr(md5(s_name), 1, 8)), '); fee CNY',
  CAST(CAST(CAST(l_tax AS DECIMAL(18,2)) * 1.370 AS DECIMAL(24,2)) AS VARCHAR), '. [redacted] reviewed.') AS text, 2 AS names, 2 AS amounts FROM s""")
def _(t):
    """Payment notes with names of one to three words, each the start of the next, in brackets and before commas."""
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    forms = F.explode(F.array(*[F.format_string(f.format("%s"), F.col("s_name")) for f in NAME_FORMS])).alias("name")
    m = F.col("l_linenumber") % 3
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), F.col("l_tax").cast("decimal(18,2)").alias("f")).join(s, "l_suppkey")
    x = x.withColumn("text", F.concat(F.lit("Paid "), "s_name", F.when(m == 0, "").when(m == 1, " Trading").otherwise(" Trading Ltd"), F.lit(", amount CNY"), F.format_number("v", 2),
                                      F.lit(" in full ("), "s_name", F.lit("); fee CNY"), F.col("f").cast("string"), F.lit(". J. Doe reviewed.")))
    return Q.anonymise(x, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], Q.name_map(s.select(forms)), "1.370", (r"J\. Doe",))


@query("style_profile", """SELECT account, count(*) AS texts, min(length(text)) AS shortest, median(length(text)) AS median, max(length(text)) AS longest, sum(len(regexp_extract_all(text, '(?:CNY|人民币)\\s*[0-9]'))) AS prefixed,
  sum(len(regexp_extract_all(text, '[0-9]万元'))) AS wan, sum(len(regexp_extract_all(text, '[0-9]亿元'))) AS yi, sum(len(regexp_extract_all(text, '[0-9]\\.[0-9]万元'))) AS one_decimal FROM commentary_gen GROUP BY 1""")
def _(t):
    return Q.style_profile(t.commentary_gen, ["account"])


WORDS = {"token": "(?i)token|password|secret", "contact": r"[0-9]{3}.[0-9]{3}.[0-9]{3}", "licence": "(?i)licen[sc]e|copyright"}


@query("keyword_hits", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), h AS (" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS category FROM l WHERE regexp_matches(line, '{p.replace('(?i)', '')}'{', ' + chr(39) + 'i' + chr(39) if p.startswith('(?i)') else ''})" for n, p in WORDS.items()) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY line_no) AS hit_no FROM h)
SELECT doc_id, category, hit_no, CAST(line_no AS INT) AS line_no, CAST(length(line) AS INT) AS chars FROM r WHERE hit_no <= 5""")
def _(t):
    return Q.keyword_hits(t.documents, "doc_id", WORDS)


@query("digest")
def _(t):
    return Q.digest(t.documents, "doc_id", 280)


@query("digest_accounts", r"""WITH p AS (SELECT entity_id, yr, attempt, account, string_split(regexp_replace(trim(text), '([.!?;])\s+', '\1␞', 'g'), '␞') AS s FROM commentary_gen),
x AS (SELECT entity_id, yr, attempt, account, unnest(s) AS s, generate_subscripts(s, 1) AS rank FROM p),
o AS (SELECT entity_id, yr, attempt, list({'used': CAST(length(s) AS BIGINT), 'n': CAST(1 AS BIGINT), 'text': s} ORDER BY rank, account, s) AS l FROM x WHERE s <> '' GROUP BY ALL),
f AS (SELECT entity_id, yr, attempt, list_reduce(l, lambda a, c: CASE WHEN a.used + c.used + 1 <= 280 THEN {'used': a.used + c.used + 1, 'n': a.n + 1, 'text': a.text || ' ' || c.text} ELSE a END) AS f FROM o)
SELECT entity_id, yr, attempt, f.n AS sentences, f.text AS digest FROM f""")
def _(t):
    """One digest per entity, year and attempt, across the accounts."""
    return Q.digest_blocks(t.commentary_gen, ["entity_id", "yr", "attempt"], "account", 280)


def _json_oracle(description: str) -> str:
    return f"""SELECT entity_id, account, yr, CAST(to_json({{'fields': ['description', 'period', 'amount'],
  'rows': list({{'row_idx': row_idx, 'description': {description}, 'period': CAST(period_end AS VARCHAR), 'amount': CAST(amount AS VARCHAR)}}
               ORDER BY row_idx, {description}, CAST(period_end AS VARCHAR), CAST(amount AS VARCHAR)),
  'currency': 'CNY', 'scale': 'thousand'}}) AS VARCHAR) AS document FROM detail_line GROUP BY entity_id, account, yr"""


@query("table_json", _json_oracle("description"))
def _(t):
    """JSON documents per account and year. What grows with the data is their number."""
    return Q.table_json(t.detail_line, ["entity_id", "account", "yr"])


@query("table_json_normalized", _json_oracle("upper(trim(description))"))
def _(t):
    """The same documents with descriptions rewritten by a caller's function."""
    return Q.table_json(t.detail_line, ["entity_id", "account", "yr"], lambda text: F.upper(F.trim(text)))


@query("ledger_reference_rows", """SELECT contract_id, source_file, pass, CAST((CASE WHEN rent_total <> '未提及' THEN 1 ELSE 0 END) + 6 AS INT) AS filled FROM contract_row WHERE pass = 2 OR rent_total <> '未提及'""")
def _(t):
    """Rows a person filled: at least five core fields say something. ``filled`` counts all fields of the ledger."""
    return Q.reference_rows(t.contract_row, LEDGER_CORE).withColumn("filled", Q.said_count(LEDGER_FIELDS)).select("contract_id", "source_file", "pass", "filled")


@query("contract_fixups", """SELECT contract_id, pass, project, industry, source_file, rent_total, regexp_extract(free_months, '([0-9.]+)', 1) AS free_months, day_rent, day_fee, regexp_replace(CAST(round(CAST(day_rent AS DOUBLE) + CAST(day_fee AS DOUBLE), 6) AS VARCHAR), '[.]0$', '') AS day_total FROM contract_row""")
def _(t):
    return Q.contract_fixups(t.contract_row)


SOFT = "lower(trim(a.{f})) = lower(trim(b.{f})) OR coalesce(abs(try_cast(a.{f} AS DOUBLE) - try_cast(b.{f} AS DOUBLE)) <= CASE WHEN abs(try_cast(b.{f} AS DOUBLE)) < 10 THEN greatest(0.01, abs(try_cast(b.{f} AS DOUBLE)) * 0.03) ELSE greatest(1.0, abs(try_cast(b.{f} AS DOUBLE)) * 0.002) END, false)"


@query("field_diff", " UNION ALL ".join(f"SELECT a.contract_id, '{f}' AS field, a.{f} AS extracted, b.{f} AS reference, {SOFT.format(f=f)} AS equal FROM contract_row a JOIN contract_row b ON a.contract_id = b.contract_id AND a.pass = 1 AND b.pass = 2" for f in LEDGER_FIELDS))
def _(t):
    c = t.contract_row
    return Q.field_diff(c.where("pass = 1"), c.where("pass = 2"), "contract_id", LEDGER_FIELDS)


@query("merge_reviews", """SELECT a.contract_id, CASE WHEN b.rent_total <> '未提及' THEN b.rent_total ELSE a.rent_total END AS rent_total, b.free_months, b.day_total, CASE WHEN a.rent_total <> b.rent_total THEN 1 ELSE 0 END AS changes
FROM contract_row a JOIN contract_row b ON a.contract_id = b.contract_id AND a.pass = 1 AND b.pass = 2""")
def _(t):
    f = ["rent_total", "free_months", "day_total"]
    c = t.contract_row
    return Q.merge_reviews(c.where("pass = 1").select("contract_id", *f), c.where("pass = 2"), "contract_id", f)


@query("merge_payments", """WITH r AS (SELECT contract_id, period_no, line_id, CASE period_no % 3 WHEN 0 THEN rent + 5 WHEN 1 THEN rent END AS rent, mgmt_fee, CASE WHEN other IS NULL THEN CAST(0.01 AS DECIMAL(18,2)) END AS other,
   CASE WHEN period_no % 3 = 1 THEN rent + mgmt_fee + coalesce(other, 0) END AS total FROM payment_row),
m AS (SELECT p.contract_id, p.period_no, p.line_id, p.rent, p.mgmt_fee, p.other, p.total, coalesce(r.rent, p.rent) AS nr, coalesce(r.mgmt_fee, p.mgmt_fee) AS nf, coalesce(r.other, p.other) AS no, coalesce(r.total, p.total) AS nt
   FROM payment_row p JOIN r USING (contract_id, period_no, line_id)),
b AS (SELECT *, abs(rent + mgmt_fee + coalesce(other, 0) - total) <= 0.02 AND abs(nr + nf + coalesce(no, 0) - nt) > 0.02 AS rejected FROM m)
SELECT contract_id, period_no, line_id, CASE WHEN rejected THEN rent ELSE nr END AS rent, CASE WHEN rejected THEN mgmt_fee ELSE nf END AS mgmt_fee,
  CASE WHEN rejected THEN coalesce(other, no) ELSE no END AS other, CASE WHEN rejected THEN total ELSE nt END AS total, rejected FROM b""")
def _(t):
    """A second reading that raises a rent, corrects a total, or fills an amount."""
    p, third = t.payment_row, F.col("period_no") % 3
    money = lambda x: x.cast("decimal(18,2)")
    review = p.select("contract_id", "period_no", "line_id", money(F.when(third == 0, F.col("rent") + 5).when(third == 1, F.col("rent"))).alias("rent"), "mgmt_fee",
                      money(F.when(F.col("other").isNull(), F.lit("0.01"))).alias("other"),
                      money(F.when(third == 1, F.col("rent") + F.col("mgmt_fee") + F.coalesce("other", F.lit(0)))).alias("total"))
    return Q.merge_payments(p, review, ["contract_id", "period_no", "line_id"])


@query("column_resolve", """SELECT c_custkey AS contract_id, c_name AS A, c_mktsegment AS B, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '未提及' END AS C, '未提及' AS D FROM customer""")
def _(t):
    """Fields named by letter, by title, by title without blanks, or not at all."""
    header = t.spark.createDataFrame([("A", "Tenant name"), ("B", "Line of business"), ("C", "Site"), ("D", "Deposit")], "letter string, title string")
    n = F.col("c_nationkey")
    fields = F.map_from_arrays(F.array(F.lit("A"), F.when(n % 3 == 0, F.lit("Line of business")).otherwise(F.lit("Lineofbusiness")), F.when(n % 2 == 0, F.lit("Site")).otherwise(F.lit("Elsewhere"))),
                               F.array(F.col("c_name"), F.col("c_mktsegment"), n.cast("string")))
    return Q.resolve_columns(t.customer.select(F.col("c_custkey").alias("contract_id"), fields.alias("fields")), "contract_id", header)


@query("reference_overlap", "SELECT DISTINCT source_file FROM contract_row WHERE pass = 1 AND rent_total <> '未提及' INTERSECT SELECT source_file FROM contract_row WHERE pass = 2")
def _(t):
    c = t.contract_row
    return c.where("pass = 1 AND rent_total <> '未提及'").select("source_file").intersect(c.where("pass = 2").select("source_file"))


@query("verdict_counts", """WITH v AS (SELECT a.source_file, a.contract_id % 7 = 0 AS miss, a.contract_id % 5 = 0 AND a.contract_id % 7 <> 0 AS con FROM contract_row a WHERE pass = 1)
SELECT a.source_file, 6 + CASE WHEN a.rent_total = b.rent_total THEN 1 ELSE 0 END AS supported, CASE WHEN a.rent_total <> b.rent_total AND a.rent_total <> '未提及' THEN 1 ELSE 0 END AS contradict,
  CASE WHEN a.rent_total = '未提及' THEN 1 ELSE 0 END AS not_on_pages, 0 AS missing_ok, 0 AS other, CASE WHEN a.rent_total <> b.rent_total AND a.rent_total <> '未提及' THEN 'rent_total' ELSE '' END AS contradicted
FROM contract_row a JOIN contract_row b ON a.contract_id = b.contract_id AND a.pass = 1 AND b.pass = 2""")
def _(t):
    c = t.contract_row
    name = c.select("contract_id", "source_file").distinct()
    d = Q.field_diff(c.where("pass = 1"), c.where("pass = 2"), "contract_id", LEDGER_FIELDS)
    same = F.col("extracted") == F.col("reference")
    verdict = (F.when(same, "supported").when(F.col("extracted").isin(*Q.MISSING) & F.col("reference").isin(*Q.MISSING), "missing ok")
               .when(F.col("extracted").isin(*Q.MISSING), "not on pages").otherwise("contradict"))
    return Q.verdict_counts(d.join(name, "contract_id").select("source_file", "field", verdict.alias("verdict")))


@query("batch_summary", "WITH " + RECON + """, t AS (SELECT portfolio, count(DISTINCT (entity_id, account)) AS tabs, count(DISTINCT (entity_id, account)) FILTER (amount = 0) AS nil_tabs FROM schedule_line GROUP BY 1),
e AS (SELECT DISTINCT entity_id, portfolio FROM schedule_line),
r AS (SELECT portfolio, count(*) AS lines, count(*) FILTER (match IN ('✅ Match', '⚠️ Match')) AS matches, count(*) FILTER (match = '❌ Diff') AS diffs, count(*) FILTER (mapping_status = 'Missing mapping') AS warned FROM recon JOIN e USING (entity_id) GROUP BY 1)
SELECT portfolio, sum(tabs) AS tabs, sum(nil_tabs) AS nil_tabs, sum(lines) AS lines, sum(matches) AS matches, sum(diffs) AS diffs, sum(warned) AS warned FROM t JOIN r USING (portfolio) GROUP BY ROLLUP (portfolio)""")
def _(t):
    s = t.schedule_line
    tabs = s.groupBy("portfolio", "entity_id", "account").agg(F.bool_or(F.col("amount") == 0).alias("nil")).groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("tabs"), F.count_if("nil").alias("nil_tabs"))
    r = recon_of(t).join(s.select("entity_id", "portfolio").distinct(), "entity_id").groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("match").isin("✅ Match", "⚠️ Match")).alias("matches"), F.count_if(F.col("match") == "❌ Diff").alias("diffs"),
        F.count_if(F.col("mapping_status") == "Missing mapping").alias("warned"))
    n = ["tabs", "nil_tabs", "lines", "matches", "diffs", "warned"]
    return tabs.join(r, "portfolio").rollup("portfolio").agg(*[F.sum(c).alias(c) for c in n])
