"""Canonical tables bound to the Parquet tables at hand.

Each binding is one SQL text that Spark and the test oracle both run unchanged.
An entity is a supplier, its portfolio a nation, and the financial year ends on
30 June, so every table below grows with ``lineitem`` or with the text tables.
Nothing here filters on an id: rows differ through CASE expressions only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.sources.sinks import landed, size_of

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["ledger_line"] = """
SELECT CAST(s.s_suppkey AS BIGINT) AS entity_id, s.s_name AS entity, n.n_name AS portfolio,
       p.p_type AS account, l.l_returnflag AS flag, l.l_linestatus AS status,
       CAST(year(l.l_shipdate) AS INT) AS yr, CAST(month(l.l_shipdate) AS INT) AS mo,
       CAST(year(l.l_shipdate) + CASE WHEN month(l.l_shipdate) >= 7 THEN 1 ELSE 0 END AS INT) AS fy,
       CAST(l.l_quantity AS DECIMAL(18,2)) AS qty,
       CAST(CAST(l.l_extendedprice AS DECIMAL(18,2))
            * (CAST(1 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(20,4)) AS amount
FROM lineitem l
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation n ON n.n_nationkey = s.s_nationkey
"""

# Chart of accounts (fixed values). One tab is left out so that "Missing mapping" occurs.
VIEWS["account_alias"] = """
SELECT * FROM (VALUES
  ('OI',  'IS', 'Revenue',        'STANDARD', 'Standard revenue',  1),
  ('OC',  'IS', 'Expenses',       'LARGE',    'Operating cost',    2),
  ('GA',  'IS', 'Expenses',       'PROMO',    'Promotion expense', 3),
  ('AR',  'BS', 'Current assets', 'SMALL',    'Accounts receivable', 4),
  ('Cash','BS', 'Current assets', 'MEDIUM',   'Cash at bank',      5)
) AS t(mapping_key, statement_type, category, tab_name, statement_label, line_no)
"""

VIEWS["schedule_line"] = """
SELECT entity_id, entity, portfolio, account, fy AS yr,
       CASE WHEN fy = 2002 THEN DATE '2001-10-31' ELSE make_date(fy, 6, 30) END AS period_end,
       CAST(sum(amount) AS DECIMAL(20,2)) AS amount
FROM ledger_line GROUP BY entity_id, entity, portfolio, account, fy
"""

# Schedule rows below the account: six components, then the total row.
VIEWS["detail_line"] = """
SELECT entity_id, entity, portfolio, account, yr, period_end, row_idx, description, amount
FROM (
  SELECT entity_id, entity, portfolio, account, fy AS yr,
         CASE WHEN fy = 2002 THEN DATE '2001-10-31' ELSE make_date(fy, 6, 30) END AS period_end,
         CASE concat(flag, status) WHEN 'AF' THEN 1 WHEN 'AO' THEN 2 WHEN 'NF' THEN 3
              WHEN 'NO' THEN 4 WHEN 'RF' THEN 5 ELSE 6 END AS row_idx,
         CASE concat(flag, status) WHEN 'AF' THEN 'Accepted goods' WHEN 'AO' THEN 'Accepted services'
              WHEN 'NF' THEN 'New orders' WHEN 'NO' THEN 'of which renewals'
              WHEN 'RF' THEN 'Returned goods' ELSE '123456 Returns clearing' END AS description,
         CAST(sum(CASE WHEN flag = 'R' THEN -amount ELSE amount END) AS DECIMAL(20,2)) AS amount
  FROM ledger_line GROUP BY entity_id, entity, portfolio, account, fy, flag, status
  UNION ALL
  SELECT entity_id, entity, portfolio, account, fy AS yr,
         CASE WHEN fy = 2002 THEN DATE '2001-10-31' ELSE make_date(fy, 6, 30) END AS period_end,
         7 AS row_idx, concat('Total ', lower(account)) AS description,
         CAST(sum(CASE WHEN flag = 'R' THEN -amount ELSE amount END) AS DECIMAL(20,2)) AS amount
  FROM ledger_line GROUP BY entity_id, entity, portfolio, account, fy
) x
"""

VIEWS["statement_line"] = """
SELECT s.entity_id, s.entity, s.portfolio, coalesce(a.statement_type, 'IS') AS statement_type,
       coalesce(a.statement_label, 'Unlisted income') AS description, s.account, s.yr, s.period_end,
       CAST((CASE WHEN a.category = 'Expenses' THEN -1 ELSE 1 END) *
            (CASE (s.entity_id * 7 + coalesce(a.line_no, 6) * 3 + s.yr) % 10
               WHEN 6 THEN s.amount + CAST(0.60 AS DECIMAL(4,2))
               WHEN 7 THEN s.amount * CAST(1.003 AS DECIMAL(6,3))
               WHEN 8 THEN s.amount * CAST(1.050 AS DECIMAL(6,3))
               WHEN 9 THEN CAST(0 AS DECIMAL(20,2))
               ELSE s.amount END) AS DECIMAL(20,2)) AS amount
FROM schedule_line s LEFT JOIN account_alias a ON a.tab_name = s.account
"""

VIEWS["statement_full"] = """
SELECT entity_id, entity, portfolio, statement_type, description, account, yr, period_end, amount FROM statement_line
UNION ALL
SELECT entity_id, entity, portfolio, statement_type, 'Total current assets', NULL, yr, period_end,
       CAST(sum(amount) AS DECIMAL(20,2))
FROM statement_line WHERE statement_type = 'BS'
GROUP BY entity_id, entity, portfolio, statement_type, yr, period_end
"""

VIEWS["metric_month"] = """
SELECT entity_id, entity, account AS phase, yr, mo,
       CAST(sum(qty) AS DECIMAL(20,2)) AS area,
       CAST(sum(amount) AS DECIMAL(20,2)) AS revenue,
       CAST(day(last_day(make_date(yr, mo, 1))) AS INT) AS days
FROM ledger_line GROUP BY entity_id, entity, account, yr, mo
"""

# One sheet per entity: title, stage row with blanks, unit and date row, accounts, total,
# a note column and a tie-out block to the right.
VIEWS["cells"] = """
SELECT portfolio AS workbook_id, entity AS sheet, row_idx, col_idx, cell_text, indent, hidden
FROM (
  SELECT DISTINCT entity_id, entity, portfolio, 0 AS row_idx, 0 AS col_idx,
         concat('Schedule - ', entity) AS cell_text, 0 AS indent, false AS hidden FROM schedule_line
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 2, 0, 'CNY''000', 0, false FROM schedule_line
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 1, CAST(yr - 1994 AS INT),
       CASE yr WHEN 1995 THEN 'Mgt acc' WHEN 1997 THEN 'Indicative adjusted' END, 0, false
     FROM schedule_line WHERE yr IN (1995, 1997)
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 1, 10, 'Remarks', 0, false FROM schedule_line
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 2, CAST(yr - 1994 AS INT),
       CAST(period_end AS VARCHAR(10)), 0, false FROM schedule_line
  UNION ALL SELECT DISTINCT s.entity_id, s.entity, s.portfolio, CAST(2 + a.line_no AS INT), 0, s.account,
       CASE WHEN a.line_no IN (2, 3) THEN 1 ELSE 0 END, false
     FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
  UNION ALL SELECT s.entity_id, s.entity, s.portfolio, CAST(2 + a.line_no AS INT), CAST(s.yr - 1994 AS INT),
       CAST(s.amount AS VARCHAR(30)), 0, false
     FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
  UNION ALL SELECT DISTINCT s.entity_id, s.entity, s.portfolio, CAST(2 + a.line_no AS INT), 10,
       concat('Balance of ', lower(a.statement_label), ' agreed to ledger'), 0, false
     FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 9, 0, 'Total', 0, false FROM schedule_line
  UNION ALL SELECT s.entity_id, s.entity, s.portfolio, 9, CAST(s.yr - 1994 AS INT),
       CAST(CAST(sum(s.amount) AS DECIMAL(20,2)) AS VARCHAR(30)), 0, false
     FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
     GROUP BY s.entity_id, s.entity, s.portfolio, s.yr
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 11, CAST(yr - 1994 + 11 AS INT),
       CAST(period_end AS VARCHAR(10)), 0, false FROM schedule_line
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 13, 11, 'Check', 0, false FROM schedule_line
  UNION ALL SELECT s.entity_id, s.entity, s.portfolio, 13, CAST(s.yr - 1994 + 11 AS INT),
       CAST(CAST(sum(s.amount) AS DECIMAL(20,2)) AS VARCHAR(30)), 0, false
     FROM schedule_line s GROUP BY s.entity_id, s.entity, s.portfolio, s.yr
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 18, 0, '示意性调整后 - detail of accounts in this book', 0, false FROM schedule_line
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 20, 0, 'CNY''000', 0, false FROM schedule_line
  UNION ALL SELECT DISTINCT entity_id, entity, portfolio, 20, CAST(yr - 1994 AS INT),
       CAST(period_end AS VARCHAR(10)), 0, false FROM schedule_line
  UNION ALL SELECT DISTINCT s.entity_id, s.entity, s.portfolio, CAST(20 + a.line_no AS INT), 0, concat('Part ', lower(s.account)), 0, false
     FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
  UNION ALL SELECT s.entity_id, s.entity, s.portfolio, CAST(20 + a.line_no AS INT), CAST(s.yr - 1994 AS INT),
       CAST(s.amount AS VARCHAR(30)), 0, false
     FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
) x
"""

# A statement sheet: balance sheet, income statement, then ratio rows.
VIEWS["statement_cells"] = """
SELECT portfolio AS workbook_id, concat('Financials ', entity) AS sheet, row_idx, col_idx, cell_text
FROM (
  SELECT DISTINCT entity, portfolio, h.row_idx, h.col_idx, h.cell_text FROM schedule_line
  CROSS JOIN (VALUES (0, 0, 'Indicative adjusted balance sheet'), (1, 0, 'CNY''000'), (5, 0, 'Total liabilities and owners equity'),
    (7, 0, 'Indicative adjusted income statement'), (8, 0, 'CNY''000'), (14, 0, 'Net profit'), (16, 0, '出租率'), (17, 0, '单位租金'), (18, 0, '毛利率')) AS h(row_idx, col_idx, cell_text)
  UNION ALL SELECT DISTINCT entity, portfolio, h.row_idx, CAST(yr - 1994 AS INT), CAST(period_end AS VARCHAR(10)) FROM schedule_line CROSS JOIN (VALUES (1), (8)) AS h(row_idx)
  UNION ALL SELECT DISTINCT entity, portfolio, h.row_idx, CAST(yr - 1994 AS INT), 'Indicative adjusted' FROM schedule_line CROSS JOIN (VALUES (2), (9)) AS h(row_idx)
  UNION ALL SELECT DISTINCT s.entity, s.portfolio, CASE WHEN s.statement_type = 'BS' THEN a.line_no - 1 ELSE coalesce(a.line_no, 4) + 9 END, 0, s.description
     FROM statement_line s LEFT JOIN account_alias a ON a.tab_name = s.account
  UNION ALL SELECT s.entity, s.portfolio, CASE WHEN s.statement_type = 'BS' THEN a.line_no - 1 ELSE coalesce(a.line_no, 4) + 9 END, CAST(s.yr - 1994 AS INT), CAST(s.amount AS VARCHAR(30))
     FROM statement_line s LEFT JOIN account_alias a ON a.tab_name = s.account
  UNION ALL SELECT entity, portfolio, CASE WHEN statement_type = 'BS' THEN 5 ELSE 14 END, CAST(yr - 1994 AS INT), CAST(CAST(sum(amount) AS DECIMAL(20,2)) AS VARCHAR(30))
     FROM statement_line GROUP BY entity, portfolio, statement_type, yr
  UNION ALL SELECT DISTINCT entity, portfolio, h.row_idx, CAST(yr - 1994 AS INT), '0.95' FROM schedule_line CROSS JOIN (VALUES (16), (17), (18)) AS h(row_idx)
) x
"""

# A roll-forward sheet: components across, dates down, after the carrying-amount row.
VIEWS["rollforward_cells"] = """
SELECT portfolio AS workbook_id, concat('Assets ', entity) AS sheet, row_idx, col_idx, cell_text
FROM (
  SELECT DISTINCT entity, portfolio, h.row_idx, 0 AS col_idx, h.cell_text FROM schedule_line
  CROSS JOIN (VALUES (0, 'CNY''000'), (1, 'Additions'), (2, 'Carrying amounts'), (20, 'Check of dates')) AS h(row_idx, cell_text)
  UNION ALL SELECT DISTINCT s.entity, s.portfolio, 0, CAST(a.line_no AS INT), lower(s.account) FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
  UNION ALL SELECT DISTINCT entity, portfolio, CAST(yr - 1995 + 3 AS INT), 0, CAST(period_end AS VARCHAR(10)) FROM schedule_line
  UNION ALL SELECT s.entity, s.portfolio, CAST(s.yr - 1995 + 3 AS INT), CAST(a.line_no AS INT), CAST(s.amount AS VARCHAR(30))
     FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
) x
"""

# Pre-built bridge blocks: Base / Change columns, a blank row, then a check row.
VIEWS["bridge_cells"] = """
SELECT portfolio AS workbook_id, concat('Bridge ', entity) AS sheet, row_idx, col_idx, cell_text
FROM (
  SELECT DISTINCT entity, portfolio, h.row_idx, h.col_idx, h.cell_text FROM schedule_line
  CROSS JOIN (VALUES (0, 2, 'Base'), (0, 3, 'Change'), (12, 1, 'check'), (20, 6, 'Base'), (20, 7, 'Change')) AS h(row_idx, col_idx, cell_text)
  UNION ALL SELECT DISTINCT entity, portfolio, CAST(yr - 1994 AS INT), 1, CASE yr WHEN 1995 THEN 'Start' WHEN 2002 THEN 'End' ELSE concat('Move ', CAST(yr AS VARCHAR(4))) END FROM schedule_line
  UNION ALL SELECT entity, portfolio, CAST(yr - 1994 AS INT), CASE WHEN yr IN (1995, 2002) THEN 2 ELSE 3 END,
     CAST(CASE WHEN yr IN (1995, 2002) THEN total ELSE step END AS VARCHAR(30))
    FROM (SELECT entity, portfolio, yr, CAST(sum(amount) AS DECIMAL(20,2)) AS total,
            CAST(sum(amount) - 1000 AS DECIMAL(20,2)) AS step FROM schedule_line GROUP BY entity, portfolio, yr) y
  UNION ALL SELECT DISTINCT entity, portfolio, h.row_idx, 5, h.cell_text FROM schedule_line CROSS JOIN (VALUES (21, 'Opening'), (22, 'Rise'), (23, 'Closing')) AS h(row_idx, cell_text)
  UNION ALL SELECT entity, portfolio, 21, 6, CAST(CAST(sum(amount) AS DECIMAL(20,2)) AS VARCHAR(30)) FROM schedule_line GROUP BY entity, portfolio
  UNION ALL SELECT entity, portfolio, 22, 7, CAST(CAST(sum(amount) / 2 AS DECIMAL(20,2)) AS VARCHAR(30)) FROM schedule_line GROUP BY entity, portfolio
  UNION ALL SELECT entity, portfolio, 23, 6, CAST(CAST(sum(amount) AS DECIMAL(20,2)) + CAST(sum(amount) / 2 AS DECIMAL(20,2)) AS VARCHAR(30)) FROM schedule_line GROUP BY entity, portfolio
) x
"""

# Sheets with headers of three kinds: stages over a part of the dates and a date twice; no stage and
# texts below some or all dates; no stage and a row of dates above remarks.
VIEWS["header_book"] = """
SELECT entity_id, entity, portfolio, account, yr, period_end, amount, a.line_no, CAST(CASE entity_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 9 ELSE 12 END AS INT) AS hr
FROM schedule_line s JOIN account_alias a ON a.tab_name = s.account
"""
VIEWS["header_cells"] = """
SELECT portfolio AS workbook_id, concat('Header ', entity) AS sheet, row_idx, col_idx, cell_text
FROM (
  SELECT DISTINCT entity, portfolio, hr AS row_idx, 0 AS col_idx, 'CNY''000' AS cell_text FROM header_book
  UNION ALL SELECT DISTINCT entity, portfolio, hr, CAST(yr - 1994 AS INT), CAST(period_end AS VARCHAR(10)) FROM header_book
  UNION ALL SELECT DISTINCT entity, portfolio, CAST(hr + line_no AS INT), 0, account FROM header_book
  UNION ALL SELECT entity, portfolio, CAST(hr + line_no AS INT), CAST(yr - 1994 AS INT), CAST(amount AS VARCHAR(30)) FROM header_book
  UNION ALL SELECT DISTINCT entity, portfolio, hr - 1, CAST(yr - 1994 AS INT), CASE WHEN yr < 1997 THEN 'Mgt acc' ELSE 'Indicative adjusted' END FROM header_book WHERE entity_id % 3 = 0 AND yr BETWEEN 1995 AND 1999
  UNION ALL SELECT DISTINCT entity, portfolio, h.o, 24, CASE h.o WHEN 1 THEN 'Indicative adjusted' ELSE CAST(period_end AS VARCHAR(10)) END FROM header_book CROSS JOIN (VALUES (1), (2)) AS h(o) WHERE entity_id % 3 = 0 AND yr = 1998
  UNION ALL SELECT DISTINCT entity, portfolio, CAST(hr + 20 + h.o AS INT), CAST(yr - 1994 AS INT), 'see below' FROM header_book CROSS JOIN (VALUES (0), (1), (2)) AS h(o) WHERE entity_id % 3 = 1 AND (entity_id % 2 = 0 OR h.o <= yr % 3)
  UNION ALL SELECT DISTINCT entity, portfolio, 3, CAST(yr - 1994 + h.o AS INT), CAST(period_end AS VARCHAR(10)) FROM header_book CROSS JOIN (VALUES (0), (1)) AS h(o) WHERE entity_id % 3 = 2 AND (h.o = 0 OR yr = 2002)
  UNION ALL SELECT DISTINCT entity, portfolio, CAST(4 + h.o AS INT), CAST(yr - 1994 AS INT), 'see below' FROM header_book CROSS JOIN (VALUES (0), (1), (2)) AS h(o) WHERE entity_id % 3 = 2
) x
"""

# Journals in which rows carry dates themselves: under a header of three dates, and again far below without one.
VIEWS["journal_line"] = """
SELECT entity, portfolio, account, yr, period_end, amount, yr < 1997 AS headed,
       CAST(3 * row_number() OVER (PARTITION BY entity, portfolio, yr < 1997 ORDER BY account, yr) - 2 + CASE WHEN yr < 1997 THEN 0 ELSE 1000 END AS INT) AS row_at
FROM (SELECT entity, portfolio, account, yr, max(period_end) AS period_end, CAST(sum(amount) AS DECIMAL(20,2)) AS amount FROM schedule_line GROUP BY entity, portfolio, account, yr) x
"""
VIEWS["journal_cells"] = """
SELECT portfolio AS workbook_id, concat('Journal ', entity) AS sheet, row_idx, col_idx, cell_text
FROM (
  SELECT DISTINCT entity, portfolio, 0 AS row_idx, h.col_idx, h.cell_text FROM journal_line
  CROSS JOIN (VALUES (0, 'Booked'), (1, '1995-12-31'), (2, '1996-12-31'), (3, '1997-12-31')) AS h(col_idx, cell_text)
  UNION ALL SELECT entity, portfolio, CAST(row_at + h.o AS INT), 0, concat(h.word, ' ', lower(account)) FROM journal_line CROSS JOIN (VALUES (0, 'Entry'), (1, 'Net'), (2, 'Tax')) AS h(o, word)
  UNION ALL SELECT entity, portfolio, row_at, h.c, CAST(period_end AS VARCHAR(10)) FROM journal_line CROSS JOIN (VALUES (1), (2)) AS h(c)
  UNION ALL SELECT entity, portfolio, row_at, 3, CAST(amount AS VARCHAR(30)) FROM journal_line
  UNION ALL SELECT entity, portfolio, CAST(row_at + h.o AS INT), h.c, CAST(amount AS VARCHAR(30)) FROM journal_line CROSS JOIN (VALUES (1, 1), (1, 2), (2, 2)) AS h(o, c)
) x
"""

VIEWS["ph"] = """
SELECT entity_id, entity, phase, CASE phase WHEN 'STANDARD' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 3 WHEN 'MEDIUM' THEN 4 ELSE 5 END AS k,
       yr, CAST(sum(area) AS DECIMAL(20,2)) AS area, CAST(sum(revenue) AS DECIMAL(20,2)) AS revenue FROM metric_month GROUP BY ALL
"""

# Tags of phases by year: on every fourth sheet one phase has none and another only some.
VIEWS["phase_tag"] = """
SELECT entity, k, yr, concat('T', substr(phase, 1, 3)) AS tag FROM ph
WHERE entity_id % 2 = 0 AND NOT (entity_id % 4 = 0 AND (k = 2 OR (k = 1 AND yr % 4 = 3)))
"""

# Operating sheets: one block of metric rows per phase, months across, tags above, grand total below.
VIEWS["phase_cells"] = """
SELECT entity AS sheet, row_idx, col_idx, cell_text
FROM (
  SELECT DISTINCT entity, CAST(10 + k * 6 + h.o AS INT) AS row_idx, 3 AS col_idx,
         CASE h.o WHEN 0 THEN 'Total occupancy rate' WHEN 1 THEN 'Total leased area' WHEN 2 THEN 'Rent' ELSE concat(phase, ' rental revenue') END AS cell_text
    FROM ph CROSS JOIN (VALUES (0), (1), (2), (3)) AS h(o)
  UNION ALL SELECT entity, CAST(10 + k * 6 + 1 AS INT), CAST(yr - 1985 AS INT), CAST(area AS VARCHAR(30)) FROM ph
  UNION ALL SELECT entity, CAST(10 + k * 6 + 3 AS INT), CAST(yr - 1985 AS INT), CAST(revenue AS VARCHAR(30)) FROM ph
  UNION ALL SELECT DISTINCT entity, 60, 2, 'Total rental revenue' FROM ph
  UNION ALL SELECT entity, CAST(2 + k AS INT), CAST(yr - 1985 AS INT), tag FROM phase_tag
) x
"""
# Parent rows before their parts, with no total row.
VIEWS["implicit_line"] = """
SELECT entity_id, account, yr, h.i AS row_idx, h.label AS description,
       CAST(CASE h.i WHEN 0 THEN a + b WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c + d + e WHEN 4 THEN c WHEN 5 THEN d WHEN 6 THEN e ELSE b END AS DECIMAL(20,2)) AS amount
FROM (SELECT entity_id, account, yr,
             sum(CASE WHEN row_idx = 1 THEN abs(amount) ELSE 0 END) AS a, sum(CASE WHEN row_idx = 2 THEN abs(amount) ELSE 0 END) AS b,
             sum(CASE WHEN row_idx = 3 THEN abs(amount) ELSE 0 END) AS c, sum(CASE WHEN row_idx = 4 THEN abs(amount) ELSE 0 END) AS d,
             sum(CASE WHEN row_idx = 5 THEN abs(amount) ELSE 0 END) AS e FROM detail_line GROUP BY entity_id, account, yr) x
CROSS JOIN (VALUES (0, 'Accepted'), (1, 'Accepted goods'), (2, 'Accepted services'), (3, 'Orders'), (4, 'New'), (5, 'Renewed'), (6, 'Returned'), (7, 'Memo')) AS h(i, label)
"""

# Indented rows: a parent with a value, a heading without one whose parts make up a later total.
VIEWS["indent_line"] = """
SELECT entity_id, account, yr, h.i AS row_idx, h.label AS description, h.ind AS indent,
       CAST(CASE h.i WHEN 0 THEN a + b * CASE WHEN entity_id % 7 = 0 THEN 2 ELSE 1 END WHEN 1 THEN a WHEN 2 THEN b WHEN 4 THEN c WHEN 5 THEN e WHEN 6 THEN c + e END AS DECIMAL(20,2)) AS amount
FROM (SELECT entity_id, account, yr,
             sum(CASE WHEN row_idx = 1 THEN abs(amount) ELSE 0 END) AS a, sum(CASE WHEN row_idx = 2 THEN abs(amount) ELSE 0 END) AS b,
             sum(CASE WHEN row_idx = 3 THEN abs(amount) ELSE 0 END) AS c, sum(CASE WHEN row_idx = 5 THEN abs(amount) ELSE 0 END) AS e FROM detail_line GROUP BY entity_id, account, yr) x
CROSS JOIN (VALUES (0, 'Accepted', 0), (1, 'Goods', 1), (2, 'Services', 1), (3, 'Other items', 0), (4, 'Orders', 1), (5, 'Returned', 1), (6, 'Total other', 0)) AS h(i, label, ind)
"""

VIEWS["remark"] = """
SELECT s.entity_id, s.entity, s.account, s.yr, 'row_note' AS source,
       CASE WHEN s.entity_id % 2 = 0
            THEN concat('Check | ', CAST(s.period_end AS VARCHAR(10)), ': ',
                        CAST(CAST(abs(st.amount) - s.amount AS DECIMAL(20,2)) AS VARCHAR(30)))
            ELSE concat('Timing difference for ', lower(s.account), ' under review by management') END AS note
FROM schedule_line s JOIN statement_line st
  ON st.entity_id = s.entity_id AND st.account = s.account AND st.yr = s.yr
WHERE abs(abs(st.amount) - s.amount) > 1 AND st.amount <> 0
UNION ALL
SELECT entity_id, entity, account, yr, 'rhs_columns',
       CASE entity_id % 3 WHEN 0 THEN concat('New contracts for ', lower(account), ' started in ', CAST(yr AS VARCHAR(4)))
            WHEN 1 THEN 'Check' ELSE concat('Bank confirmation obtained for ', lower(account)) END
FROM schedule_line
"""

VIEWS["commentary_gen"] = """
SELECT s.entity_id, s.entity, s.account, s.yr, t.attempt,
       concat('The balance as at ', CAST(s.period_end AS VARCHAR(10)), ' totalled CNY',
              CAST(CAST(s.amount * t.mult AS DECIMAL(20,0)) AS VARCHAR(30)),
              CASE s.entity_id % 3 WHEN 0 THEN ', mainly driven by new contracts. '
                   WHEN 1 THEN '. Balances were confirmed by the bank; no reason is given in the information provided. '
                   ELSE '. ' END,
              '余额合计为', CAST(CAST(s.amount / 10000 AS DECIMAL(20,1)) AS VARCHAR(30)), '万元。') AS text
FROM schedule_line s
CROSS JOIN (VALUES (1, 1000), (2, 1), (3, 2)) AS t(attempt, mult)
"""

# What a model reviewer said about the same commentary.
VIEWS["model_review"] = """
SELECT entity_id, account, yr, attempt, 1 AS review_no, 'mainly driven by new contracts' AS clause,
       false AS supported, 'reasoning' AS category FROM commentary_gen WHERE contains(text, 'driven by')
UNION ALL
SELECT entity_id, account, yr, attempt, 2, substr(text, 1, position('totalled' IN text) + 7), false, 'hallucination'
FROM commentary_gen WHERE attempt = 2
"""

# Enumerated compositions: complete, short by one item, ten times too large, or parent plus children.
VIEWS["composition_text"] = """
SELECT entity_id, account, yr,
       concat('余额合计', CAST(CAST(t / 10000 AS DECIMAL(20,1)) AS VARCHAR(30)), '万元，主要包括：1）商品',
              CAST(CAST(a * m / 10000 AS DECIMAL(20,1)) AS VARCHAR(30)), '万元；2）服务',
              CAST(CAST(b * m / 10000 AS DECIMAL(20,1)) AS VARCHAR(30)), '万元；3）新订单',
              CAST(CAST(c * m / 10000 AS DECIMAL(20,1)) AS VARCHAR(30)), '万元。',
              CASE WHEN entity_id % 5 = 1 THEN '' ELSE
                concat('其余', CAST(CAST((t - a - b - c) * m / 10000 AS DECIMAL(20,1)) AS VARCHAR(30)), '万元为其他。') END) AS text
FROM (SELECT entity_id, account, yr,
             CAST(sum(CASE WHEN row_idx < 7 THEN abs(amount) ELSE 0 END) AS DECIMAL(20,2)) AS t,
             CAST(sum(CASE WHEN row_idx = 1 THEN abs(amount) ELSE 0 END) AS DECIMAL(20,2)) AS a,
             CAST(sum(CASE WHEN row_idx = 2 THEN abs(amount) ELSE 0 END) AS DECIMAL(20,2)) AS b,
             CAST(sum(CASE WHEN row_idx = 3 THEN abs(amount) ELSE 0 END) AS DECIMAL(20,2)) AS c,
             CASE entity_id % 5 WHEN 2 THEN 10 WHEN 3 THEN 2 ELSE 1 END AS m
      FROM detail_line GROUP BY entity_id, account, yr) x
"""

VIEWS["claim_text"] = """
SELECT entity_id, entity, account, yr,
       concat(CASE account WHEN 'STANDARD' THEN '我方已核对银行对账单；' WHEN 'LARGE' THEN '管理层表示该余额为时间性差异；'
                           WHEN 'MEDIUM' THEN '经核对未发现重大差异；' ELSE '' END,
              '余额为', CAST(amount AS VARCHAR(30)), '元。') AS text
FROM schedule_line
"""

# Figures as they are typed into cells.
VIEWS["amount_text"] = """
SELECT entity_id, account, yr, row_idx, amount,
       CASE row_idx WHEN 1 THEN CAST(amount AS VARCHAR(30)) WHEN 2 THEN concat('(', CAST(abs(amount) AS VARCHAR(30)), ')')
            WHEN 3 THEN concat(substr(t, 1, length(t) - 6), ',', substr(t, length(t) - 5))
            WHEN 4 THEN concat(substr(t, 1, length(t) - 6), '，', substr(t, length(t) - 5))
            WHEN 5 THEN concat('  ', t, ' ') WHEN 6 THEN 'n/a' ELSE '' END AS cell_text
FROM (SELECT entity_id, account, yr, row_idx, amount, CAST(abs(amount) + 10000 AS VARCHAR(30)) AS t FROM detail_line) x
"""

# Period labels in every notation.
VIEWS["period_text"] = """
SELECT entity_id, account, yr, period_end,
       CASE account WHEN 'STANDARD' THEN concat('FY', substr(CAST(yr AS VARCHAR(4)), 3, 2))
            WHEN 'LARGE' THEN concat(CAST(month(period_end) AS VARCHAR(2)), 'M', substr(CAST(yr AS VARCHAR(4)), 3, 2))
            WHEN 'PROMO' THEN concat(CAST(year(period_end) AS VARCHAR(4)), '年', CAST(month(period_end) AS VARCHAR(2)), '月', CAST(day(period_end) AS VARCHAR(2)), '日')
            WHEN 'SMALL' THEN concat(CAST(yr AS VARCHAR(4)), '年1-', CAST(month(period_end) AS VARCHAR(2)), '月')
            WHEN 'MEDIUM' THEN concat(CAST(yr AS VARCHAR(4)), '年')
            ELSE CASE WHEN entity_id % 2 = 0 THEN CAST(period_end AS VARCHAR(10)) ELSE CAST(datediff_days AS VARCHAR(10)) END END AS label
FROM (SELECT entity_id, account, yr, period_end, 36526 + yr - 2000 AS datediff_days FROM schedule_line) x
"""

VIEWS["label_text"] = """
SELECT p_partkey AS label_id, concat(p_name, ' & ', p_type, ' Receivables: (Expenses)') AS label,
       CASE p_type WHEN 'SMALL' THEN concat(p_name, '_type') WHEN 'PROMO' THEN concat('leasing_', p_name)
            WHEN 'LARGE' THEN '货币资金' ELSE concat(p_name, '_code status_ok') END AS raw_label
FROM part
"""

VIEWS["model_output"] = """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('<think>draft</think>Verified output: "', text, '"')
            WHEN 1 THEN concat('final output: ', text, ' I verified the figures.')
            WHEN 2 THEN concat('<THINK>never closed ', text) ELSE concat('已验证输出： ', text) END AS text
FROM conversations
"""

VIEWS["entity_text"] = """
SELECT s.s_suppkey AS entity_id, concat('2024-06-30 - 南通', CASE WHEN s.s_nationkey % 2 = 0 THEN concat(' ', s.s_name, ' (', n.n_name, ')') ELSE '通海' END) AS label
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
"""

VIEWS["rate_text"] = """
SELECT entity_id, phase, yr, mo, concat('Rent rose from CNY0.91 to CNY', CAST(CAST(floor(revenue / area) AS BIGINT) AS VARCHAR(30)),
       ' per sqm per day. Revenue was CNY', CAST(revenue AS VARCHAR(30)), ' for the month.') AS text
FROM metric_month WHERE area > 0
"""

VIEWS["run_log"] = """
SELECT event_id, ts, concat('stage_', CAST(user_id % 4 AS VARCHAR(2))) AS stage, user_id AS account,
       CAST(value AS DECIMAL(10,2)) AS duration_s, event_type,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS completion_tokens, 90 AS token_cap
FROM events
"""

# The same log as text lines; sign-ups are heartbeat lines that carry no figures.
VIEWS["run_log_line"] = """
SELECT event_id, CASE WHEN event_type = 'signup' THEN concat('heartbeat ', stage) ELSE
  concat('INFO [', stage, '] Processed: account ', CAST(account AS VARCHAR(20)), ' | Duration: ', CAST(duration_s AS VARCHAR(20)),
         's | Model: model-', event_type, ' | Prompt chars: ', CAST(completion_tokens * 40 AS VARCHAR(20)),
         ' | Output chars: ', CAST(CASE WHEN ok = 0 THEN 0 ELSE completion_tokens * 4 END AS VARCHAR(20)),
         ' | Tokens used: ', CAST(completion_tokens * 11 AS VARCHAR(20)), ' | Prompt tokens: ', CAST(completion_tokens * 10 AS VARCHAR(20)),
         ' | Completion tokens: ', CAST(completion_tokens AS VARCHAR(20)), ' | Total tokens: ', CAST(completion_tokens * 11 AS VARCHAR(20)),
         ' | Estimated prompt tokens: ', CAST(completion_tokens * 10 AS VARCHAR(20)), ' | Estimated output tokens: ',
         CAST(completion_tokens AS VARCHAR(20)), ' | Expected max output tokens: ', CAST(token_cap AS VARCHAR(20)), ' | Token source: ',
         CASE WHEN event_type = 'click' THEN 'estimated' ELSE 'provider_usage' END) END AS line
FROM run_log
"""

VIEWS["stage_text"] = """
SELECT conv_id AS account, turn AS stage_no, role, text FROM conversations
"""

VIEWS["payment_row"] = """
SELECT l_orderkey AS contract_id, l_linenumber AS period_no, l_partkey AS line_id,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS rent,
       CAST(l_quantity AS DECIMAL(18,2)) AS mgmt_fee,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_tax AS DECIMAL(18,2)) END AS other,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + CAST(l_quantity AS DECIMAL(18,2))
            + CASE WHEN l_returnflag = 'N' THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(l_tax AS DECIMAL(18,2)) END
            + CASE WHEN l_partkey % 11 = 0 THEN CAST(1 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END
            AS DECIMAL(18,2)) AS total
FROM lineitem
"""

VIEWS["contract_row"] = """
SELECT c.c_custkey AS contract_id, concat(c.c_name, '.pdf') AS source_file, t.pass,
       concat('Project ', CAST(c.c_nationkey AS VARCHAR(3))) AS project, c.c_mktsegment AS industry,
       CASE WHEN c.c_custkey % 7 = 0 AND t.pass = 1 THEN '未提及'
            ELSE CAST(CAST(c.c_acctbal AS DECIMAL(18,2)) + CASE WHEN c.c_custkey % 5 = 0 AND t.pass = 2 THEN 3 ELSE 0 END AS VARCHAR(30)) END AS rent_total,
       CASE WHEN c.c_custkey % 4 = 0 THEN '约3个月' ELSE '3' END AS free_months,
       '0.95' AS day_rent, '0.15' AS day_fee,
       CASE WHEN c.c_custkey % 6 = 0 THEN '1200' ELSE '1.1' END AS day_total
FROM customer c CROSS JOIN (VALUES (1), (2)) AS t(pass)
"""

VIEWS["sheet_label"] = """
SELECT p_brand AS workbook_id, p_name AS sheet_name, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS total
FROM part GROUP BY p_brand, p_name
"""


def _closure(sql: str, skip: frozenset[str] = frozenset()) -> list[str]:
    """Names of the bindings that ``sql`` needs, in definition order."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"[a-z_]+", queue.pop()))
        for name in VIEWS:
            if name in words and name not in needed and name not in skip:
                needed.add(name)
                queue.append(VIEWS[name])
    return [name for name in VIEWS if name in needed]


def with_views(sql: str) -> str:
    """Prefix oracle SQL with the bindings it mentions."""
    body = sql.strip()
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in _closure(body)]
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SOURCE = re.compile(r"\b(FROM|JOIN)\s+([a-z_]+)\b")

# Tables that most jobs read several times: landed once per application.
SHARED = frozenset({"schedule_line", "detail_line", "metric_month", "statement_full", "commentary_gen", "journal_line", "ph", "phase_cells"})
# Those in buckets of their entity: an entity has a bounded number of rows in them, however many ledger lines it has.
BUCKETED = {"schedule_line": "entity_id", "detail_line": "entity_id", "commentary_gen": "entity_id"}

# These only sum the ledger by financial year, so they read one landed table of such sums instead of joining the ledger anew.
YEARLY = frozenset({"schedule_line", "detail_line"})
YEAR_KEYS = ["entity_id", "entity", "portfolio", "account", "flag", "status", "fy"]
# Dimensions of the ledger that grow: joined by hashing their share of a partition, so the ledger itself is never sorted.
HASHED = frozenset({"part", "supplier"})


#: Bytes of ledger lines to a bucket.
BUCKET_BYTES = 4 << 20


def ledger_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets that follow the size of the ledger, so that a bucket stays small; at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-size_of(read_base(spark, sf_dir, "lineitem")) // BUCKET_BYTES))


def ledger_years(spark: SparkSession, sf_dir: str, memo: dict[str, DataFrame]) -> DataFrame:
    """The ledger summed by all columns but the month; sums of its sums are sums of its lines.

    Dealt by the bucket before it is written, so a bucket is one file and not one of each task.
    """
    n = ledger_buckets(spark, sf_dir)
    return landed(spark, sf_dir, "ledger_year", lambda: table(spark, sf_dir, "ledger_line", memo).groupBy(*YEAR_KEYS).agg(F.sum("amount").alias("amount")).repartition(n, "entity_id"),
                  "entity_id", n)


def table(spark: SparkSession, sf_dir: str, name: str, memo: dict[str, DataFrame] | None = None) -> DataFrame:
    """A base table or a canonical table, as a lazy DataFrame."""
    memo = {} if memo is None else memo
    if name in memo:
        return memo[name]
    if name in BASE_TABLES:
        df = read_base(spark, sf_dir, name)
    else:
        sql = VIEWS[name]
        used = {m.group(2) for m in _SOURCE.finditer(sql)} & (set(VIEWS) | set(BASE_TABLES))
        text = _SOURCE.sub(lambda m: f"{m.group(1)} {{{m.group(2)}}}" if m.group(2) in used else m.group(0), sql)

        def build() -> DataFrame:
            sources = {u: table(spark, sf_dir, u, memo) for u in used}
            if name in YEARLY:
                sources["ledger_line"] = ledger_years(spark, sf_dir, memo)
            if name == "ledger_line":
                sources |= {u: sources[u].hint("shuffle_hash") for u in HASHED}
            df = spark.sql(text, **sources) if used else spark.sql(sql)
            return df.toDF(*df.columns)  # drops the SQL table aliases, so struct fields cannot clash with them

        if name in BUCKETED:
            df = landed(spark, sf_dir, name, build, BUCKETED[name], ledger_buckets(spark, sf_dir))
        else:
            df = landed(spark, sf_dir, name, build) if name in SHARED else build()
    memo[name] = df
    return df
