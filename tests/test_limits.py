"""Rows beyond limits that operators once had, and names in awkward places."""

import random

import pytest
from pyspark.sql import functions as F

from tieout.functions import blocks
from tieout.operators import cells as K
from tieout.operators import clauses as C
from tieout.operators import hierarchy as H
from tieout.operators import matching as M
from tieout.operators import quality as Q
from tieout.sources.sinks import shared_folder

CELLS = "workbook_id string, sheet string, row_idx int, col_idx int, cell_text string"


def grid(spark, rows):
    """rows: {row: [cell texts]} of one sheet."""
    return K.typed(spark.createDataFrame([("w", "s", r, i, t) for r, texts in rows.items() for i, t in enumerate(texts) if t], CELLS))


def test_no_name_survives_anonymising(spark):
    names = Q.name_map(spark.createDataFrame([("Acme",), ("Acme Trading",), ("Acme Trading Ltd",), ("Beta",), ("C+D Co.",)], "name string"))
    texts = [(1, "Paid Acme Trading Ltd, amount CNY1,000.50 and (Beta) CNY5.00"), (2, "Acme/Acme Trading: Acmexx Beta2"), (3, "nothing here"), (4, None), (5, ""), (6, "to C+D Co. CNY 1,234,567")]
    got = {r.id: r for r in Q.anonymise(spark.createDataFrame(texts, "id int, text string"), ["id"], names, "2.000").collect()}
    fake = {r.name: r.pseudonym for r in names.collect()}
    assert got[1].text == f"Paid {fake['Acme Trading Ltd']}, amount CNY2,001.00 and ({fake['Beta']}) CNY10.00" and (got[1].names, got[1].amounts) == (2, 2)
    assert got[2].text == f"{fake['Acme']}/{fake['Acme Trading']}: Acmexx Beta2" and got[2].names == 2
    assert got[3].text == "nothing here" and got[4].text is None and got[5].text == ""
    assert got[6].text == f"to {fake['C+D Co.']} CNY2,469,134.00"


def test_deep_indents_find_their_parents(spark):
    rows = [("k", i, ind) for i, ind in enumerate([0, 16, 17, 40, 16, 0])]
    got = {r.row_idx: r.parent_row for r in H.indent_parents(spark.createDataFrame(rows, "k string, row_idx int, indent int"), ["k"]).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: None}


def test_period_blocks_far_down_and_across_gaps(spark):
    dates = ["Label", "2021-12-31", "2022-12-31"]
    rows = {0: dates, 1: ["a", "1", "2"], 2: ["b", "3", "4"], 40: ["c", "5", "6"], 300: dates, 301: ["d", "1", "2"], 302: ["e", "3", "4"]}
    got = {r["head"]: r for r in K.period_blocks(grid(spark, rows)).collect()}
    assert set(got) == {0, 300}
    assert got[0].last_row == 2 and got[300].last_row == 302 and got[300].data_rows == 2


def plain_period_blocks(rows, blank=3):
    """Scan from the top with the regions claimed so far, on {row: {col: text}}."""
    dated = lambda x: x.startswith("20")
    figure = lambda x: x.isdigit() and not dated(x)

    def spans(r):
        out, label, cols = [], None, []
        for c, x in [*sorted(rows.get(r, {}).items()), (99, "end")]:
            if dated(x):
                cols += [c] * (label is not None)
            else:
                if len(cols) >= 2:
                    out.append((label, cols))
                label, cols = c, []
        return out

    found, claimed, n = [], [], max(rows, default=-1) + 10
    for r in range(n):
        for label, cols in spans(r):
            if any(c == label and a <= r <= b for c, a, b in claimed):
                continue
            j, empty, data, last = r + 1, 0, 0, None
            while j < n and empty < blank:
                here = rows.get(j, {})
                nums = any(figure(here.get(c, "")) for c in cols)
                if label not in here and not nums:
                    empty += 1
                else:
                    empty = 0
                    if spans(j) and label in here and not nums:
                        break
                    data, last = data + nums, j if nums else last
                j += 1
            if data >= 2:
                claimed.append((label, r, j))
                found.append((label, r, len(cols), data, last))
    return found


def test_dated_blocks_against_a_scan_with_claims(spark):
    draw = random.Random(11)
    cells, want = [], set()
    for k in range(60):
        sheet = {}
        for r in range(40):
            if draw.random() < 0.15:
                continue
            kinds = draw.choice([["x", "d", "d", "1"], ["x", "1", "2", "3"], ["x", "d", "d", "d"], ["", "1", "", "2"], ["x", "d", "d", "1", "x", "d", "d"], ["x", "", "", "", "y", "5", "6"], ["7", "d", "", "d"], ["x"]])
            sheet[r] = {c: "2021-12-31" if x == "d" else x for c, x in enumerate(kinds) if x}
        sheet = {r + 10 * (r // 20): v for r, v in sheet.items()}
        cells += [("w", f"s{k}", r, c, x) for r, row in sheet.items() for c, x in row.items()]
        want |= {(f"s{k}", *b) for b in plain_period_blocks(sheet)}
    got = {(r.sheet, r.label_col, r["head"], r.periods, r.data_rows, r.last_row) for r in K.period_blocks(K.typed(spark.createDataFrame(cells, CELLS))).collect()}
    assert len(want) > 100 and got == want
    assert K.period_blocks(K.typed(spark.createDataFrame([], CELLS))).count() == 0


def test_claimed_spans_chain(spark):
    """A chain of two hundred, spans that overlap it, and a group of its own."""
    rows = [("a", i, i + 1) for i in range(400)] + [("b", 5, 90), ("b", 6, 7), ("b", 90, 95), ("b", 91, 92), ("b", 96, 96)]
    got = {(r.k, r.s) for r in blocks.claim_spans(spark.createDataFrame(rows, "k string, s int, e int"), ["k"], "s", "e").collect()}
    assert got == {("a", i) for i in range(0, 400, 2)} | {("b", 5), ("b", 91), ("b", 96)}


def test_relaxed_headers_against_a_scan(spark):
    """Every row of random sheets tried as the header, its columns profiled below."""
    draw = random.Random(5)
    cells, want = [], set()
    for k in range(40):
        sheet = [(r, c, draw.choice(["1.5", "2.5", "3", "text", "2021-12-31", "2022-12-31", "remarks"])) for r in range(12) for c in range(6) if draw.random() < 0.6]
        sheet.append((0, 0, "CNY'000"))
        sheet = list({(r, c): (r, c, x) for r, c, x in sheet}.values())
        cells += [("w", f"s{k}", *x) for x in sheet]
        for tier, (least, most) in enumerate(K.RELAXED, 1):
            best = []
            for row in range(12):
                cols = []
                for c in range(1, 6):
                    body = [x for r, cc, x in sheet if cc == c and r > row]
                    n = sum(x[0].isdigit() and "-" not in x for x in body)
                    if any(r == row and cc == c and x.startswith("20") for r, cc, x in sheet) and n >= 1 and n / len(body) >= least and len(body) - n <= most:
                        cols.append(c)
                if len(cols) > len(best):
                    best, at = cols, row
            if best:
                want |= {(f"s{k}", at, tier, c) for c in best}
                break
    typed = K.typed(spark.createDataFrame(cells, CELLS))
    got = {(r.sheet, r.date_row, r.tier, r.col_idx) for r in K.relaxed_header(typed, K.description_column(typed)).collect()}
    assert len({w[2] for w in want}) == 2 and got == want


def test_phase_tags_by_shared_columns(spark):
    """Two tag rows for four blocks: most shared columns win, the smaller tag on a tie, none leaves the number."""
    cells = []
    put = lambda sheet, r, texts: cells.extend((sheet, r, c, t) for c, t in enumerate(texts) if t)

    def block(sheet, top, figures, revenue="Dry revenue post VAT"):
        put(sheet, top, ["", "Total occupancy rate"])
        put(sheet, top + 1, ["", "Total leased area", *figures])
        put(sheet, top + 2, ["", revenue, *figures])

    put("s", 0, ["", "", *["wide"] * 8])
    put("s", 1, ["", "", "", "", *["cold"] * 4])
    block("s", 10, ["0", "0", "5", "6", "7", "8"])  # four of either: the smaller tag
    block("s", 20, ["1", "2", "3", "4", "5", "6", "7", "8"])  # all eight of the wide one
    block("s", 30, ["0"] * 8)  # nothing active
    block("s", 40, ["0", "0", "1"])  # one of either again
    block("t", 10, ["1"])
    block("t", 20, ["1"])
    block("t", 30, ["1"], "Gross revenue")
    got = {(r.sheet, r.n): r.label for r in K.phase_blocks(spark.createDataFrame(cells, "sheet string, row_idx int, col_idx int, cell_text string")).collect()}
    assert got == {("s", 1): "cold", ("s", 2): "wide", ("s", 3): "Phase 3", ("s", 4): "cold (2)", ("t", 1): "Dry", ("t", 2): "Dry (2)", ("t", 3): "Phase 3"}


def test_segments_end_at_blank_rows(spark):
    rows = grid(spark, {0: ["x"], 1: ["x"], 3: ["x"], 9: ["x"]})
    assert {r.row_idx: r.segment for r in K.with_segment(rows, 1).collect()} == {0: 0, 1: 0, 3: 3, 9: 9}
    assert {r.row_idx: r.segment for r in K.with_segment(rows, 3).collect()} == {0: 0, 1: 0, 3: 0, 9: 9}


def test_many_keys_that_chain(spark):
    n = 70  # more than the rounds there once were
    rows = [("w", f"k{i:03d}", f"s{j:03d}", 1000 - i * 2 + (1 if j == i else 2 if j == i - 1 else 0)) for i in range(n) for j in (i - 1, i) if j >= 0]
    got = M.assign_one_to_one(spark.createDataFrame(rows[:40], "workbook_id string, mapping_key string, sheet_name string, score int"))
    assert got.select("sheet_name").distinct().count() == got.count() > 0


def test_long_clauses_and_fallback_feedback(spark):
    clause = "x" * 300
    v = spark.createDataFrame([(1, "a", 2000, 1, 0, clause, "reasoning", False), (1, "b", 2000, 1, 0, clause, "hallucination", False), (1, "b", 2000, 1, 1, "y", "reasoning", False)],
                              "entity_id int, account string, yr int, attempt int, clause_no int, clause string, category string, supported boolean")
    bad, feedback = C.defective(v)
    got = {r.account: r.feedback for r in feedback.collect()}
    assert got == {"a": f'- "{clause}"', "b": f'- "{clause}"'}
    assert [r.account for r in bad.collect()] == ["b"]


def test_clause_offsets_of_long_texts(spark):
    text = "".join(f" part {i}, with figures." for i in range(500))
    rows = C.clauses(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")).where("id = 1").collect()
    assert len(rows) == 1000 and all(text[r.start : r.end] == r.clause for r in rows)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_first_rows_is_the_whole_sheet_by_default(spark):
    df = spark.range(5).select(F.col("id").alias("row_idx"))
    assert df.where(K.first_rows(None)).count() == 5 and df.where(K.first_rows(2)).count() == 2


def test_candidates_are_decided_by_margin(spark):
    """One key per rule: (score, matches, periods, gap, alias, exact) of its candidates in order."""
    cases = {
        "only": [(50.0, 0, 0, None, "a", False)],
        "exact": [(50.0, 0, 2, 0.5, "a", True), (90.0, 0, 2, 0.1, "b", False)],
        "periods": [(50.0, 2, 3, 0.1, "a", False), (50.0, 1, 3, 0.1, "b", False)],
        "gap": [(50.0, 1, 3, 0.10, "a", False), (50.0, 1, 3, 0.125, "b", False)],
        "gap and score": [(56.0, 1, 3, 0.10, "a", False), (50.0, 1, 3, 0.11, "b", False)],
        "equal gap, high score": [(70.0, 1, 3, 0.1, "a", False), (50.0, 1, 3, 0.1, "b", False)],
        "equal": [(60.0, 1, 3, 0.1, "a", False), (50.0, 1, 3, 0.1, "b", False)],
        "score": [(60.0, 0, 0, None, "a", False), (50.0, 0, 0, None, "b", False)],
        "near score": [(53.0, 0, 0, None, "a", False), (50.0, 0, 0, None, "b", False)],
        "copy": [(60.0, 0, 0, None, "a", False), (50.0, 0, 0, None, "a", False)],
    }
    rows = [(k, f"{k} v{i}" if k == "copy" else f"{k} {i}", *c, i) for k, cs in cases.items() for i, c in enumerate(cs, 1)]
    ranked = spark.createDataFrame(rows, "k string, sheet string, score double, matches int, periods int, avg_gap double, matched_alias string, exact boolean, rank int")
    keys = spark.createDataFrame([(k,) for k in [*cases, "none"]], "k string")
    got = {r.k: (r.decision, r.reason) for r in M.decide_candidates(ranked, keys, ["k"]).collect()}
    assert got == {"only": ("accepted", "only candidate"), "exact": ("accepted", "exact alias"), "periods": ("accepted", "more periods tie"), "gap": ("accepted", "smaller gap"),
                   "gap and score": ("accepted", "smaller gap"), "equal gap, high score": ("accepted", "smaller gap"), "equal": ("ambiguous", "too close"), "score": ("accepted", "score"),
                   "near score": ("ambiguous", "too close"), "copy": ("ambiguous", "several versions"), "none": ("rejected", "no candidate")}


def test_value_scale_reads_the_last_period(spark):
    rows = [("a", 1, "5000000"), ("a", 2, "-1500"), ("a", 2, None), ("b", 1, "1000000"), ("c", 1, "999.99"), ("d", 1, "0"), ("d", 1, None), ("e", 1, "2000"), ("f", None, "1"), ("g", 1, "1000")]
    statement = spark.createDataFrame(rows, "k string, period_end int, amount string").withColumn("amount", F.col("amount").cast("decimal(20,2)"))
    printed = spark.createDataFrame([("a", "CNY'000"), ("b", "RMB'000"), ("c", "CNY"), ("d", "CNY"), ("e", "CNY")], "k string, unit string")
    got = {r.k: (r.scale, r.mismatch) for r in K.value_scale(statement, printed, ["k"]).collect()}
    assert got == {"a": ("thousands", False), "b": ("units", True), "c": ("small", None), "d": (None, None), "e": ("thousands", True), "g": ("thousands", None)}
