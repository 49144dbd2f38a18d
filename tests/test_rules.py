"""Golden values and brute-force checks on tiny tables."""

import random
from collections import Counter
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tieout.functions import blocks, cleanup, dates, labels, numbers, prose
from tieout.operators import analysis, bridge, cells, clauses, hierarchy, matching, quality


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_bridge_factors(spark):
    row = spark.createDataFrame([(0.1383755348771996, 38911.78333333333, 214, 0.38570535057924626, 56642.766, 365)],
                                ["unit_rent_a", "area_a", "days_a", "unit_rent_b", "area_b", "days_b"])
    r = bridge.with_factors(row).first()
    assert r.price == pytest.approx(2059.545458900859)
    assert r.area == pytest.approx(1463.5320655100995)
    assert r.days == pytest.approx(3298.960105589041)


def test_bridge_days_run_through_idle_months(spark):
    rows = [(1, "P", 2024, m, 100, 10, 30) for m in (6, 10)] + [(1, "Q", 2024, m, 1, 1, 30) for m in range(1, 13)]
    m = spark.createDataFrame(rows, "entity_id long, phase string, yr int, mo int, area int, revenue int, days int").withColumn(
        "area", F.col("area").cast("decimal(20,2)")).withColumn("revenue", F.col("revenue").cast("decimal(20,2)"))
    r = {x.phase: x for x in bridge.annual_series(m).collect()}
    assert r["P"].days == 210 and r["P"].area == 100.0 and r["P"].revenue == 20.0


def test_clause_offsets_reproduce_the_text(spark):
    text = "Total was CNY1,234,567.5, up.  余额合计为5.8万元，其中；end"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = clauses.clauses(df).orderBy("start").collect()
    assert [r.clause for r in rows] == ["Total was CNY1,234,567.5,", "up.", "余额合计为5.8万元，", "其中；", "end"]
    assert all(text[r.start:r.end] == r.clause for r in rows)


def test_amounts_are_read_once(spark):
    got = one(spark, prose.amounts(F.lit("CNY5.8 million and CNY54,950 and 12.3万 and 1,234")))
    assert [float(x) for x in got] == [5800000.0, 123000.0, 54950.0, 1234.0]


def test_dates_and_labels(spark):
    assert str(one(spark, dates.period_end(F.lit("9M22")))) == "2022-09-30"
    assert str(one(spark, dates.parse_date(F.lit("45291")))) == "2023-12-31"
    assert one(spark, dates.parse_date(F.lit("45291"), False)) is None
    assert one(spark, labels.row_type(F.lit("Sub-total"))) == "subtotal"
    assert one(spark, numbers.coerce_numeric(F.lit("(1,234.5)"))) == -1234.5
    assert one(spark, labels.stage_of(F.lit("Indivative adjusted"))) == "Indicative adjusted"


def test_style_rules(spark):
    t = F.lit("The balance as at 2024-03-01 was CNY 78.2K, remained relatively stable. Fees were CNY0.0 million in FY24. The <NAME> left.")
    assert one(spark, cleanup.english_style(t)) == "the balance as at 1 March 2024 was CNY78,200. Fees were nil in FY24."
    t = F.lit("The accumulated reserve fund was CNY7.96 million, CNY-12.340 million before and CNY3.5 million in FY22.")
    assert one(spark, cleanup.english_style(t)) == "the accumulated reserve fund was CNY8.0 million, CNY-12.3 million before and CNY3.5 million in FY22."
    assert one(spark, cleanup.house_style(F.lit("余额为0元。调整-12.5万元"), F.lit("BS"))) == "无余额。调整负12.5万元"
    assert one(spark, cleanup.house_style(F.lit("分别为0元、1.8万元"), F.lit("IS"))) == "分别为0元、1.8万元"
    assert one(spark, cleanup.clean_output(F.lit('<think>x</think>Verified output: "ok"'))) == "ok"
    assert one(spark, cleanup.repair_json(F.lit('note {“a”: [1,],} end'))) == '{"a": [1]}'


@pytest.fixture(scope="module")
def ordered(spark):
    rnd = random.Random(7)
    rows = [(g, i * 3, rnd.choice([None, rnd.randint(1, 50)])) for g in ("hot", "cold") for i in range(60 if g == "hot" else 5)]
    return rows, spark.createDataFrame(rows, "g string, i long, v long")


@pytest.mark.parametrize("width", [4, 7, 1000])
def test_ranged_windows_equal_plain_ones(ordered, width):
    rows, df = ordered
    fill = {(r.g, r.i): r.f for r in blocks.fill_forward(df, ["g"], "i", "v", "f", width).collect()}
    run = {(r.g, r.i): r.s for r in blocks.running_sum(df, ["g"], "i", F.coalesce("v", F.lit(0)), "s", width).collect()}
    top = {(r.g, r.i): r.m for r in blocks.running_max(df, ["g"], "i", {"m": F.col("v")}, width).collect()}
    idx = blocks.dense_index(df, ["g"], "i", "p", width)
    nxt = {(r.g, r.i): r.n for r in blocks.with_following(idx, ["g"], "p", 2, lambda w: {"n": F.lead("v", 2).over(w)}, width).collect()}
    for g in ("hot", "cold"):
        mine = [r for r in rows if r[0] == g]
        last, total, peak = None, 0, None
        for k, (_, i, v) in enumerate(mine):
            assert top[(g, i)] == peak
            last, total = (v if v is not None else last), total + (v or 0)
            peak = v if peak is None else (peak if v is None else max(peak, v))
            assert fill[(g, i)] == last and run[(g, i)] == total
            assert nxt[(g, i)] == (mine[k + 2][2] if k + 2 < len(mine) else None)


def test_intervals_are_claimed_left_to_right(spark):
    rnd = random.Random(3)
    iv = sorted({s: (s, s + rnd.randint(2, 6)) for s in rnd.sample(range(200), 60)}.values())
    kept, end = [], -1
    for s, e in iv:
        if s > end:
            kept.append((s, e))
            end = e
    df = spark.createDataFrame([("a", s, e) for s, e in iv], "g string, s long, e long")
    assert sorted((r.s, r.e) for r in blocks.claim_intervals(df, ["g"], "s", "e", 6).collect()) == kept


def test_indent_parents(spark):
    rows = [(0, 0), (1, 1), (2, 2), (3, 1), (4, 0), (5, 2), (6, 1)]
    df = spark.createDataFrame([("k", i, n) for i, n in rows], "k string, row_idx long, indent int")
    got = {r.row_idx: r.parent_row for r in hierarchy.indent_parents(df, ["k"]).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 0, 4: None, 5: 4, 6: 4}


def test_band_join_misses_nothing(spark):
    rnd = random.Random(11)
    src = [0, 499, 500, 9999, 10000, 10001, 10500] + [round(rnd.uniform(1, 5e5), 2) for _ in range(150)]
    tgt = [0.3, 0.6, 1, 700] + [round(s * rnd.uniform(0.94, 1.06), 2) for s in src] + [s + d for s in src[:40] for d in (-500, 500, 501)]
    tgt = sorted({abs(round(x, 2)) for x in tgt})
    p = spark.createDataFrame([(1, "p", float(s)) for s in src], "entity_id long, pool string, v double").withColumn("value", F.col("v").cast("decimal(28,4)")).drop("v")
    t = spark.createDataFrame([(1, "p", float(x)) for x in tgt], "entity_id long, pool string, v double").withColumn("target", F.col("v").cast("decimal(28,4)")).drop("v")
    got = {float(r.target) for r in clauses.matched_targets(t, p).collect()}
    tie = lambda x: any((round(x) == 0) if a == 0 else abs(x - a) <= max(500, a * 0.05) + 1e-9 for a in src)
    assert got == {x for x in tgt if tie(x)}


def test_assignment_is_serial_by_score(spark):
    rnd = random.Random(5)
    rows = {(w, k, s): float(rnd.randint(50, 90)) for w in "ab" for k in "pqrs" for s in rnd.sample("1234567", 3)}
    want = {}
    for w in "ab":
        best = {k: max(v for (x, y, _), v in rows.items() if (x, y) == (w, k)) for k in "pqrs"}
        used = set()
        for k in sorted(best, key=lambda k: (-best[k], k)):
            free = [(v, s) for (x, y, s), v in rows.items() if (x, y) == (w, k) and s not in used]
            if free:
                want[(w, k)] = max(free)[1]
                used.add(want[(w, k)])
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "workbook_id string, mapping_key string, sheet_name string, score double")
    assert {(r.workbook_id, r.mapping_key): r.sheet_name for r in matching.assign_one_to_one(df).collect()} == want


def test_fuzzy_scores(spark):
    lab = spark.createDataFrame([("w", "Trade receivables"), ("w", "Other payables"), ("w", "货币资金明细")], "workbook_id string, sheet_name string")
    ali = spark.createDataFrame([("AR", "Trade receivable"), ("OP", "Other payable"), ("Cash", "货币资金")], "mapping_key string, alias string")
    got = {r.mapping_key: r.score for r in matching.fuzzy_candidates(lab, ali).collect()}
    assert got["AR"] == 100.0 and got["OP"] == 100.0
    ratio = SequenceMatcher(None, "货币资金明细", "货币资金").ratio()
    assert got["Cash"] == pytest.approx(round(40 + ratio * 40, 2))


def test_composition_findings(spark):
    rows = [(1, "a", 2020, "余额合计100.0万元，主要包括：1）x60.0万元；2）y40.0万元。"), (2, "a", 2020, "余额合计100.0万元，主要包括：1）x600.0万元；2）y400.0万元。"),
            (3, "a", 2020, "余额合计100.0万元，主要包括：1）x60.0万元；2）y25.0万元。其余15.0万元为z。"), (4, "a", 2020, "余额合计100.0万元，主要包括：1）x60.0万元；2）y20.0万元。")]
    df = spark.createDataFrame(rows, "entity_id long, account string, yr int, text string")
    got = {r.entity_id: r.finding for r in clauses.composition_check(df).collect()}
    assert got == {1: "adds up", 2: "unit error 10x", 3: "adds up", 4: "shortfall"}


def test_period_columns_come_from_the_data(spark):
    schema = "entity_id long, account string, description string, yr int, amount decimal(20,2)"
    rows = spark.sql("SELECT 1L AS entity_id, 'a' AS account, 'x' AS description, yr, CAST(yr AS decimal(20,2)) AS amount FROM VALUES (1987), (2031) v(yr)")
    wide = analysis.period_matrix(rows)
    ids = ["entity_id", "account", "description"]
    assert wide.columns == [*ids, "fy1987", "fy2031"]
    assert {(r.period, int(r.amount)) for r in analysis.unpivot_periods(wide, ids).collect()} == {("fy1987", 1987), ("fy2031", 2031)}
    none = analysis.period_matrix(spark.createDataFrame([], schema))
    assert none.columns == ids and analysis.unpivot_periods(none, ids).count() == 0


def test_a_review_keeps_sums_that_held(spark):
    table = lambda v: spark.sql(f"SELECT CAST(c1 AS bigint) AS k, {', '.join(f'CAST(c{i} AS decimal(18,2)) AS {n}' for i, n in ((2, 'rent'), (3, 'mgmt_fee'), (4, 'other'), (5, 'total')))} FROM VALUES {v} v(c1, c2, c3, c4, c5)")
    base = table("(1, 10, 2, NULL, 12), (2, 10, 2, NULL, 15), (3, 10, 2, NULL, 12), (4, 1, 1, 1, 3)")
    review = table("(1, 11, NULL, NULL, NULL), (2, NULL, NULL, 3, NULL), (3, 11, NULL, NULL, 13), (5, 7, 1, NULL, 8)")
    got = {r.k: (*[None if x is None else int(x) for x in (r.rent, r.mgmt_fee, r.other, r.total)], r.rejected) for r in quality.merge_payments(base, review, ["k"]).collect()}
    assert got == {1: (10, 2, None, 12, True), 2: (10, 2, 3, 15, False), 3: (11, 2, None, 13, False), 4: (1, 1, 1, 3, False), 5: (7, 1, None, 8, False)}


def test_rollup_against_every_pair(spark):
    rng = random.Random(5)
    names = ["", "a", "ab", "north star", "northern star holdings", *("".join(rng.choices("abc ", k=rng.randint(1, 24))) for _ in range(60))]
    entities, tabs = [(rng.randrange(3), n) for n in names], [(p, n) for p in range(3) for n in rng.sample(names, 6)]
    form = lambda n: " ".join(n.split())
    want = {}
    for p, e in entities:
        for q, s in tabs:
            en, sn = form(e), form(s)
            score = (0.9 if sn in en or en in sn else SequenceMatcher(None, en, sn).ratio()) + 0.05
            if p == q and score >= 0.45:
                want[p, e] = max(want.get((p, e), (0.0, "")), (score, s))
    got = matching.rollup_match(spark.createDataFrame(entities, "portfolio int, entity string"), spark.createDataFrame(tabs, "portfolio int, sheet_name string"))
    assert {(r.portfolio, r.entity): (r.score, r.sheet_name) for r in got.collect()} == {k: (round(v, 4), s) for k, (v, s) in want.items()}


def test_digest_takes_first_sentences_of_all_accounts_first(spark):
    rows = [(1, "a", "One. Two is far too long to be taken here. Six."), (1, "b", "Three. Four."), (1, "c", None), (2, "a", "A first sentence always stands. Next.")]
    got = {r.page: (r.sentences, r.digest) for r in quality.digest_blocks(spark.createDataFrame(rows, "page int, account string, text string"), ["page"], "account", 22).collect()}
    assert got == {1: (4, "One. Three. Four. Six."), 2: (1, "A first sentence always stands.")}


def test_a_date_predicate_can_be_passed_in(spark):
    t = spark.createDataFrame([("w", "s", 0, 0, "31/12/2023"), ("w", "s", 0, 1, "FY23A"), ("w", "s", 0, 2, "Cash")], "workbook_id string, sheet string, row_idx int, col_idx int, cell_text string")
    dated = lambda df: {r.col_idx for r in df.where("dated").collect()}
    assert 1 not in dated(cells.typed(t)) and dated(cells.typed(t, lambda x: F.rlike(x, F.lit("^FY[0-9]{2}")))) == {1}


def test_ledger_rows_with_five_core_fields_are_kept(spark):
    from tieout.plans.quality import LEDGER_CORE, LEDGER_FIELDS

    said = {f: "1" for f in LEDGER_FIELDS}
    four, five = said | {"rent_total": "未提及"}, said | {"industry": " "}
    rows = [dict(name=n, **r) for n, r in (("four", four), ("five", five), ("five bare", five | {"project": None}), ("all", said))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "name string, " + ", ".join(f"{f} string" for f in LEDGER_FIELDS))
    assert {r.name for r in quality.reference_rows(df, LEDGER_CORE).collect()} == {"five", "five bare", "all"}
    letters = "a string, b string, c string, d string, e string, f string"
    wide = spark.createDataFrame([("4", "x", "x", "x", "x", "无"), ("5", "x", "x", "x", "x", "x")], letters)
    six = wide.withColumn("g", F.lit("x")).withColumn("c", F.lit(None).cast("string"))
    assert [r.a for r in quality.reference_rows(wide, list("bcdef")).collect()] == ["5"]
    assert [r.a for r in quality.reference_rows(six, list("abcdefg")).collect()] == ["4", "5"]


def test_band_buckets_of_targets_hold_every_source(spark):
    """One or two buckets a target (up to eight before), and the bucket of every source that ties is among them."""
    sources = [0, 1, 499, 500, 501, 9999, 10000, 10001, 123456, 987654321, 10**15] + [round(37 * 1.31**k, 4) for k in range(60)]
    rows = [(Decimal(str(a)).quantize(Decimal("0.0001")), (Decimal(str(a)) * Decimal(m) + Decimal(d)).quantize(Decimal("0.0001")).copy_abs())
            for a in sources for m in ("1", "0.95", "1.05", "0.9501") for d in ("0", "500", "-500", "0.5")]
    t, a = F.col("t"), F.col("a")
    df = spark.createDataFrame(rows, "a decimal(28,4), t decimal(28,4)").withColumn("b", clauses.target_buckets(t.cast("double")))
    assert df.where(F.size("b") > 2).count() == 0
    tied = df.where(clauses.in_band(t, a))
    assert tied.count() > 300 and tied.where(~F.array_contains("b", clauses.pool_bucket(a.cast("double")))).count() == 0


def test_verdicts_deal_clauses_once(spark):
    """Reviews and figures meet clauses by attempt: one exchange a table, none for what follows by attempt."""
    key = "entity_id bigint, account string, yr int, attempt int, clause_no int"
    rows = spark.createDataFrame([(1, "A", 2000, 1, 0, 0, 9, "up by CNY5"), (1, "A", 2000, 1, 1, 9, 30, "driven by new contracts"), (1, "A", 2000, 1, 2, 30, 40, "all well")], f"{key}, start int, end int, clause string")
    grounded = spark.createDataFrame([(1, "A", 2000, 1, 0, False), (1, "A", 2000, 1, 0, True)], f"{key}, grounded boolean")
    reviews = spark.createDataFrame([(1, "A", 2000, 1, 1, "driven by", False, "Reasoning"), (1, "A", 2000, 1, 2, "driven by new", True, "data-backed"), (1, "A", 2000, 1, 3, "driven by new", False, "hallucination")],
                                    "entity_id bigint, account string, yr int, attempt int, review_no int, clause string, supported boolean, category string")
    verdicts = clauses.combine_verdicts(rows, grounded, reviews)
    assert [(r.clause_no, r.category, r.supported) for r in verdicts.orderBy("clause_no").collect()] == [(0, "hallucination", False), (1, "data-backed", True), (2, "data-backed", True)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clauses.arbiter(clauses.combine_verdicts(rows, grounded, reviews))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 4  # clauses, reviews, figures, then texts by account and year


def test_schedules_share_one_ledger_of_years(spark, tmp_path):
    """Both tables of schedules read the ledger's yearly sums, landed once, and sum to the ledger."""
    from tieout.sources import sinks
    from tieout.sources.views import table

    sf, memo = "/root/testdata/sf0.001", {}
    ledger = table(spark, sf, "ledger_line", memo).groupBy("entity_id", "account", "fy").agg(F.sum("amount").cast("decimal(20,2)").alias("v")).collect()
    lines = table(spark, sf, "schedule_line", memo).collect()
    assert Counter((r.entity_id, r.account, r.fy, r.v) for r in ledger) == Counter((r.entity_id, r.account, r.yr, r.amount) for r in lines)
    table(spark, sf, "detail_line", memo)
    assert (spark.sparkContext.applicationId, sf, "ledger_year") in sinks._LANDED
