"""Steps that are worked out once or move no rows, and results that stay as they are."""

import uuid

from pyspark.sql import functions as F

import __spark_entry__ as reg
from tieout.functions import blocks, cleanup, prose
from tieout.operators import cells as K
from tieout.operators import clauses as C
from tieout.operators import hierarchy as H
from tieout.operators import quality as Q
from tieout.sources.sinks import landed
from tieout.sources.views import table

SF = "/root/testdata/sf0.001"


def plan(df, physical=False):
    run = df._jdf.queryExecution()
    return (run.executedPlan() if physical else run.optimizedPlan()).toString()


def test_sums_over_a_landed_key_move_no_rows(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("a"), F.col("id").alias("v"))
    df = landed(spark, uuid.uuid4().hex, "by key", lambda: rows, "k", 4)
    sums = df.groupBy("k", "a").agg(F.sum("v").alias("s"))
    assert "Exchange" not in plan(sums, True)
    assert sums.agg(F.sum("s")).first()[0] == 4950 and sums.count() == 21


def test_a_name_is_looked_for_by_its_rarest_word(spark):
    names = Q.name_map(spark.createDataFrame([("Acme Ltd",), ("Beta Ltd",), ("Beta Ltd (North)",), (None,)], "name string"))
    assert {r.name: r.word for r in Q.name_anchors(names).collect()} == {"Acme Ltd": "Acme", "Beta Ltd": "Beta", "Beta Ltd (North)": "North"}
    texts = spark.createDataFrame([(1, "Beta Ltd (North) paid Acme Ltd, Beta Ltd and Ltd"), (2, "Acme Ltds"), (2, "Acme  Ltd")], "id int, text string")
    got = Q.anonymise(texts, ["id"], names, "1.000")
    fake = {r.name: r.pseudonym for r in names.collect()}
    assert {r.text: r.names for r in got.collect()} == {
        f"{fake['Beta Ltd (North)']} paid {fake['Acme Ltd']}, {fake['Beta Ltd']} and Ltd": 3, "Acme Ltds": 0, "Acme  Ltd": 0}


def test_english_style_works_a_text_out_once(spark):
    df = spark.createDataFrame([("A, REFLECTING x", ), ("Fees, ANNUALISED at CNY1K; rose. You Should consider it. (CNY2 Annualised) CNY7.96 million, consistent with Historical Trends; end.",), (None,)], "t string")
    x = df.select(cleanup.english_style(F.col("t")).alias("t"))
    assert [r.t for r in x.collect()] == ["A, REFLECTING x", "Fees; rose. CNY8.0 million; end.", None]
    assert plan(x).count(r",\s*remained relatively stable") == 1


def test_composition_check_reads_a_pattern_once(spark):
    rows = [(1, "a", 2000, "余额合计100.0万元，主要包括：1）商品60.0万元；2）服务30.0 万元。其余负10.0万元为其他。"), (2, "a", 2000, "余额合计1,000元，包括甲400元、乙600元。"), (3, "a", 2000, None)]
    x = C.composition_check(spark.createDataFrame(rows, "entity_id int, account string, yr int, text string"))
    got = {r.entity_id: r for r in x.collect()}
    assert set(got) == {1, 2} and (got[1].items, got[1].listed, got[1].finding) == (3, 800000, "shortfall") and (got[2].items, got[2].finding) == (2, "adds up")
    assert plan(x).count("其余[") == 1


def test_rate_context_reads_a_pattern_once(spark):
    assert plan(reg.queries()["rate_context"](spark, SF)).count("CNY|RMB|USD") == 1


def test_parts_travel_with_their_parent(spark):
    rows = [("k", i * 10, d, a) for i, (d, a) in enumerate([("All", 30), ("x", 10), ("y", 20), ("z", 5)])]
    x = H.implicit_breakdowns(spark.createDataFrame(rows, "k string, row_idx int, description string, amount int").withColumn("amount", F.col("amount").cast("decimal(20,2)")), ["k"])
    assert sorted((r.parent_row, r.row_idx) for r in x.collect()) == [(0, 10), (0, 20)]
    assert "description" not in plan(x)


def test_statement_rows_are_read_once(spark):
    cells = [(0, 0, "balance sheet"), (1, 0, "CNY'000"), (1, 1, "2020-12-31"), (2, 0, "Cash"), (2, 1, "1.5"), (3, 0, "Nil"), (3, 1, "0.0")]
    typed = K.typed(spark.createDataFrame([("w", "s", *c) for c in cells], "workbook_id string, sheet string, row_idx int, col_idx int, cell_text string"))
    x = K.extract_statement(typed, K.section_bounds(typed), K.description_column(typed))
    assert [(r.description, r.amount) for r in x.collect()] == [("Cash", 1500)]
    assert "LeftSemi" not in plan(x)


def test_journals_and_phases_start_from_landed_lines(spark):
    assert "Window" not in plan(table(spark, SF, "journal_cells"))
    assert "Aggregate" not in plan(table(spark, SF, "phase_cells"))


def test_no_step_of_dated_blocks_grows_into_a_large_plan(spark, monkeypatch):
    """Each pass over ordered rows holds its input twice, so the steps are landed in between (124 tables in one plan before)."""
    sizes = []

    def landing(df, name):
        sizes.append(plan(df).count("Relation [") + plan(df).count("LogicalRDD"))
        return cut(df, name)

    cut = K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", landing)
    cells = [(r, c, x) for r, row in enumerate([["Label", "2021-12-31", "2022-12-31"], ["a", "1", "2"], ["b", "", "4"], ["Label", "2021-12-31", "2022-12-31"], ["c", "5", "6"]]) for c, x in enumerate(row) if x]
    typed = K.typed(spark.createDataFrame([("w", "s", *c) for c in cells], "workbook_id string, sheet string, row_idx int, col_idx int, cell_text string"))
    x = K.period_blocks(typed)
    assert [(r["head"], r.data_rows, r.last_row) for r in x.collect()] == [(0, 2, 2)]
    assert len(sizes) > 2 and max(sizes) < 10


def test_running_sums_and_maxima_go_in_one_pass(spark):
    rows = spark.createDataFrame([("k", i, None if i % 3 else i) for i in range(0, 40, 2)] + [("m", 5, 1)], "k string, i int, v int")
    x = blocks.running(rows, ["k"], "i", {"s": F.coalesce("v", F.lit(0))}, {"above": F.col("i"), "top": F.col("v")}, width=7)
    got = {(r.k, r.i): (r.s, r.above, r.top) for r in x.collect()}
    assert len(got) == 21 and got["m", 5] == (1, None, None) and got["k", 0] == (0, None, None)
    for i in range(2, 40, 2):
        below = [v for v in range(0, i, 2) if v % 3 == 0]
        assert got["k", i] == (sum(below) + (0 if i % 3 else i), i - 2, max(below))


def test_ledger_years_lie_in_one_file_a_bucket(spark, monkeypatch):
    """However many tasks sum the ledger (each wrote a file for every bucket of its suppliers before)."""
    from tieout.sources import views

    monkeypatch.setattr(views, "BUCKET_BYTES", 4000)
    sf = f"{SF}/../{uuid.uuid4().hex}/../sf0.001"  # a scope of its own
    monkeypatch.setattr(views, "read_base", lambda spark, sf_dir, name: spark.read.parquet(f"{SF}/{name}.parquet"))
    n = views.ledger_buckets(spark, sf)
    years = views.ledger_years(spark, sf, {})
    assert n > 20 and len(years.inputFiles()) <= n
    assert years.groupBy().agg(F.sum("amount")).first()[0] == table(spark, SF, "ledger_line").groupBy().agg(F.sum("amount")).first()[0]


def test_typed_cells_lie_in_no_more_files_than_buckets(spark):
    from tieout.plans import cells
    from tieout.plans.registry import Tables

    t = Tables(spark, SF)
    assert len(cells.cells_of(t).inputFiles()) <= t.buckets()


def test_verdicts_stay_in_the_buckets_of_their_entity(spark):
    """Clauses, figures, sources and reviews lie by entity; what is landed from them moves no rows."""
    from tieout.plans import commentary
    from tieout.plans.registry import Tables
    from tieout.sources import sinks

    t = Tables(spark, SF)
    steps = [t.commentary_gen, commentary.clauses_of(t), commentary.amounts_of(t), commentary.pool_of(t), commentary.grounded_of(t), commentary.verdicts_of(t)]
    assert all("Exchange" not in plan(x.groupBy("entity_id").count(), True) for x in steps)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with sinks._joins_in_buckets(spark):
            verdicts = C.combine_verdicts(steps[1], steps[4], t.model_review)
            assert "Exchange" not in plan(verdicts, True).replace("BroadcastExchange", "")
        assert "Exchange" in plan(C.combine_verdicts(steps[1], steps[4], t.model_review), True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None) in (None, "true")


def test_numbers_of_notes_are_read_once_and_as_before(spark):
    notes = ["Rent USD1,200.50 and 3.5 million, 1.2亿; 4万 of 12,345", "CNY5万", "mn", "in 1995", "5 mn HKD7", "1,234,567.8", "US$9", "人民币8", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(notes)], "i int, note string")
    x = prose.with_numbers(rows, "note", "v")
    assert x.columns == ["i", "note", "v"]
    bare = F.transform(F.regexp_extract_all(F.coalesce("note", F.lit("")), F.lit(f"({prose.BARE_NUMBER})"), F.lit(1)), lambda s: F.regexp_replace(s, ",", "").cast(prose.AMOUNT_TYPE))
    want = {r.i: r.v for r in rows.select("i", F.array_distinct(F.concat(prose.amounts(F.col("note")), bare)).alias("v")).collect()}
    assert {r.i: r.v for r in x.collect()} == want and len(want[0]) > 5 and want[9] == []
    lines = spark.createDataFrame([(1, "A", 7, 1, 10)], "entity_id bigint, account string, period_end int, row_idx int, amount int").withColumn("amount", F.col("amount").cast("decimal(20,2)"))
    remarks = spark.createDataFrame([(1, "A", "CNY60 in 1995"), (1, "A", "none"), (1, "B", "7"), (None, "B", "8")], "entity_id bigint, account string, note string")
    chart = spark.createDataFrame([("A", "IS")], "tab_name string, statement_type string")
    months = spark.createDataFrame([(1, "A", 4)], "entity_id bigint, account string, months int")
    pool = C.source_pool(lines, remarks, chart, months)
    assert sorted((r.pool, float(r.value)) for r in pool.collect()) == [("B", 7), ("B", 8), ("IS", 10), ("IS", 60), ("IS", 180), ("IS", 1995), ("IS", 5985)]
    assert plan(pool).count("million|mn") == 2  # found, then blanked


def test_a_clause_key_drops_every_blank(spark):
    df = spark.createDataFrame([(" The\tRent\n\x0b\f\r rose , by 5%. ",), ("余额 合计。",), (None,)], "t string")
    assert [r[0] for r in df.select(C.clause_key(F.col("t"))).collect()] == ["therentrose,by5%", "余额合计", None]
    assert "regexp" not in plan(df.select(C.clause_key(F.col("t"))))


def test_scale_errors_stay_in_the_buckets_of_their_entity(spark):
    from tieout.plans import commentary
    from tieout.plans.registry import Tables

    t = Tables(spark, SF)
    found = reg.queries()["scale_errors"](spark, SF)
    assert "Exchange" not in plan(found.groupBy("entity_id").count(), True)
    plain = C.scale_errors(commentary.grounded_of(t), commentary.pool_of(t))
    assert found.count() > 100 and found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0
