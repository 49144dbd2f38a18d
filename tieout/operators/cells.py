"""Sheets as long cell tables: profiles, headers, columns, sections, tables.

``typed`` parses landed cells (workbook_id, sheet, row_idx, col_idx, cell_text); all
other functions take its result as ``cells``.
Every step is an aggregation or an equi join on (workbook_id, sheet, row or
column). No step gathers a sheet in one place. Where a decision may be limited to the
first rows, the limit is a parameter; None, the default, is the whole sheet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions import blocks
from tieout.functions.cleanup import is_likely_entity
from tieout.functions.dates import parse_date
from tieout.functions.labels import contains_any, has_thousand_marker, has_unit_marker, row_type, stage_of
from tieout.functions.numbers import coerce_numeric
from tieout.sources.sinks import cut_lineage

SHEET = ["workbook_id", "sheet"]
ROW, COL = [*SHEET, "row_idx"], [*SHEET, "col_idx"]
PREFERRED_STAGE = "Indicative adjusted"
# Fixed values.
UNIT_ROWS = 8
REMARK_WORDS = ("remark", "remarks", "note", "notes", "comment", "comments", "备注", "附注", "注释", "說明", "说明")
TICKS = ("✓", "√", "✔", "☑", "■", "□", "●", "○", "★", "☆")
NAV_NAMES = ("overview", "adj", "contract", "tb", "cover", "mapping", "je", "pt", "pivottable", "tb combine", "mgt account",
             "fill-in choice", "封面", "下拉选项source", "透视表")
SECTION_STARTS = (("BS", ("示意性调整后资产负债表", "示意性調整後資產負債表", "indicative adjusted balance sheet", "balance sheet")),
                  ("IS", ("示意性调整后利润表", "indicative adjusted income statement")))
SECTION_ENDS = ("负债及所有者权益总计", "total liabilities and owner", "净利润", "net profit")
POST_SECTION = ("经营指标", "主要经营指标", "运营指标", "关键指标", "财务比率", "比率分析", "operating metric", "operating indicator",
                "key metric", "key indicator", "kpi", "ratio analysis", "financial ratio", "key performance")
RATIO_ROWS = ("出租率", "单位租金", "单位物管费", "毛利率", "净利率", "营业利润率", "增长率", "ebitda%", "占收入比", "每平方米", "元/平方米")
CARRYING = ("carrying amounts", "net book value", "carrying amount", "账面价值", "賬面價值")
MONEY = "decimal(20,2)"


def first_rows(most: int | None) -> Column:
    """The first ``most`` rows of a sheet; all of them for None."""
    return F.lit(True) if most is None else F.col("row_idx") < most


def looks_dated(text: Column) -> Column:
    return parse_date(text).isNotNull()


def typed(cells: DataFrame, date_detector: Callable[[Column], Column] = looks_dated) -> DataFrame:
    """Non-blank cells with their number, strict date, stage, unit flag and loose date flag.

    Everything below works on this table, so a cell's text is parsed once. ``date_detector``
    says which texts count as dates when columns are judged.
    """
    t = F.col("cell_text")
    return cells.where(F.trim(F.coalesce(t, F.lit(""))) != "").select(
        *cells.columns, coerce_numeric(t, MONEY).alias("number"), parse_date(t, False).alias("date"),
        stage_of(t).alias("stage"), has_thousand_marker(t).alias("unit"), date_detector(t).alias("dated"))


def used_range(cells: DataFrame) -> DataFrame:
    return cells.where(F.trim("cell_text") != "").groupBy(*SHEET).agg(
        F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.min("col_idx").alias("first_col"), F.max("col_idx").alias("last_col"))


def cell_display(text: Column) -> Column:
    """Whole numbers without a point; trailing zeros off."""
    number = F.rlike(text, F.lit(r"^-?[0-9]+\.[0-9]+$"))
    return F.when(number, F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(F.trim(text))


def text_lines(cells: DataFrame) -> DataFrame:
    """Each used row as ``| row | a | b |``, blanks kept between the used columns."""
    rows = cells.where(F.trim("cell_text") != "").groupBy(*ROW).agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", cell_display(F.col("cell_text"))))).alias("m"))
    x = rows.join(used_range(cells), SHEET)
    cols = F.transform(F.sequence("first_col", "last_col"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return x.select(*ROW, F.concat(F.lit("| "), (F.col("row_idx") + 1).cast("string"), F.lit(" | "), F.array_join(cols, " | "), F.lit(" |")).alias("line"))


def column_letters(number: Column) -> Column:
    """Letters of a column from its number (from 1): A to Z, then AA and so on, three letters at most."""
    letter = lambda n: F.chr(n % 26 + 65)
    n = number - 1
    second, third = F.floor((n - 26) / 26), F.floor((n - 702) / 676)
    return F.concat(F.when(n >= 702, letter(third)).otherwise(""), F.when(n >= 26, letter(second)).otherwise(""), letter(n))


def sheet_export(cells: DataFrame) -> DataFrame:
    """(SHEET, row_idx, line): ``text_lines`` below a title, the used range and the column names (rows -3 to -1) of each sheet."""
    r = used_range(cells)
    corner = lambda c, row: F.concat(column_letters(F.col(c) + 1), (F.col(row) + 1).cast("string"))
    names = F.transform(F.sequence(F.lit(1), F.col("last_col") - F.col("first_col") + 1), lambda i: F.concat(F.lit("Col"), column_letters(i)))
    heads = F.array(F.concat(F.lit("===== SHEET: "), F.col("sheet"), F.lit(" =====")),
                    F.concat(F.lit("USED_RANGE: "), corner("first_col", "first_row"), F.lit(":"), corner("last_col", "last_row")),
                    F.concat(F.lit("| ExcelRow | "), F.array_join(names, " | "), F.lit(" |")))
    top = r.select(*SHEET, F.posexplode(heads).alias("i", "line")).select(*SHEET, (F.col("i") - 3).alias("row_idx"), "line")
    return top.unionByName(text_lines(cells))


def preview(cells: DataFrame, rows: int = 12) -> DataFrame:
    """Per sheet: non-blank cells among the first rows, hidden flag, and whether it is offered to the user."""
    full = F.trim(F.coalesce("cell_text", F.lit(""))) != ""
    return cells.where(F.col("row_idx") < rows).groupBy(*SHEET).agg(
        F.count_if(full).alias("filled"), F.coalesce(F.bool_or("hidden"), F.lit(False)).alias("hidden")).withColumn(
        "offered", (F.col("filled") > 0) & ~F.col("hidden"))


def row_hits(cells: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Stage and date hits of the rows that may be headers; rows without either are left out."""
    h = cells.where(first_rows(scan_rows) & (F.col("stage").isNotNull() | F.col("date").isNotNull()))
    return h.groupBy(*ROW).agg(F.count("stage").alias("stage_hits"), F.count("date").alias("date_hits"))


def stage_rows(cells: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Rows that name stages: two or more hits, or one with a date row from one above to two below."""
    h = row_hits(cells)
    near = h.where("date_hits >= 1").select(*SHEET, F.explode(F.sequence(F.col("row_idx") - 2, F.col("row_idx") + 1)).alias("row_idx")).distinct()
    s = h.where(first_rows(scan_rows))
    return s.where("stage_hits >= 2").select(*ROW).unionByName(s.where("stage_hits = 1").join(near, ROW, "left_semi").select(*ROW))


def header_rows(cells: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Primary stage row (most hits, earliest) and the date row within two rows of it."""
    h = row_hits(cells)
    stage = h.where(first_rows(scan_rows) & (F.col("stage_hits") > 0)).groupBy(*SHEET).agg(
        F.max_by("row_idx", F.struct("stage_hits", -F.col("row_idx"))).alias("stage_row"))
    near = stage.select(*SHEET, "stage_row", F.explode(F.sequence(F.col("stage_row") - 2, F.col("stage_row") + 2)).alias("row_idx"))
    dates = near.join(h.where("date_hits > 0"), ROW).groupBy(*SHEET).agg(
        F.max_by("row_idx", F.struct("date_hits", -F.col("row_idx"))).alias("date_row"))
    return stage.join(dates, SHEET, "left")


def description_column(cells: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Column holding a unit marker; else the best text score in the first rows; else the first column."""
    t = F.col("cell_text")
    low = F.lower(t)
    remark = contains_any(low, REMARK_WORDS)
    dated = F.col("dated")
    text = ~remark & ~dated & F.col("number").isNull() & (F.length(F.trim(t)) > 1)
    head = first_rows(scan_rows)
    marker = F.rlike(t, F.lit("(?i)CNY'000|人民币千元"))
    c = cells.where(F.trim(t) != "").groupBy(*COL).agg(
        F.bool_or(marker).alias("marker"), F.count_if(head & text).alias("texts"),
        (F.count_if(head & text) * 2 - F.count_if(head & contains_any(t, TICKS)) * 2 - F.count_if(head & remark)
         - F.count_if(head & ~remark & dated)).alias("score"))
    return c.groupBy(*SHEET).agg(
        F.min(F.when(F.col("marker"), F.col("col_idx"))).alias("m"),
        F.max_by("col_idx", F.when(F.col("texts") > 0, F.struct("score", -F.col("col_idx")))).alias("s")).select(
        *SHEET, F.coalesce("m", "s", F.lit(0)).alias("desc_col"))


def filled_stages(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Stage of every dated column: carried right from the stage row, stopped by any other text there.

    The window runs along one header row, whose width the file format bounds.
    """
    t = cells.join(headers, SHEET)
    head = t.where(F.col("row_idx").isin(F.col("stage_row"), F.col("date_row"))).groupBy(*COL).agg(
        F.max(F.when(F.col("row_idx") == F.col("stage_row"), F.coalesce("stage", F.lit("")))).alias("mark"),
        F.max(F.when(F.col("row_idx") == F.col("date_row"), F.col("date"))).alias("date"))
    carried = F.last("mark", True).over(Window.partitionBy(*SHEET).orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0))
    return head.select(*COL, "date", F.nullif(carried, F.lit("")).alias("stage"))


def dedupe_columns(columns: DataFrame) -> DataFrame:
    """First column of every (stage, date)."""
    return columns.where("date IS NOT NULL").groupBy(*SHEET, "stage", "date").agg(F.min("col_idx").alias("col_idx"))


def column_profiles(cells: DataFrame, start: DataFrame) -> DataFrame:
    """Numeric and text cells per column from ``data_start`` (per sheet) on."""
    return cells.join(start, SHEET).where(F.col("row_idx") >= F.col("data_start")).groupBy(*COL).agg(
        F.count("number").alias("numbers"), F.count_if(F.col("number").isNull()).alias("texts"))


def value_columns(cells: DataFrame, headers: DataFrame, desc: DataFrame) -> DataFrame:
    """Dated columns right of the description whose body is numeric enough, or whose marker says so."""
    start = headers.select(*SHEET, (F.greatest("date_row", "stage_row") + 1).alias("data_start"))
    marks = cells.join(headers, SHEET).where("row_idx = stage_row").select(
        *COL, (F.col("stage") == PREFERRED_STAGE).alias("marked"), contains_any(F.lower("cell_text"), REMARK_WORDS).alias("remark"))
    head = cells.join(headers, SHEET).where("row_idx = date_row AND date IS NOT NULL").select(*COL, "date")
    x = head.join(desc, SHEET).where("col_idx > desc_col").join(marks, COL, "left").join(column_profiles(cells, start), COL, "left").fillna(0, ["numbers", "texts"])
    numeric = (F.col("numbers") >= 1) & (F.col("numbers") >= F.col("texts")) & (F.col("texts") <= 2)
    empty = (F.col("numbers") + F.col("texts")) == 0
    ok = ~F.coalesce("remark", F.lit(False)) & (F.coalesce("marked", F.lit(False)) | numeric | empty)
    return x.where(ok).select(*COL, "date", "numbers", "texts", F.coalesce("marked", F.lit(False)).alias("marked"))


def body_profiles(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """Numeric and text cells of a column from each asked row on.

    ``asked``: workbook_id, sheet, col_idx, start, distinct. Counts run up from the end of
    the column once, however many rows of it are asked for.
    """
    own = cells.join(asked.select(*COL).distinct(), COL, "left_semi")
    empty = F.lit(0).cast("bigint")
    counted = own.select(*COL, (-2 * F.col("row_idx")).alias("_at"), F.col("number").isNotNull().cast("bigint").alias("_n"), F.col("number").isNull().cast("bigint").alias("_t"), F.lit(None).cast(asked.schema["start"].dataType).alias("start"))
    x = counted.unionByName(asked.select(*COL, (-2 * F.col("start") + 1).alias("_at"), empty.alias("_n"), empty.alias("_t"), "start"))
    x = blocks.running_sums(x, COL, "_at", {"numbers": F.col("_n"), "texts": F.col("_t")})
    return x.where("start IS NOT NULL").select(*COL, "start", "numbers", "texts")


def header_candidates(cells: DataFrame, headers: DataFrame, desc: DataFrame) -> DataFrame:
    """Value columns (h, d, m, col_idx, date, marked) of every date row and marker row near a sheet's stage row.

    A sheet has 6 x 3 candidates, enumerated by offset; a column counts if its marker says
    so, or its body below both rows is empty or numeric enough.
    """
    h = headers.select(*SHEET, F.col("stage_row").alias("h"))
    d = F.sequence(F.greatest(F.col("h") - 2, F.lit(0)), F.col("h") + 3)
    cand = h.withColumn("d", F.explode(d)).withColumn("m", F.explode(F.array_distinct(F.array("h", F.col("d") - 1, F.col("d") + 1)))).where("m >= 0")
    top = cells.join(cand.select(*SHEET, F.explode(F.array("d", "m")).alias("row_idx")).distinct(), ROW, "left_semi")
    dates = top.where("date IS NOT NULL").select(*SHEET, F.col("row_idx").alias("d"), "col_idx", "date", contains_any(F.lower("cell_text"), REMARK_WORDS).alias("r1"))
    marks = top.select(*SHEET, F.col("row_idx").alias("m"), "col_idx", (F.col("stage") == PREFERRED_STAGE).alias("marked"),
                       contains_any(F.lower("cell_text"), REMARK_WORDS).alias("r2"))
    x = cand.join(dates, [*SHEET, "d"]).join(desc, SHEET).where("col_idx > desc_col").join(marks, [*SHEET, "m", "col_idx"], "left")
    x = x.withColumn("start", F.greatest("d", "m") + 1).withColumn("marked", F.coalesce("marked", F.lit(False)))
    x = x.join(body_profiles(cells, x.select(*COL, "start").distinct()), [*COL, "start"])
    numeric = (F.col("numbers") >= 1) & (F.col("numbers") >= F.col("texts")) & (F.col("texts") <= 2)
    empty = (F.col("numbers") + F.col("texts")) == 0
    ok = ~F.col("r1") & ~F.coalesce("r2", F.lit(False)) & (F.col("marked") | numeric | empty)
    return x.where(ok).select(*SHEET, "h", "d", "m", "col_idx", "date", "marked")


def best_header(cells: DataFrame, headers: DataFrame, desc: DataFrame) -> DataFrame:
    """Best (date row, marker row) near the header by markers, distinct dates, repeats and columns."""
    return chosen_header(header_candidates(cells, headers, desc))


def chosen_header(candidates: DataFrame) -> DataFrame:
    score = candidates.groupBy(*SHEET, "h", "d", "m").agg(F.count_if("marked").alias("marked"), F.count_distinct("date").alias("dates"), F.count(F.lit(1)).alias("columns"))
    order = F.struct("marked", "dates", F.col("dates") - F.col("columns"), "columns", -F.col("d"), -F.when(F.col("m") == F.col("h"), 0).when(F.col("m") < F.col("d"), 1).otherwise(2))
    return score.groupBy(*SHEET).agg(F.max_by(F.struct("d", "m", "marked", "dates", "columns"), order).alias("b")).select(
        *SHEET, F.col("b.d").alias("date_row"), F.col("b.m").alias("marker_row"), "b.marked", "b.dates", "b.columns")


#: (least share of numbers, most texts) in the body of a dated column, the stricter scan first. Fixed values.
RELAXED = ((0.4, 2), (0.3, 3))


def relaxed_header(cells: DataFrame, desc: DataFrame, tiers: tuple[tuple[float, int], ...] = RELAXED, scan_rows: int | None = None) -> DataFrame:
    """Dated columns (date_row, tier, col_idx, date) of the row that has most of them, without any stage row.

    Every row is a candidate; a dated cell right of the description counts if the cells
    below it hold a number, numbers enough and few texts. The first tier that finds a column
    on a sheet decides; of equal rows the upper one.
    """
    dated = cells.where(first_rows(scan_rows) & F.col("date").isNotNull() & ~contains_any(F.lower("cell_text"), REMARK_WORDS))
    spots = dated.join(desc, SHEET).where("col_idx > desc_col").select(*ROW, "col_idx", "date", (F.col("row_idx") + 1).alias("start"))
    x = spots.join(body_profiles(cells, spots.select(*COL, "start")), [*COL, "start"]).where("numbers >= 1")
    share = F.col("numbers") / (F.col("numbers") + F.col("texts"))
    fits = F.array(*[F.when((share >= least) & (F.col("texts") <= most), i + 1) for i, (least, most) in enumerate(tiers)])
    x = x.withColumn("tier", F.explode(F.array_compact(fits))).select(*SHEET, "tier", "row_idx", "col_idx", "date")
    rows = x.groupBy(*SHEET, "tier", "row_idx").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy(*SHEET).agg(F.min_by(F.struct("tier", "row_idx"), F.struct("tier", -F.col("n"), "row_idx")).alias("b")).select(*SHEET, "b.*")
    return x.join(best, [*SHEET, "tier", "row_idx"]).select(*SHEET, F.col("row_idx").alias("date_row"), "tier", "col_idx", "date")


def header_columns(cells: DataFrame, headers: DataFrame, desc: DataFrame) -> DataFrame:
    """The value columns of every sheet's table: date_row, marker_row, tier, col_idx, date.

    The best header near the stage row decides (tier 0); of its columns those from the first
    to the last marked one stay, all where none is marked. Sheets without such a header take
    the relaxed scan. Of columns of one date the first stays.
    """
    near = cut_lineage(header_candidates(cells, headers, desc), "header-candidates")
    best = chosen_header(near).select(*SHEET, F.col("date_row").alias("d"), F.col("marker_row").alias("m"))
    strict = near.join(best, [*SHEET, "d", "m"])
    marked = F.when(F.col("marked"), F.col("col_idx"))
    reach = strict.groupBy(*SHEET).agg(F.min(marked).alias("lo"), F.max(marked).alias("hi"))
    strict = strict.join(reach, SHEET).where("lo IS NULL OR col_idx BETWEEN lo AND hi")
    found = strict.select(*SHEET, F.col("d").alias("date_row"), F.col("m").alias("marker_row"), F.lit(0).alias("tier"), "col_idx", "date")
    others = cells.join(best, SHEET, "left_anti")
    relaxed = relaxed_header(others, desc).select(*SHEET, "date_row", F.lit(None).cast("int").alias("marker_row"), "tier", "col_idx", "date")
    return found.unionByName(relaxed).groupBy(*SHEET, "date_row", "marker_row", "tier", "date").agg(F.min("col_idx").alias("col_idx"))


def section_bounds(cells: DataFrame) -> DataFrame:
    """Statement sections: start row, and the first of end keyword, next section, indicator heading or ratio run."""
    rows = cells.where(F.trim("cell_text") != "").groupBy(*ROW).agg(F.lower(F.array_join(F.array_sort(F.collect_set("cell_text")), " ")).alias("text"))
    start = F.lit(None).cast("string")
    for name, words in reversed(SECTION_STARTS):
        start = F.when(contains_any(F.col("text"), words), name).otherwise(start)
    r = rows.withColumn("section", start).withColumn("ends", contains_any(F.col("text"), SECTION_ENDS)).withColumn(
        "post", contains_any(F.col("text"), POST_SECTION)).withColumn("ratio", contains_any(F.col("text"), RATIO_ROWS))
    # Ratio runs of three or more, over consecutive filled rows.
    pos = blocks.dense_index(r, SHEET, "row_idx", "pos")
    nxt = lambda w: {"r1": F.lead("ratio", 1).over(w), "r2": F.lead("ratio", 2).over(w)}
    runs = blocks.with_following(pos, SHEET, "pos", 2, nxt).where("ratio AND r1 AND r2").select(*SHEET, F.col("row_idx").alias("run_row"))
    starts = r.where("section IS NOT NULL").select(*SHEET, "section", F.col("row_idx").alias("start_row"))
    following = starts.withColumn("next_start", F.lead("start_row").over(Window.partitionBy(*SHEET).orderBy("start_row")))
    marks = (r.where("ends").select(*SHEET, F.col("row_idx").alias("at"), F.lit(1).alias("keep"))
             .unionByName(r.where("post").select(*SHEET, F.col("row_idx").alias("at"), F.lit(0).alias("keep")))
             .unionByName(runs.select(*SHEET, F.col("run_row").alias("at"), F.lit(0).alias("keep"))))
    last = r.groupBy(*SHEET).agg((F.max("row_idx") + 1).alias("sheet_end"))
    first_mark = following.join(marks, SHEET).where("at > start_row").groupBy(*SHEET, "start_row").agg(
        F.min(F.col("at") + F.col("keep")).alias("mark_end"))
    return following.join(first_mark, [*SHEET, "start_row"], "left").join(last, SHEET).select(
        *SHEET, "section", "start_row", F.least(F.coalesce("mark_end", "sheet_end"), F.coalesce("next_start", "sheet_end")).alias("end_row"))


def extract_statement(cells: DataFrame, bounds: DataFrame, desc: DataFrame) -> DataFrame:
    """Statement lines of every section: label, date, rounded amount in full units.

    Header one below the section row, values times the unit multiplier, nil-only rows dropped,
    first column wins where a date repeats.
    """
    b = bounds.withColumn("date_row", F.col("start_row") + 1)
    t = cells
    inside = t.join(b, SHEET).where("row_idx >= date_row AND row_idx < end_row").join(desc, SHEET)
    inside = cut_lineage(inside.select(*SHEET, "section", "row_idx", "col_idx", "cell_text", "number", "date", "unit", "date_row", "desc_col"), "statement-cells")
    head = inside.where("row_idx = date_row")
    unit = head.groupBy(*SHEET, "section").agg(F.max(F.when(F.col("unit"), 1000).otherwise(1)).alias("multiplier"))
    dates = head.where("date IS NOT NULL AND col_idx > desc_col").groupBy(*SHEET, "section", "date").agg(F.min("col_idx").alias("col_idx"))
    labels = inside.where("row_idx > date_row AND col_idx = desc_col").select(*SHEET, "section", "row_idx", F.trim("cell_text").alias("description"))
    values = inside.where("row_idx > date_row AND number IS NOT NULL").select(*SHEET, "section", "row_idx", "col_idx", "number")
    x = values.join(dates, [*SHEET, "section", "col_idx"]).join(labels, [*SHEET, "section", "row_idx"]).join(unit, [*SHEET, "section"])
    x = x.withColumn("amount", F.bround(F.col("number") * F.col("multiplier"), 0).cast("decimal(24,0)"))
    # a window along one row, whose width the file format bounds
    peak = F.max(F.abs("amount")).over(Window.partitionBy(*SHEET, "section", "row_idx"))
    return x.withColumn("peak", peak).where("peak > 0").select(
        *SHEET, "section", "row_idx", "description", F.col("date").alias("period_end"), "amount")


def sheet_profile(cells: DataFrame, headers: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Kind, title, stage labels, unit markers and header rows per sheet."""
    t = cells
    low = F.lower("cell_text")
    head = first_rows(scan_rows)
    titled = first_rows(scan_rows) & F.col("stage").isNull() & F.col("date").isNull() & ~F.col("unit") & ~low.isin("back", "nan", "none")
    a = t.groupBy(*SHEET).agg(
        F.min_by(F.trim("cell_text"), F.when(titled, F.struct("row_idx", "col_idx"))).alias("title"),
        F.bool_or(head & contains_any(low, ("balance sheet", "资产负债表", "資產負債表"))).alias("bal"),
        F.bool_or(head & contains_any(low, ("income statement", "profit and loss", "利润表", "利潤表"))).alias("inc"),
        F.bool_or(head & contains_any(low, ("台账", "台賬"))).alias("book"),
        F.array_join(F.array_sort(F.collect_set(F.when(first_rows(scan_rows) & has_unit_marker(F.col("cell_text")), F.trim("cell_text")))), ", ").alias("unit_markers"),
        F.array_join(F.array_sort(F.collect_set("stage")), ", ").alias("stage_labels"),
        F.coalesce(F.bool_or(F.col("stage") == PREFERRED_STAGE), F.lit(False)).alias("has_indicative"))
    x = a.join(headers, SHEET, "left")
    name = F.lower(F.trim("sheet"))
    nav = name.isin(*NAV_NAMES) | name.endswith("-->") | name.endswith(" for report") | name.startswith("upslide_") | name.startswith("_tm_")
    kind = (F.when(nav, "template_nav").when(F.contains(name, F.lit("financials")) | (F.col("bal") & F.col("inc")), "financial_summary")
            .when(F.col("stage_row").isNotNull(), "financial_schedule")
            .when(F.contains(F.lower("title"), F.lit("ledger")) | F.col("book"), "support_schedule").otherwise("other"))
    blocks_n = stage_rows(cells).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("stage_blocks"))
    x = x.join(blocks_n, SHEET, "left").withColumn("kind", kind)
    return x.select(*SHEET, "kind", F.coalesce("title", F.lit("Sheet")).alias("title"), "stage_row", "date_row", "stage_labels", "unit_markers", "has_indicative",
                    F.when((F.col("kind") != "financial_summary") & (F.coalesce("stage_blocks", F.lit(0)) >= 3), "multiple").otherwise("single").alias("scope"))


def entity_blocks(cells: DataFrame, entities: DataFrame) -> DataFrame:
    """Blocks between stage rows scored against an entity's name; best block per (sheet, entity).

    ``entities``: workbook_id, sheet, entity. Title match 6, exact block entity 10, context 4, one per name part.
    """
    s = stage_rows(cells)
    nxt = s.withColumn("end_row", F.lead("row_idx").over(Window.partitionBy(*SHEET).orderBy("row_idx"))).withColumnRenamed("row_idx", "stage_row")
    t = cells
    around = nxt.withColumn("row_idx", F.explode(F.sequence(F.greatest(F.col("stage_row") - 5, F.lit(0)), F.col("stage_row") + 1))).join(t, ROW)
    plain = (F.col("row_idx") < F.col("stage_row")) & (F.col("row_idx") >= F.col("stage_row") - 4)
    rows = around.groupBy(*SHEET, "stage_row", "end_row", "row_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "cell_text"))), lambda x: x["cell_text"]), " ").alias("text"),
        (F.count("stage") + F.count("date") + F.count_if("unit")).alias("header_like"))
    b = rows.groupBy(*SHEET, "stage_row", "end_row").agg(
        F.max_by("text", F.when(plain & (F.col("header_like") == 0), F.col("row_idx"))).alias("title"),
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "text"))), lambda x: x["text"]), " ")).alias("context"))
    b = b.withColumn("title", F.coalesce("title", "sheet"))
    part = F.regexp_extract("title", r"\s[-–]\s(.+)$", 1)
    x = b.join(entities, SHEET).withColumn("block_entity", F.lower(F.trim(part))).withColumn("e", F.lower(F.trim("entity")))
    words = F.filter(F.split("e", r"\s+"), lambda w: F.length(w) >= 3)
    score = (F.when(F.col("e") == F.col("block_entity"), 10).otherwise(0) + F.when(F.contains(F.lower("title"), F.col("e")), 6).otherwise(0)
             + F.when(F.contains("context", F.col("e")), 4).otherwise(0)
             + F.size(F.filter(words, lambda w: F.contains(F.lower("title"), w))) + F.size(F.filter(words, lambda w: F.contains(F.col("context"), w))))
    x = x.withColumn("score", score).withColumn("strict", F.when(F.col("block_entity") != "", F.col("block_entity") == F.col("e")).otherwise(F.contains(F.lower("title"), F.col("e"))))
    return x.groupBy(*SHEET, "entity").agg(F.max_by(F.struct("stage_row", "end_row", "title", "score", "strict"),
                                                  F.struct("strict", "score", -F.col("stage_row"))).alias("b")).select(*SHEET, "entity", "b.*")


def rollforward(cells: DataFrame, desc: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Roll-forward sheets turned round: one line per component and date below the carrying-amount row."""
    t = cells.join(desc, SHEET)
    low = F.lower(F.trim("cell_text"))
    labels = t.where("col_idx = desc_col")
    start = labels.where(low.isin(*CARRYING)).groupBy(*SHEET).agg(F.min("row_idx").alias("carrying"))
    header = t.where(first_rows(scan_rows)).groupBy(*ROW).agg(F.bool_or("unit").alias("u"), F.bool_or(
        (F.col("col_idx") > F.col("desc_col")) & F.col("date").isNull() & ~F.col("unit")).alias("c")).where("u AND c").groupBy(*SHEET).agg(F.min("row_idx").alias("head"))
    stop = labels.join(start, SHEET).where((F.col("row_idx") > F.col("carrying")) & low.startswith("check")).groupBy(*SHEET).agg(F.min("row_idx").alias("stop"))
    dates = labels.where("date IS NOT NULL").join(start, SHEET).join(stop, SHEET, "left").where(
        "row_idx > carrying AND (stop IS NULL OR row_idx < stop)").select(*ROW, F.col("date").alias("period_end"))
    enough = dates.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*SHEET)
    comps = t.join(header, SHEET).where("row_idx = head AND col_idx > desc_col AND date IS NULL AND NOT unit").select(*COL, F.trim("cell_text").alias("component"))
    values = t.where("number IS NOT NULL").select(*SHEET, "row_idx", "col_idx", "number")
    return values.join(dates.join(enough, SHEET, "left_semi"), ROW).join(comps, COL).select(
        *SHEET, "component", "period_end", F.col("number").alias("amount"))


def label_fill(cells: DataFrame, desc: DataFrame) -> DataFrame:
    """Description of every filled row; blank ones inherit the label above."""
    t = cells.where(F.trim("cell_text") != "").join(desc, SHEET)
    rows = t.groupBy(*ROW).agg(F.max(F.when(F.col("col_idx") == F.col("desc_col"), F.trim("cell_text"))).alias("own"))
    return blocks.fill_forward(rows, SHEET, "row_idx", "own", "label").select(*ROW, "own", "label")


def main_end(cells: DataFrame, desc: DataFrame, headers: DataFrame) -> DataFrame:
    """Row after the first total row below the header; the sheet's end where there is none."""
    t = cells.where(F.trim("cell_text") != "").join(desc, SHEET).join(headers, SHEET)
    total = (F.col("col_idx") == F.col("desc_col")) & (F.col("row_idx") > F.col("date_row")) & (row_type(F.col("cell_text")) == "total")
    return t.groupBy(*SHEET).agg(F.coalesce(F.min(F.when(total, F.col("row_idx"))), F.max("row_idx")).alias("last")).select(
        *SHEET, (F.col("last") + 1).alias("end_row"))


def normalise(cells: DataFrame, headers: DataFrame, desc: DataFrame, ends: DataFrame) -> DataFrame:
    """Every sheet of every workbook as typed schedule lines, in one plan.

    Headers and stages, first-wins columns, labels, row types, amounts in full units.
    """
    cols = dedupe_columns(filled_stages(cells, headers).join(value_columns(cells, headers, desc).select(*COL), COL, "left_semi"))
    unit = cells.groupBy(*SHEET).agg(F.max(F.when(F.col("unit"), 1000).otherwise(1)).alias("multiplier"))
    inside = cells.join(headers, SHEET).join(ends, SHEET).where(
        "row_idx > greatest(date_row, stage_row) AND row_idx < end_row")
    labels = inside.join(desc, SHEET).where("col_idx = desc_col").select(*ROW, F.trim("cell_text").alias("description"))
    values = inside.where("number IS NOT NULL").select(*SHEET, "row_idx", "col_idx", "number")
    return values.join(cols, COL).join(labels, ROW).join(unit, SHEET).select(
        *SHEET, "row_idx", "col_idx", "description", row_type(F.col("description")).alias("row_type"), "stage", F.col("date").alias("period_end"),
        F.bround(F.col("number") * F.col("multiplier"), 0).cast("decimal(24,0)").alias("amount"))


def projection_choice(lines: DataFrame) -> DataFrame:
    """Per sheet: latest non-zero preferred column, else latest non-zero of any stage, else the latest."""
    c = lines.groupBy(*SHEET, "stage", "period_end").agg(F.sum(F.abs("amount")).alias("size"))
    live = F.col("size") > 0
    tier = F.when((F.col("stage") == PREFERRED_STAGE) & live, 3).when(live, 2).when(F.col("stage") == PREFERRED_STAGE, 1).otherwise(0)
    best = c.groupBy(*SHEET).agg(F.max_by(F.struct("stage", "period_end", "size"), F.struct(tier, "period_end")).alias("b"))
    return best.select(*SHEET, F.col("b.stage").alias("effective_stage"), F.col("b.period_end").alias("effective_date"), "b.size",
                       F.when(F.col("b.stage") == PREFERRED_STAGE, "-").otherwise(
                           F.concat(F.lit(f"Fallback from {PREFERRED_STAGE} to "), F.coalesce("b.stage", F.lit("?")))).alias("flag"))


def detail_tables(cells: DataFrame, ends: DataFrame, lines: DataFrame, tie: str = "0.02") -> DataFrame:
    """Report-ready blocks below or beside the main table that tie to the account on some period.

    A header row has a unit marker and two or more distinct dates, one of them shared
    with the account; at least two labelled rows; the first block that ties wins.
    An empty row or the next header ends a block: a row's header is the latest above it
    in its run of filled rows, so each cell belongs to one block and is joined once.
    """
    per_sheet = lines.groupBy(*SHEET).agg(F.max("col_idx").alias("main_col"), F.collect_set("period_end").alias("periods"))
    totals = lines.where("row_type = 'total' AND amount <> 0").groupBy(*SHEET).agg(
        F.map_from_entries(F.collect_set(F.struct("period_end", "amount"))).alias("account"))
    heads = cells.where("unit OR date IS NOT NULL").groupBy(*ROW).agg(
        F.min(F.when(F.col("unit"), F.col("col_idx"))).alias("unit_col"),
        F.collect_list(F.when(F.col("date").isNotNull(), F.struct("col_idx", "date"))).alias("dates")).where("unit_col IS NOT NULL")
    h = heads.join(ends, SHEET).join(per_sheet, SHEET).join(totals, SHEET).where("row_idx >= end_row OR unit_col > main_col")
    h = h.withColumn("dates", F.filter("dates", lambda d: d["col_idx"] > F.col("unit_col")))
    found = F.transform("dates", lambda d: d["date"])
    h = h.where((F.size("dates") >= 2) & (F.size(F.array_distinct(found)) == F.size("dates")) & F.arrays_overlap(found, "periods")).select(
        *SHEET, F.col("row_idx").alias("head"), "unit_col", F.map_from_entries("dates").alias("dates"), "account")
    mult = cells.groupBy(*SHEET).agg(F.max(F.when(F.col("unit"), 1000).otherwise(1)).alias("multiplier"))
    at = with_segment(cells.select(*ROW).distinct(), 1).join(h.select(*SHEET, F.col("head").alias("row_idx"), F.col("head").alias("_h")), ROW, "left")
    owned = blocks.fill_forward(at, [*SHEET, "segment"], "row_idx", "_h", "head").where("head IS NOT NULL AND row_idx > head").select(*ROW, "head")
    body = cells.select(*SHEET, "row_idx", "col_idx", "cell_text", "number").join(owned, ROW).join(h.drop("dates", "account"), [*SHEET, "head"])
    rows = body.groupBy(*SHEET, "head", "row_idx").agg(
        F.max(F.when(F.col("col_idx") == F.col("unit_col"), F.trim("cell_text"))).alias("label"),
        F.collect_list(F.when(F.col("number").isNotNull(), F.struct("col_idx", "number"))).alias("cells")).where("label IS NOT NULL")
    key = [*SHEET, "head"]
    v = rows.join(h, key).join(mult, SHEET).withColumn("is_total", row_type(F.col("label")) == "total").withColumn("c", F.explode("cells")).withColumn(
        "period_end", F.try_element_at("dates", F.col("c.col_idx"))).where("period_end IS NOT NULL").withColumn(
        "value", (F.col("c.number") * F.col("multiplier")).cast("decimal(24,2)"))
    per = v.groupBy(*key, "period_end").agg(
        F.coalesce(F.max(F.when(F.col("is_total"), F.col("value"))), F.sum("value")).alias("block"),
        F.first(F.try_element_at("account", F.col("period_end"))).alias("account"), F.collect_set(F.when(~F.col("is_total"), F.col("row_idx"))).alias("rows"))
    ok = F.abs(F.col("block") - F.col("account")) <= F.greatest(
        F.lit(1).cast("decimal(28,4)"), (F.abs("account") * F.lit(tie).cast("decimal(3,2)")).cast("decimal(28,4)"))
    b = per.groupBy(*key).agg(F.count_if(ok).alias("tied"), F.count_if(~ok).alias("differs"),
                              F.size(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("rows")).where("tied > 0 AND rows >= 2")
    return b.groupBy(*SHEET).agg(F.min_by(F.struct("head", "tied", "differs", "rows"), "head").alias("b")).select(*SHEET, "b.*")


def detail_from_breakdown(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A detail table from a schedule's own breakdown rows: two or more valued ones; nil rows stay as headings only before a valued row."""
    b = lines.where(row_type(F.col("description")) == "breakdown").groupBy(*keys, "row_idx", "description").agg(F.max(F.abs("amount")).alias("peak"))
    x = blocks.dense_index(b.withColumn("heading", F.col("peak") == 0), keys, "row_idx", "pos")
    x = blocks.with_following(x, keys, "pos", 1, lambda w: {"next_heading": F.lead("heading").over(w)})
    enough = x.where("NOT heading").groupBy(*keys).agg(F.count(F.lit(1)).alias("valued")).where("valued >= 2")
    return x.where("NOT heading OR next_heading = false").join(enough, keys).select(*keys, "row_idx", "description", "heading", "valued")


def auxiliary_totals(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Totals of a ``check`` row right of the table, dated by the nearest dated row above it."""
    right = lines.groupBy(*SHEET).agg(F.max("col_idx").alias("main_col"))
    t = cells.join(right, SHEET).where("col_idx > main_col")
    checks = t.where(F.lower(F.trim("cell_text")) == "check").select(*SHEET, F.col("row_idx").alias("check_row"), F.col("col_idx").alias("check_col"))
    dated = t.where("date IS NOT NULL").select(*SHEET, F.col("row_idx").alias("head"), "col_idx", F.col("date").alias("period_end"))
    head = checks.join(dated.select(*SHEET, "head", "col_idx"), SHEET).where("head < check_row AND col_idx > check_col").groupBy(
        *SHEET, "check_row", "check_col").agg(F.max("head").alias("head"))
    mult = cells.groupBy(*SHEET).agg(F.max(F.when(F.col("unit"), 1000).otherwise(1)).alias("multiplier"))
    vals = t.where("number IS NOT NULL").select(*SHEET, F.col("row_idx").alias("check_row"), "col_idx", "number")
    x = head.join(dated, [*SHEET, "head"]).where("col_idx > check_col").join(vals, [*SHEET, "check_row", "col_idx"]).join(mult, SHEET)
    x = x.withColumn("total", F.bround(F.col("number") * F.col("multiplier"), 0).cast("decimal(24,0)"))
    first = x.groupBy(*SHEET).agg(F.min(F.struct("check_col", "check_row")).alias("f"))
    return x.join(first, SHEET).where("check_col = f.check_col AND check_row = f.check_row").select(*SHEET, "period_end", "total")


def supporting_notes(cells: DataFrame, headers: DataFrame, desc: DataFrame, ends: DataFrame, lines: DataFrame, most: int = 8) -> DataFrame:
    """Note-like text right of the figures, with the row's label; distinct, the first ``most`` per sheet."""
    right = lines.groupBy(*SHEET).agg(F.max("col_idx").alias("main_col"))
    t = cells.join(headers, SHEET).join(ends, SHEET).where("row_idx > greatest(date_row, stage_row) AND row_idx < end_row")
    note = (F.length(F.trim("cell_text")) >= 8) & F.col("stage").isNull() & F.col("date").isNull() & ~F.col("unit")
    extra = t.join(right, SHEET).where((F.col("col_idx") > F.col("main_col")) & note).groupBy(*ROW).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.trim("cell_text").alias("x")))), lambda x: x["x"]), " | ").alias("text"))
    labels = t.join(desc, SHEET).where("col_idx = desc_col AND date IS NULL").select(*ROW, F.trim("cell_text").alias("label"))
    n = extra.join(labels, ROW, "left").select(*ROW, F.concat_ws(" | ", "label", "text").alias("note"))
    d = n.groupBy(*SHEET, "note").agg(F.min("row_idx").alias("row_idx"))
    rank = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_idx"))
    return d.withColumn("note_no", rank).where(F.col("note_no") <= most)


def adjacent_columns(cells: DataFrame, headers: DataFrame, ends: DataFrame, lines: DataFrame, most: int = 5) -> DataFrame:
    """Up to five text columns right of the figures, named by their header; repeated names get a number."""
    right = lines.groupBy(*SHEET).agg(F.max("col_idx").alias("main_col"))
    t = cells.join(headers, SHEET).join(right, SHEET).where(F.col("col_idx").between(F.col("main_col") + 1, F.col("main_col") + most))
    head = t.where(F.col("row_idx").isin(F.col("date_row"), F.col("stage_row")) & F.col("stage").isNull() & F.col("date").isNull() & ~F.col("unit")).groupBy(*COL).agg(
        F.max_by(F.trim("cell_text"), F.when(F.col("row_idx") == F.col("date_row"), 1).otherwise(0)).alias("header"))
    body = t.join(ends, SHEET).where("row_idx > greatest(date_row, stage_row) AND row_idx < end_row").groupBy(*COL).agg(F.count(F.lit(1)).alias("filled"))
    x = body.join(head, COL, "left").withColumn("header", F.coalesce("header", F.concat(F.lit("Detail "), F.col("col_idx").cast("string"))))
    n = F.row_number().over(Window.partitionBy(*SHEET, "header").orderBy("col_idx"))
    return x.withColumn("n", n).select(*COL, "filled", F.when(F.col("n") == 1, F.col("header")).otherwise(
        F.concat("header", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("header"))


def row_type_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    kinds = ["detail", "breakdown", "subtotal", "total"]
    k = row_type(F.col("description"))
    return lines.groupBy(*keys).agg(*[F.count_if(k == n).alias(n) for n in kinds], F.count(F.lit(1)).alias("rows"))


def language_vote(cells: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Report language and statement mode per workbook, from its sheets."""
    t = F.col("cell_text")
    s = cells.where(first_rows(scan_rows)).groupBy(*SHEET).agg(
        F.bool_or(F.rlike(t, F.lit("[一-鿿]"))).alias("cjk"), F.bool_or(contains_any(F.lower(t), ("balance sheet", "资产负债表"))).alias("bs"),
        F.bool_or(contains_any(F.lower(t), ("income statement", "利润表"))).alias("inc"))
    w = s.groupBy("workbook_id").agg(F.count_if("cjk").alias("chi"), F.count_if(~F.col("cjk")).alias("eng"), F.bool_or("bs").alias("bs"), F.bool_or("inc").alias("inc"))
    mode = F.when(F.col("bs") & F.col("inc"), "full").when(F.col("bs"), "bs_only").when(F.col("inc"), "is_only").otherwise("none")
    return w.select("workbook_id", "chi", "eng", F.when(F.col("chi") > F.col("eng"), "Chi").otherwise("Eng").alias("language"), mode.alias("mode"))


def entity_candidates(cells: DataFrame) -> DataFrame:
    """Names after `` - `` in the rows above a sheet's first stage row and in sheet names, per workbook.

    Titles must be plausible names; names are kept from two sightings on. A sheet without
    a stage row has no title rows.
    """
    name = F.trim(F.regexp_extract("cell_text", r"\s[-–]\s(.+)$", 1))
    head = stage_rows(cells).groupBy(*SHEET).agg(F.min("row_idx").alias("head_row"))
    above = cells.join(head, SHEET).where(F.col("row_idx") < F.col("head_row")).select("workbook_id", name.alias("name"))
    titles = above.where((F.col("name") != "") & is_likely_entity(F.col("name"))).withColumn("source", F.lit("title"))
    sheets = cells.select(*SHEET).distinct().select("workbook_id", F.regexp_replace("sheet", "^Financials ", "").alias("name"), F.lit("sheet").alias("source"))
    return titles.unionByName(sheets).groupBy("workbook_id", "name").agg(
        F.count(F.lit(1)).alias("seen"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where("seen >= 2")


def unit_coverage(cells: DataFrame) -> DataFrame:
    """Where each sheet's thousands marker is: first eight rows, later, or nowhere."""
    first = cells.groupBy(*SHEET).agg(F.min(F.when(F.col("unit"), F.col("row_idx"))).alias("marker_row"))
    return first.withColumn("coverage", F.when(F.col("marker_row") < UNIT_ROWS, "top").when(F.col("marker_row").isNotNull(), "later").otherwise("none"))


#: Least size of the largest value that looks like whole units, and like thousands (fixed values).
WHOLE_UNITS, THOUSANDS = 1_000_000, 1_000


def value_scale(statement: DataFrame, printed: DataFrame, keys: list[str]) -> DataFrame:
    """What scale a statement's values look like, next to the unit it prints.

    ``statement``: keys, period_end, amount; ``printed``: keys and unit, one row per key. The
    largest value of the last period decides; without a value there other than zero there is
    no scale. ``mismatch``: printed thousands over values that look whole, or no thousands
    marker over values that look like thousands; null where the unit or the scale is unknown
    or the values are small. One aggregation, joined to the units on the keys.
    """
    size = F.abs(F.col("amount"))
    last = statement.where("period_end IS NOT NULL").groupBy(*keys).agg(
        F.max(F.struct("period_end", F.coalesce(size, F.lit(0)).alias("size"))).alias("x"))
    largest = F.when(F.col("x.size") > 0, F.col("x.size"))
    scaled = last.join(printed.select(*keys, "unit"), keys, "left").select(
        *keys, "unit", F.col("x.period_end").alias("period_end"), largest.alias("largest"),
        F.when(largest >= WHOLE_UNITS, "units").when(largest >= THOUSANDS, "thousands").when(largest.isNotNull(), "small").alias("scale"))
    marked = has_thousand_marker(F.col("unit"))
    return scaled.withColumn("mismatch", F.when(F.col("unit").isNotNull() & F.col("scale").isin("units", "thousands"), marked == (F.col("scale") == "units")))


def stage_label_audit(cells: DataFrame) -> DataFrame:
    """Stage-row labels that are not recognised, and stage columns without a date."""
    s = stage_rows(cells).withColumnRenamed("row_idx", "stage_row")
    t = cells
    h = row_hits(cells).where("date_hits > 0")
    near = s.withColumn("row_idx", F.explode(F.sequence(F.col("stage_row") - 2, F.col("stage_row") + 2))).join(h, ROW).groupBy(*SHEET, "stage_row").agg(
        F.max_by("row_idx", F.struct("date_hits", -F.col("row_idx"))).alias("date_row"))
    labels = t.select(*SHEET, F.col("row_idx").alias("stage_row"), "col_idx", "stage").join(s, [*SHEET, "stage_row"])
    dates = t.where("date IS NOT NULL").select(*SHEET, F.col("row_idx").alias("date_row"), "col_idx", "date")
    x = labels.join(near, [*SHEET, "stage_row"], "left").join(dates, [*SHEET, "date_row", "col_idx"], "left")
    return x.groupBy(*SHEET, "stage_row").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("stage").isNull()).alias("unrecognised"),
                                            F.count_if(F.col("date").isNull()).alias("undated"))


def scaling_audit(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Raw cell times the sheet's multiplier against the stored amount, address by address."""
    mult = cells.groupBy(*SHEET).agg(F.max(F.when(F.col("unit"), 1000).otherwise(1)).alias("multiplier"))
    raw = cells.where("number IS NOT NULL").select(*SHEET, "row_idx", "col_idx", "number").join(mult, SHEET)
    x = lines.join(raw, [*ROW, "col_idx"]).withColumn("gap", F.abs(F.col("number") * F.col("multiplier") - F.col("amount")))
    return x.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("gap") > 1).alias("off"), F.max("gap").cast("decimal(24,2)").alias("largest_gap"))


def row_survival(cells: DataFrame, headers: DataFrame, desc: DataFrame, ends: DataFrame, lines: DataFrame) -> DataFrame:
    """Every labelled row below the header: whether it reached the lines, and why not."""
    t = cells.join(desc, SHEET).join(headers, SHEET).join(ends, SHEET).where("row_idx > greatest(date_row, stage_row)")
    rows = t.groupBy(*ROW).agg(F.max(F.when(F.col("col_idx") == F.col("desc_col"), F.trim("cell_text"))).alias("label"),
                             F.count("number").alias("numbers"), F.max("end_row").alias("end_row"))
    kept = lines.select(*ROW).distinct().withColumn("kept", F.lit(True))
    reason = (F.when(F.col("kept"), "kept").when(F.col("row_idx") >= F.col("end_row"), "below the table")
              .when(F.col("label").isNull(), "no label").when(F.col("numbers") == 0, "no figures").otherwise("no dated column"))
    return rows.join(kept, ROW, "left").select(*ROW, "label", reason.alias("outcome"))


def label_set_search(cells: DataFrame, wanted: DataFrame, min_hits: int = 2, columns: int | None = None) -> DataFrame:
    """Sheets that hold at least two of a list of row labels in their first ``columns`` columns (None: all), best first per list.

    ``wanted``: list_id, workbook_id, label.
    """
    spots = cells.where(F.lit(True) if columns is None else F.col("col_idx") < columns).select(*SHEET, F.trim("cell_text").alias("label"), "row_idx")
    hit = spots.join(wanted, ["workbook_id", "label"]).groupBy("list_id", *SHEET, "label").agg(F.min("row_idx").alias("row_idx"))
    s = hit.groupBy("list_id", *SHEET).agg(F.count(F.lit(1)).alias("hits"), F.min("row_idx").alias("first_row")).where(F.col("hits") >= min_hits)
    rank = F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("hits"), "first_row", "sheet"))
    return s.withColumn("rank", rank)


def bridge_blocks(cells: DataFrame) -> DataFrame:
    """Items of every Base / Change block: rows below the header until two blank rows or a check row."""
    t = cells
    low = F.lower(F.trim("cell_text"))
    base = t.where(low == "base").select(*SHEET, F.col("row_idx").alias("head"), F.col("col_idx").alias("base_col"))
    change = t.where(low == "change").select(*SHEET, F.col("row_idx").alias("head"), (F.col("col_idx") - 1).alias("base_col"))
    heads = base.join(change, [*SHEET, "head", "base_col"], "left_semi")
    offset = F.col("col_idx") - F.col("base_col")
    x = heads.join(t.select(*SHEET, "row_idx", "col_idx", "cell_text", "number"), SHEET).where((F.col("row_idx") > F.col("head")) & offset.between(-1, 1))
    rows = x.groupBy(*SHEET, "head", "base_col", "row_idx").agg(
        F.max(F.when(offset == -1, F.trim("cell_text"))).alias("label"), F.max(F.when(offset == 0, F.col("number"))).alias("base"),
        F.max(F.when(offset == 1, F.col("number"))).alias("change"))
    key = [*SHEET, "head", "base_col"]
    w = Window.partitionBy(*key).orderBy("row_idx")
    stop = F.contains(F.lower("label"), F.lit("check")) | (F.col("row_idx") - F.coalesce(F.lag("row_idx").over(w), F.col("head")) > 2)
    ends = rows.withColumn("stop", F.coalesce(stop, F.lit(False))).where("stop").groupBy(*key).agg(F.min("row_idx").alias("stop_row"))
    items = rows.join(ends, key, "left").where("stop_row IS NULL OR row_idx < stop_row").withColumn(
        "kind", F.when(F.col("base").isNotNull() & F.col("change").isNull(), "total").when(F.col("change").isNotNull() & F.col("base").isNull(), "delta")).where("kind IS NOT NULL")
    items = items.withColumn("value", F.coalesce("base", "change"))
    chk = items.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.when(F.col("kind") == "total", F.col("value")), "row_idx").alias("s"),
        F.max_by(F.struct("kind", "value"), "row_idx").alias("last"), F.sum(F.when(F.col("kind") == "delta", F.col("value"))).alias("moves")).where("n >= 2")
    rebuilt = F.coalesce("s", F.lit(0)) + F.coalesce("moves", F.lit(0))
    end = F.when(F.col("last.kind") == "total", F.col("last.value")).otherwise(rebuilt)
    ok = F.abs(rebuilt - end) < F.greatest(F.lit(1.0), F.abs(end).cast("double") * 0.005)
    return items.join(chk.select(*key, ok.alias("check_ok")), key).select(*key, "row_idx", "label", "kind", "value", "check_ok")


def with_segment(rows: DataFrame, blank: int, keys: list[str] = SHEET) -> DataFrame:
    """``rows`` (keys, row_idx, ...) with ``segment``: the first row of their run, which ends where ``blank`` rows in a row are empty."""
    row = [*keys, "row_idx"]
    filled = rows.select(*row).distinct()
    after = filled.select(*keys, F.explode(F.sequence(F.col("row_idx") + 1, F.col("row_idx") + blank)).alias("row_idx")).distinct()
    starts = filled.join(after, row, "left_anti").withColumn("_start", F.col("row_idx"))
    marked = blocks.fill_forward(filled.join(starts, row, "left"), keys, "row_idx", "_start", "segment")
    return rows.join(marked.select(*row, "segment"), row)


def dated_headers(cells: DataFrame) -> DataFrame:
    """Label cells followed by two or more dates before the next other cell: label_col, head, periods and the dates' columns."""
    w = Window.partitionBy(*ROW).orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0)
    is_date = F.col("date").isNotNull()
    labelled = cells.withColumn("label_col", F.last(F.when(~is_date, F.col("col_idx")), True).over(w)).where(is_date & F.col("label_col").isNotNull())
    spans = labelled.groupBy(*ROW, "label_col").agg(F.sort_array(F.collect_list("col_idx")).alias("cols"))
    return spans.select(*SHEET, "label_col", "cols", F.col("row_idx").alias("head"), F.size("cols").cast("bigint").alias("periods")).where("periods >= 2")


def period_blocks(cells: DataFrame, blank: int = 3, least: int = 2) -> DataFrame:
    """Dated blocks anywhere on a sheet: a label cell followed by two or more dates, then rows with figures.

    A block reads its label column and the columns of its dates. It ends before a row that
    heads a dated block, has a label and no figure of this one, or where ``blank`` rows in a
    row hold neither label nor figure; ``least`` rows need a figure. The rows down to the one
    that ends a block, that one included, belong to it: from top to bottom, a header inside
    the rows of a block kept before with the same label column is no block. Blocks side by
    side have label columns of their own. Cost follows cells times layouts (label column and
    dates' columns) of a sheet, not headers.
    """
    heads = cut_lineage(dated_headers(cells), "dated-headers")
    layout = [*SHEET, "label_col", "cols"]
    layouts = heads.select(*layout).distinct()
    filled = cells.select(*SHEET, F.col("col_idx").alias("label_col"), "row_idx")
    figures = cells.where("number IS NOT NULL").select(*ROW, "col_idx")
    labels = layouts.join(filled, [*SHEET, "label_col"]).select(*layout, "row_idx", F.lit(True).alias("label"), F.lit(False).alias("figure"))
    counted = layouts.withColumn("col_idx", F.explode("cols")).join(figures, [*SHEET, "col_idx"]).select(*layout, "row_idx", F.lit(False).alias("label"), F.lit(True).alias("figure"))
    rows = labels.unionByName(counted).groupBy(*layout, "row_idx").agg(F.bool_or("label").alias("label"), F.bool_or("figure").alias("figure"))
    rows = rows.join(heads.select(*SHEET, F.col("head").alias("row_idx")).distinct().withColumn("dated", F.lit(True)), ROW, "left")
    rows = rows.join(heads.select(*layout, F.col("head").alias("row_idx"), "periods"), [*layout, "row_idx"], "left")
    # landed between passes, as each pass holds its input twice
    rows = cut_lineage(rows.where("row_idx IS NOT NULL").withColumn("_figure", F.when(F.col("figure"), F.col("row_idx"))), "block-rows")
    # what ends a block that is open above it: a gap above a row, a row that stops it, the end of the layout
    mark = lambda end, figures, last: F.struct(end.alias("end"), figures.cast("bigint").alias("figures"), last.alias("last"))
    x = blocks.running(rows, layout, "row_idx", {"_figures": F.col("figure").cast("bigint")}, {"_before": F.col("row_idx"), "_last": F.col("_figure")})
    gap = F.col("row_idx") - F.col("_before") > blank
    stop = F.col("dated") & F.col("label") & ~F.col("figure")
    x = x.withColumn("_mark", F.when(gap, mark(F.col("_before") + blank + 1, F.col("_figures") - F.col("figure").cast("bigint"), F.col("_last")))
                     .when(stop, mark(F.col("row_idx"), F.col("_figures"), F.col("_last"))))
    marks = x.select(*layout, "row_idx", "periods", "_figures", "_mark").where("_mark IS NOT NULL OR periods IS NOT NULL")
    tail = rows.groupBy(*layout).agg((F.max("row_idx") + blank + 1).alias("row_idx"), F.count_if("figure").alias("n"), F.max("_figure").alias("last"))
    tail = tail.select(*layout, "row_idx", F.lit(None).cast("bigint").alias("periods"), F.col("n").alias("_figures"), mark(F.col("row_idx"), F.col("n"), F.col("last")).alias("_mark"))
    # read from the far end: a mark at an even place, what a header sees below itself at the odd one after it
    none = F.lit(None)
    places = F.array_compact(F.array(
        F.when(F.col("_mark").isNotNull(), F.struct((-2 * F.col("row_idx")).alias("at"), none.cast("bigint").alias("asks"), F.col("_mark").alias("mark"))),
        F.when(F.col("periods").isNotNull(), F.struct((-2 * F.col("row_idx") - 1).alias("at"), F.col("periods").alias("asks"), none.cast(marks.schema["_mark"].dataType).alias("mark")))))
    marks = marks.unionByName(tail).withColumn("_p", F.explode(places)).select(*layout, "row_idx", "_figures", F.col("_p.at").alias("_at"), F.col("_p.asks").alias("periods"), F.col("_p.mark").alias("_mark"))
    asked = blocks.fill_forward(cut_lineage(marks, "block-marks"), layout, "_at", "_mark", "next").where("periods IS NOT NULL").select(
        *SHEET, "label_col", F.col("row_idx").alias("head"), "periods", (F.col("next.figures") - F.col("_figures")).alias("data_rows"), F.col("next.last").alias("last_row"), F.col("next.end").alias("end"))
    found = cut_lineage(asked.where(F.col("data_rows") >= least), "dated-blocks")
    key = [*SHEET, "label_col", "head"]
    kept = found.join(blocks.claim_spans(found, key[:-1], "head", "end"), key)
    titles = cells.where("date IS NULL").select(*SHEET, F.col("col_idx").alias("label_col"), F.col("row_idx").alias("_above"), F.trim("cell_text").alias("t"))
    above = kept.select(*key, F.explode(F.array(F.col("head") - 1, F.col("head") - 2)).alias("_above"))
    title = above.join(titles, [*SHEET, "label_col", "_above"]).groupBy(*key).agg(F.max_by("t", "_above").alias("title"))
    return kept.join(title, key, "left").select(*key, "periods", "data_rows", "last_row", "title")


# Metric rows of an operating sheet (fixed values).
METRICS = (("occupancy", r"^total occupancy rate$"), ("area", r"leased area$|occupied area$"), ("rent", r"^rent$"), ("revenue", r"revenue"))
# Words before "revenue" that name no type (fixed values).
AGGREGATE_WORDS = ("gross", "total", "net")


def phase_blocks(cells: DataFrame, tail: int = 8, repeats: int = 4) -> DataFrame:
    """Phase blocks of operating sheets: rows by metric in the occupancy row's own column, and a label.

    A block runs from its occupancy row to the next one, the last for ``tail`` rows. Tags are
    short texts that stand ``repeats`` times in a row. Where a sheet has as many tag rows as
    blocks, they go together by position; where the numbers differ, a block takes the tag
    that shares most columns with its own figures other than zero (the tag of fewer columns
    on a tie, then the upper one) and stays ``Phase n`` without any. A sheet without tags
    takes the type named in the revenue row, else ``Phase n``. Repeated labels get a number.
    ``cells``: sheet, row_idx, col_idx, cell_text.
    """
    text = F.trim("cell_text")
    metric = F.lit(None).cast("string")
    for name, pattern in reversed(METRICS):
        metric = F.when(F.rlike(F.lower(text), F.lit(pattern)), name).otherwise(metric)
    m = cells.withColumn("metric", metric).where("metric IS NOT NULL")
    occ = m.where("metric = 'occupancy'").groupBy("sheet", F.col("row_idx").alias("start")).agg(F.max("col_idx").alias("anchor"))
    occ = blocks.dense_index(occ, ["sheet"], "start", "n")
    counts = occ.groupBy("sheet").agg(F.count(F.lit(1)).alias("blocks"))
    # every metric row meets the block that starts at or above it
    owned = m.select("sheet", "row_idx").distinct().join(occ.select("sheet", F.col("start").alias("row_idx"), F.col("start").alias("_start")), ["sheet", "row_idx"], "left")
    owned = blocks.fill_forward(owned, ["sheet"], "row_idx", "_start", "start").where("start IS NOT NULL").select("sheet", "row_idx", "start")
    inside = m.join(owned, ["sheet", "row_idx"]).join(occ.join(counts, "sheet"), ["sheet", "start"]).where((F.col("col_idx") == F.col("anchor")) & ((F.col("n") < F.col("blocks")) | (F.col("row_idx") <= F.col("start") + tail)))
    row = lambda k: F.max(F.when(F.col("metric") == k, F.col("row_idx")))
    b = inside.groupBy("sheet", "n", "start", "blocks").agg(row("area").alias("area_row"), row("rent").alias("rent_row"), row("revenue").alias("revenue_row"),
                                                          F.max_by("cell_text", F.when(F.col("metric") == "revenue", F.col("row_idx"))).alias("revenue_text"))
    short = F.rlike(text, F.lit(r"^\D{1,8}$")) & ~F.rlike(text, F.lit(r"(?i)年|月|日|LTM|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"))
    named = cells.where(short).groupBy("sheet", "row_idx", text.alias("tag")).agg(F.collect_set("col_idx").alias("cols")).where(F.size("cols") >= repeats)
    rows = blocks.dense_index(named.groupBy("sheet", "row_idx").agg(F.array_join(F.array_sort(F.collect_set("tag")), "/").alias("tag")), ["sheet"], "row_idx", "n")
    x = b.join(rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("tags")), "sheet", "left").join(rows.select("sheet", "n", "tag"), ["sheet", "n"], "left")
    spots = named.select("sheet", "tag", "row_idx", F.explode("cols").alias("col_idx")).groupBy("sheet", "tag", "col_idx").agg(F.min("row_idx").alias("tag_row"))
    sizes = spots.groupBy("sheet", "tag").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("tag_row", "col_idx")).alias("place"))
    amount = coerce_numeric(F.col("cell_text"), MONEY)
    figures = cells.where(amount != 0).select("sheet", "row_idx", "col_idx")
    sides = x.where("tags <> blocks").select("sheet", "n", F.explode(F.array("area_row", "revenue_row")).alias("row_idx"))
    active = sides.join(figures, ["sheet", "row_idx"]).select("sheet", "n", "col_idx").distinct()
    shared = active.join(spots, ["sheet", "col_idx"]).groupBy("sheet", "n", "tag").agg(F.count(F.lit(1)).alias("overlap")).join(sizes, ["sheet", "tag"])
    nearest = shared.groupBy("sheet", "n").agg(F.min_by("tag", F.struct(-F.col("overlap"), "size", "place")).alias("nearest"))
    derived = F.trim(F.regexp_replace("revenue_text", r"(?i)\s*(rental )?revenue.*$", ""))
    derived = F.when(~F.lower(derived).isin("", *AGGREGATE_WORDS), derived)
    label = F.when(F.col("tags") == F.col("blocks"), F.col("tag")).when(F.col("tags").isNull(), derived).otherwise(F.col("nearest"))
    x = x.join(nearest, ["sheet", "n"], "left").withColumn("base", F.coalesce(label, F.concat(F.lit("Phase "), F.col("n").cast("string"))))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("sheet", "base").orderBy("n")))
    return x.select("sheet", "n", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("label"),
                    F.col("start").alias("occupancy_row"), "area_row", "rent_row", "revenue_row")
