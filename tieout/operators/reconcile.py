"""Statement lines against schedule totals.

All joins and aggregations are keyed by the entity, so one hash partitioning on
``entity_id`` serves the whole chain; the chart of accounts is a literal-sized
table and is left to Catalyst's own size check for broadcasting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.labels import alias_form, compares_as_magnitude, is_skip_label, row_type

TOLERANCE = 1
MATERIALITY = "0.005"
FULL_PERIOD_MONTHS = 10

# Status texts (fixed values).
MATCH, MATCH_ZERO, IMMATERIAL, DIFF = "✅ Match", "⚠️ Match", "✅ Immaterial", "❌ Diff"
NOT_FOUND, INTERIM = "⚠️ Not Found", "⚠️ Interim Diff (prior period matches)"
WARNING_LABELS = {"Missing mapping": "⚠️ Map", "Tab-only match": "⚠️ Tab", "Mapped but missing tab": "⚠️ No tab"}


def exploded_aliases(chart: DataFrame) -> DataFrame:
    """One row per (mapping key, alias): the key itself, the tab name, the statement label."""
    named = F.array(*[F.struct(F.lit(i).alias("ord"), F.col(c).alias("alias"))
                      for i, c in enumerate(("mapping_key", "tab_name", "statement_label"))])
    return (
        chart.select("mapping_key", "statement_type", "category", "line_no", F.explode(named).alias("x"))
        .select("mapping_key", "statement_type", "category", "line_no", "x.ord", "x.alias",
                alias_form(F.col("x.alias")).alias("alias_norm"))
    )


def resolve_aliases(names: DataFrame, chart: DataFrame) -> DataFrame:
    """Map each distinct ``account_name`` to the chart; misses keep a reason.

    Tiers: exact key, exact alias, normal form; the earliest chart line wins.
    """
    aliases = exploded_aliases(chart)
    tier = (F.when((F.col("ord") == 0) & (F.col("alias") == F.col("account_name")), 0)
            .when(F.col("alias") == F.col("account_name"), 1).otherwise(2))
    hits = (
        names.select("account_name").distinct()
        .withColumn("alias_norm", alias_form(F.col("account_name")))
        .join(aliases, "alias_norm")
        .where((F.col("ord") > 0) | (F.col("alias") == F.col("account_name")))
        .groupBy("account_name")
        .agg(F.min_by(F.struct("mapping_key", "statement_type", "category"),
                      F.struct(F.when(tier == 0, 0).otherwise(1), "line_no", "ord")).alias("hit"))
    )
    key, kind = F.col("hit.mapping_key"), F.col("hit.statement_type")
    return names.select("account_name").distinct().join(hits, "account_name", "left").select(
        "account_name",
        F.coalesce(key, F.lit("")).alias("mapping_key"),
        F.coalesce(kind, F.lit("")).alias("account_type"),
        F.when(kind.isin("BS", "IS"), kind).otherwise("other").alias("classification"),
        F.when(key.isNull(), "No key or alias matched this account name.")
        .when(kind.isin("BS", "IS"), F.concat(F.lit("Mapped to "), kind, F.lit(" via '"), key, F.lit("'.")))
        .otherwise("Mapped type is not classified as BS or IS.").alias("reason"),
    )


def account_total(lines: DataFrame, keys: list[str], auxiliary: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """One total per (keys): stored projection total, auxiliary check total with the table's sign, first total row, else first valued row.

    ``lines`` needs ``row_idx``, ``description`` and ``amount``; a single aggregation with
    map-side partials, no window. ``auxiliary`` has auxiliary_total and ``stored`` has
    stored_total, one row per key each; a stored total is taken with its own sign, zero too.
    """
    kind = row_type(F.col("description"))
    total = lines.withColumn("kind", kind).groupBy(*keys).agg(
        F.min_by("amount", F.when(F.col("kind") == "total", F.col("row_idx"))).alias("table_total"),
        F.min_by("amount", F.when(~F.col("kind").isin("breakdown", "subtotal") & (F.abs("amount") > 0),
                                  F.col("row_idx"))).alias("first_value"),
    )
    tiers = [F.col("table_total"), F.col("first_value")]
    if auxiliary is not None:
        total = total.join(auxiliary.select(*keys, "auxiliary_total"), keys, "full_outer")
        flip = (F.col("table_total") != 0) & ((F.col("table_total") > 0) != (F.col("auxiliary_total") > 0))
        tiers.insert(0, F.when(flip, F.abs("auxiliary_total") * F.signum(F.col("table_total")).cast("int")).otherwise(F.col("auxiliary_total")))
    if stored is not None:
        total = total.join(stored.select(*keys, "stored_total"), keys, "full_outer")
        tiers.insert(0, F.col("stored_total"))
    return total.select(*keys, F.coalesce(*tiers).alias("total"))


def _tie_status(source: Column, tab: Column, zero_with_adjacent: Column) -> Column:
    gap = F.abs(source - tab)
    return (
        F.when(tab.isNull(), NOT_FOUND)
        .when(gap <= TOLERANCE, F.when(zero_with_adjacent, MATCH_ZERO).otherwise(MATCH))
        .when((source != 0) & (gap <= F.abs(source) * F.lit(MATERIALITY).cast("decimal(4,3)")), IMMATERIAL)
        .otherwise(DIFF)
    )


def reconcile(statement: DataFrame, schedule: DataFrame, chart: DataFrame) -> DataFrame:
    """Every statement line at its latest period against the schedule total of its tab.

    ``statement``: entity_id, entity, statement_type, description, period_end, amount.
    ``schedule``: entity_id, account, period_end, amount (one total per account and period).
    """
    periods = statement.groupBy("entity_id", "statement_type").agg(
        F.sort_array(F.collect_set("period_end"), asc=False).alias("p"))
    periods = periods.select("entity_id", "statement_type", F.get("p", F.lit(0)).alias("date"),
                             F.get("p", F.lit(1)).alias("prior_date"))

    def at(date_col: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("period_end") == F.col(date_col), F.col("amount"))),
                          F.lit(0)).cast("decimal(20,2)")

    lines = (
        statement.join(periods, ["entity_id", "statement_type"])
        .groupBy("entity_id", "entity", "statement_type", "description", "date", "prior_date")
        .agg(at("date").alias("value"), at("prior_date").alias("prior_value"))
    )

    # Tab lookup by name happens once per distinct label, not per entity: the tab
    # named like the line first, else any tab among the line's aliases.
    aliases = exploded_aliases(chart).where("ord > 0")
    line_key = (
        lines.select("description").distinct().withColumn("alias_norm", alias_form(F.col("description")))
        .join(aliases, "alias_norm", "left").groupBy("description")
        .agg(F.min("alias_norm").alias("desc_norm"), F.min_by(
            F.struct("mapping_key", "category"), F.struct("line_no", "ord")).alias("m"))
        .select("description", "desc_norm", "m.mapping_key", "m.category")
    )
    tab_names = schedule.select(F.col("account").alias("tab")).distinct().withColumn("tab_norm", alias_form(F.col("tab")))
    tab_keys = tab_names.join(aliases.select(F.col("alias_norm").alias("tab_norm"), F.col("mapping_key").alias("tab_key")), "tab_norm")
    direct = line_key.join(tab_names, F.col("tab_norm") == F.col("desc_norm")).select("description", "tab", F.lit(0).alias("rank"))
    by_alias = line_key.join(tab_keys, F.col("tab_key") == F.col("mapping_key")).select("description", "tab", F.lit(1).alias("rank"))
    candidates = direct.unionByName(by_alias).groupBy("description", "tab").agg(F.min("rank").alias("rank"))
    # One row per (entity, tab) holding its few periods, so one join serves every date.
    by_period = schedule.groupBy("entity_id", F.col("account").alias("tab")).agg(
        F.map_from_entries(F.collect_list(F.struct("period_end", "amount"))).alias("by_period"))
    tabs = by_period.join(candidates, "tab").groupBy("entity_id", "description").agg(
        F.min_by(F.struct("tab", "by_period"), F.struct("rank", "tab")).alias("t"))
    mapped = (
        lines.join(line_key.select("description", "mapping_key", "category"), "description", "left")
        .join(tabs, ["entity_id", "description"], "left")
    )

    zero_source = (F.col("value") == 0) & (F.col("prior_date").isNull() | (F.col("prior_value") == 0))
    skipped = is_skip_label(F.col("description"))
    mapped = mapped.withColumn("mapping_status", (
        F.when(zero_source, "Zero source").when(skipped, "Skipped")
        .when(F.col("t").isNotNull() & F.col("mapping_key").isNull(), "Tab-only match")
        .when(F.col("t").isNotNull(), "Mapped")
        .when(F.col("mapping_key").isNotNull(), "Mapped but missing tab")
        .otherwise("Missing mapping")
    )).withColumn("compared", ~F.col("mapping_status").isin("Zero source", "Skipped")).withColumn(
        "tab", F.when(F.col("compared"), F.col("t.tab")))

    zero_with_adjacent = (F.col("value") == 0) & (F.col("prior_value") != 0)
    tab_value = F.coalesce(F.when(F.col("compared"), F.try_element_at("t.by_period", F.col("date"))),
                           F.when(zero_with_adjacent & F.col("tab").isNotNull(), F.lit(0).cast("decimal(20,2)")))
    magnitude = (F.col("statement_type") == "IS") & compares_as_magnitude(F.col("description"), F.col("category"))
    out = mapped.withColumn("tab_value", tab_value).withColumn("magnitude", magnitude).withColumn(
        "prior_tab", F.when(F.col("compared"), F.try_element_at("t.by_period", F.col("prior_date"))))
    src = F.when(F.col("magnitude"), F.abs("value")).otherwise(F.col("value"))
    tab = F.when(F.col("magnitude"), F.abs("tab_value")).otherwise(F.col("tab_value"))
    return out.select(
        "entity_id", "entity", "statement_type", F.col("description").alias("financials_account"), "date",
        F.col("value").alias("financials_value"),
        F.when(F.col("compared"), F.coalesce("tab", F.lit("Not Found"))).otherwise("-").alias("tab_account"),
        F.when(F.col("compared"), F.coalesce("tab_value", F.lit(0).cast("decimal(20,2)"))).alias("tab_value"),
        F.when(F.col("compared"), F.abs(src - tab)).cast("decimal(20,2)").alias("diff"),
        F.when(F.col("compared"), _tie_status(src, tab, zero_with_adjacent)).otherwise("-").alias("match"),
        F.when(F.col("compared"), F.coalesce("mapping_key", F.lit("-"))).otherwise("-").alias("mapping_key"),
        "mapping_status", "prior_date", "prior_value", "prior_tab", "magnitude",
    )


def rescue_interim(recon: DataFrame) -> DataFrame:
    """A Diff at a part-period cut becomes an interim diff where the prior period ties."""
    gap = (F.year("date") - F.year("prior_date")) * 12 + F.month("date") - F.month("prior_date")
    src = F.when(F.col("magnitude"), F.abs("prior_value")).otherwise(F.col("prior_value"))
    tab = F.when(F.col("magnitude"), F.abs("prior_tab")).otherwise(F.col("prior_tab"))
    ties = tab.isNotNull() & _tie_status(src, tab, F.lit(False)).isin(MATCH, IMMATERIAL)
    rescued = (F.col("match") == DIFF) & (gap > 0) & (gap < FULL_PERIOD_MONTHS) & ties
    return recon.withColumn("match", F.when(F.coalesce(rescued, F.lit(False)), INTERIM).otherwise(F.col("match")))


def status_counts(recon: DataFrame) -> DataFrame:
    """Counts per statement type and overall, per status and for all rows."""
    return recon.groupBy("statement_type", "match", "entity_id").count().rollup("statement_type", "match").agg(
        F.sum("count").alias("rows"), F.grouping_id().alias("level"))


def display_rows(recon: DataFrame) -> DataFrame:
    """Zero-source lines hidden; mapping warnings shown as the status."""
    label = F.col("match")
    for status, short in WARNING_LABELS.items():
        label = F.when(F.col("mapping_status") == status, short).otherwise(label)
    return recon.where("mapping_status <> 'Zero source'").select(
        "entity_id", "financials_account", "mapping_key", label.alias("match"), "date", "financials_value",
        "tab_account", "tab_value", "diff",
        F.col("mapping_status").isin(*WARNING_LABELS).alias("warned"))


def eligible_accounts(recon: DataFrame, schedule: DataFrame) -> DataFrame:
    """Accounts to report on: reconciled ones first, then any with a non-zero period."""
    ok = F.col("match").isin(MATCH, MATCH_ZERO, IMMATERIAL) | ((F.col("statement_type") == "IS") & (F.col("match") == DIFF))
    tabs = schedule.select("entity_id", "account").distinct()
    reconciled = (
        recon.where(ok & (F.col("tab_account") != "-"))
        .select("entity_id", F.col("tab_account").alias("account"), F.lit(1).alias("priority"))
        .join(tabs, ["entity_id", "account"], "left_semi")
    )
    active = schedule.where("amount <> 0").select("entity_id", "account", F.lit(2).alias("priority"))
    return reconciled.unionByName(active).groupBy("entity_id", "account").agg(F.min("priority").alias("priority"))


def notes_explaining_diffs(recon: DataFrame, note_values: DataFrame) -> DataFrame:
    """Diffs whose amount a note of the same tab quotes, within max(1, 0.5%).

    Equality on (entity, account) narrows the join; values are distinct first, so
    repeated notes cannot multiply it.
    """
    values = note_values.select("entity_id", "account", "note", F.abs("value").alias("v")).distinct()
    diffs = recon.where(F.col("match") == DIFF).select("entity_id", F.col("tab_account").alias("account"), "diff")
    band = F.greatest(F.lit(1).cast("decimal(24,5)"), F.col("diff") * F.lit(MATERIALITY).cast("decimal(4,3)"))
    return (
        diffs.join(values, ["entity_id", "account"])
        .where(F.abs(F.col("v") - F.col("diff")) <= band)
        .select("entity_id", "account", "diff", "note").distinct()
    )


def report_order(accounts: DataFrame, chart: DataFrame) -> DataFrame:
    """Position of every account in the report: balance sheet, income statement, others; line, name."""
    dim = chart.select(F.col("tab_name").alias("account"), "mapping_key", "statement_type", "category", "line_no")
    by = Window.partitionBy("entity_id").orderBy(
        F.coalesce(F.when(F.col("statement_type") == "BS", 0).when(F.col("statement_type") == "IS", 1), F.lit(2)),
        F.coalesce("line_no", F.lit(9999)), "account")
    return accounts.join(dim, "account", "left").withColumn("position", F.row_number().over(by)).select(
        "entity_id", "account", "mapping_key", "statement_type", "category", "position")


def first_occurrences(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Distinct non-blank values with their first position."""
    text = F.trim(F.coalesce(F.col(value), F.lit("")))
    return rows.withColumn(value, text).where(F.col(value) != "").groupBy(*keys, value).agg(
        F.min(position).alias("first_position"))
