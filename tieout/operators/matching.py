"""Sheets to accounts: fuzzy candidates, ranking, one-to-one assignment, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.labels import contains_any, fuzzy_form, is_compact_cjk
from tieout.functions.similarity import seq_ratio
from tieout.sources.sinks import cut_lineage

# Score parts (fixed values).
TOKEN, ALIAS_IN, CANDIDATE_IN, CJK_IN, CJK_CAP, RATIO_MIN, RATIO_WEIGHT, CAP, EXACT, FLOOR = 18.0, 24.0, 12.0, 40.0, 24.0, 0.70, 40.0, 95.0, 100.0, 45.0


def overlay(base: DataFrame, dynamic: DataFrame, key: str = "mapping_key") -> DataFrame:
    """Dynamic rows replace base rows of the same key."""
    cols = [c for c in base.columns if c != key]
    both = base.withColumn("_p", F.lit(1)).unionByName(dynamic.withColumn("_p", F.lit(0)))
    return both.groupBy(key).agg(F.min_by(F.struct(*cols), "_p").alias("_r")).select(key, "_r.*")


def _word(text: Column, word: str) -> Column:
    return F.rlike(text, F.lit(rf"\b{word}\b"))


def semantic_adjustment(c: Column, a: Column) -> Column:
    """Penalties for words that change what an account is."""
    has = lambda t, w: F.contains(t, F.lit(w))
    cost = F.when((has(c, "non operating") != has(a, "non operating")) & (has(c, "operating") | has(a, "operating")), -42.0).otherwise(0.0)
    nc, na = has(c, "non current"), has(a, "non current")
    cost += F.when(nc != na, -34.0).when((has(c, "current") != has(a, "current")) & ~nc & ~na, -16.0).otherwise(0.0)
    for word, loss in (("other", -18.0), ("payable", -16.0), ("surcharge", -16.0), ("receivable", -16.0)):
        cost += F.when(_word(c, word) != _word(a, word), loss).otherwise(0.0)
    cost += F.when(has(c, "customer") & ~has(a, "customer"), -24.0).otherwise(0.0)
    notes = F.rlike(c, F.lit(r"\bnotes?\b")) != F.rlike(a, F.lit(r"\bnotes?\b"))
    return cost + F.when(notes & _word(c, "receivable") & _word(a, "receivable"), -20.0).when(notes, -12.0).otherwise(0.0)


def _blocks(norm: Column) -> Column:
    tokens = F.filter(F.array_distinct(F.split(norm, " ")), lambda t: t != "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - 1, F.lit(1))), lambda i: F.substring(norm, i, F.lit(2)))
    return F.when(is_compact_cjk(norm), F.array_distinct(F.concat(tokens, grams))).otherwise(tokens)


def fuzzy_candidates(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Scored (workbook, sheet, mapping key) candidates at or above the floor.

    Labels and aliases are reduced to distinct normal forms and joined on shared
    tokens (or CJK bigrams). A pair that shares none scores 40 at most, below the
    floor, so blocking loses nothing.
    """
    lab = labels.select("sheet_name").distinct().withColumn("c", fuzzy_form(F.col("sheet_name")))
    ali = aliases.select("mapping_key", "alias").distinct().withColumn("a", fuzzy_form(F.col("alias")))
    cs, as_ = lab.select("c").distinct(), ali.select("a").distinct()
    pairs = cs.withColumn("b", F.explode(_blocks(F.col("c")))).join(as_.withColumn("b", F.explode(_blocks(F.col("a")))), "b").select("c", "a").distinct()
    split = lambda x: F.filter(F.array_distinct(F.split(x, " ")), lambda t: t != "")
    pairs = pairs.withColumn("ct", split(F.col("c"))).withColumn("at", split(F.col("a"))).withColumn("n", F.size(F.array_intersect("ct", "at")))
    pairs = pairs.withColumn("ratio", seq_ratio("c", "a"))
    base = F.when(F.col("n") > 0, F.col("n") * TOKEN + F.when(F.col("n") == F.size("at"), ALIAS_IN).otherwise(0.0)
                  + F.when(F.col("n") == F.size("ct"), CANDIDATE_IN).otherwise(0.0)).otherwise(0.0)
    cjk = is_compact_cjk(F.col("c")) & is_compact_cjk(F.col("a"))
    inside = F.contains("c", F.col("a")) | F.contains("a", F.col("c"))
    full = base + F.when(cjk & inside, CJK_IN).otherwise(0.0) + F.when(F.col("ratio") >= RATIO_MIN, F.col("ratio") * RATIO_WEIGHT).otherwise(0.0)
    score = (F.when(F.col("c") == F.col("a"), EXACT).when(cjk & ~inside, F.least(base, F.lit(CJK_CAP)))
             .otherwise(F.least(full + semantic_adjustment(F.col("c"), F.col("a")), F.lit(CAP))))
    scored = pairs.withColumn("score", F.round(score, 2)).where(F.col("score") >= FLOOR).select("c", "a", "score")
    best = scored.join(ali, "a").groupBy("c", "mapping_key").agg(F.max_by(F.struct("score", "alias"), F.struct("score", "alias")).alias("s"))
    hits = lab.join(best, "c").select("sheet_name", "mapping_key", "s.score", F.col("s.alias").alias("matched_alias"))
    return labels.select("workbook_id", "sheet_name").join(hits, "sheet_name")


def rank_candidates(candidates: DataFrame, statement: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates ordered by how many periods tie to the statement, mean gap, score, name.

    ``candidates``: entity_id, mapping_key, sheet, score. Differences of one unit count as no gap.
    """
    s = statement.select("entity_id", "mapping_key", "period_end", F.abs("amount").alias("st"))
    t = totals.select("entity_id", "sheet", "period_end", F.abs("amount").alias("tt"))
    gap = F.abs(F.col("st") - F.col("tt"))
    pct = F.when(gap <= 1, 0.0).when(F.col("st") != 0, gap.cast("double") / F.col("st").cast("double")).otherwise(1.0)
    j = candidates.join(s, ["entity_id", "mapping_key"], "left").join(t, ["entity_id", "sheet", "period_end"], "left")
    a = j.groupBy("entity_id", "mapping_key", "sheet", "score").agg(
        F.count_if(gap <= F.greatest(F.lit(1), F.col("st") * F.lit("0.005").cast("decimal(4,3)"))).alias("matches"),
        F.count("tt").alias("periods"), F.round(F.avg(pct), 6).alias("avg_gap"))
    w = Window.partitionBy("entity_id", "mapping_key").orderBy(F.desc("matches"), F.asc_nulls_last("avg_gap"), F.desc("score"), "sheet")
    return a.withColumn("rank", F.row_number().over(w))


# What sets the first candidate apart from the second (fixed values): mean gaps this far apart; a
# smaller distance with this much score; equal gaps with more; names alone.
GAP_CLEAR, GAP_SMALL, GAP_EQUAL = 0.02, 0.005, 0.001
SCORE_SMALL, SCORE_EQUAL, SCORE_NAMES = 5, 20, 3
VERSIONED = r"(?i)\bv\d+\b|version|\bcopy\b"


def decide_candidates(ranked: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """accepted, ambiguous or rejected per key, with the first candidate and the reason.

    ``ranked``: ``by``, sheet, score, matches, periods, avg_gap, rank, matched_alias, exact
    (rank from 1 without ties); ``keys``: ``by``, one row each. A key without candidates is
    rejected, one with a single candidate accepts it. Else the first is accepted if it alone
    is an exact alias, ties more periods to the statement, has the clearly smaller mean gap,
    or, where no figures were compared, leads by score with no sign of several versions of
    one sheet among the first three names. What is left is ambiguous. Null scores count as 0.
    """
    at = lambda i: F.max_by(F.struct("sheet", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("periods", F.lit(0)).alias("periods"),
                                     F.when(F.col("periods") > 0, F.col("avg_gap")).alias("gap"), "matched_alias", F.coalesce("exact", F.lit(False)).alias("exact")), F.when(F.col("rank") == i, 1))
    pair = ranked.where("rank <= 3").groupBy(*by).agg(at(1).alias("a"), at(2).alias("b"), F.bool_or(F.rlike("sheet", F.lit(VERSIONED))).alias("versions"))
    lead, ahead = F.col("a.score") - F.col("b.score"), F.col("b.gap") - F.col("a.gap")
    level = F.col("a.matches") == F.col("b.matches")
    near = level & ((ahead >= GAP_CLEAR) | ((ahead >= GAP_SMALL) & (lead >= SCORE_SMALL)) | ((F.abs(ahead) <= GAP_EQUAL) & (lead >= SCORE_EQUAL)))
    unseen = (F.col("a.periods") == 0) & (F.col("b.periods") == 0)
    several = F.col("versions") & F.col("a.matched_alias").eqNullSafe(F.col("b.matched_alias"))
    reason = (F.when(F.col("a").isNull(), "no candidate").when(F.col("b").isNull(), "only candidate").when(F.col("a.exact") & ~F.col("b.exact"), "exact alias")
              .when((F.col("a.periods") > 0) & (F.col("a.matches") > F.col("b.matches")), "more periods tie").when(near, "smaller gap")
              .when(unseen & (lead > SCORE_NAMES) & ~several, "score").when(unseen & (lead > SCORE_NAMES), "several versions").otherwise("too close"))
    decision = F.when(F.col("reason") == "no candidate", "rejected").when(F.col("reason").isin("several versions", "too close"), "ambiguous").otherwise("accepted")
    return keys.select(*by).join(pair, by, "left").withColumn("reason", reason).select(*by, F.col("a.sheet").alias("sheet"), decision.alias("decision"), "reason")


def assign_one_to_one(candidates: DataFrame) -> DataFrame:
    """Keys pick sheets in order of their best score; a sheet goes to one key per workbook.

    All workbooks advance together. In a round a key is settled when no key before it
    still lists its top sheet; every workbook settles at least one key per round, so there
    are at most as many rounds as keys that chain in one workbook. Each round is a written table.
    """
    first = candidates.groupBy("workbook_id", "mapping_key").agg(F.max("score").alias("top"))
    order = F.struct(F.col("top") * -1, "mapping_key")
    open_ = candidates.join(first, ["workbook_id", "mapping_key"]).select("workbook_id", "mapping_key", "sheet_name", "score", order.alias("prio"))
    open_ = cut_lineage(open_, "assign")
    done = None
    while True:
        pick = open_.groupBy("workbook_id", "mapping_key", "prio").agg(F.max_by("sheet_name", F.struct("score", F.col("sheet_name"))).alias("sheet_name"))
        owner = open_.groupBy("workbook_id", "sheet_name").agg(F.min("prio").alias("owner"))
        settled = cut_lineage(pick.join(owner, ["workbook_id", "sheet_name"]).where("prio = owner").select("workbook_id", "mapping_key", "sheet_name"), "assign")
        done = settled if done is None else done.unionByName(settled)
        open_ = cut_lineage(open_.join(settled.select("workbook_id", "mapping_key"), ["workbook_id", "mapping_key"], "left_anti")
                            .join(settled.select("workbook_id", "sheet_name"), ["workbook_id", "sheet_name"], "left_anti"), "assign")
        if open_.isEmpty():
            return done


def override_issues(requests: DataFrame, sheets: DataFrame, chart: DataFrame) -> DataFrame:
    """Manual overrides with an issue: unknown key, unknown sheet, or a sheet asked for twice (first key keeps it)."""
    r = requests.join(sheets.select("workbook_id", F.col("sheet_name"), F.lit(True).alias("known")), ["workbook_id", "sheet_name"], "left").join(
        chart.select("mapping_key", F.lit(True).alias("mapped")), "mapping_key", "left")
    valid = r.where("known AND mapped").groupBy("workbook_id", "sheet_name").agg(F.min("mapping_key").alias("keeper"))
    x = r.join(valid, ["workbook_id", "sheet_name"], "left")
    return x.select("workbook_id", "sheet_name", "mapping_key", F.when(F.col("mapped").isNull(), "unknown key").when(
        F.col("known").isNull(), "invalid sheet").when(F.col("keeper") != F.col("mapping_key"), "conflict").otherwise("applied").alias("issue"))


def summary_sheet(profiles: DataFrame) -> DataFrame:
    """Financial-summary sheet per workbook: kind, name, then reading order."""
    score = (F.when(F.col("kind") == "financial_summary", 100).otherwise(0) + F.when(F.contains(F.lower("sheet"), F.lit("financials")), 50).otherwise(0)
             - F.when(F.col("kind") == "template_nav", 200).otherwise(0))
    return profiles.withColumn("score", score).groupBy("workbook_id").agg(
        F.min_by(F.struct("sheet", "score"), F.struct(F.col("score") * -1, "sheet")).alias("b"), F.count(F.lit(1)).alias("options")).select("workbook_id", "b.*", "options")


def rollup_match(entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """Roll-up sheet per entity within its portfolio: containment .9, else similarity, +.05, from .45 on.

    ``sheets`` holds the few tabs of one roll-up workbook per portfolio; similarity runs on
    distinct name pairs without containment only, and only where their lengths let it reach
    the floor: at most the shorter name's characters can be shared.
    """
    e = entities.withColumn("en", fuzzy_form(F.col("entity")))
    s = sheets.withColumn("sn", fuzzy_form(F.col("sheet_name")))
    j = e.join(s, "portfolio")
    inside = F.contains("en", F.col("sn")) | F.contains("sn", F.col("en"))
    reach = F.least(F.length("en"), F.length("sn")) * 5 >= F.length("en") + F.length("sn")  # a similarity of .4
    p = j.select("en", "sn").distinct().where(inside | reach).withColumn("score", F.when(inside, 0.9).otherwise(seq_ratio("en", "sn")) + 0.05)
    best = j.join(p.where("score >= 0.45"), ["en", "sn"]).groupBy("portfolio", "entity").agg(
        F.max_by(F.struct("sheet_name", "score"), F.struct("score", "sheet_name")).alias("b"))
    return best.select("portfolio", "entity", "b.sheet_name", F.round("b.score", 4).alias("score"))
