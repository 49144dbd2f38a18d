"""Commentary rules as Column expressions: script, amounts, dates, causes, clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.dates import CJK_DATE_PATTERN, ISO_PATTERN
from tieout.functions.labels import CJK, contains_any

# Amount forms in the order they are read; each pass blanks what it took (fixed values).
CURRENCY = r"(?:CNY|RMB|USD|HKD|US\$|\$|人民币|人民幣)"
AMOUNT_PASSES = (
    ("million", rf"(?i)(?:{CURRENCY})?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:million|mn)\b", 1000000),
    ("yi", r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*亿", 100000000),
    ("wan", r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*万", 10000),
    ("currency", rf"(?i){CURRENCY}\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1),
    ("grouped", r"(?:^|[^0-9.])([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?)", 1),
)
#: What a text must hold for a pass to find anything: a look before the costlier pattern.
AMOUNT_HINTS = (("million", "mn"), ("亿",), ("万",), ("cny", "rmb", "usd", "hkd", "$", "人民"), (",",))
BARE_NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
# Causal wording (fixed values).
CAUSAL = (r"(?i)driven by|attributed to|reflect|due to|owing to|as a result|because|"
          r"thanks to|annualis|recurring|did not recur|no material|management (?:said|stated|noted)|"
          r"由于|反映|主要系|主要由于|预计|年化|归因于|得益于")
AMOUNT_TYPE = "decimal(28,4)"


def has_cjk(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(CJK))


def cjk_share(text: Column) -> Column:
    """Share of CJK characters; 0 for empty text."""
    t = F.coalesce(text, F.lit(""))
    kept = F.length(t) - F.length(F.regexp_replace(t, CJK, ""))
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(kept.cast("double") / F.length(t))


def ascii_punctuation(text: Column, keep_stops: bool = False) -> Column:
    out = F.translate(text, "，、", ",,")
    return out if keep_stops else F.translate(out, "。．", "..")


def amounts(text: Column) -> Column:
    """array<decimal>: money amounts in base units, in reading order of the five passes."""
    work, found = F.coalesce(text, F.lit("")), []
    for _, pattern, scale in AMOUNT_PASSES:
        found.append(F.transform(F.regexp_extract_all(work, F.lit(pattern), F.lit(1)), _scaled(F.lit(scale).cast("decimal(9,0)"))))
        work = F.regexp_replace(work, pattern, "  ")
    return F.concat(*found)


def with_amounts(df: DataFrame, text: str, name: str) -> DataFrame:
    """``amounts`` as a column of ``df``, one projection per pass so that no pass repeats the ones before it.

    Hints are looked for once, as a pass only takes text away; what it took is blanked where a later pass may look.
    """
    x = df.withColumn("_w", F.coalesce(F.col(text), F.lit(""))).withColumn("_low", F.lower("_w"))
    x = x.select("*", *[contains_any(F.col("_low"), hint).alias(f"_h{i}") for i, hint in enumerate(AMOUNT_HINTS)]).drop("_low")
    none = F.array().cast(f"array<{AMOUNT_TYPE}>")
    for i, (_, pattern, scale) in enumerate(AMOUNT_PASSES):
        by = F.lit(scale).cast("decimal(9,0)")
        may, later = F.col(f"_h{i}"), [F.col(f"_h{j}") for j in range(i + 1, len(AMOUNT_PASSES))]
        blanks = may & reduce(lambda a, b: a | b, later, F.lit(False))
        x = x.select(*[c for c in x.columns if c != "_w"],
                     F.when(may, F.transform(F.regexp_extract_all("_w", F.lit(pattern), F.lit(1)), _scaled(by))).otherwise(none).alias(f"_a{i}"),
                     F.when(blanks, F.regexp_replace("_w", pattern, "  ")).otherwise(F.col("_w")).alias("_w"))
    found = [f"_a{i}" for i in range(len(AMOUNT_PASSES))]
    return x.withColumn(name, F.concat(*found)).drop("_w", *found, *[f"_h{i}" for i in range(len(AMOUNT_PASSES))])


def _scaled(by: Column):
    return lambda x: (F.replace(x, F.lit(","), F.lit("")).cast("decimal(22,4)") * by).cast(AMOUNT_TYPE)


def with_numbers(df: DataFrame, text: str, name: str) -> DataFrame:
    """As a column of ``df``: money amounts, then every bare number, each once; what a note can vouch for."""
    bare = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({BARE_NUMBER})"), F.lit(1)),
                       lambda x: F.replace(x, F.lit(","), F.lit("")).cast(AMOUNT_TYPE))
    return with_amounts(df, text, "_amounts").withColumn(name, F.array_distinct(F.concat("_amounts", bare))).drop("_amounts")


def quoted_dates(text: Column) -> Column:
    """array<string> of ``yyyy-M-d`` keys for ISO and CJK dates, each once."""
    keys = []
    for pattern in (CJK_DATE_PATTERN, ISO_PATTERN):
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
        keys.append(F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "ymd")]), lambda z: F.concat_ws(
            "-", z["y"].cast("int").cast("string"), z["m"].cast("int").cast("string"), z["d"].cast("int").cast("string"))))
    return F.array_distinct(F.concat(*keys))


def has_causal_language(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(CAUSAL))


# "No cause given" statements assert nothing, so they go before the marker test (fixed values).
NO_CAUSE = (
    "原因未在资料中说明", "原因未在数据中说明", "备注中未提供进一步解释",
    "未在资料中说明原因", "数据中未提供原因", "变动原因未在数据中明确说明",
    "the reason is not set out in the information provided",
    "no reason is given in the information provided",
)
# Wording that claims a cause, driver or expectation (fixed values).
INFERENCE_CJK = ("主要系", "主要由于", "所致", "导致", "预计", "推测", "预期", "反映", "结合其性质",
                 "表明", "拉低", "带动", "归因", "驱动", "原因")
INFERENCE_ENG = ("mainly due to", "driven by", "attributable to", "reflecting", "as a result of",
                 "expected to", "indicates that", "suggests that", "because of", "owing to")


def asserts_inference(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    for phrase in NO_CAUSE:
        body = F.replace(body, F.lit(phrase), F.lit(""))
    return contains_any(body, INFERENCE_CJK) | contains_any(F.lower(body), INFERENCE_ENG)


def strip_reasoning(text: Column) -> Column:
    """Model output without reasoning blocks, closed or cut short."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)<think>.*$", "")
    return F.trim(F.regexp_replace(out, r"(?i)^\s*</think>", ""))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)
