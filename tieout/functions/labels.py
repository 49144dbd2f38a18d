"""Label rules as Column expressions: normal forms, stages, units, row types, categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and limits the results depend on.
SKIP_KEYWORDS = (
    "subtotal", "sub-total", "sub total", "gross profit", "gross loss", "operating profit",
    "operating loss", "profit/(loss) before taxation", "profit before taxation",
    "loss before taxation", "net profit", "net loss",
    "合计", "总计", "小计", "毛利", "营业利润", "利润总额", "净利润", "亏损",
)
TOTAL_KEYWORDS = ("total", "总计", "合计", "總計", "合計")
SUBTOTAL_KEYWORDS = ("subtotal", "sub-total", "sub total", "小计", "小計")
COMPANY_TOKENS = ("有限公司", "股份", "基金", "公司")
STAGES = (
    ("Indicative adjusted", ("indicative adjusted", "indivative adjusted", "示意性调整后",
                             "示意性調整後", "示意性调整数", "示意性調整數")),
    ("Indicative adjustment", ("indicative adjustment", "indivative adjustment", "示意性调整", "示意性調整")),
    ("Audited", ("audited", "审定数", "審定數")),
    ("Audit adjustment", ("audit adjustment", "审计调整", "審計調整")),
    ("Mgt acc", ("mgt acc", "management account", "管理层数", "管理層數")),
)
STAGE_MAX_CHARS = 35
THOUSAND_MARKERS = ("cny'000", "rmb'000", "usd'000", "hkd'000", "人民币千元", "人民幣千元")
UNIT_MARKERS = ("CNY'000", "USD'000", "HKD'000", "人民币千元", "人民幣千元", "million", "百万", "百萬")
REVENUE_WORDS = ("income", "revenue", "sale", "gain", "收益", "收入")
EQUITY_WORDS = ("capital", "reserve", "earnings", "equity", "股本", "资本", "留存", "未分配利润")
LIABILITY_WORDS = ("loan", "borrowing", "payable", "liability", "tax", "借款", "应付", "负债", "負債")
LONG_TERM_WORDS = ("long term", "long-term", "non current", "non-current", "长期", "非流动", "非流動")
NON_CURRENT_ASSET_WORDS = (
    "property", "fixed asset", "intangible", "deferred", "investment", "长期", "非流动", "非流動",
    "固定资产", "固定資產", "无形资产", "無形資產", "投资",
)
EXPENSE_CATEGORY_WORDS = ("expense", "loss", "cost")
EXPENSE_NAME_WORDS = ("loss", "expense", "cost", "损失", "费用", "成本")
CJK = "[一-鿿]"


def contains_any(text: Column, words) -> Column:
    """True where ``text`` holds at least one of ``words`` (plain substrings)."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def clean_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def fuzzy_form(text: Column) -> Column:
    """Lower case, ``&`` spelled out, symbols to spaces, four plural nouns made singular."""
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "&", " and ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for plural, single in (("expenses", "expense"), ("payables", "payable"),
                           ("receivables", "receivable"), ("properties", "property")):
        out = F.regexp_replace(out, rf"\b{plural}\b", single)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def alias_form(text: Column) -> Column:
    """Lower case without colons and brackets; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[：:（）()]", ""), r"\s+", " "))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fuzzy_form(text), " "), lambda t: t != ""))


def is_compact_cjk(text: Column) -> Column:
    return F.rlike(fuzzy_form(text), F.lit(f"^{CJK}+$"))


def stage_of(text: Column) -> Column:
    """Canonical reporting stage, or null."""
    t = F.lower(clean_spaces(text))
    out = F.when((t == "") | (F.length(t) > STAGE_MAX_CHARS), F.lit(None).cast("string"))
    for name, variants in STAGES:
        out = out.when(contains_any(t, variants), F.lit(name))
    return out


def has_thousand_marker(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), THOUSAND_MARKERS)


def has_unit_marker(text: Column) -> Column:
    return contains_any(F.lower(clean_spaces(text)), [m.lower() for m in UNIT_MARKERS])


def unit_multiplier(text: Column) -> Column:
    return F.when(has_thousand_marker(text), 1000).otherwise(1)


def row_type(description: Column) -> Column:
    low = F.lower(description)
    return (
        F.when(low.startswith("of which") | low.startswith("其中"), "breakdown")
        .when(contains_any(low, SUBTOTAL_KEYWORDS), "subtotal")
        .when(contains_any(low, TOTAL_KEYWORDS), "total")
        .when(F.rlike(description, F.lit(r"^\d{6,}")), "breakdown")
        .when(contains_any(description, COMPANY_TOKENS), "breakdown")
        .otherwise("detail")
    )


def is_skip_label(text: Column) -> Column:
    """Totals and profit lines that never map to a schedule tab."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    return (t != "") & (low.startswith("total ") | contains_any(low, SKIP_KEYWORDS))


def category_of(name: Column, statement_type: Column) -> Column:
    n = fuzzy_form(name)
    income = F.when(contains_any(n, REVENUE_WORDS), "Revenue").otherwise("Expenses")
    balance = (
        F.when(contains_any(n, EQUITY_WORDS), "Equity")
        .when(contains_any(n, LIABILITY_WORDS) & contains_any(n, LONG_TERM_WORDS), "Non-current liabilities")
        .when(contains_any(n, LIABILITY_WORDS), "Current liabilities")
        .when(contains_any(n, NON_CURRENT_ASSET_WORDS), "Non-current assets")
        .otherwise("Current assets")
    )
    return F.when(statement_type == "IS", income).otherwise(balance)


def compares_as_magnitude(name: Column, category: Column) -> Column:
    """Income-statement cost lines tie out on size, not on sign."""
    return (contains_any(F.lower(F.trim(F.coalesce(category, F.lit("")))), EXPENSE_CATEGORY_WORDS)
            | contains_any(F.lower(F.trim(F.coalesce(name, F.lit("")))), EXPENSE_NAME_WORDS))


# Placeholder tokens, tried in this order (fixed values).
PLACEHOLDERS = (
    ("_status", ""), ("_type", ""), ("_name", ""), ("_code", ""), ("_id", ""),
    ("leasing_status_status", "租赁状态"), ("leasing_", "租赁"), ("status_", ""), (r"_\w+_\w+", ""),
)


def clean_placeholders(text: Column) -> Column:
    out = text
    for pattern, replacement in PLACEHOLDERS:
        out = F.regexp_replace(out, f"(?i){pattern}", replacement)
    again = F.regexp_replace(out, r"[a-zA-Z]+_[a-zA-Z_]+", "")
    return F.trim(F.when(F.rlike(out, F.lit("[a-zA-Z_]{3,}")), again).otherwise(out))
