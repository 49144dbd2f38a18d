"""Number rules as Column expressions: parsing, display units, tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Display units (fixed values): (floor of the largest figure, label, decimals).
DISPLAY_UNITS = {
    "Chi": ((100000000, "人民币亿元", 2), (10000, "人民币万元", 1), (1, "人民币元", 0)),
    "Eng": ((1000000, "CNY million", 2), (1000, "CNY thousand", 1), (1, "CNY", 0)),
}


def number_text(text: Column) -> Column:
    """Commas out, parentheses to a leading minus."""
    return F.trim(F.translate(F.translate(F.trim(text), ",，)", ""), "(", "-"))


def coerce_numeric(text: Column, to: str = "double") -> Column:
    t = number_text(text)
    return F.when(F.rlike(t, F.lit(NUMBER)), t.try_cast(to))


def parseable_number_text(text: Column) -> Column:
    """Separators between digits out, full-width stops to points."""
    t = F.trim(text)
    for _ in range(2):  # neighbouring separators share a digit, so pass twice
        t = F.regexp_replace(t, "([0-9])[，,、،﹐︐]([0-9])", "$1$2")
    return F.translate(t, "。．", "..")


def display_unit(largest: Column, language: str) -> tuple[Column, Column, Column]:
    """(divisor, label, decimals) for an account whose largest magnitude is given."""
    units = DISPLAY_UNITS[language]
    out = []
    for pos in range(3):
        expr = F.when(largest >= units[0][0], F.lit(units[0][pos]))
        expr = expr.when(largest >= units[1][0], F.lit(units[1][pos])).otherwise(F.lit(units[2][pos]))
        out.append(expr)
    return tuple(out)


def amount_display(value: Column, language: str) -> Column:
    """One figure with its own unit, for running text."""
    size = F.abs(value).cast("double")
    sign = F.when(value < 0, "-").otherwise("")
    if language == "Chi":
        body = (
            F.when(size < 10000, F.concat(F.format_string("%,.0f", size), F.lit("元")))
            .when(size / 10000 >= 10000, F.concat(F.format_string("%.2f", size / 10000 / 10000), F.lit("亿元")))
            .otherwise(F.concat(F.format_string("%.1f", size / 10000), F.lit("万元")))
        )
        text = F.concat(sign, body)
    else:
        body = F.when(size < 1000000, F.format_string("%,.0f", size)).otherwise(
            F.concat(F.format_string("%.1f", size / 1000000), F.lit(" million")))
        text = F.concat(F.lit("CNY"), sign, body)
    return F.when(value.isNull() | (value == 0), "0").otherwise(text)
