"""Period labels and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PATTERN = "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
CJK_DATE_PATTERN = r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日"


def _month_end(year: Column, month: Column) -> Column:
    valid = month.between(1, 12)
    return F.when(valid, F.last_day(F.make_date(year, F.when(valid, month).otherwise(1), F.lit(1))))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def period_end(label: Column) -> Column:
    """``FY24``, ``9M22``, ``2023年12月31日``, ``2023年1-6月`` or ``2023年`` to its last day; else null."""
    fy, ytd = "^FY([0-9]{2})$", "^([0-9]{1,2})M([0-9]{2})$"
    full, span, year = (r"^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日$", r"^([0-9]{4})年([0-9]{1,2})-([0-9]{1,2})月$",
                        r"^([0-9]{4})年$")
    return (
        F.when(F.rlike(label, F.lit(fy)), _month_end(_part(label, fy, 1) + 2000, F.lit(12)))
        .when(F.rlike(label, F.lit(ytd)), _month_end(_part(label, ytd, 2) + 2000, _part(label, ytd, 1)))
        .when(F.rlike(label, F.lit(full)),
              F.concat_ws("-", *[F.regexp_extract(label, full, g) for g in (1, 2, 3)]).try_cast("date"))
        .when(F.rlike(label, F.lit(span)), _month_end(_part(label, span, 1), _part(label, span, 3)))
        .when(F.rlike(label, F.lit(year)), _month_end(_part(label, year, 1), F.lit(12)))
    )


def parse_date(text: Column, allow_bare_number: bool = True) -> Column:
    """A cell as a date: spreadsheet serials, period labels, ISO and slashed forms.

    With ``allow_bare_number=False`` plain numbers are refused: the reading to
    use while it is still open which row holds the dates.
    """
    t = F.trim(text)
    digits = F.rlike(t, F.lit("^[0-9]+$"))
    bare = F.rlike(F.translate(t, ",.", ""), F.lit("^[0-9]+$"))
    serial = F.when(digits & (F.length(t) == 5), t.try_cast("int"))
    from_serial = F.when(serial.between(20000, 60000), F.date_add(F.lit("1899-12-30").cast("date"), serial))
    slash = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    iso_like = F.translate(t, "/", "-")
    iso = F.when(F.rlike(iso_like, F.lit(r"^[0-9]{4}(-[0-9]{1,2}){0,2}( [0-9:.]+)?$")),
                 F.regexp_extract(iso_like, r"^([0-9-]+)", 1).try_cast("date"))
    us = F.when(F.rlike(t, F.lit(slash)),
                F.concat_ws("-", F.regexp_extract(t, slash, 3), F.regexp_extract(t, slash, 1),
                            F.regexp_extract(t, slash, 2)).try_cast("date"))
    parsed = F.coalesce(from_serial, period_end(t), iso, us)
    return parsed if allow_bare_number else F.when(~bare, parsed)


def months_in_period(end: Column, anchor_month: Column, anchor_day: Column, months: Column | None = None) -> Column:
    """1..11 for a part year, null for a full one."""
    on_anchor = (F.month(end) == anchor_month) & (F.dayofmonth(end) == anchor_day)
    shifted = F.pmod(F.month(end) - anchor_month, F.lit(12))
    derived = F.when(shifted <= 0, F.month(end)).otherwise(shifted)
    with_anchor = F.when(~on_anchor & (derived > 0) & (derived < 12), derived)
    without = F.when(F.month(end) != 12, F.month(end))
    derived_all = F.when(anchor_month.isNotNull(), with_anchor).otherwise(without)
    if months is None:
        return derived_all
    return F.when((months > 0) & (months < 12), months).otherwise(derived_all)


def period_label(end: Column, anchor_month: Column, anchor_day: Column, language: str,
                 months: Column | None = None) -> Column:
    """``FY24`` / ``9M24`` or ``2024年度`` / ``2024年1-9月``."""
    m = months_in_period(end, anchor_month, anchor_day, months)
    after = (F.month(end) > anchor_month) | ((F.month(end) == anchor_month) & (F.dayofmonth(end) > anchor_day))
    year = F.year(end) + F.when(anchor_month.isNotNull() & after, 1).otherwise(0)
    if language == "Chi":
        return (F.when(m.isNotNull(), F.concat(year.cast("string"), F.lit("年1-"), m.cast("string"), F.lit("月")))
                .otherwise(F.concat(year.cast("string"), F.lit("年度"))))
    short = F.lpad((year % 100).cast("string"), 2, "0")
    return F.when(m.isNotNull(), F.concat(m.cast("string"), F.lit("M"), short)).otherwise(F.concat(F.lit("FY"), short))
