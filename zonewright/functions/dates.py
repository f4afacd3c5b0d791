"""Dates of zones and of free text. They stay ISO strings; calendar questions go through try_to_date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIVOT = 26


def expand_date(c: Column, birth: bool | Column, pivot: int = PIVOT) -> Column:
    """YYMMDD to YYYY-MM-DD without a calendar check; other texts stay. A birth year above the pivot is of the 1900s, all else of the 2000s."""
    birth = F.lit(birth) if isinstance(birth, bool) else birth
    century = F.when(birth & (F.substring(c, 1, 2).try_cast("int") > pivot), "19").otherwise("20")
    iso = F.concat(century, F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 2), F.lit("-"), F.substring(c, 5, 2))
    return F.when(c.rlike(r"\A[0-9]{6}\z"), iso).otherwise(c)


def date_completeness(c: Column) -> Column:
    return F.when(c.rlike(r"\A[0-9]{6}\z"), "Complete").when(c.rlike(r"\A<{6}\z"), "Unknown").when(c.rlike(r"\A[0-9<]{6}\z"), "PartiallyUnknown").otherwise("Malformed")


def parse_iso(c: Column) -> Column:
    """A date if the text is exactly YYYY-MM-DD and exists."""
    return F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


def is_leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_month(y: Column, m: Column) -> Column:
    """0 for a month that doesn't exist."""
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(is_leap_year(y), 29).otherwise(28)).when(m.between(1, 12), 31).otherwise(0)


def is_well_formed(y: Column, m: Column, d: Column) -> Column:
    return m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m))


def to_epoch_days(c: Column) -> Column:
    return F.unix_date(parse_iso(c)).cast("long")


def from_epoch_days(n: Column) -> Column:
    return F.date_format(F.date_from_unix_date(n.cast("int")), "yyyy-MM-dd")


def validity(birth: Column, expiry: Column, today: str) -> Column:
    """struct of four: both dates exist; not yet expired; born before expiry; days until expiry. today is an argument, not the clock."""
    b, e = parse_iso(birth), parse_iso(expiry)
    days = F.date_diff(e, F.lit(today).cast("date")).cast("long")
    return F.struct(
        (b.isNotNull() & e.isNotNull()).alias("dates_well_formed"), F.coalesce(days >= 0, F.lit(False)).alias("in_date"), F.coalesce(b < e, F.lit(False)).alias("dob_before_expiry"), days.alias("days_until_expiry")
    )


def all_ok(v: Column) -> Column:
    """Of a validity(): the dates exist, in order, and the document hasn't expired."""
    return v["dates_well_formed"] & v["in_date"] & v["dob_before_expiry"]


def normalize_date(c: Column) -> Column:
    """YYYYMMDD, Y-M-D or D.M.Y with - . or / to ISO, for years 1900 to 2999, months to 12 and days to 31; other texts only trimmed."""
    t = F.trim(c)
    ymd = r"\A([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})\z"
    dmy = r"\A([0-9]{1,2})[-./]([0-9]{1,2})[-./]([0-9]{4})\z"
    part = lambda p, i: F.regexp_extract(t, p, i)
    flat = r"\A([0-9]{4})([0-9]{2})([0-9]{2})\z"
    pick = lambda a, b, d: F.when(t.rlike(flat), part(flat, a)).when(t.rlike(ymd), part(ymd, b)).when(t.rlike(dmy), part(dmy, d))
    y, m, d = pick(1, 1, 3), pick(2, 2, 2), pick(3, 3, 1)
    n = lambda x: x.try_cast("int")
    ok = n(y).between(1900, 2999) & n(m).between(1, 12) & n(d).between(1, 31)
    return F.when(ok, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(t)
