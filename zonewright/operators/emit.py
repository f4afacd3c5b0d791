"""Emitting zones from fields, driven by the same layouts as parsing: every check digit is computed, so what is emitted parses as valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checksum import check_digit, let
from ..functions.names import clean, fixed, name_field
from ..schemas import MRV_A, MRV_B, TD1, TD2, TD3, Layout


def digit(c: Column, width: int | None = None) -> Column:
    return let(c, lambda v: check_digit(v, width).cast("string"))


def doc_number(number: Column, room: int) -> Column:
    """struct<field, check, prefix>: a number beyond 9 characters goes on in front of the optional data if it fits there."""

    def split(c: Column) -> Column:
        long = (F.length(c) > 9) & (F.length(c) - 9 + 2 <= room)
        field = F.rpad(c, 9, "<")
        more = F.concat(F.substr(c, F.lit(10)), digit(c), F.lit("<"))
        return F.struct(field.alias("field"), F.when(long, F.lit("<")).otherwise(digit(field, 9)).alias("check"), F.when(long, more).otherwise("").alias("prefix"))

    return let(clean(F.coalesce(number, F.lit(""))), split)


def sex_char(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.isin("M", "F"), u).otherwise("<")


def emit(layout: Layout, *, document_code: Column, issuing_country: Column, document_number: Column, surname: Column, given_names: Column, nationality: Column, date_of_birth: Column, sex: Column, date_of_expiry: Column, optional: Column | None = None, optional2: Column | None = None) -> Column:
    """The zone's lines, as an array. Dates are YYMMDD; optional is the personal number or optional data."""
    optional = F.lit("") if optional is None else F.coalesce(optional, F.lit(""))
    optional2 = F.lit("") if optional2 is None else F.coalesce(optional2, F.lit(""))
    room = layout.optional[0][2] - layout.optional[0][1]
    plain = let(fixed(document_number, 9), lambda n: F.struct(n.alias("field"), digit(n, 9).alias("check"), F.lit("").alias("prefix")))
    dated = lambda c: let(fixed(c, 6), lambda v: F.concat(v, digit(v, 6)))
    head = F.concat(fixed(document_code, 2), fixed(issuing_country, 3))
    people = name_field(surname, given_names, layout.name_at[2] - layout.name_at[1])
    nation = fixed(nationality, 3)

    def lines_of(n: Column) -> Column:
        data = F.rpad(F.concat(n["prefix"], clean(optional)), room, "<")
        if layout.lines == 3:
            first = F.concat(head, n["field"], n["check"], data)
            return F.array(first, F.concat(dated(date_of_birth), sex_char(sex), dated(date_of_expiry), nation, fixed(optional2, 11)), people)
        if layout.personal_check:
            data = let(data, lambda d: F.concat(d, digit(d, room)))
        return F.array(F.concat(head, people), F.concat(n["field"], n["check"], nation, dated(date_of_birth), sex_char(sex), dated(date_of_expiry), data))

    out = let(doc_number(document_number, room) if layout.overflow else plain, lines_of)
    if not layout.composite:
        return out
    spans, at = layout.composite

    def closed(lines: Column) -> Column:
        parts = F.concat(*(F.substring(lines[n], s + 1, e - s) for n, s, e in spans))
        last = digit(parts, sum(e - s for _, s, e in spans))
        return F.array(*(F.concat(lines[k], last) if k == at[0] else lines[k] for k in range(layout.lines)))

    return let(out, closed)


def zone(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def format_td3(**fields) -> Column:
    return zone(emit(TD3, **fields))


def format_td2(**fields) -> Column:
    return zone(emit(TD2, **fields))


def format_td1(**fields) -> Column:
    return zone(emit(TD1, **fields))


def format_mrv_a(**fields) -> Column:
    return zone(emit(MRV_A, **fields))


def format_mrv_b(**fields) -> Column:
    return zone(emit(MRV_B, **fields))
