"""Strict parsing of zone lines into records, driven by the formats' layouts. Errors are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksum import char_value, check_digit, is_mrz_charset, let, rtrim_filler, verify
from ..functions.countries import Countries
from ..functions.dates import PIVOT, date_completeness, expand_date
from ..schemas import CHECKS, FORMATS, Layout, Span


def cut(lines: list[Column], at: Span) -> Column:
    return F.substring(lines[at[0]], at[1] + 1, at[2] - at[1])


def _width(*spans: Span) -> int:
    return sum(e - s for _, s, e in spans)


def overflow(number: Column, check: Column, optional: Column) -> Column:
    """struct<full, ok, legacy, consumed> of a document number that goes on in the optional data; null if it doesn't.

    The check digit's place is a filler then; the optional data begin with the rest, its check digit and a filler. The older form keeps
    8 characters of the number in front.
    """
    end = F.instr(optional, "<") - 1
    there = (check == "<") & (rtrim_filler(number) != "") & (end >= 2) & F.substr(optional, end, F.lit(1)).rlike("^[0-9]$")

    def read(x: Column) -> Column:
        old_form = number.endswith("<") & verify(x["old"], x["digit"])
        done = lambda y: F.struct(
            F.when(y["old_ok"], x["old"]).otherwise(x["spec"]).alias("full"), (y["spec_ok"] | y["old_ok"]).alias("ok"), y["old_ok"].alias("legacy"), (x["end"] + 1).alias("consumed")
        )
        return let(let(verify(x["spec"], x["digit"]), lambda v: F.struct(v.alias("spec_ok"), (~v & old_form).alias("old_ok"))), done)

    rest = F.substr(optional, F.lit(1), end - 1)
    forms = F.struct(F.concat(number, rest).alias("spec"), F.concat(rtrim_filler(F.substring(number, 1, 8)), rest).alias("old"), F.substr(optional, end, F.lit(1)).alias("digit"), end.alias("end"))
    return F.when(there, let(forms, read))


def names(field: Column) -> tuple[Column, Column]:
    """Surname and given names: the parts before and after the first double filler."""
    body = rtrim_filler(field)
    at = F.instr(body, "<<")
    tidy = lambda c: F.trim(F.translate(c, "<", " "))
    return tidy(F.when(at > 0, F.substr(body, F.lit(1), at - 1)).otherwise(body)), tidy(F.when(at > 0, F.substr(body, at + 2)).otherwise(""))


def error(lines: list[Column], layout: Layout) -> Column:
    """struct<kind, expected, got, detail> of the first fault, line by line: length, then characters; the document code last. Null if none."""
    fault = lambda kind, got=None, detail=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(layout.width if kind == "BadLength" else None).cast("int").alias("expected"),
        (F.lit(None).cast("int") if got is None else got).alias("got"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )
    out = F.lit(None)
    conditions = []
    for line in lines:
        conditions.append((F.octet_length(line) != layout.width, fault("BadLength", F.octet_length(line))))
        conditions.append((~is_mrz_charset(line), fault("BadCharacter", None, F.regexp_extract(line, "([^A-Z0-9<])", 1))))
    conditions.append((~F.substring(lines[0], 1, 1).isin(*layout.first), fault("BadDocumentCode", None, F.substring(lines[0], 1, 2))))
    out = F.when(*conditions[0])
    for condition, value in conditions[1:]:
        out = out.when(condition, value)
    return F.when(F.greatest(*(x.isNull() for x in lines)) if len(lines) > 1 else lines[0].isNull(), fault("NotFound")).otherwise(out)


def overflow_of(lines: list[Column], layout: Layout) -> Column:
    at = lambda s: cut(lines, s)
    return overflow(at(layout.number), at(layout.number_check), at(layout.optional[0]))


def checks(lines: list[Column], layout: Layout, over: Column | None = None) -> dict[str, Column]:
    """The five results; a check that a format lacks holds. over: overflow_of() the lines, if it is at hand."""
    at = lambda s: cut(lines, s)
    plain = verify(at(layout.number), at(layout.number_check), 9)
    if layout.overflow:
        plain = F.coalesce((overflow_of(lines, layout) if over is None else over)["ok"], plain)
    after = lambda s: (s[0], s[2], s[2] + 1)
    out = {"document_number": plain, "date_of_birth": verify(at(layout.birth), at(after(layout.birth)), 6), "date_of_expiry": verify(at(layout.expiry), at(after(layout.expiry)), 6)}
    out["personal_number"] = verify(at(layout.optional[0]), at(layout.personal_check), _width(*layout.optional)) if layout.personal_check else F.lit(True)
    if layout.composite:
        spans, digit = layout.composite
        out["composite"] = let(F.concat(*map(at, spans)), lambda v: verify(v, at(digit), _width(*spans)))
    else:
        out["composite"] = F.lit(True)
    return {c: out[c] for c in CHECKS}


def parse(lines: list[Column], layout: Layout, pivot: int = PIVOT) -> Column:
    """struct of a zone's fields and checks; null where error() isn't."""
    over = overflow_of(lines, layout) if layout.overflow else F.lit(None).cast("struct<full: string, ok: boolean, legacy: boolean, consumed: int>")
    return F.when(error(lines, layout).isNull(), let(over, lambda o: _fields(lines, layout, pivot, o)))


def _fields(lines: list[Column], layout: Layout, pivot: int, o: Column) -> Column:
    at = lambda s: cut(lines, s)
    surname, given = names(at(layout.name_at))
    number = rtrim_filler(at(layout.number))
    consumed = F.lit(0)
    full, legacy = F.lit(None).cast("string"), F.lit(False)
    if layout.overflow:
        full, legacy, consumed = rtrim_filler(o["full"]), F.coalesce(o["legacy"], F.lit(False)), F.coalesce(o["consumed"], F.lit(0))
    tails = [rtrim_filler(F.substr(at(layout.optional[0]), consumed + 1)), *(rtrim_filler(at(s)) for s in layout.optional[1:])]
    personal = tails[0] if len(tails) == 1 else F.array_join(F.filter(F.array(*tails), lambda x: x != ""), " ")
    letter = at(layout.sex)
    fields = {
        "format": F.lit(layout.name),
        "document_type": rtrim_filler(F.substring(lines[0], 1, 2)),
        "issuing_country": rtrim_filler(F.substring(lines[0], 3, 3)),
        "document_number": number,
        "document_number_full": full,
        "document_number_legacy_encoding": legacy,
        "surname": surname,
        "given_names": given,
        "nationality": rtrim_filler(at(layout.nationality)),
        "date_of_birth": expand_date(at(layout.birth), True, pivot),
        "date_of_birth_completeness": date_completeness(at(layout.birth)),
        "sex": F.when(letter.isin("M", "F"), letter).otherwise("X"),
        "date_of_expiry": expand_date(at(layout.expiry), False),
        "personal_number": F.nullif(personal, F.lit("")),
        "mrz_lines": F.array(*lines),
    }
    results = F.struct(*(v.alias(c) for c, v in checks(lines, layout, o).items()))
    return F.struct(*(v.alias(c) for c, v in fields.items()), results.alias("checks"))


def failed(checks_column: Column) -> Column:
    """Names of the checks that fail, in their order."""
    return F.filter(F.array(*(F.when(~checks_column[c], F.lit(c)) for c in CHECKS)), lambda x: x.isNotNull())


def score(checks_column: Column) -> Column:
    return sum((checks_column[c].cast("int") for c in CHECKS), F.lit(0))


def all_valid(checks_column: Column) -> Column:
    return score(checks_column) == len(CHECKS)


def with_names(df: DataFrame, countries: Countries, column: str = "mrz") -> DataFrame:
    """Adds the full document number and the names of the two countries."""
    c = F.col(column)
    return df.withColumns(
        {
            "full_document_number": F.coalesce(c["document_number_full"], c["document_number"]),
            "issuing_country_name": countries.name(c["issuing_country"]),
            "nationality_name": countries.name(c["nationality"]),
        }
    )


def parse_by_format(df: DataFrame, format_column: str, lines: str = "mrz_lines", pivot: int = PIVOT) -> DataFrame:
    """Parses each row by its labelled format, not by a guess: adds mrz and error."""
    value = fault = None
    for f in FORMATS.values():
        own = [F.try_element_at(F.col(lines), F.lit(i + 1)) for i in range(f.lines)]
        is_f = F.col(format_column) == f.name
        value = F.when(is_f, parse(own, f, pivot)) if value is None else value.when(is_f, parse(own, f, pivot))
        fault = F.when(is_f, error(own, f)) if fault is None else fault.when(is_f, error(own, f))
    return df.withColumns({"mrz": value, "error": fault})


__all__ = ["all_valid", "char_value", "check_digit", "checks", "cut", "error", "failed", "names", "overflow", "parse", "parse_by_format", "score", "with_names"]
