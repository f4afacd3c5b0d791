"""Normal forms of values that a model or a person wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .countries import Countries
from .dates import normalize_date

#: Long forms and their codes.
SEXES = {"MALE": "M", "FEMALE": "F", "UNSPECIFIED": "X", "UNKNOWN": "X", "OTHER": "X"}
TYPES = {"PASSPORT": "P", "IDENTITY CARD": "I", "ID CARD": "I", "NATIONAL IDENTITY CARD": "I", "NATIONAL ID": "I", "VISA": "V"}


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def _coded(c: Column, codes: dict[str, str]) -> Column:
    up = F.upper(trim(c))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[up], up)


def sex(c: Column) -> Column:
    return _coded(c, SEXES)


def document_type(c: Column) -> Column:
    return _coded(c, TYPES)


def country_code(c: Column, countries: Countries) -> Column:
    """Three letters or D in upper case; a known name's code; else as it was."""
    t = trim(c)
    return F.when(t.rlike(r"\A([A-Za-z]{3}|[Dd])\z"), F.upper(t)).otherwise(F.coalesce(countries.code_for_name(t), t))


def collapse_spaces(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def given_names(c: Column) -> Column:
    return F.upper(collapse_spaces(F.translate(c, "<-", "  ")))


def record(df: DataFrame, countries: Countries) -> DataFrame:
    """All fields of a record; doing it twice changes nothing."""
    return df.withColumns(
        {
            "document_type": document_type(F.col("document_type")),
            "issuing_country": country_code(F.col("issuing_country"), countries),
            "nationality": country_code(F.col("nationality"), countries),
            "given_names": given_names(F.col("given_names")),
            "date_of_birth": normalize_date(F.col("date_of_birth")),
            "date_of_expiry": normalize_date(F.col("date_of_expiry")),
            "sex": sex(F.col("sex")),
        }
    )
