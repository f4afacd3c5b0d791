"""Fixed shapes: zone formats, their field offsets, and record schemas.

Offsets are 0-based and end-exclusive, (line, start, end). They are the public ICAO 9303 layouts and are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<"
Span = tuple[int, int, int]


@dataclass(frozen=True)
class Layout:
    """One zone format. checks: name to (field spans, span of its check digit); composite has no digit in visas."""

    name: str
    lines: int
    width: int
    first: str  # letters the first line may begin with
    name_at: Span
    number: Span
    number_check: Span
    nationality: Span
    birth: Span
    sex: Span
    expiry: Span
    optional: tuple[Span, ...]
    personal_check: Span | None = None
    composite: tuple[tuple[Span, ...], Span] | None = None
    overflow: bool = False
    #: Repair ranges by line: (start, end, kind), kind "digit", "letter" or "filler" (both passes), applied in this order.
    repairs: dict[int, tuple[tuple[int, int, str], ...]] = field(default_factory=dict, hash=False)


_LINE2 = {"number": (1, 0, 9), "number_check": (1, 9, 10), "nationality": (1, 10, 13), "birth": (1, 13, 19), "sex": (1, 20, 21), "expiry": (1, 21, 27)}
_HEAD = ((2, 5, "letter"), (5, 0, "name"))
_DATED = ((9, 10, "digit"), (10, 13, "letter"), (13, 20, "digit"), (21, 28, "digit"))

TD3 = Layout(
    "Td3", 2, 44, "P", (0, 5, 44), **_LINE2, optional=((1, 28, 42),), personal_check=(1, 42, 43), composite=(((1, 0, 10), (1, 13, 20), (1, 21, 43)), (1, 43, 44)),
    overflow=True, repairs={0: _HEAD, 1: (*_DATED, (42, 44, "digit"), (28, 42, "filler"))},
)
TD2 = Layout(
    "Td2", 2, 36, "IAC", (0, 5, 36), **_LINE2, optional=((1, 28, 35),), composite=(((1, 0, 10), (1, 13, 20), (1, 21, 35)), (1, 35, 36)),
    overflow=True, repairs={0: _HEAD, 1: (*_DATED, (35, 36, "digit"), (28, 35, "filler"))},
)
TD1 = Layout(
    "Td1", 3, 30, "IAC", (2, 0, 30), (0, 5, 14), (0, 14, 15), (1, 15, 18), (1, 0, 6), (1, 7, 8), (1, 8, 14), ((0, 15, 30), (1, 18, 29)),
    composite=(((0, 5, 30), (1, 0, 7), (1, 8, 15), (1, 18, 29)), (1, 29, 30)), overflow=True,
    repairs={0: ((2, 5, "letter"), (14, 15, "digit"), (15, 30, "filler")), 1: ((0, 7, "digit"), (8, 15, "digit"), (15, 18, "letter"), (29, 30, "digit"), (18, 29, "filler")), 2: ((0, 0, "name"),)},
)
MRV_A = Layout("MrvA", 2, 44, "V", (0, 5, 44), **_LINE2, optional=((1, 28, 44),), repairs={0: _HEAD, 1: _DATED})
MRV_B = Layout("MrvB", 2, 36, "V", (0, 5, 36), **_LINE2, optional=((1, 28, 36),), repairs={0: _HEAD, 1: _DATED})
FORMATS = {x.name: x for x in (TD3, TD2, TD1, MRV_A, MRV_B)}

CHECKS = ("document_number", "date_of_birth", "date_of_expiry", "personal_number", "composite")
CORE_FIELDS = ("document_type", "issuing_country", "document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "personal_number")

_S, _B = T.StringType(), T.BooleanType()
CHECKS_TYPE = T.StructType([T.StructField(c, _B) for c in CHECKS])
ERROR_TYPE = T.StructType([T.StructField("kind", _S), T.StructField("expected", T.IntegerType()), T.StructField("got", T.IntegerType()), T.StructField("detail", _S)])
VALIDITY_TYPE = "struct<dates_well_formed: boolean, in_date: boolean, dob_before_expiry: boolean, days_until_expiry: bigint>"
#: The flat record, and labels of real specimens.
RECORD = T.StructType(
    [T.StructField(c, _S) for c in CORE_FIELDS]
    + [T.StructField("mrz_line", _S), T.StructField("mrz_checksums_valid", _B), T.StructField("extraction_method", _S), T.StructField("issuing_country_name", _S), T.StructField("nationality_name", _S)]
)
HISTORY = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("run_timestamp_unix", T.LongType()), ("git_sha", _S), ("invocation", _S), ("documents", T.LongType()), ("provider_id", _S), ("read_ok_rate", T.DoubleType()),
        ("labelled_documents", T.LongType()), ("field_match_rate", T.DoubleType()), ("mean_cer", T.DoubleType()), ("unsupported_assertion_rate", T.DoubleType()), ("mean_ms", T.DoubleType()),
    )]
)
