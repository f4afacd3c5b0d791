"""Confidence, integrity findings, promotion of proven fields, and routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.countries import Countries
from ..functions.names import STYLES, encode_name_component, transliterate
from ..schemas import CORE_FIELDS

#: The confidence vocabulary.
PROVEN, STRUCTURAL, PLAUSIBLE, UNSURE, IMPLAUSIBLE, LONG_NAME = 1.0, 0.9, 0.65, 0.5, 0.3, 12
CHECKED = ("document_number", "date_of_birth", "date_of_expiry", "personal_number")
KINDS = {"P": "passport", "I": "id_card"}


FINDINGS = "array<struct<kind: string, field: string, got: string, issuing_country: string, nationality: string, surname_len: int>>"


def uniform(value: float) -> Column:
    return F.struct(*(F.lit(value).cast("float").alias(f) for f in CORE_FIELDS))


def mrz_confidence() -> Column:
    """Fields that a check digit covers are proven; the others are read at fixed places."""
    return F.struct(*(F.lit(PROVEN if f in CHECKED else STRUCTURAL).cast("float").alias(f) for f in CORE_FIELDS))


def looks_like_country_code(c: Column) -> Column:
    return c.rlike(r"\A[A-Z]{3}\z")


def looks_like_a_date(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, r"\A([0-9]+)-([0-9]+)-([0-9]+)\z", i).try_cast("int")
    return F.coalesce(part(1).between(1900, 2999) & part(2).between(1, 12) & part(3).between(1, 31), F.lit(False))


def heuristic_confidence(record: Column) -> Column:
    """Of a model's record: half where nothing is said, more where the value's form is plausible, less where it isn't."""
    plausible = {
        "document_type": lambda v: v.isin("P", "I", "A", "C", "V"),
        "issuing_country": looks_like_country_code,
        "document_number": lambda v: v.rlike(r"\A[A-Za-z0-9]{3,20}\z"),
        "surname": lambda v: F.lit(True),
        "given_names": lambda v: F.lit(True),
        "nationality": looks_like_country_code,
        "date_of_birth": looks_like_a_date,
        "sex": lambda v: v.isin("M", "F", "X"),
        "date_of_expiry": looks_like_a_date,
    }

    def of(f: str) -> Column:
        if f not in plausible:
            return F.lit(UNSURE)
        v = normalize.trim(record[f])
        return F.when(F.coalesce(v, F.lit("")) == "", UNSURE).when(plausible[f](v), PLAUSIBLE).otherwise(IMPLAUSIBLE)

    return F.struct(*(of(f).cast("float").alias(f) for f in CORE_FIELDS))


def missing(record: Column) -> Column:
    """Blank fields, in the fixed order."""
    return F.filter(F.array(*(F.when(normalize.trim(F.coalesce(record[f], F.lit(""))) == "", F.lit(f)) for f in CORE_FIELDS)), lambda x: x.isNotNull())


def document_kind(code: Column) -> Column:
    first = F.substring(code, 1, 1)
    return F.when(first == "P", "passport").when(first == "I", "id_card").otherwise("other")


def _finding(kind: str, **values: Column) -> Column:
    fields = {"field": "string", "got": "string", "issuing_country": "string", "nationality": "string", "surname_len": "int"}
    return F.struct(F.lit(kind).alias("kind"), *(values.get(f, F.lit(None)).cast(t).alias(f) for f, t in fields.items()))


def _present(*findings: Column) -> Column:
    return F.filter(F.array(*findings), lambda x: x.isNotNull())


def line1_findings(m: Column, countries: Countries) -> Column:
    """What contradicts itself in the fields that no check digit covers."""
    issuer, nation = countries.name(m["issuing_country"]), countries.name(m["nationality"])
    digits = lambda c: c.rlike("[0-9]")
    return _present(
        F.when(issuer.isNull(), _finding("unrecognized_issuing_country", got=m["issuing_country"])),
        F.when(
            issuer.isNotNull() & nation.isNotNull() & (m["issuing_country"] != m["nationality"]),
            _finding("issuing_country_nationality_mismatch", issuing_country=m["issuing_country"], nationality=m["nationality"]),
        ),
        F.when((m["given_names"] == "") & (F.octet_length(m["surname"]) > LONG_NAME), _finding("missing_name_separator", surname_len=F.octet_length(m["surname"]))),
        F.when(nation.isNull(), _finding("unrecognized_nationality", got=m["nationality"])),
        F.when(digits(m["surname"]), _finding("non_alphabetic_name", field=F.lit("surname"))),
        F.when(digits(m["given_names"]), _finding("non_alphabetic_name", field=F.lit("given_names"))),
    )


def name_matches(value: Column, zone: Column) -> Column:
    """A name agrees with a zone's if one of the transliteration styles gives it, or it as cut off."""
    want = normalize.collapse_spaces(zone)

    def style(s: str) -> Column:
        got = normalize.collapse_spaces(F.translate(encode_name_component(transliterate(value, s)), "<", " "))
        return (got == want) | ((F.length(want) < F.length(got)) & got.startswith(want))

    out = want == ""
    for s in STYLES:
        out = out | style(s)
    return out


def contradictions(record: Column, m: Column, countries: Countries) -> Column:
    """Where a model's record says otherwise than the zone, in the six fields that no check digit covers; blank sides agree."""
    country = lambda f: ~countries.equivalent(normalize.country_code(record[f], countries), m[f])
    first = lambda c: F.upper(F.substring(c, 1, 1))
    own = normalize.document_type(record["document_type"])
    differ = {
        "document_type": (own != "") & (first(own) != first(m["document_type"])),
        "issuing_country": country("issuing_country"),
        "nationality": country("nationality"),
        "sex": normalize.sex(record["sex"]) != m["sex"],
        "surname": ~name_matches(record["surname"], m["surname"]),
        "given_names": ~name_matches(record["given_names"], m["given_names"]),
    }
    said = lambda f: (normalize.trim(F.coalesce(record[f], F.lit(""))) != "") & (m[f] != "")
    return _present(*(F.when(said(f) & d, _finding("llm_contradicts_mrz_structural", field=F.lit(f))) for f, d in differ.items()))


#: Fields that a finding puts in doubt; "" stands for the field that the finding names.
DOUBTS = {
    "unrecognized_issuing_country": ("issuing_country",),
    "unrecognized_nationality": ("nationality",),
    "issuing_country_nationality_mismatch": ("issuing_country", "nationality"),
    "missing_name_separator": ("surname", "given_names"),
    "non_alphabetic_name": ("",),
    "llm_contradicts_mrz_structural": ("",),
}


def downgraded(confidence: Column, findings: Column) -> Column:
    named = [k for k, fields in DOUBTS.items() if "" in fields]

    def doubted(f: str) -> Column:
        kinds_of = [k for k, fields in DOUBTS.items() if f in fields]
        own = lambda x: x["kind"].isin(*kinds_of) if kinds_of else F.lit(False)
        return F.exists(findings, lambda x: own(x) | (x["kind"].isin(*named) & (x["field"] == f)))

    return F.struct(*(F.when(F.coalesce(doubted(f), F.lit(False)), IMPLAUSIBLE).otherwise(confidence[f]).cast("float").alias(f) for f in CORE_FIELDS))


def kinds(findings: Column) -> Column:
    """Only the kinds: nothing personal."""
    return F.transform(findings, lambda x: x["kind"])


def promotable(m: Column) -> dict[str, Column]:
    """Which fields of a zone are proven well enough to replace a model's."""
    c = m["checks"]
    return {
        "document_number": c["document_number"],
        "date_of_birth": c["date_of_birth"] & (m["date_of_birth_completeness"] == "Complete"),
        "date_of_expiry": c["date_of_expiry"],
        "personal_number": c["personal_number"] & (m["format"] == "Td3") & m["personal_number"].isNotNull(),
    }


def promoted(record: Column, confidence: Column, m: Column) -> tuple[Column, Column]:
    """Record and confidence with the proven fields of the zone."""
    ok = {f: F.coalesce(c, F.lit(False)) for f, c in promotable(m).items()}
    fields = F.struct(*((F.when(ok[f], m[f]).otherwise(record[f]) if f in ok else record[f]).alias(f) for f in CORE_FIELDS))
    trust = F.struct(*((F.when(ok[f], PROVEN).otherwise(confidence[f]) if f in ok else confidence[f]).cast("float").alias(f) for f in CORE_FIELDS))
    return fields, trust


def all_proven(m: Column) -> Column:
    """Whether every field that a check digit covers is proven."""
    out = F.lit(True)
    for c in promotable(m).values():
        out = out & F.coalesce(c, F.lit(False))
    return out


def is_flagged(findings: Column) -> Column:
    return F.coalesce(F.size(findings) > 0, F.lit(False))


def hint(m: Column) -> Column:
    """The proven fields as text for a model's prompt; null without any."""
    parts = [F.when(c, F.concat(F.lit(f"{f}="), m[f])) for f, c in promotable(m).items()]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def fused(df: DataFrame, countries: Countries, record: str = "record", mrz: str = "mrz") -> DataFrame:
    """A model's record joined with the row's zone: findings, confidence and fields. Without a zone the record stays as it is."""
    r, m = F.col(record), F.col(mrz)
    base = heuristic_confidence(r)
    findings = F.concat(line1_findings(m, countries), contradictions(r, m, countries))
    df = df.withColumns({"findings": F.when(m.isNotNull(), findings), "_base": base}).withColumn("_down", downgraded(F.col("_base"), F.coalesce("findings", F.array().cast(FINDINGS))))
    fields, trust = promoted(r, F.col("_down"), m)
    return df.withColumns({"fields": F.when(m.isNotNull(), fields).otherwise(F.struct(*(r[f].alias(f) for f in CORE_FIELDS))), "confidence": F.when(m.isNotNull(), trust).otherwise(F.col("_base"))}).drop("_base", "_down")


def mrz_record(df: DataFrame, countries: Countries, mrz: str = "mrz") -> DataFrame:
    """Zones as records: kind, fields, findings, confidence, missing fields."""
    m = F.col(mrz)
    fields = F.struct(*(m[f].alias(f) for f in CORE_FIELDS))
    df = df.withColumns({"fields": F.when(m.isNotNull(), fields), "findings": F.when(m.isNotNull(), line1_findings(m, countries)), "kind": document_kind(m["document_type"])})
    return df.withColumns({"confidence": downgraded(mrz_confidence(), F.coalesce("findings", F.array().cast(FINDINGS))), "missing": missing(F.col("fields"))})


@dataclass(frozen=True)
class RoutingPolicy:
    """What sends a document on to a costlier reader. By default only a zone that is missing or fails its checks does."""

    on_missing_fields: bool = False
    on_line1_flagged: bool = False
    sanity_floor: float | None = None
    budget: str = "expensive"

    def decide(self, found: Column, valid: Column, flagged: Column, sanity: Column, missing_fields: Column) -> Column:
        """struct<decision, reason, budget>; the first reason that applies."""
        reason = F.when(~found, "mrz_not_found").when(~valid, "mrz_checksum_failed")
        if self.on_line1_flagged:
            reason = reason.when(flagged, "line1_flagged")
        if self.sanity_floor is not None:
            reason = reason.when(sanity < self.sanity_floor, "ocr_below_sanity_floor")
        if self.on_missing_fields:
            reason = reason.when(F.size(missing_fields) > 0, "fields_missing")
        return F.struct(F.when(reason.isNull(), "accept").otherwise("escalate").alias("decision"), reason.alias("reason"), F.when(reason.isNotNull(), self.budget).alias("budget"))


COSTS = ("free", "cheap", "expensive")


class Catalog:
    """Readers by cost. A reader is any function from DataFrame to DataFrame with the record's columns."""

    def __init__(self):
        self._readers: list[tuple[int, str, bool, object]] = []

    def register(self, ident: str, cost: str, reader, deterministic: bool = False) -> Catalog:
        if any(x[1] == ident for x in self._readers):
            raise ValueError(f"{ident} is registered already")
        self._readers.append((COSTS.index(cost), ident, deterministic, reader))
        self._readers.sort(key=lambda x: x[0])  # stable
        return self

    def ids(self) -> list[str]:
        return [x[1] for x in self._readers]

    def readers(self) -> list[tuple[str, object]]:
        return [(x[1], x[3]) for x in self._readers]

    def find(self, budget: str, deterministic: bool | None = None):
        """The cheapest reader within a budget; None without one."""
        return next((x[3] for x in self._readers if x[0] <= COSTS.index(budget) and deterministic in (None, x[2])), None)
