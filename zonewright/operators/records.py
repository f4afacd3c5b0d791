"""Records in both shapes: the flat one, the nested one with confidence and provenance, the lift between them, a model's output as a record, and the zone
reader with its evidence. All native; a broken output is a row with an error, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.checksum import blind_positions
from ..functions.countries import Countries
from ..functions.dates import validity
from ..functions.names import name_field
from ..functions.normalize import trim
from ..schemas import CHECKS, CORE_FIELDS, TD3, VALIDITY_TYPE
from . import fuse, parse
from .ocr_lines import guess_format

#: How a record was read.
BY_ZONE, BY_CLIENT, BY_MODEL = "mrz-deterministic", "mrz-wasm-client", "llm"
FORMAT_NAMES = {"Td3": "td3", "Td2": "td2", "Td1": "td1", "MrvA": "mrv_a", "MrvB": "mrv_b"}
NAMED = (*CORE_FIELDS, "issuing_country_name", "nationality_name")
FLAT = ", ".join(f"{f}: string" for f in (*NAMED, "mrz_line")) + f", mrz_checksums_valid: boolean, validity: {VALIDITY_TYPE}, extraction_method: string"


def _map(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def flat_from_zone(m: Column, countries: Countries, today: str) -> Column:
    """A valid zone as a flat record."""
    fields = {f: m[f] for f in CORE_FIELDS} | {"document_number": F.coalesce(m["document_number_full"], m["document_number"])}
    fields |= {"issuing_country_name": countries.name(m["issuing_country"]), "nationality_name": countries.name(m["nationality"])}
    more = {"mrz_line": F.array_join(m["mrz_lines"], "\n"), "mrz_checksums_valid": parse.all_valid(m["checks"]), "validity": validity(m["date_of_birth"], m["date_of_expiry"], today), "extraction_method": F.lit(BY_ZONE)}
    return F.when(m.isNotNull(), F.struct(*(c.alias(f) for f, c in (fields | more).items())))


def zone_block(m: Column) -> Column:
    """struct<lines, format, checks> of a zone."""
    return F.when(m.isNotNull(), F.struct(F.array_join(m["mrz_lines"], "\n").alias("lines"), _map(FORMAT_NAMES, m["format"]).alias("format"), m["checks"].alias("checks")))


def lifted(v1: Column, model: Column | None = None) -> Column:
    """A flat record in the nested shape. What it never recorded is derived: confidence and provenance from how it was read, the kind of document from its
    code, the zone's format from its lines; all check digits inherit the one flag."""
    method = v1["extraction_method"]
    kind = F.when(method == BY_ZONE, "mrz_checksum").when(method == BY_CLIENT, "wasm_client").otherwise("llm")
    by = F.when(kind == "llm", F.lit("unknown") if model is None else F.coalesce(model, F.lit("unknown")))
    confidence = F.when(method == BY_ZONE, fuse.mrz_confidence()).when(method == BY_CLIENT, fuse.uniform(fuse.PROVEN)).otherwise(fuse.heuristic_confidence(v1))
    lines = F.split(v1["mrz_line"], "\n")
    guess = F.when(v1["mrz_line"].isNotNull(), guess_format(F.filter(lines, lambda x: trim(x) != "")))
    ok = F.coalesce(v1["mrz_checksums_valid"], F.lit(False))
    block = F.struct(v1["mrz_line"].alias("lines"), F.coalesce(guess, F.lit("td3")).alias("format"), F.struct(*(ok.alias(c) for c in CHECKS)).alias("checks"))
    return F.when(
        v1.isNotNull(),
        F.struct(
            F.struct(F.coalesce(fuse.document_kind(v1["document_type"]), F.lit("other")).alias("kind"), guess.alias("mrz_format")).alias("document"),
            F.struct(*(v1[f].alias(f) for f in NAMED)).alias("fields"), confidence.alias("confidence"), F.struct(kind.alias("kind"), by.alias("model")).alias("provenance"),
            F.when(v1["mrz_line"].isNotNull(), block).alias("mrz"), v1["validity"].alias("validity"), method.alias("extraction_method"),
        ),
    )


def nested_from_zone(df: DataFrame, countries: Countries, today: str, mrz: str = "mrz", out: str = "record") -> DataFrame:
    """Zones as nested records: the lift of the flat one, with the exact format and checks, the findings of its first line, and the confidence they leave."""
    m = F.col(mrz)
    df = df.withColumn("_v2", lifted(flat_from_zone(m, countries, today))).withColumn("_found", F.when(m.isNotNull(), fuse.line1_findings(m, countries)))
    down = fuse.downgraded(F.col("_v2.confidence"), F.coalesce("_found", F.array().cast(fuse.FINDINGS)))
    kind = F.struct(F.col("_v2.document.kind").alias("kind"), _map(FORMAT_NAMES, m["format"]).alias("mrz_format"))
    v2 = F.col("_v2").withField("document", kind).withField("mrz", zone_block(m)).withField("line1_integrity", F.col("_found")).withField("confidence", down)
    return df.withColumn(out, F.when(m.isNotNull(), v2)).drop("_v2", "_found")


def with_zone(v2: Column, m: Column) -> Column:
    """A model's nested record with the zone that was read in place of the one it claims; without a zone none."""
    format_ = F.when(m.isNotNull(), _map(FORMAT_NAMES, m["format"]))
    return v2.withField("mrz", zone_block(m)).withField("document", F.struct(v2["document"]["kind"].alias("kind"), format_.alias("mrz_format")))


def checksums_valid(m: Column) -> Column:
    """Null without a zone."""
    return F.when(m.isNotNull(), parse.all_valid(m["checks"]))


def flat_from_nested(v2: Column, valid: Column) -> Column:
    """The flat shape of a nested record. Whether the check digits hold is given by the caller: the nested one can't tell false from unknown."""
    return F.struct(*(v2["fields"][f].alias(f) for f in NAMED), v2["mrz"]["lines"].alias("mrz_line"), valid.alias("mrz_checksums_valid"), v2["validity"].alias("validity"), v2["extraction_method"].alias("extraction_method"))


def view(v2: Column, valid: Column, version: int) -> Column:
    """A record as JSON in the shape that version 1 or 2 asks for."""
    return F.to_json(flat_from_nested(v2, valid), {"ignoreNullFields": "false"}) if version == 1 else F.to_json(v2, {"ignoreNullFields": "true"})


# ---- a model's output ----------------------------------------------------------------------------------


def parsed(raw: Column) -> Column:
    """struct<record, error, repaired> of a model's output: one JSON object as it stands, else after repair. The method is always the model's."""
    fixed = F.when(text.needs_repair(raw), text.repair_json_text(raw)).otherwise(raw)
    value = F.try_parse_json(trim(fixed))
    error = F.when(value.isNull(), "invalid JSON after repair").when(~text.is_json_object(fixed), "model output was valid JSON but not an object")
    record = F.from_json(fixed, f"struct<{FLAT}>").withField("extraction_method", F.lit(BY_MODEL))
    return F.struct(F.when(error.isNull(), record).alias("record"), error.alias("error"), text.needs_repair(raw).alias("repaired"))


def repairs(df: DataFrame, raw: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents and how many outputs had to be repaired."""
    return df.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if(text.needs_repair(F.col(raw))).alias("repair_fallbacks"))


def prompt_ref(ident: str, template: str) -> Column:
    """struct<id, digest> of the prompt a record came from."""
    return F.struct(F.lit(ident).alias("id"), text.prompt_digest(F.lit(template)).alias("digest"))


# ---- the zone reader -----------------------------------------------------------------------------------


def evidence(m: Column, recognized: Column, findings: Column, missing: Column) -> Column:
    """struct of what a reader saw: the zone, its failed checks and blind places, the first line's findings, the text's size, the missing fields."""
    return F.struct(
        m.isNotNull().alias("mrz_found"), F.coalesce(checksums_valid(m), F.lit(False)).alias("mrz_checksums_valid"), F.coalesce(parse.failed(m["checks"]), F.array().cast("array<string>")).alias("mrz_failed"),
        _map(FORMAT_NAMES, m["format"]).alias("mrz_format"), F.when(m.isNotNull(), blind_positions(F.array_join(m["mrz_lines"], "\n"))).alias("blind_positions"),
        F.coalesce(fuse.kinds(findings), F.array().cast("array<string>")).alias("line1_findings"), F.length(recognized).alias("text_chars"),
        F.when(recognized == "", 0).otherwise(F.size(F.split(F.regexp_replace(recognized, r"\r?\n\z", ""), "\n"))).alias("text_lines"), text.page_sanity(recognized).alias("text_sanity"), missing.alias("missing"),
    )


def has_text(e: Column) -> Column:
    return e["text_chars"] > 0


def line1_flagged(e: Column) -> Column:
    return F.size(e["line1_findings"]) > 0


def read_zone(df: DataFrame, countries: Countries, today: str, text_column: str = "text", mrz: str = "mrz") -> DataFrame:
    """The zone reader on scanned texts: adds record (nested; null where no valid zone was found) and evidence."""
    m = F.col(mrz)
    df = nested_from_zone(df, countries, today, mrz)
    valid = F.coalesce(checksums_valid(m), F.lit(False))
    df = df.withColumn("record", F.when(valid, F.col("record")))
    absent = F.when(valid, fuse.missing(F.col("record.fields"))).otherwise(F.array(*map(F.lit, CORE_FIELDS)))
    return df.withColumn("evidence", evidence(m, F.coalesce(text_column, F.lit("")), F.when(valid, F.col("record.line1_integrity")), absent))


def integrity_candidates(m: Column, countries: Countries) -> Column:
    """Names of the candidate checks of a first line that fire, the rejected one of a name field in non-canonical form included."""
    digits = m["surname"].rlike("[0-9]") | m["given_names"].rlike("[0-9]")
    name = F.substring(F.get(m["mrz_lines"], F.lit(0)), TD3.name_at[1] + 1, TD3.name_at[2] - TD3.name_at[1])
    odd = (m["format"] == TD3.name) & (name != name_field(m["surname"], m["given_names"], TD3.name_at[2] - TD3.name_at[1]))
    fired = [F.when(countries.name(m["nationality"]).isNull(), "unrecognized_nationality"), F.when(digits, "non_alphabetic_name"), F.when(odd, "non_canonical_name_field")]
    return F.filter(F.array(*fired), lambda x: x.isNotNull())
