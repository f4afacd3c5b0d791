"""The reader benchmark: every registered reader on every document, and its reports. A reader is a function from DataFrame to DataFrame that keeps the key
and adds `read` (a struct of the core fields, null where it read nothing) and `ms`; a document's failure is a null read."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ALPHABET, CORE_FIELDS
from . import evaluate
from .fuse import Catalog
from .jobs import option
from .scan import score, search


def reads(documents: DataFrame, catalog: Catalog, key: str = "doc_id", keep: tuple[str, ...] = ("truth", "text", "mrz_found")) -> DataFrame:
    """(provider, key, kept columns, read, ms) for every document and reader: a union of the readers' outputs, so no pairs are formed or shuffled."""
    each = [reader(documents).select(F.lit(ident).alias("provider"), key, *keep, "read", F.col("ms").cast("double").alias("ms")) for ident, reader in catalog.readers()]
    return reduce(DataFrame.unionByName, each)


def report(found: DataFrame) -> DataFrame:
    """Per reader: documents, reads, labelled documents, field match rate, mean CER, unsupported assertions by anchoring, and mean, p50, p95 of the time."""
    base = found.groupBy("provider").agg(
        F.count("*").alias("documents"), F.count("read").alias("read_ok"), F.count("truth").alias("labelled_documents"), (F.count("read") / F.count("*")).alias("read_ok_rate")
    )
    accuracy = evaluate.field_accuracy(found.filter("truth is not null"))
    said = evaluate.unsupported_assertions(found).groupBy("provider").pivot("bucket", ["all", "anchored", "unanchored"]).agg(F.first("assertions").alias("assertions"), F.first("unsupported_rate").alias("unsupported_rate"))
    times = evaluate.nearest_rank(found, "ms", {"p50_ms": 0.5, "p95_ms": 0.95}, ("provider",)).withColumnsRenamed({"mean": "mean_ms"}).drop("n")
    return base.join(accuracy, "provider", "left").join(said, "provider", "left").join(times, "provider", "left")


def details(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per reader and document: whether it read, which fields differ from the label, and which no text supports."""
    wrong = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col("truth")[f].alias("t"), F.col("read")[f].alias("r")) for f in CORE_FIELDS)), lambda x: (F.coalesce(x["t"], F.lit("")) != "") & ~x["t"].eqNullSafe(x["r"]))
    rows = found.select("provider", key, "text", "read", F.col("read").isNotNull().alias("read_ok"), F.transform(wrong, lambda x: x["field"]).alias("wrong_fields"))
    return rows.select("provider", key, "read_ok", "wrong_fields", evaluate.unsupported_fields(F.col("read"), F.col("text")).alias("unsupported_fields"))


def by_class(df: DataFrame, n: int, column: str = "specimen_class") -> DataFrame:
    """The n largest classes, of equal ones the first by name."""
    return df.groupBy(column).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), column).limit(n)


def register(spark: SparkSession) -> None:
    """SQL functions icao_check_digit(text), -1 where a character has no value, and parse_mrz_text(text), a struct of ok, valid, format, lines and the zone's
    plain fields. The first is a SQL expression; the second searches on Arrow batches, as scan() does."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION icao_check_digit(field STRING) RETURNS INT RETURN CASE WHEN field RLIKE '^[A-Z0-9<]*$' THEN
      CASE WHEN field = '' THEN 0 ELSE aggregate(sequence(1, length(field)), 0, (a, i) -> a + (instr('{ALPHABET}', substr(field, i, 1)) - 1) % 36 * element_at(array(7, 3, 1), (i - 1) % 3 + 1)) % 10 END ELSE -1 END""")

    @F.pandas_udf("ok boolean, valid boolean, format string, lines array<string>")
    def parse_mrz_text(texts: pd.Series) -> pd.DataFrame:
        found = [search(t) for t in texts]
        rows = [(x is not None, x is not None and score(x[1], x[0]) == 5, x and x[0].name, x and list(x[1])) for x in found]
        return pd.DataFrame(rows, columns=["ok", "valid", "format", "lines"])

    spark.udf.register("parse_mrz_text", parse_mrz_text)


def options(conf: dict[str, str]) -> Column:
    """A job's options as one struct: how many documents run at once, whether the model gets the zone's hint, and the audit log's folder."""
    return F.struct(F.lit(option(conf, "workers", 4)).alias("workers"), F.lit(conf.get("mrz_hint", "") == "1").alias("mrz_hint"), F.lit(conf.get("audit_log")).cast("string").alias("audit_log"))
