"""Zones and records derived from the star schema's orders and customers, the same in Spark and in SQL, so that every result has an independent check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.emit import emit
from ..schemas import ALPHABET, MRV_A, MRV_B, TD1, TD2, TD3

STATES = ("UTO", "DEU", "FRA", "ITA", "ESP", "POL", "HRV", "SRB", "NLD", "SWE", "CHE", "AUT")
CODES = {"Td3": "P", "Td2": "I", "Td1": "I", "MrvA": "V", "MrvB": "V"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer pieces than there are cores is dealt out to all of them before work on its rows; others stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order: (doc_id, num, surname, given, issuer, dob, exp, sex, personal, segment), dates as YYMMDD."""
    o, c = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")), table(spark, sf_dir, "customer")
    y, rest = F.year("o_orderdate"), F.date_format("o_orderdate", "MMdd")
    yy = lambda n: F.lpad(((y + n) % 100).cast("string"), 2, "0")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc_id"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("num"), F.col("c_mktsegment").alias("surname"),
        F.concat(F.lit("NATION "), F.chr(F.col("c_nationkey") % 26 + 65)).alias("given"), F.element_at(F.array(*map(F.lit, STATES)), F.col("c_nationkey") % 12 + 1).alias("issuer"),
        F.concat(yy(-30), rest).alias("dob"), F.concat(yy(35), rest).alias("exp"), F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("X")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("sex"),
        F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("personal"), F.col("c_mktsegment").alias("segment"),
    )


HOLDERS = f"""h AS (
  SELECT o_orderkey AS doc_id, lpad(o_orderkey::VARCHAR, 9, '0') AS num, c_mktsegment AS surname, 'NATION ' || chr((65 + c_nationkey % 26)::INTEGER) AS given,
    ({list(STATES)!r})[(c_nationkey % 12 + 1)::INTEGER] AS issuer, lpad(((year(o_orderdate) - 30) % 100)::VARCHAR, 2, '0') || strftime(o_orderdate, '%m%d') AS dob,
    lpad(((year(o_orderdate) + 35) % 100)::VARCHAR, 2, '0') || strftime(o_orderdate, '%m%d') AS exp, (['M', 'F', 'X'])[(o_custkey % 3 + 1)::INTEGER] AS sex,
    lpad(c_custkey::VARCHAR, 7, '0') AS personal, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def zone_of(layout, number=None):
    """The zone's lines for a holders row."""
    number = F.col("num") if number is None else number
    more = {"optional2": F.col("personal")} if layout is TD1 else {"optional": F.col("personal")} if layout in (TD3, TD2) else {}
    return emit(layout, document_code=F.lit(CODES[layout.name]), issuing_country=F.col("issuer"), document_number=number, surname=F.col("surname"), given_names=F.col("given"), nationality=F.col("issuer"), date_of_birth=F.col("dob"), sex=F.col("sex"), date_of_expiry=F.col("exp"), **more)


def cd(x: str) -> str:
    """SQL for the check digit of a text expression."""
    return f"(coalesce(list_sum(list_transform(range(1, len({x}) + 1), lambda i: ((instr('{ALPHABET}', substr({x}, i, 1)) - 1) % 36) * ([7, 3, 1])[((i - 1) % 3 + 1)::INTEGER])), 0) % 10)::INTEGER"


_D = lambda x: f"{x} || {cd(x)}::VARCHAR"
_NAME = "surname || '<<' || replace(given, ' ', '<')"
_SEX = "(CASE WHEN sex IN ('M', 'F') THEN sex ELSE '<' END)"


def zone_sql(layout) -> str:
    """SQL for the same zone's lines, as (doc_id, l1, l2[, l3]) from h."""
    head = f"rpad('{CODES[layout.name]}', 2, '<') || issuer"
    if layout is TD1:
        body = f"{_D('dob')} || {_SEX} || {_D('exp')} || issuer || rpad(personal, 11, '<')"
        first = f"{head} || {_D('num')} || repeat('<', 15)"
        return f"""z0 AS (SELECT *, {first} AS l1, {body} AS b, rpad({_NAME}, 30, '<') AS l3 FROM h),
z AS (SELECT *, b || {cd("(substr(l1, 6, 25) || substr(b, 1, 7) || substr(b, 9, 7) || substr(b, 19, 11))")}::VARCHAR AS l2 FROM z0)"""
    w = layout.width
    first = f"{head} || rpad({_NAME}, {w - 5}, '<')"
    room = layout.optional[0][2] - layout.optional[0][1]
    data = f"rpad({'personal' if layout in (TD3, TD2) else repr('')}, {room}, '<')"
    body = f"{_D('num')} || issuer || {_D('dob')} || {_SEX} || {_D('exp')} || {_D(data) if layout is TD3 else data}"
    if layout in (MRV_A, MRV_B):
        return f"z AS (SELECT *, {first} AS l1, {body} AS l2 FROM h)"
    end = w - 22
    return f"""z0 AS (SELECT *, {first} AS l1, {body} AS b FROM h),
z AS (SELECT *, b || {cd(f"(substr(b, 1, 10) || substr(b, 14, 7) || substr(b, 22, {end}))")}::VARCHAR AS l2 FROM z0)"""


def iso(x: str, century: str) -> str:
    return f"'{century}' || substr({x}, 1, 2) || '-' || substr({x}, 3, 2) || '-' || substr({x}, 5, 2)"
