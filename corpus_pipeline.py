"""The corpus pipeline: language ID, near duplicates, source mixing, tokens. Each stage is written as Parquet and read again as the next one's documents.

Defined results: null and empty texts, and those without letters, go with the language stage; repeated rows and ties are settled by id, text and a digest of
the whole row; rows with null ids are told apart by their texts; texts are read whole, however long; an empty table gives an empty one; documents may have
any further columns, of any names, which are handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonewright.llm import bpe, langid, mixing, ngram_join
from zonewright.llm.common import remove, ship, stored
from zonewright.llm.queries import vocabulary

#: Words of a shingle and the least similarity in percent of near duplicates; operator 8's query has its own.
WORDS, PERCENT = 5, 80


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, so that no column of theirs clashes with what a stage adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it is fitted on the labelled ones that are not held out."""
    ship(spark)
    return langid.predict(_rows(docs), langid.fit(docs), text="row.text", keep=("row",)).filter("not rejected").select("row.*")


def _digest(row: Column) -> Column:
    """Of a whole row, to order rows that are alike in what a stage reads."""
    return F.xxhash64(row)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one, that with the smallest id (null last); documents without words link with nothing and all stay.

    Rows are known by id and text, so neither null ids nor ids given to several texts mix up the decisions on them. Of rows equal in both one stays.
    """
    ship(spark)
    rows = _rows(docs).withColumn("hash", F.xxhash64("row.text"))
    named = rows.select(F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), "hash").alias("key"), F.col("row.text").alias("text"))
    kept = ngram_join.classes(named, "key", words=WORDS, percent=PERCENT).filter("key = component_id").groupBy("key").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    kept = stored(kept.select(F.col("key.doc_id").alias("id"), F.col("key.hash").alias("its_hash"), ((F.col("n") > 1) & (F.col("size") > 0)).alias("again")), "pipeline-kept")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("its_hash"))
    out = rows.join(kept.filter("not again").hint("merge"), same, "left_semi").select("row.*")
    again = kept.filter("again")
    if again.isEmpty():
        return out
    more = rows.join(again.hint("merge"), same, "left_semi").groupBy("row.doc_id", "hash").agg(F.min_by("row", _digest(F.col("row"))).alias("row"))
    return out.unionByName(more.select("row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole epochs, and the document at a source's cut as a whole.

    Rows are known by id, text and source; where a source's cut falls among rows alike in these, `more` of them are taken once more than `least`.
    """
    rows = _rows(docs).withColumn("hash", F.xxhash64("row.text"))
    times = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    mixed = mixing.mix(rows.select("row.doc_id", "row.text", "row.source", "hash"), keep=("hash",)).withColumn("n", times)
    taken = mixed.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("its_hash"), F.col("source").alias("from")).agg(
        F.max("n").alias("n"), F.min("n").alias("least"), (F.sum("n") - F.min("n") * F.count("*")).alias("more")
    )
    taken = stored(taken.filter("n > 0"), "pipeline-taken")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("its_hash")) & F.col("row.source").eqNullSafe(F.col("from"))
    out = rows.join(taken.filter("n = least").hint("merge"), same).select("row", "n")
    cut = taken.filter("n > least")
    if not cut.isEmpty():
        nth = F.row_number().over(Window.partitionBy("row.doc_id", "hash", "row.source").orderBy(_digest(F.col("row"))))
        parted = rows.join(cut.hint("merge"), same).withColumn("n", F.col("least") + F.when(nth <= F.col("more"), 1).otherwise(0))
        out = out.unionByName(parted.filter("n > 0").select("row", F.col("n").cast("int").alias("n")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("epoch")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digest of the text they decode to."""
    ship(spark)
    return bpe.tokenized(docs, vocabulary(), keep=("doc_id", "source"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
#: SQL can't express the language model or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table is deleted when the next one's is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        new: list[str] = []
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", new)
        remove(spark, *old)
        old = new
    return docs
