"""The queries of the training-data operators and their SQL. Each runs over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, langid, license_scan, merkle, minhash, mixing, ngram_join, topk, transport_stream, urlfilter, vector_codes, warc
from .common import ship, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return transport_stream.stream_index(stored(transport_stream.media_column(_table(spark, sf_dir, "documents")), "media")).drop("packets", "continuity_errors", "crc_errors", "sync_errors", "pes_errors")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("target_uri")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return chat.read_formatted(stored(chat.format_turns(chat.table_of(chat.as_records(chat.with_probe(_table(spark, sf_dir, "conversations"))))), "formatted"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.classes(_table(spark, sf_dir, "documents")).drop("set_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return vector_codes.encode(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_transport_stream, op2_mixing, op3_warc, op4_chat, op5_top_k, op6_bpe, op7_url_filter, op8_ngram_join, op9_language_id, op10_license_scan, op11_minhash, op12_vector_codes, op13_merkle_manifest)}
ORACLES = {"op2_mixing": mixing.SQL, "op3_warc": warc.SQL, "op4_chat": chat.SQL, "op5_top_k": topk.SQL, "op8_ngram_join": ngram_join.SQL, "op11_minhash": minhash.SQL, "op12_vector_codes": vector_codes.SQL, "op13_merkle_manifest": merkle.SQL}
