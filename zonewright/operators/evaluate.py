"""Accuracy reports: outcomes per document, and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import character_error_rate
from ..schemas import CORE_FIELDS
from ..sources.files import checkpointed

COMPARED = (*CORE_FIELDS, "mrz_lines")


def outcomes(truth: Column, got: Column) -> Column:
    """array<struct<field, cer, expected, got>> over the compared fields; all lost where nothing was found."""
    text = lambda m, f: F.array_join(m[f], "\n") if f == "mrz_lines" else F.coalesce(m[f], F.lit(""))
    one = lambda f: F.struct(
        F.lit(f).alias("field"), F.when(got.isNull(), 1.0).otherwise(character_error_rate(text(truth, f), text(got, f))).alias("cer"),
        text(truth, f).alias("expected"), F.when(got.isNotNull(), text(got, f)).alias("got"),
    )
    return F.array(*map(one, COMPARED))


def miss_kind(truth: Column, got: Column, valid: Column, failure: Column | None = None) -> Column:
    """Why a document is a miss, null for a hit; the first reason that applies."""
    failure = F.lit(None).cast("string") if failure is None else failure
    return (
        F.when(failure.isNotNull() | truth.isNull(), "ocr_error")
        .when(got.isNull(), "no_mrz_found")
        .when(~valid, "checksum_failed")
        .when(got["document_number"] != truth["document_number"], "document_number_mismatch")
    )


def hit_rate(df: DataFrame, hit: str = "hit") -> DataFrame:
    return df.agg(F.count_if(hit).alias("hits"), F.count("*").alias("documents"), (F.count_if(hit) / F.greatest(F.count("*"), F.lit(1))).alias("hit_rate"))


def gate(df: DataFrame, floor: float, hit: str = "hit") -> DataFrame:
    """The hit rate, and whether it reaches the floor."""
    return hit_rate(df, hit).withColumn("passes", F.col("hit_rate") >= floor)


def passes_gate(df: DataFrame, floor: float, hit: str = "hit") -> bool:
    return gate(df, floor, hit).first()["passes"]


def misses_by_kind(df: DataFrame, kind: str = "miss_kind") -> DataFrame:
    return df.groupBy(kind).agg(F.count(kind).alias("n")).filter("n > 0").orderBy(kind)  # a filter on the kind itself would be computed a second time below


def flagged_share(df: DataFrame) -> DataFrame:
    """Of the hits, those whose first line is flagged; null without hits."""
    return df.agg(F.count_if(F.col("hit") & F.col("line1_flagged")).alias("flagged"), F.try_divide(F.count_if(F.col("hit") & F.col("line1_flagged")), F.count_if("hit")).alias("flagged_share"))


def mean_cer_by_field(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Worst first, then by name."""
    one = df.select(F.explode(fields).alias("x")).select("x.field", "x.cer")
    return one.groupBy("field").agg(F.avg("cer").alias("mean_cer"), F.count("*").alias("n")).orderBy(F.desc("mean_cer"), "field")


def unpivot_fields(df: DataFrame, record: str, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """(keys, field, value) of the fields that aren't blank."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(record)[f].alias(value)) for f in CORE_FIELDS)))
    return df.select(*keys, pairs.alias("x")).select(*keys, "x.*").filter(F.coalesce(F.col(value), F.lit("")) != "")


def field_accuracy(reads: DataFrame, by: str = "provider", truth: str = "truth", read: str = "read") -> DataFrame:
    """Share of equal fields and mean error rate, over the fields that the truth has; a field not read counts as empty."""
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(truth)[f].alias("t"), F.coalesce(F.col(read)[f], F.lit("")).alias("r")) for f in CORE_FIELDS)))
    rows = reads.select(by, both.alias("x")).select(by, "x.*").filter(F.coalesce("t", F.lit("")) != "")
    return rows.groupBy(by).agg(F.count("*").alias("compared"), F.avg((F.col("t") == F.col("r")).cast("double")).alias("field_match_rate"), F.avg(character_error_rate(F.col("t"), F.col("r"))).alias("mean_cer"))


def supported(field: Column, value: Column, text: Column) -> Column:
    """Whether a value stands in the text, whatever the case; a date may stand there as YYMMDD."""
    low = F.lower(text)
    digits = F.concat(F.substring(value, 3, 2), F.substring(value, 6, 2), F.substring(value, 9, 2))
    dated = field.isin("date_of_birth", "date_of_expiry") & value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return low.contains(F.lower(value)) | (dated & low.contains(digits))


def unsupported_assertions(reads: DataFrame, record: str = "read", text: str = "text", by: str = "provider", anchored: str = "mrz_found") -> DataFrame:
    """Per reader, and per reader and whether a zone anchors the document: documents, assertions, unsupported ones and their share.

    One pass over the reads: documents count all texts, assertions only the fields read.
    """
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(record)[f].alias("v")) for f in CORE_FIELDS))
    said = F.filter(fields, lambda x: F.coalesce(x["v"], F.lit("")) != "")
    bad = F.filter(said, lambda x: ~supported(x["field"], x["v"], F.col(text)))
    rows = reads.select(by, F.col(anchored).alias("anchored"), F.size(said).alias("s"), F.size(bad).alias("b"))
    out = rows.rollup(by, "anchored").agg(F.grouping_id().alias("_g"), F.count("*").alias("documents"), F.sum("s").cast("long").alias("assertions"), F.sum("b").cast("long").alias("unsupported"))
    return out.filter("_g < 3").withColumn("bucket", F.when(F.col("_g") == 1, "all").when(F.col("anchored"), "anchored").otherwise("unanchored")).select(
        by, "bucket", "documents", "assertions", "unsupported", F.try_divide("unsupported", "assertions").alias("unsupported_rate")
    )


def unsupported_fields(read: Column, text: Column) -> Column:
    """Names of the fields whose value no text supports."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), read[f].alias("v")) for f in CORE_FIELDS))
    bad = F.filter(fields, lambda x: (F.coalesce(x["v"], F.lit("")) != "") & ~supported(x["field"], x["v"], text))
    return F.transform(bad, lambda x: x["field"])


#: One over the greatest error, as a share of the rows, of the bounds between which an exact rank is looked for.
ACCURACY = 10_000


def nearest_rank(df: DataFrame, value: str, ranks: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, and for each name the value at rank round((n - 1) p), exactly, from two reads.

    The first gives each group's size and, for each rank, two values it lies between for certain (a mergeable sketch's percentiles on either side, as far apart
    as their error bound asks); the second counts all rows at once by what they are below of and, where they lie between, by value. Only those counts meet in a window.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    marks = [m for p in ranks.values() for m in (max(0.0, p - 3 / ACCURACY), min(1.0, p + 3 / ACCURACY))]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.percentile_approx("_v", marks, ACCURACY).alias("_q"))
    both = _on(rows, sizes, by)
    flags = lambda conditions: sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    low = flags(F.col("_v") < F.col("_q")[2 * i] for i in range(len(ranks)))
    near = flags(F.col("_v").between(F.col("_q")[2 * i], F.col("_q")[2 * i + 1]) for i in range(len(ranks)))
    marked = both.select(*by, "n", "mean", low.alias("_low"), near.alias("_near"), F.when(near > 0, F.col("_v")).alias("_v"))
    counts = marked.groupBy(*by, "_low", "_near", "_v").agg(F.count("*").alias("_c"), F.first("n").alias("n"), F.first("mean").alias("mean"))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    bit = lambda c, i: F.when(F.col(c).bitwiseAND(F.lit(1 << i)) > 0, F.col("_c")).otherwise(0)
    counts = counts.withColumns({f"_at{i}": F.floor((F.col("n") - 1) * p + 0.5) - F.sum(bit("_low", i)).over(whole) for i, p in enumerate(ranks.values())})
    counts = counts.withColumns({f"_upto{i}": F.sum(bit("_near", i)).over(upto) for i in range(len(ranks))})
    picks = [F.min(F.when((bit("_near", i) > 0) & (F.col(f"_upto{i}") > F.col(f"_at{i}")), F.col("_v"))).alias(name) for i, name in enumerate(ranks)]
    return counts.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *picks)


def _on(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Joined on columns in which nulls are equal; without columns, right is one row."""
    if not by:
        return left.join(F.broadcast(right))
    right = right.withColumnsRenamed({b: f"_r{i}" for i, b in enumerate(by)})
    return left.join(right, [F.col(b).eqNullSafe(F.col(f"_r{i}")) for i, b in enumerate(by)]).drop(*(f"_r{i}" for i in range(len(by))))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative counts per upper bound, with +Inf, sum and count."""
    v = F.col(value)
    aggs = [F.count_if(v <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds] + [F.count(v).alias("le_inf"), F.sum(v).alias("total")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def latest(df: DataFrame, series: str, time: str, order: str, value: str) -> DataFrame:
    """The latest row of each series that has a value; of equal times the last. An aggregate: nothing is sorted, and a hot series is combined where it lies."""
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(series).agg(F.max_by(F.struct(*rows.columns), F.struct(time, order)).alias("_row")).select("_row.*")


def first_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with equal keys that of the lowest order."""
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def series_in_first_seen_order(df: DataFrame, series: str, time: str, order: str) -> DataFrame:
    """Series by their first row, rows by time within them. Minima are aggregates, and the sort ranges over all of its keys: a hot series is spread over many tasks."""
    first = df.groupBy(series).agg(F.min(order).alias("series_at"))
    return _on(df, first, (series,)).orderBy("series_at", time, order)


def trend_axis(df: DataFrame, time: str) -> DataFrame:
    """First and last time, a point apart at least."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last")).withColumn("last", F.when(F.col("first") == F.col("last"), F.col("last") + 1).otherwise(F.col("last")))


def stride(df: DataFrame, n: int, order: str) -> DataFrame:
    """n rows at even distances: ranks floor(i total / n). Ranks come from a range sort and the partitions' counts, not from one task; the sorted
    rows are checkpointed, so that counts and ranks see the same partitions."""
    placed = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_p": F.shiftright("_id", 33), "_k": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_p").alias("_part"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    rank = F.col("_before") + F.col("_k")
    i = F.ceil(rank * n / F.col("_total"))
    ranked = placed.join(F.broadcast(counts), F.col("_p") == F.col("_part"))
    return ranked.filter((i < n) & (F.floor(i * F.col("_total") / n) == rank)).select(*df.columns)


def keep_last(df: DataFrame, n: int, order: str) -> DataFrame:
    """The n rows with the highest order."""
    return df.orderBy(F.desc(order)).limit(n)
