r"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key; rows are range-sorted by it within their source, prefix sums of the sizes are taken with a
three-level scan tree (row, leaf range, branch range, source), and each source is cut at its exact budget, after as many whole
epochs as the budget holds. The key's leading digits are the ranges, so a source that holds a third of all rows is spread
over 65,536 leaves and no task gets a source as a whole; a reread or a lost executor gives the same order again.

Targets: the sources share `share` of all sizes by weight; a source whose share is above `epochs` times its size stops there,
and the excess is shared again until none is above. That fixed point is found in closed form from two prefix sums over the
sources in the order of the weight each size can carry.

Defined results: null source is a source of its own, after all others; null text has size 0; a source of size 0 has target 0; rows equal in
id and size are interchangeable and each is counted; no rows give no rows. Other columns of the input are ignored. A text of any length is counted by one
expression. All rows of one id have one key, so many rows with a null or repeated id meet in one leaf: ids should be unique and not null at scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, remove, stored

WEIGHTS = (5, 2, 1)
#: Share of all sizes to mix, as a fraction of integers, and the most epochs of a source.
SHARE, EPOCHS = (3, 2), 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def random_key(ident: Column, seed: str) -> Column:
    """32 hex digits that depend on nothing but the id and the seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("-"))).cast("binary"))


def ranked(df: DataFrame, by: list[Column], name: str, paths: list[str]) -> DataFrame:
    """Adds _rank from 0 in the order given, over all rows: a range sort, and a scan of the partitions' counts."""
    placed = stored(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), name, paths
    ).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(F.broadcast(counts), "_part").withColumn("_rank", F.col("_before") + F.col("_at")).drop("_id", "_part", "_at", "_n", "_before")


def running(df: DataFrame, rank: str, value: str, out: str) -> DataFrame:
    """Adds the sum of value over all rows of smaller rank: windows over runs of 4096 ranks, then over the runs' sums."""
    run, runs = F.expr(f"{rank} div 4096"), Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_run", run)
    sums = df.groupBy("_run").agg(F.sum(value).alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(runs), F.lit(0)))
    within = Window.partitionBy("_run").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_w", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums.select("_run", "_b"), "_run").withColumn(out, F.col("_w") + F.col("_b")).drop("_run", "_w", "_b")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, paths: list[str] | None = None) -> DataFrame:
    """Of (source, source_size): adds target (double), and budget, its whole words.

    With level = (share of all sizes - caps of the full sources) / (weights of the others), a source is full if
    cap / weight is below the level; in the order of cap / weight the full ones come first.
    """
    paths, own = [] if paths is None else paths, []
    num, den = share
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    w = ranked(sizes, [F.col("source").asc_nulls_last()], "mix-sources", own).select("source", "source_size", weight.alias("_weight"))
    w = w.withColumn("_cap", F.col("source_size") * epochs)
    order = [F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()]
    w = stored(running(running(ranked(w, order, "mix-order", own), "_rank", "_cap", "_caps"), "_rank", "_weight", "_weights"), "mix-levels", paths)
    remove(sizes.sparkSession, *own)
    total = w.agg(F.sum("source_size").alias("_size"), F.sum("_weight").alias("_all"))
    # den * level = top / under, from each source on as the first that isn't full
    w = w.join(F.broadcast(total)).withColumns({"_top": F.col("_size") * num - F.col("_caps") * den, "_under": F.col("_all") - F.col("_weights")})
    open_ = w.filter(F.col("_cap").cast("decimal(38,0)") * den * F.col("_under") >= F.col("_top").cast("decimal(38,0)") * F.col("_weight"))
    first = open_.agg(F.min_by(F.struct("_top", "_under", "_rank"), "_rank").alias("_l"))  # none: all are full
    level = (F.col("_l._top") * F.col("_weight")).cast("double") / (F.col("_l._under") * den).cast("double")
    full = F.col("_l").isNull() | (F.col("_rank") < F.col("_l._rank"))
    return w.join(F.broadcast(first)).withColumn("target", F.when(full, F.col("_cap").cast("double")).otherwise(level)).select(
        "source", "source_size", "target", F.floor("target").cast("long").alias("budget")
    )


def mix(docs: DataFrame, ident: str = "doc_id", size: Column | None = None, source: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, size, source_size, target, taken, and the columns kept, which order rows equal in id and size. The document at the cut is taken in part, so that a source's taken sum is its budget."""
    paths: list[str] = []
    size = word_count(F.col("text")) if size is None else size
    rows = stored(docs.select(F.col(ident).alias("_id"), F.col(source).alias("source"), size.alias("size"), random_key(F.col(ident), seed).alias("_key"), *keep), "mix-rows", paths)
    rows = rows.withColumns({"_b1": F.substring("_key", 1, 2), "_b2": F.substring("_key", 3, 2)})
    leaves = stored(rows.groupBy("source", "_b1", "_b2").agg(F.sum("size").alias("_s")), "mix-leaves", paths)
    branches = stored(leaves.groupBy("source", "_b1").agg(F.sum("_s").alias("_s")), "mix-branches", paths)
    targets = source_targets(branches.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, share, epochs, paths)
    before = lambda group, order: F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    t = targets.withColumnRenamed("source", "_src")
    branches = branches.withColumn("_b1_before", before(["source"], "_b1")).join(t, F.col("source").eqNullSafe(F.col("_src"))).drop("_src", "_s")
    leaves = leaves.withColumn("_b2_before", before(["source", "_b1"], "_b2"))
    b = branches.withColumnsRenamed({"source": "_src", "_b1": "_c1"})
    leaves = leaves.join(b, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b1") == F.col("_c1")))
    leaves = leaves.select(F.col("source").alias("_src"), F.col("_b1").alias("_c1"), F.col("_b2").alias("_c2"), (F.col("_b1_before") + F.col("_b2_before")).alias("_leaf_before"), "source_size", "target", "budget")
    within = Window.partitionBy("source", "_b1", "_b2").orderBy("_key", "_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_row_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(leaves, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b1") == F.col("_c1")) & (F.col("_b2") == F.col("_c2")))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - F.col("_whole") * F.col("source_size") - F.col("_leaf_before") - F.col("_row_before")
    taken = F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.withColumn("_whole", whole).select(F.col("_id").alias(ident), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


#: The same in DuckDB SQL, with the constants above.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '-')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER q AS r,
         coalesce(sum(2 * source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         coalesce(sum(w) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws,
         sum(source_size) OVER () AS total, sum(w) OVER () AS allw
  FROM s WINDOW q AS (ORDER BY 2.0 * source_size / w, source NULLS LAST)),
l AS (
  SELECT 3 * total - 2 * caps AS top, allw - ws AS under, r FROM o
  WHERE cap * 2 * (allw - ws) >= (3 * total - 2 * caps) * w ORDER BY r LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
         CASE WHEN l.r IS NULL OR o.r < l.r THEN o.cap::DOUBLE ELSE (l.top * o.w)::DOUBLE / (l.under * 2)::DOUBLE END AS target
  FROM o LEFT JOIN l ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size::BIGINT AS source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size
             + greatest(0, least(size, budget - budget // source_size * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
