r"""Exact top-k search by inner product: tiled matrix products, a partial selection in each tile, and a tree of merges.

Queries are dealt into blocks and candidates into shards, both by a hash of the id and as large as TILE_BYTES of components allow, since each query is sent to
every shard and each candidate to every block; small tables are cut finer, for all cores to work. Each tile
(block, shard) is one matrix product in one task; it keeps the k best of the shard for each of its queries. The lists of a query are then merged
in a tree, `FAN_IN` shards at a time, so no task sees more than k * FAN_IN rows of a query per round. Both sides are dealt out by the tile's key;
nothing is broadcast or collected.

Scores are exact integers: components are floor(256 * x); products go through float64 while every partial sum is below 2^53, and
through Python integers otherwise (a score beyond 64 bits is held at the bound). Ties go to the smaller id.

Defined results: null vectors, and vectors with null or non-finite components, take no part; vectors meet only vectors of the same length; all vectors of a
repeated id count, as queries and as candidates, but rows equal in id and vector count once; a null id takes no part; a query without candidates gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of one side of a tile, as doubles; rows below which a shard isn't cut finer; shards merged at a time.
TILE_BYTES, LEAST, FAN_IN = 1 << 25, 1024, 16
_EXACT, _LONG = 2.0**53, (1 << 63) - 1


def usable(v: Column) -> Column:
    """A vector without null or non-finite components (null: false)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad), F.lit(False))


def quantized(v: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * v.astype(np.float64))


def _unique(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by id; of rows equal in id and vector one."""
    order = np.lexsort((*rows.T[::-1], ids)) if len(ids) != len(np.unique(ids)) else np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    first = np.append(True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(1)) if len(ids) else np.empty(0, bool)
    return ids[first], rows[first]


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates of each query; both sides sorted by id."""
    if not len(q) or not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    n, out = len(c), []
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        if bound < _EXACT:
            s = (part @ c.T).astype(np.int64)
        else:
            s = np.clip(np.array([[int(x) for x in r] for r in part], object) @ np.array([[int(x) for x in r] for r in c], object).T, -_LONG, _LONG).astype(np.int64)
        lo, hi = (np.searchsorted(c_ids, q_ids[a : a + 256], side) for side in ("left", "right"))
        kk = min(n, k + int((hi - lo).max(initial=0)))  # more, for the query's own rows
        if bound * (n + 1) < 2.0**62:
            key = s * n + np.arange(n - 1, -1, -1)  # ties: the smaller index
            top = np.argpartition(-key, kk - 1, axis=1)[:, :kk] if kk < n else np.broadcast_to(np.arange(n), s.shape)
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        else:
            top = np.argsort(-s, axis=1, kind="stable")[:, :kk]
        keep = (top < lo[:, None]) | (top >= hi[:, None])
        keep &= np.cumsum(keep, axis=1) <= k
        out.append((np.repeat(q_ids[a : a + 256], kk)[keep.ravel()], c_ids[top][keep], np.take_along_axis(s, top, 1)[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tile_of(key, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    out = ([], [], [])
    both = left.num_rows and right.num_rows  # a missing side comes without columns
    l_dim, r_dim = (t.column(c).to_numpy() if both else np.empty(0, int) for t, c in ((left, "_dim"), (right, "c_dim")))
    for d in np.intersect1d(l_dim, r_dim):
        sides = []
        for t, dims, pre in ((left, l_dim, ""), (right, r_dim, "c")):
            at = t.filter(pa.array(dims == d))
            flat = at.column(pre + "_v").combine_chunks()
            values = (flat.flatten() if hasattr(flat, "flatten") else flat).to_numpy(zero_copy_only=False).reshape(at.num_rows, int(d))
            ids, values = _unique(at.column(pre + "_i").to_numpy(), values)
            sides += ids, quantized(values)
        for o, x in zip(out, tile(*sides, k)):
            o.append(x)
    q, v, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
    shard = np.full(len(q), key[1].as_py(), np.int32)
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64()), "_s": pa.array(shard, pa.int32())})


def top_k(table: DataFrame, k: int = 5, every: int = 50, ident: str = "vec_id", vector: str = "embedding", query_block: int | None = None, shard: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by `every`."""
    rows = table.select(F.col(ident).cast("long").alias("_i"), F.col(vector).alias("_v")).filter(F.col("_i").isNotNull() & usable(F.col("_v")))
    n, m, width = rows.agg(F.count("*"), F.count_if(F.col("_i") % every == 0), F.max(F.size("_v"))).first()
    room = max(256, TILE_BYTES // (8 * max(1, width or 1)))
    cores = table.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-m // (query_block or room)))
    shards = max(1, -(-n // shard) if shard else max(-(-n // room), min(2 * cores, -(-n // LEAST))))
    deal = lambda seed, parts: F.pmod(F.xxhash64("_i", F.lit(seed)), F.lit(parts)).cast("int")
    rows = rows.withColumn("_dim", F.size("_v"))
    queries = rows.filter(F.col("_i") % every == 0).withColumns({"_q": deal(1, blocks), "_s": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    cands = rows.withColumns({"_s": deal(2, shards), "_q": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    cands = cands.select(*(F.col(c).alias(f"c{c}") for c in ("_q", "_s", "_i", "_v", "_dim")))  # a self-join needs names of its own
    lists = queries.groupBy("_q", "_s").cogroup(cands.groupBy("c_q", "c_s")).applyInArrow(lambda key, a, b: _tile_of(key, a, b, k), "query_id long, vec_id long, score long, _s int")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    while shards > FAN_IN:
        lists = lists.withColumn("_s", F.expr(f"_s div {FAN_IN}").cast("int")).withColumn("_r", best("query_id", "_s")).filter(F.col("_r") <= k).drop("_r")
        shards = -(-shards // FAN_IN)
    return lists.withColumn("rank", best("query_id")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
