r"""Compression of vectors to codes: product quantization whose assignments are pruned by distances to fixed pivots (LAESA).

Vectors become integers, floor(1024 x), and are cut into equal consecutive parts. Each part position has a codebook, at first those parts of the vectors with the
smallest ids; each round assigns every part to its nearest entry and replaces entries by the floors of their parts' means.

1. Pivots are some entries of the first codebook, far from each other. They never change: each part's distances to them are computed once and stored beside it.
2. In a round, only the few distances between pivots and entries are new. By the triangle inequality the difference of two distances to a pivot is a lower
   bound of the distance between part and entry; the entries with the least bounds are evaluated first, exactly, in integers, and of the others only those
   whose bound doesn't exceed the best found. Bounds are doubles and give way by more than their rounding, so no nearest entry and no tie is pruned.
3. Each task adds up its parts by entry; Spark adds up the tasks' sums. What meets on the driver is the codebook and its sums, as large as the codebook, whatever the rows.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; a null id comes after all others and rows equal in id are
ordered by vector; of fewer rows than entries all are entries, and rows that repeat give entries that repeat; shorter vectors count as padded with zeros up to the longest, and that to a
multiple of the parts; an unused entry stays; integers are held at 2^62 and errors at 2^63 - 1; null labels are one label; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, stored
from .topk import usable

#: Part positions, entries of a codebook, rounds, pivots of a part position, and entries that are evaluated before any is pruned.
PARTS, ENTRIES, ROUNDS, PIVOTS, FIRST = 4, 256, 4, 8, 8
#: Up to this magnitude differences and sums of squares are taken in 64 bits, beyond it in Python's integers; the bound of an integer and of an error; rows and pairs handled at once.
SMALL, LARGE, LONG, ROWS, PAIRS = 1 << 24, 1 << 62, (1 << 63) - 1, 2048, 1 << 17


def integers(v: np.ndarray, scale: float = 1024.0) -> np.ndarray:
    """floor(scale x) of doubles: 64 bits, held at +-LARGE."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * scale), -float(LARGE), float(LARGE)).astype(np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exactly."""
    if not a.size or not b.size or max(abs(int(a.min())), abs(int(a.max())), abs(int(b.min())), abs(int(b.max()))) <= SMALL and a.shape[-1] <= 1 << 12:
        d = a - b
        return (d * d).sum(-1)
    d = a.astype(object) - b.astype(object)
    return (d * d).sum(-1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to each of b, as doubles."""
    return np.sqrt(np.stack([squares(a, x[None]).astype(np.float64) for x in b], 1)) if len(b) else np.zeros((len(a), 0))


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before, from the first on; of equals the first."""
    chosen = [0]
    least = squares(entries, entries[:1]).astype(np.float64)
    while len(chosen) < min(n, len(entries)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squares(entries, entries[chosen[-1:]]).astype(np.float64))
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, the lower of equals; squared distance; pairs evaluated) of each part."""
    n, m = len(parts), len(entries)
    mine = distances(entries, pivots)
    bound = np.zeros((n, m))
    for p in range(mine.shape[1]):
        a, b = to_pivots[:, p, None], mine[None, :, p]
        np.maximum(bound, np.abs(a - b) - 1e-9 * (a + b), out=bound)
    first = min(first, m)
    early = np.argpartition(bound, first - 1, axis=1)[:, :first]
    exact = squares(parts[:, None, :], entries[early])
    best = exact.min(1)
    code = np.where(exact == best[:, None], early, m).min(1)
    open_ = bound <= np.sqrt(best.astype(np.float64))[:, None] * (1 + 1e-9)
    np.put_along_axis(open_, early, False, 1)
    rows, cols = np.nonzero(open_)
    for a in range(0, len(rows), PAIRS):
        r, c = rows[a : a + PAIRS], cols[a : a + PAIRS]
        d = squares(parts[r], entries[c])
        at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        low, who = np.minimum.reduceat(d, at), r[at]
        index = np.minimum.reduceat(np.where(d == np.repeat(low, np.diff(np.append(at, len(r)))), c, m), at)
        better, tie = low < best[who], (low == best[who]) & (index < code[who])
        best[who[better]] = low[better]
        code[who[better | tie]] = index[better | tie]
    return code, best, n * first + len(rows)


class Codebooks:
    """The entries and pivots of all part positions. It travels to the tasks with their code: as large as its entries, whatever the rows."""

    def __init__(self, first: np.ndarray, parts: int = PARTS, pivots: int = PIVOTS):
        self.parts = parts
        self.entries = list(np.split(first, parts, axis=1)) if first.shape[1] else [first] * parts
        self.pivots = [far_apart(e, pivots) for e in self.entries]

    def to_pivots(self, v: np.ndarray) -> list[np.ndarray]:
        return [distances(x, p) for x, p in zip(self.split(v), self.pivots)]

    def split(self, v: np.ndarray) -> list[np.ndarray]:
        return list(np.split(v, self.parts, axis=1)) if v.shape[1] else [v] * self.parts

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for row in e for x in row).encode()).hexdigest()

    def renewed(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> None:
        for (p, k), (n, total) in sums.items():
            self.entries[p][k] = [x // n for x in total]

    def assign(self, batch: pa.RecordBatch):
        """Yields (first row, vectors, codes and squared distances by part) of runs of a stored batch."""
        v = _matrix(batch.column("v"), np.int64)
        to = _matrix(batch.column("to"), np.float64)
        widths = np.cumsum([len(p) for p in self.pivots])[:-1]
        for a in range(0, len(v), ROWS):
            run = v[a : a + ROWS]
            found = [nearest(x, t, e, p)[:2] for x, t, e, p in zip(self.split(run), np.split(to[a : a + ROWS], widths, axis=1), self.entries, self.pivots)]
            yield a, run, [f[0] for f in found], [f[1] for f in found]


def _matrix(lists: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(lists), -1) if len(lists) else np.empty((0, 0), kind)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), kind))


def padded(v: Column, width: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v)))


def _measured(rows: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """(id, label, v, to): integers and their distances to the pivots."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                v = integers(_matrix(part.column("v"), np.float64).reshape(part.num_rows, width))
                to = np.concatenate(books.to_pivots(v), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), _lists(v, pa.int64()), _lists(to, pa.float64())], names=["id", "label", "v", "to"])

    return rows.select("id", "label", padded(F.col("v"), width).alias("v")).mapInArrow(run, f"{kinds}, v array<long>, to array<double>")


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to (parts assigned, componentwise sums). Sums are carried in two halves of 32 bits, so none overflows."""
    parts, entries, widths = books.parts, len(books.entries[0]), [e.shape[1] for e in books.entries]

    def run(batches):
        n = np.zeros((parts, entries), np.int64)
        halves = [np.zeros((2, entries, w), np.int64) for w in widths]
        for b in batches:
            for _, v, codes, _ in books.assign(b):
                for p, (x, code) in enumerate(zip(books.split(v), codes)):
                    n[p] += np.bincount(code, minlength=entries)
                    np.add.at(halves[p][0], code, x >> 32)
                    np.add.at(halves[p][1], code, x & 0xFFFFFFFF)
        for p in range(parts):
            used = np.flatnonzero(n[p])
            if len(used):
                columns = [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[p][used], pa.int64()), *(_lists(h[used], pa.int64()) for h in halves[p])]
                yield pa.RecordBatch.from_arrays(columns, names=["p", "k", "n", "hi", "lo"])

    one = rows.select("v", "to").mapInArrow(run, "p int, k int, n long, hi array<long>, lo array<long>")
    by_place = one.select("p", "k", "n", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "x")) if max(widths) else one.select("p", "k", "n", F.lit(0).alias("at"), F.struct(F.lit(0).alias("hi"), F.lit(0).alias("lo")).alias("x"))
    total = by_place.groupBy("p", "k", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x.hi").cast("decimal(20,0)")).alias("hi"), F.sum(F.col("x.lo").cast("decimal(20,0)")).alias("lo"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for p, k, at, n, hi, lo in total.orderBy("p", "k", "at").collect():
        out.setdefault((p, k), (n, []))[1].append((int(hi) << 32) + int(lo))
    return {key: (n, x[: widths[key[0]]]) for key, (n, x) in out.items()}


def _coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))

    def run(batches):
        for b in batches:
            for a, v, codes, far in books.assign(b):
                hexes = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
                step = 2 * books.parts
                error = [min(LONG, sum(map(int, x))) for x in zip(*far)]
                part = b.slice(a, len(v))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([hexes[i : i + step] for i in range(0, len(hexes), step)], pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"{kinds}, code string, error long")


def encode(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per row kept: id, code, error, label_error, codebooks_sha256."""
    spark = df.sparkSession
    paths: list[str] = []
    rows = df.select(F.col(ident).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        kind = df.schema[ident].dataType.simpleString()
        return spark.createDataFrame([], f"`{ident}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-longest // parts) * parts
    first = rows.select("id", padded(F.col("v"), width).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # a codebook's worth
    books = Codebooks(integers(np.array([r["v"] for r in first], np.float64).reshape(len(first), width)), parts)
    rows = stored(_measured(rows, books, width), "codes-parts", paths)
    for _ in range(rounds):
        books.renewed(_sums(rows, books))
    coded = stored(_coded(rows, books), "codes-coded")
    remove(spark, *paths)
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(ident), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL: products of integers below 2^53 are exact in doubles."""
    out = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, j, v[(j * len(v) // {parts} + 1)::INTEGER : ((j + 1) * len(v) // {parts})::INTEGER] AS x FROM v, range({parts}) r(j)),
c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, x AS e FROM p QUALIFY row_number() OVER (PARTITION BY j ORDER BY vec_id) <= {entries})"""
    ]
    for i in range(rounds + 1):
        out.append(
            f"""n{i} AS MATERIALIZED (SELECT c.j, c.k, c.e, list_inner_product(c.e, c.e) AS ee FROM c{i} c),
a{i} AS MATERIALIZED (SELECT p.vec_id, p.j, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, e) + ee, 'k': k}}) AS b FROM p JOIN n{i} n ON n.j = p.j GROUP BY p.vec_id, p.j)"""
        )
        if i < rounds:
            out.append(
                f"""s{i} AS (SELECT p.j, b.k AS k, generate_subscripts(x, 1) AS pos, unnest(x) AS y FROM p JOIN a{i} a ON a.vec_id = p.vec_id AND a.j = p.j),
m{i} AS (SELECT j, k, list(f ORDER BY pos) AS e FROM (SELECT j, k, pos, floor(sum(y) / count(*)) AS f FROM s{i} GROUP BY j, k, pos) GROUP BY j, k),
c{i + 1} AS MATERIALIZED (SELECT c.j, c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j AND m.k = c.k)"""
            )
    out.append(
        f"""z AS (SELECT vec_id, string_agg(printf('%02x', (b.k)::INTEGER), '' ORDER BY j) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(t, ',' ORDER BY j, k)) AS h FROM (SELECT j, k, array_to_string(list_transform(e, lambda y: y::BIGINT::VARCHAR), ',') AS t FROM c{rounds}))
SELECT z.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.h AS codebooks_sha256 FROM z JOIN v ON v.vec_id = z.vec_id CROSS JOIN h"""
    )
    return "WITH " + ",\n".join(out)


SQL = _sql()
