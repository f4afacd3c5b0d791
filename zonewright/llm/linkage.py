"""Links among sets that share index buckets: exact verification, components, and tiles that link without putting out pairs.

A bucket's members are cut by hash into blocks, as many as its members and their tokens ask for; a tile holds two blocks of one bucket, in one task, whatever the
bucket's size; buckets of one block, most of which have two or three members, are dealt by hash into tiles of many, which are handled at once. Its candidates (pairs of different components that a cheap test on signatures lets pass) are never rows: a first pass puts out the members that have
any, and only these meet with their whole sets, in a second one. There the candidates are tried in runs from the likeliest on, pairs whose ends have been joined meanwhile are skipped, and a link
joins its ends: a tile of c components puts out at most c - 1 links, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, shingle_set, stored

#: Members of a block and their tokens, at most (in the mean: the hash deals them out).
BLOCK, TOKENS = 1024, 1 << 20
#: Members of a tile of small buckets, in the mean.
BIN = 256
#: Pairs of a tile that are tested at once; the least number that is tried at once on whole sets; so many of a bucket are tried one by one; cells of a bit map.
PAIRS, RUN, FEW, BITS = 1 << 14, 64, 16, 1 << 22
#: A test of candidates: (table, rows x, rows y) to (x, y, likeness), for row numbers x of one block and y of the other.
Test = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


_K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)]


def tokens_of(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy().view(np.uint64)


def digests_of(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each sorted set, as two signed numbers; (0, 0) of the empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = sizes > 0
    out = np.zeros((len(sets), 2), np.int64)
    if full.any():
        tokens, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        sums = np.stack([np.add.reduceat(mix(x), starts) for x in (tokens ^ _K[1], tokens * _K[2])], axis=1)
        out[full] = mix(sums + sizes[full, None].astype(np.uint64) * _K[0]).view(np.int64)
    return out


def digest_of(tokens: np.ndarray) -> tuple[int, int]:
    """digests_of() one set."""
    return tuple(digests_of([tokens])[0].tolist())


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(d, a, b, t) to whole sets (d, n, tokens). A row whose text isn't the class's (an id given twice) is dropped."""

    def run(batches):
        split = Words()
        for b in batches:
            d, want = b.column("d").to_pylist(), list(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
            for first, arrays in split.of([x.as_py() for x in b.column("t")]):
                sets = [shingle_set(h, words) for h in arrays]
                rows = [(d[i], s) for i, (s, k) in enumerate(zip(sets, digests_of(sets).tolist()), first) if tuple(k) == want[i]]
                if rows:
                    ids, sets = zip(*rows)
                    ends = np.cumsum([0, *map(len, sets)])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))], names=["d", "n", "tokens"])

    return texts.select("d", "a", "b", F.col("t").cast("binary").alias("t")).mapInArrow(run, "d long, n long, tokens array<long>")


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap enough."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that link, by exact intersection of whole sets (d, tokens)."""
    s = sets.select("d", "tokens")
    both = pairs.hint("merge").join(s.select(F.col("d").alias("a"), F.col("tokens").alias("ta")), "a").hint("merge").join(s.select(F.col("d").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for b in batches:
            keep = [links(tokens_of(x), tokens_of(y), percent) for x, y in zip(b.column("ta"), b.column("tb"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, paths: list[str]) -> DataFrame:
    """(node, label) of all nodes with an edge; the label is a node of the component, the same for all of it.

    Each round maps every node to its smallest neighbour, follows those pointers to their ends and contracts the graph; a component loses
    at least half of its nodes a round, however long its paths or large its stars are.
    """
    most = 2 * edges.count()  # of edges and nodes
    keep = lambda df, name: stored(df, name, paths, rows=most)
    e = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = None
    while not e.isEmpty():
        f = keep(e.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")), "cc-to")
        while True:
            g = f.select(F.col("a").alias("c"), F.col("to").alias("next"))
            f2 = keep(f.join(g, F.col("to") == F.col("c")).select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "cc-to")
            f = f2.select("a", "to")
            if f2.filter("moved").isEmpty():
                break
        g = f.select(F.col("a").alias("c"), F.col("to").alias("next"))
        labels = f.select(F.col("a").alias("node"), F.col("to").alias("label")) if labels is None else keep(labels.join(g, F.col("label") == F.col("c"), "left").select("node", F.coalesce("next", "label").alias("label")), "cc-labels")
        e = e.join(g, F.col("a") == F.col("c")).select(F.col("next").alias("a"), "b").join(g, F.col("b") == F.col("c")).select("a", F.col("next").alias("b"))
        e = keep(e.filter("a <> b").distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return labels


def mixed(index: DataFrame, labels: DataFrame, paths: list[str]) -> DataFrame:
    """The members (key, d, ...) of buckets that hold more than one component, with their labels."""
    now = index.join(labels.withColumnRenamed("node", "d").hint("merge"), "d", "left").withColumn("label", F.coalesce("label", "d"))
    two = now.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x < _y").select("key")
    return stored(now.join(two.hint("merge"), "key"), "link-mixed", paths)


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    """Columns as arrays; lists of equal length and bytes as matrices."""
    out = {}
    for name in t.column_names:
        c = t.column(name).combine_chunks()
        if pa.types.is_binary(c.type):
            out[name] = np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1)
        elif pa.types.is_list(c.type):
            out[name] = c.flatten().to_numpy().reshape(len(c), -1)
        else:
            out[name] = c.to_numpy()
    return out


def _candidates(t: pa.Table, columns: list[str], test: Test) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, likeness) of a tile's candidates, by row number. Only rows of one bucket and of different components are paired, each pair once."""
    a = _arrays(t.select(columns))
    labels, at, key = a["label"], a["at"], t.column("key").to_numpy()
    whole = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    order = np.lexsort((labels, key))
    new = np.append(True, np.diff(key[order]) != 0)
    begin, end = (np.append(np.flatnonzero(c), len(order)) for c in (new, new | np.append(True, np.diff(labels[order]) != 0)))
    mine, last = (np.repeat(c[1:], np.diff(c)) for c in (end, begin))  # ends of each row's run of one component, and of its bucket
    sums = np.append(0, np.cumsum(last - mine))
    out, lo = [], 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + PAIRS, "right")) - 1)
        n = last[lo:hi] - mine[lo:hi]
        x = order[np.repeat(np.arange(lo, hi), n)]
        y = order[np.arange(len(x)) + np.repeat(mine[lo:hi] - (sums[lo:hi] - sums[lo]), n)]
        if not whole:
            across = at[x] != at[y]
            x, y = x[across], y[across]
        if len(x):
            out.append(test(a, x, y))
        lo = hi
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


class Overlaps:
    """Tests of many pairs among a few sets: what at least two of them have is numbered, and intersections are counted in bit maps of bounded size."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets])
        _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        keep = shared[ids]
        self.ids = (np.cumsum(shared) - 1)[ids[keep]]
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)[keep]
        self.width = int(shared.sum())

    def link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """links() of the sets numbered x and y."""
        if not len(x):
            return np.zeros(0, bool)
        used = np.zeros(len(self.sizes), bool)
        used[x] = used[y] = True
        place = np.cumsum(used) - 1
        of = used[self.rows]
        rows, ids = place[self.rows[of]], self.ids[of]
        same = np.zeros(len(x), np.int64)
        step = max(64, BITS // int(used.sum()) // 64 * 64)
        for lo in range(0, self.width, step):
            here = (ids >= lo) & (ids < lo + step) if step < self.width else slice(None)
            map_ = np.zeros((int(used.sum()), min(step, -(-(self.width - lo) // 64) * 64)), bool)
            map_[rows[here], ids[here] - lo] = True
            words = np.packbits(map_, axis=1).view(np.uint64)
            run = max(1, BITS // 8 // words.shape[1])
            for k in range(0, len(x), run):
                same[k : k + run] += np.bitwise_count(words[place[x[k : k + run]]] & words[place[y[k : k + run]]]).sum(1, dtype=np.int64)
        return 100 * same >= self.percent * (self.sizes[x] + self.sizes[y] - same)


def _joined(t: pa.Table, columns: list[str], test: Test, percent: int) -> list[tuple[int, int]]:
    """The links that join components of a tile. A bucket's candidates are tried in runs, which grow while none links; pairs whose ends are joined before their run aren't tried."""
    x, y, like = _candidates(t, columns, test)
    if not len(x):
        return []
    d, key = t.column("d").to_pylist(), t.column("key").to_numpy()[x]
    component = np.unique(t.column("label").to_numpy(), return_inverse=True)[1]
    lists = t.column("tokens").combine_chunks()
    sets = np.split(lists.flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
    order = np.lexsort((-like, key))
    out = []
    for pairs in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        a, b, lo, size = x[pairs], y[pairs], 0, RUN
        if len(pairs) > FEW:
            rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            both = Overlaps([sets[k] for k in rows], percent)
        while lo < len(pairs):
            run = lo + np.flatnonzero(component[a[lo : lo + size]] != component[b[lo : lo + size]])
            lo += size
            if len(pairs) > FEW:
                run = run[both.link(at[run], at[len(pairs) + run])]
            else:
                run = [k for k in run if links(sets[a[k]], sets[b[k]], percent)]
            size = RUN if len(run) else min(2 * size, PAIRS)
            for k in run:
                p, q = component[a[k]], component[b[k]]
                if p != q:
                    component[component == q] = p
                    out.append((d[a[k]], d[b[k]]))
    return out


def tile_links(members: DataFrame, marks: DataFrame, on: list[str], sets: DataFrame, test: Test, percent: int, paths: list[str]) -> DataFrame:
    """Links (a, b) that join components within the buckets of members (key, d, n, label). marks has what else the test reads, by the columns on.

    A bucket has one value of each column of on but d, and only rows alike in these share a tile: their marks are of one width.
    """
    kinds = [c for c in on if c != "d"]
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / TOKENS)).cast("int")
    sizes = members.groupBy("key").agg(blocks.alias("blocks"))
    totals = members.groupBy(*kinds).agg(F.count("*").alias("_m"), F.coalesce(F.sum("n"), F.lit(0)).alias("_t")).collect()  # a row for each rung
    bins = F.lit(1)
    for r in totals:
        many = F.lit(max(1, -(-r["_m"] // BIN), -(-r["_t"] // TOKENS)))
        bins = F.when(reduce(and_, (F.col(c) == r[c] for c in kinds)), many).otherwise(bins) if kinds else many
    # buckets of one block share tiles; the number of a bin may be a key as well, since rows of different buckets aren't paired
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key", F.lit(13)), bins)).otherwise(F.col("key"))
    rows = members.join(sizes.hint("merge"), "key").withColumn("at", F.pmod(F.xxhash64("d", F.lit(11)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("tile", tile).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(marks.hint("merge"), on)
    columns = [c for c in members.columns + marks.columns if c not in {"key", *on} - {"d"}]
    columns = list(dict.fromkeys(columns)) + ["at"]
    rows = rows.select("tile", "key", *kinds, F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), *columns)

    def mark(t: pa.Table) -> pa.Table:
        x, y, _ = _candidates(t, columns, test)
        return t.take(pa.array(np.union1d(x, y)))

    marked = stored(rows.groupBy("tile", "i", "j", *kinds).applyInArrow(mark, rows.schema), "link-marked", paths)
    full = marked.hint("merge").join(sets.select("d", "tokens"), "d")

    def join(t: pa.Table) -> pa.Table:
        found = _joined(t, columns, test, percent)
        return pa.table({c: pa.array([p[k] for p in found], pa.int64()) for k, c in enumerate("ab")})

    return full.groupBy("tile", "i", "j", *kinds).applyInArrow(join, "a long, b long").distinct()
