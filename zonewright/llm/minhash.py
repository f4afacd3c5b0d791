r"""MinHash near-duplicates by a signature-coordinate inverted join.

Each set of shingles has a signature of K minima, and is posted under each pair of coordinate and value. Two sets of similarity s collide in each coordinate with
probability s, so linked ones (s >= 0.8) in 51 of 64 on average; pairs with at least T = 30 collisions are retained and verified on whole sets. That a link
has fewer is a matter of less than 1e-8 (the binomial tail at s = 0.8, less above).

1. Equal sets are one class, told apart by 128-bit digests and numbered. Classes are posted, lists with one class dropped.
2. Prefix. A pair with T collisions has one in any K - T + 1 coordinates. So a class needs a list shared with others among the first that many (the screen), and
   then T shared lists in all; only the K - T + 1 shortest lists of a class (those it has alone come first, then by length and coordinate) are merged, the long ones are skipped.
3. Merge. Each class first meets the leader of most of its lists; links are verified and make components. Lists that still hold several components are merged in
   tiles: collisions are counted in all K coordinates at once, and pairs that reach T are verified. First each class's longest list, which joins
   families at once; then all lists, where a pair counts only in the first list that the two have in common, so it is looked at once.

Defined results: a null text, or one without words, has no shingles, links with nothing and is kept; shorter texts than k words are one shingle; equal texts are in one
component; rows that repeat an id are classified by their own texts; null ids take part and lose against others as names. Other columns are ignored. A text of any length is
one set. Ties between leaders go to the smaller number. No table is broadcast by hint, no list of candidates is cut, and pairs are never rows before they link (but for one leader a class).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import Words, mix, remove, shingle_set, stored
from .linkage import components, digests_of, mixed, sets_of, tile_links, verified

#: Words of a shingle, least similarity in percent, coordinates, and collisions of a pair that is verified.
WORDS, PERCENT, COORDINATES, MATCHES = 4, 80, 64, 30
#: Tokens hashed at once, and passes of the screen on all coordinates.
RUN, SCREENS = 1024, 2
_K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA3AAACB1D1C5D7F5)]


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, k + 1, dtype=np.uint64)
    return mix(i * _K[0])[:, None], (mix(i * _K[1]) | np.uint64(1))[:, None]


def signatures(sets: list[np.ndarray], k: int = COORDINATES) -> np.ndarray:
    """The minima of each non-empty set, 32 bits a coordinate, a row a set; sets are hashed in runs of bounded size."""
    salt, odd = _seeds(k)
    out = np.empty((len(sets), k), np.uint32)
    run, size, begin = [], 0, 0

    def flush(end: int) -> None:
        if run:
            flat = np.concatenate(run)
            starts = np.cumsum([0, *map(len, run[:-1])])
            out[begin:end] = (np.minimum.reduceat((flat ^ salt) * odd, starts, axis=1) >> np.uint64(32)).T

    for i, s in enumerate(sets):
        if len(s) > RUN:
            flush(i)
            least = np.full((k, 1), np.iinfo(np.uint64).max, np.uint64)
            for a in range(0, len(s), RUN):
                np.minimum(least, ((s[a : a + RUN] ^ salt) * odd).min(1, keepdims=True), out=least)
            out[i] = (least[:, 0] >> np.uint64(32)).astype(np.uint32)
            run, size, begin = [], 0, i + 1
            continue
        run.append(s)
        size += len(s)
        if size >= RUN:
            flush(i + 1)
            run, size, begin = [], 0, i + 1
    flush(len(sets))
    return out


def smallest(percent: int) -> int:
    """The least size of a set that can link with a different one."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def _signed(docs: DataFrame, ident: str, text: str, words: int, percent: int) -> DataFrame:
    """Per row: id, digest (a, b), size, signature (null where only equal sets can link)."""
    kind, least = docs.schema[ident].dataType.simpleString(), smallest(percent)

    def run(batches):
        split = Words()
        for b in batches:
            pairs, sizes, sigs = [], [], []
            for _, arrays in split.of([x.as_py() for x in b.column(1)]):
                sets = [shingle_set(h, words) for h in arrays]
                pairs += digests_of(sets).tolist()
                sizes += map(len, sets)
                large = [s for s in sets if len(s) >= least]
                rows = iter(signatures(large).view(np.int32)) if large else iter(())
                sigs += [next(rows) if len(s) >= least else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)), pa.array(sizes, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=["id", "a", "b", "n", "sig"])

    return docs.select(F.col(ident), F.col(text).cast("binary")).mapInArrow(run, f"id {kind}, a long, b long, n long, sig array<int>")


def _posts(classes: DataFrame, coordinates: int) -> DataFrame:
    """(d, at, key): a posting for each of the first coordinates."""
    posts = classes.select("d", F.posexplode(F.slice("sig", 1, coordinates)).alias("at", "v"))
    return posts.select("d", "at", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))


def collisions(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _close(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _test(percent: int, once: bool):
    """Candidates of a tile: sizes within reach and enough collisions; once: only where the bucket is the first that both have in common."""

    def test(t, x, y):
        n, sig = t["n"], t["sig"]
        fits = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
        x, y = x[fits], y[fits]
        same = sig[x] == sig[y]
        like = same.sum(1)
        keep = like >= MATCHES
        if once:
            rank = np.where(same, t["rank"][x], np.iinfo(np.int64).max).min(1)
            keep &= rank == t["own"][x]
        return x[keep], y[keep], like[keep].astype(np.float64)

    return test


def _lists(left: DataFrame, paths: list[str]) -> DataFrame:
    """Adds rank: for each coordinate the rank of the class's list in the order of all (by length, then coordinate), null where it has the list alone; and drops
    classes that share fewer than MATCHES lists."""
    posts = _posts(left, COORDINATES)
    counts = stored(posts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "minhash-lists", paths)
    shared = posts.join(counts.hint("merge"), "key").select("d", F.struct("at", (F.col("c") * 256 + F.col("at")).alias("rank")).alias("x"))
    ranks = shared.groupBy("d").agg(F.collect_list("x").alias("x")).filter(F.size("x") >= MATCHES)  # of up to COORDINATES
    full = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.coalesce(F.map_from_entries("x")[i], F.lit((1 << 62)).cast("long")))
    out = left.drop("rank").join(ranks.select("d", full.alias("rank")).hint("merge"), "d")
    return stored(out, "minhash-left", paths)


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id of the component)."""
    spark = docs.sparkSession
    paths: list[str] = []
    rows = stored(_signed(docs, ident, text, words, percent), "minhash-rows")
    known = rows.filter("n > 0").groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    known = stored(known.withColumn("d", F.monotonically_increasing_id()), "minhash-classes", paths)

    # the screen: a list shared among the first coordinates, then enough shared lists
    prefix = COORDINATES - MATCHES + 1
    large = known.filter("sig is not null").select("d", "rep", "a", "b", "n", "sig")
    lists = _posts(large, prefix).groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    alone = lists.filter("lo = hi").groupBy(F.col("lo").alias("d")).agg(F.count("*").alias("c")).filter(F.col("c") == prefix)
    left = stored(large.join(alone.hint("merge"), "d", "left_anti"), "minhash-left", paths)
    for _ in range(SCREENS):
        left = _lists(left, paths)

    # the index of prefixes
    named = F.transform("rank", lambda r, i: F.struct(r.alias("own"), i.alias("at")))
    first = F.slice(F.array_sort(named), F.lit(1), F.lit(prefix) - F.size(F.filter("rank", lambda r: r == (1 << 62))))
    index = left.select("d", "n", F.explode(first).alias("p"), "sig").select("d", "n", F.col("p.own").alias("own"), (F.shiftleft(F.col("p.at").cast("long"), 32) + F.get("sig", F.col("p.at")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    index = stored(index, "minhash-index", paths)
    texts = docs.select(F.col(ident).alias("_id"), F.col(text).alias("t")).join(left.select("d", "rep", "a", "b").hint("merge"), F.col("_id").eqNullSafe(F.col("rep"))).select("d", "a", "b", "t")
    sets = stored(sets_of(texts, words), "minhash-sets", paths)
    if not sets.groupBy("d").count().filter("count > 1").isEmpty():  # rows given twice
        sets = stored(sets.dropDuplicates(["d"]), "minhash-sets", paths)

    # leaders
    lead = index.groupBy("key").agg(F.min("d").alias("l"), F.max("d").alias("_h")).filter("l < _h").select("key", "l")
    votes = index.join(lead.hint("merge"), "key").filter("d <> l").groupBy("d", "l").agg(F.count("*").alias("w"))
    stars = votes.groupBy(F.col("d").alias("a")).agg(F.min_by("l", F.struct(-F.col("w"), "l")).alias("b"))
    of = lambda x: left.select(F.col("d").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"))
    stars = stars.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").filter(_close(F.col("na"), F.col("nb"), percent) & (collisions(F.col("siga"), F.col("sigb")) >= MATCHES)).select("a", "b")
    edges = stored(verified(stars, sets, percent), "minhash-links", paths)
    labels = components(edges, paths)

    # tiles: each class's longest list, then all lists
    for once in (False, True):
        now = mixed(index, labels, paths)
        if now.isEmpty():
            break
        marks = left.select("d", "sig", *(["rank"] if once else []))
        if not once:
            longest = now.groupBy("d").agg(F.max_by("key", F.struct("own", "key")).alias("key"))
            now = now.drop("own").join(now.join(longest.hint("merge"), ["d", "key"], "left_semi").select("key").distinct().hint("merge"), "key", "left_semi")
        more = stored(tile_links(now, marks, ["d"], sets, _test(percent, once), percent, paths), "minhash-links", paths)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = components(edges, paths)

    names = known.select("a", "b", "d", "rep").join(labels.withColumnRenamed("node", "d").hint("merge"), "d", "left").withColumn("label", F.coalesce("label", "d"))
    least = names.groupBy("label").agg(F.min("rep").alias("component_id"))
    names = stored(names.join(least, "label").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "component_id"), "minhash-names")
    remove(spark, *paths)
    out = rows.select("id", "a", "b", "n").join(names, (F.col("n") > 0) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    return out.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """classes(), and kept: whether the row is the one that stays of its component."""
    out = classes(docs, ident, text, words, percent)
    return out.withColumn("kept", F.col(ident).eqNullSafe(F.col("component_id")))


#: The same in DuckDB SQL, by all shared shingles.
SQL = f"SELECT *, doc_id = component_id AS kept FROM ({ngram_join.SQL.replace('>= 85 *', f'>= {PERCENT} *')})"
