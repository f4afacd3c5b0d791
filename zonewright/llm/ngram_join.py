r"""N-gram Jaccard join by token-combination prefixes: components of documents whose shingle sets overlap enough.

Documents with equal sets are one class, told apart by 128-bit digests and numbered; all that follows is about classes.

1. Screen. Tokens (hashed shingles) are ordered: first those that only one class has (unique), then those that exactly two have (rare), then all
   others (frequent), by hash within each. Two linked classes share a token of their prefixes of n - ceil(t n) + 1 tokens, and not
   a unique one; a class whose prefix is all unique has no partner and is done. A first pass counts only the tokens below a hash bound (those
   above count as frequent, so the order stays the same for all), the next ones all tokens of the classes left. What isn't unique in a class bounds its
   overlap with any other, a filter for all later pairs.
2. Index. A rare token names its two classes: single tokens suffice for classes whose prefix ends among the rare. Where it reaches the frequent
   tokens, tokens are dealt by hash into token classes, and the prefix is extended: a token class with c tokens of the prefix counts c - K + 1, and the prefix ends
   where these counts reach p = n - ceil(t n) + 1. Were fewer than K tokens of each token class shared, p tokens of the shorter prefix would be missing in the other set, one
   more than a link allows; so linked sets share K tokens of one token class, both within their prefixes, and the combinations of K tokens in each token class are indexed.
   The number of token classes belongs to a ladder of set sizes in steps of two; a set that may link with the next rung indexes that one too. A set leaves the
   buckets in which no other could overlap it enough.
3. Verify. Within a bucket each class is first paired with one leader, and links are verified exactly on whole sets. Buckets that then still hold more than one
   component are linked in tiles (see linkage): first the largest bucket of each class, which joins families at once, then all others. Candidates there are pairs of different
   components whose signatures allow a link: a byte for each of 4 (H + 1) token classes, of which linked sets differ in at most H. So a bucket of linked texts is
   not expanded into pairs, and no link between different components is lost. What stays quadratic is the comparison of signatures in a bucket of many similar texts that don't link.
4. Components by contraction and pointer jumping over the links.

Defined results: a null text, or one without words, has no shingles and links with nothing; shorter texts than k words are one
shingle; equal texts are in one component; rows that repeat an id are classified by their own texts; null ids take part and lose against others
as names. Other columns are ignored. A text of any length is one set; ties between leaders go by number. No side of these joins has a proven bound: the large ones are
hinted as sort-merge joins at every size alike, and none is hinted as broadcast. Tables between steps lie in the shared folder and are deleted when they are used up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, remove, shingle_set, stored
from .linkage import components, digests_of, mixed, sets_of, tile_links
from .linkage import tokens_of as _tokens
from .linkage import verified as _verified

#: Words of a shingle, least similarity in percent, and the fraction of the hash range that the screen counts.
WORDS, PERCENT, SCREEN = 4, 85, 0.25
#: Tokens of a combination, token classes for each token that the prefix has without extension, and screens on whole sets.
TOGETHER, SPREAD, SCREENS = 3, 1.85, 2
_K = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


class Ladder:
    """Set sizes in steps of two, with the parameters of each rung."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.least = percent, 1
        while 100 * self.least < percent * (self.least + 1):
            self.least += 1  # smaller sets link with equal ones only

    def rungs(self, n: int) -> list[int]:
        """That of the size, and the next one if a linked set may be there."""
        c = n.bit_length() - 1
        return [c, c + 1] if 100 * n // self.percent >= 2 << c else [c]

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def differ(self, c: int) -> int:
        """The most tokens in which two linked sets differ whose larger one is on rung c."""
        return (200 - 2 * self.percent) * ((2 << c) - 1) // (100 + self.percent)

    def classes(self, c: int) -> int:
        """Token classes of a rung: few enough that every set there can extend its prefix far enough."""
        n = max(self.least, -(-self.percent * (1 << c) // 100))
        return max(1, min(int(SPREAD * self.prefix(n)), (n - self.prefix(n)) // (TOGETHER - 1)))


def _sums(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The token classes in use, of m, and a hash of the combination of tokens in each."""
    j = (mix(tokens ^ _K[1]) % np.uint64(m)).astype(np.int64)
    order = np.argsort(j, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(j[order]) != 0))
    return j[order][first], np.add.reduceat(mix(tokens ^ _K[0])[order], first)


def _combined(hashes: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """Sums of every k hashes within one class; classes ascend."""
    sums, last = hashes, np.arange(len(hashes))
    for _ in range(k - 1):
        parts, ends = [], []
        step = 1
        while True:
            to = last + step
            ok = to < len(hashes)
            ok[ok] = classes[to[ok]] == classes[last[ok]]
            if not ok.any():
                break
            parts.append(sums[ok] + hashes[to[ok]])
            ends.append(to[ok])
            step += 1
        if not parts:
            return np.empty(0, np.uint64)
        sums, last = np.concatenate(parts), np.concatenate(ends)
    return sums


def combination_keys(tokens: np.ndarray, ladder: Ladder) -> tuple[np.ndarray, np.ndarray]:
    """The index keys of a set (ascending tokens) and their rungs: the combinations of TOGETHER tokens in each token class of its extended prefix."""
    keys, rungs = [], []
    if len(tokens) < ladder.least:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    for c in ladder.rungs(len(tokens)):
        j = (mix(tokens ^ _K[1]) % np.uint64(ladder.classes(c))).astype(np.int64)
        order = np.argsort(j, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(j[order]) != 0))
        place = np.empty(len(j), np.int64)
        place[order] = np.arange(len(j)) - np.repeat(first, np.diff(np.append(first, len(j))))  # of a token within its class
        end = int(np.searchsorted(np.cumsum(place >= TOGETHER - 1), ladder.prefix(len(tokens)))) + 1
        order = order[order < end]
        own = _combined(mix(tokens[order] ^ _K[0]), j[order], TOGETHER)
        keys.append(mix(own + np.array([c], np.uint64) * _K[3]))
        rungs.append(np.full(len(own), c, np.int64))
    return np.concatenate(keys), np.concatenate(rungs)


def signature(tokens: np.ndarray, ladder: Ladder, c: int) -> bytes:
    """A byte for each of 4 (H + 1) token classes of a rung: linked sets differ in at most H of them, most others in far more."""
    m = 4 * (ladder.differ(c) + 1)
    out = np.zeros(m, np.uint8)
    used, sums = _sums(tokens, m)
    out[used] = (mix(sums) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def _lists(arrays: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), kind))


def _screened(docs: DataFrame, ident: str, text: str, words: int, screen: float) -> DataFrame:
    """Per row: id, digest (a, b) of its set, size, and its tokens below the bound."""
    kind = docs.schema[ident].dataType.simpleString()
    bound = np.uint64(int(screen * 2.0**64) if screen < 1 else 2**64 - 1)

    def run(batches):
        split = Words()
        for b in batches:
            digests, sizes, low = [], [], []
            for _, arrays in split.of([x.as_py() for x in b.column(1)]):
                sets = [shingle_set(h, words) for h in arrays]
                digests += digests_of(sets).tolist()
                sizes += map(len, sets)
                low += [s[: np.searchsorted(s, bound)] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in digests], pa.int64()) for k in (0, 1)), pa.array(sizes, pa.int64()), _lists(low)], names=["id", "a", "b", "n", "low"])

    return docs.select(F.col(ident), F.col(text).cast("binary")).mapInArrow(run, f"id {kind}, a long, b long, n long, low array<long>")


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """(d, n, s, keys, rungs) of whole sets."""

    def run(batches):
        ladder = Ladder(percent)
        for b in batches:
            keys, rungs = zip(*(combination_keys(_tokens(x), ladder) for x in b.column("tokens"))) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("n"), b.column("s"), _lists(list(keys)), _lists(list(rungs))], names=["d", "n", "s", "keys", "rungs"])

    return sets.select("d", "n", "s", "tokens").mapInArrow(run, "d long, n long, s long, keys array<long>, rungs array<long>")


def _signed(sets: DataFrame, percent: int) -> DataFrame:
    """(d, c, sig): each set's signatures on its rungs."""

    def run(batches):
        ladder = Ladder(percent)
        for b in batches:
            rows = [(d, c, signature(t, ladder, c)) for d, t in ((d.as_py(), _tokens(x)) for d, x in zip(b.column("d"), b.column("tokens"))) for c in ladder.rungs(len(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["d", "c", "sig"])

    return sets.select("d", "tokens").mapInArrow(run, "d long, c long, sig binary")


def _test(percent: int):
    """Candidates of a tile: what isn't unique in the two allows a link, and so do the signatures."""

    def test(t, x, y):
        n, s, sig = t["n"], t["s"], t["sig"]
        fits = np.minimum(s[y], s[x]) * (100 + percent) >= (n[y] + n[x]) * percent
        x, y = x[fits], y[fits]
        other = (sig[y] != sig[x]).sum(1)
        keep = other * (100 + percent) <= (200 - 2 * percent) // 2 * (n[y] + n[x])
        return x[keep], y[keep], -other[keep] / (n[y] + n[x])[keep]

    return test


def _may_link(n: Column, s: Column, m: Column, t: Column, percent: int) -> Column:
    """Whether sets of sizes n and m, of which at most s and t tokens are in any other set, can overlap enough."""
    return F.least(s, t) * (100 + percent) >= (n + m) * percent


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, screen: float = SCREEN) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id of the component), and set_id, the number of its class (null without shingles)."""
    spark = docs.sparkSession
    paths: list[str] = []
    rows = stored(_screened(docs, ident, text, words, screen), "join-rows", paths)
    known = rows.filter("n > 0").groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("low").alias("low"))
    known = stored(known.withColumn("d", F.monotonically_increasing_id()), "join-classes", paths)
    table = stored(rows.select("id", "a", "b", "n"), "join-table")

    # 1: the screen
    tokens = known.select(F.explode("low").alias("token"), "d").groupBy("token").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    unique = tokens.filter("lo = hi").groupBy(F.col("lo").alias("d")).agg(F.count("*").alias("u"))
    prefix = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    left = known.select("d", "rep", "a", "b", "n").join(unique.hint("merge"), "d", "left").filter(F.coalesce("u", F.lit(0)) < prefix)
    left = stored(left.select("d", "rep", "a", "b"), "join-left", paths)
    texts = docs.select(F.col(ident).alias("_id"), F.col(text).alias("t")).join(left.hint("merge"), F.col("_id").eqNullSafe(F.col("rep"))).select("d", "a", "b", "t")
    whole = stored(sets_of(texts, words), "join-sets", paths)
    if not whole.groupBy("d").count().filter("count > 1").isEmpty():  # rows given twice
        whole = stored(whole.dropDuplicates(["d"]), "join-sets", paths)

    # again on whole sets, among those that are left; what leaves makes more tokens unique
    for _ in range(SCREENS):
        tokens = whole.select(F.explode("tokens").alias("token"), "d").groupBy("token").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("c"))
        counted = stored(tokens.filter("c <= 2").groupBy("lo", "hi").agg(F.count("*").alias("c")), "join-counts", paths)
        twos = counted.filter("lo <> hi")
        ones = counted.filter("lo = hi").select(F.col("lo").alias("d"), F.col("c").alias("u"), F.lit(0).cast("long").alias("v"))
        part = lambda c: twos.select(F.col(c).alias("d"), F.lit(0).cast("long").alias("u"), F.col("c").alias("v"))  # noqa: B023, E731
        uv = ones.unionByName(part("lo")).unionByName(part("hi")).groupBy("d").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
        u, v = F.coalesce("u", F.lit(0)), F.coalesce("v", F.lit(0))
        whole = whole.select("d", "n", "tokens").join(uv.hint("merge"), "d", "left").filter(u < prefix).select("d", "n", "tokens", (F.col("n") - u).alias("s"), (u + v < prefix).alias("combos"))
        whole = stored(whole, "join-sets", paths)
    size = whole.select("d", "n", "s")
    named = lambda x: size.select(F.col("d").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    fits = _may_link(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"), percent)
    singles = twos.select(F.col("lo").alias("a"), F.col("hi").alias("b")).join(named("a"), "a").join(named("b"), "b").filter(fits).select("a", "b")

    # 2: the index of combinations; a member that none of its bucket can link with leaves the bucket
    index = _index(whole.filter("combos"), percent).select("d", "n", "s", F.explode(F.arrays_zip("keys", "rungs")).alias("k")).select(F.col("k.keys").alias("key"), F.col("k.rungs").alias("c"), "d", "n", "s")
    for _ in range(2):
        bucket = index.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("n").alias("nb"), F.max("s").alias("sb")).filter("lo < hi").select("key", "nb", "sb")
        index = stored(index.join(bucket.hint("merge"), "key").filter(_may_link(F.col("n"), F.col("s"), F.col("nb"), F.col("sb"), percent)).select("key", "c", "d", "n", "s"), "join-index", paths)

    # 3: leaders, those with the largest share of tokens in common with others; then tiles of the largest buckets, then of all
    order = F.struct((-F.col("s") / F.col("n")).alias("o"), "d", "n", "s")
    lead = index.groupBy("key").agg(F.min(order).alias("l"))
    stars = index.join(lead.hint("merge"), "key").filter(F.col("d") != F.col("l.d")).filter(_may_link(F.col("n"), F.col("s"), F.col("l.n"), F.col("l.s"), percent))
    stars = stars.groupBy(F.col("d").alias("a")).agg(F.min("l").alias("l")).select("a", F.col("l.d").alias("b"))
    edges = stored(_verified(singles.unionByName(stars), whole, percent), "join-links", paths)
    labels = components(edges, paths)
    for largest in (True, False):
        now = mixed(index, labels, paths)
        if now.isEmpty():
            break
        if largest:
            sizes = now.groupBy("key").agg(F.count("*").alias("m"))
            best = now.select("key", "d").join(sizes.hint("merge"), "key").groupBy("d").agg(F.max_by("key", F.struct("m", "key")).alias("key")).select("key").distinct()
            now = now.join(best.hint("merge"), "key", "left_semi")
        marks = _signed(whole.join(now.select("d").distinct().hint("merge"), "d", "left_semi"), percent)
        more = stored(tile_links(now, marks, ["d", "c"], whole, _test(percent), percent, paths), "join-links", paths)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = components(edges, paths)

    # 4: names
    names = known.select("a", "b", "d", "rep").join(labels.withColumnRenamed("node", "d").hint("merge"), "d", "left").withColumn("label", F.coalesce("label", "d"))
    least = names.groupBy("label").agg(F.min("rep").alias("component_id"))
    names = stored(names.join(least, "label").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "d", "component_id"), "join-names")
    remove(spark, *paths)
    out = table.join(names, (F.col("n") > 0) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    return out.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("d").alias("set_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM g JOIN r ON g.doc_id = r.a GROUP BY g.doc_id, len(g.s)
"""
