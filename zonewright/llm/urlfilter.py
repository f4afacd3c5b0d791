r"""URL filters: host rules, and gradient-boosted trees on lexical features for what no rule fits, with DataFrame functions only.

Rules are (verdict, host, path): a rule fits its host and all subdomains of it if the url's path starts with the rule's; the longest wins. The rules
label the urls they fit; the trees are trained on those and judge the others.

Features: length, path depth, digit ratio, character entropy, number of parameters, host labels, hyphens in the host, and for the last
one and two host labels a suffix statistic: the share of blocked urls, in which PRIOR_ROWS rows and every row that no rule labels count as the mean, so that a suffix
of which the rules name only the bad part isn't bad as a whole. The statistics are counted over all rows, by the suffix's 128-bit digest, which bounds the table's width. The SUFFIXES most frequent suffixes
are broadcast; where there are more, rows of the others find theirs by a shuffled join. The trees are fitted on about TRAIN_ROWS different labelled urls, chosen by a hash of the
url; however often a url is repeated it counts once. What a row is fitted on leaves out the labels of its own one of FOLDS folds of urls, and
one fold is fitted without suffix statistics, as urls of suffixes without labels are judged. Features are cut into at most BINS bins,
equal rows are merged, and each level of each tree is one grouped aggregate of gradients by (node, feature, bin). What comes to the driver are those histograms, whose size the
parameters fix. The finished trees are CASE expressions. The threshold is the score that tells the two kinds of labelled urls in the sample apart best if both count alike.

Defined results: a null url, or one without `://`, has an empty host and path; no labelled rows: all are allowed, with score 0; labels of one kind
only: that verdict. Repeated rows get equal results; other columns are ignored. A url of any length is one string in generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, remove, stored

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_ROWS, BINS, TREES, DEPTH, RATE, SHRINK, LEAST, SUFFIXES, PRIOR_ROWS, FOLDS, STEPS = 20_000, 16, 10, 3, 0.4, 1.0, 1.0, 1 << 16, 10, 5, 100
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "suffix1", "suffix2")

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # the last condition added is tried first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def count_of(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds the features that need no statistics, and the suffixes."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: F.when(c == "", 0).otherwise(n - F.length(F.replace(u, c, F.lit("")))))
    entropy = F.when(n == 0, 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, x: a + F.when(x == 0, 0.0).otherwise(-(x / n) * F.log2(x / n))))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return df.withColumns(
        {
            "length": n.cast("double"),
            "depth": count_of(F.col("path"), "/").cast("double"),
            "digits": F.when(n == 0, 0.0).otherwise(F.regexp_count(u, F.lit("[0-9]")) / n),
            "entropy": F.round(entropy, 6),
            "parameters": F.when(query == "", 0).otherwise(count_of(query, "&") + 1).cast("double"),
            "labels": F.when(F.col("host") == "", 0).otherwise(count_of(F.col("host"), ".") + 1).cast("double"),
            "hyphens": count_of(F.col("host"), "-").cast("double"),
            **{f"tail{k}": F.md5(F.substring_index("host", ".", -k)) for k in (1, 2)},
        }
    )


def _fold(url: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("folds"), url), F.lit(FOLDS)).cast("int")


@dataclass
class Trees:
    """frequent: the suffixes that are broadcast, as (k, tail, size, blocked, labelled, folds), None for none; rare: the others, None for none; trees: nested (feature, threshold, left, right) or leaf values; threshold: the least score of a blocked url; mean: the share of blocked urls among all labelled."""

    prior: float
    frequent: DataFrame | None
    trees: list
    rare: DataFrame | None = None
    threshold: float = 0.5
    mean: float = 0.0

    def with_suffixes(self, df: DataFrame, fold: Column | None = None) -> DataFrame:
        """Adds suffix1 and suffix2, the statistics of a row's suffixes; without the labels of one fold, if given."""
        for k in (1, 2):
            if self.frequent is None:
                df = df.withColumn(f"suffix{k}", F.lit(self.mean))
                continue
            own = lambda t: t.filter(F.col("k") == k).select(F.col("tail").alias("_tail"), F.struct("size", "blocked", "labelled", "folds").alias("_c"))  # noqa: B023, E731
            df = df.join(F.broadcast(own(self.frequent)), F.col(f"tail{k}") == F.col("_tail"), "left").drop("_tail")
            if self.rare is not None:
                # rows that have found theirs get keys of their own that meet nothing, so that no frequent suffix is one task's
                seek = F.when(F.col("_c").isNull(), F.concat(F.lit("="), f"tail{k}")).otherwise(F.concat(F.lit("-"), F.xxhash64("_url").cast("string")))
                rest = own(self.rare).select(F.concat(F.lit("="), "_tail").alias("_tail"), F.col("_c").alias("_d"))
                df = df.withColumn("_seek", seek).join(rest, F.col("_seek") == F.col("_tail"), "left").withColumn("_c", F.coalesce("_c", "_d")).drop("_seek", "_tail", "_d")
            c = F.col("_c")
            out = F.lit(None) if fold is None else F.element_at(c["folds"], fold + 1)
            blocked, labelled = (c[x] - F.coalesce(out[x], F.lit(0)) if fold is not None else c[x] for x in ("blocked", "labelled"))
            share = (blocked + (PRIOR_ROWS + c["size"] - labelled) * self.mean) / (PRIOR_ROWS + c["size"])
            df = df.withColumn(f"suffix{k}", F.coalesce(share, F.lit(self.mean))).drop("_c")
        return df

    def score(self) -> Column:
        """The probability of block, over columns named as FEATURES."""
        if self.prior in (0.0, 1.0):
            return F.lit(self.prior)
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for t in self.trees:
            total = total + _case(t, lambda f, at: F.col(f) > at)
        return 1 / (1 + F.exp(-total))


def _case(tree, goes_right) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, at, left, right = tree
    return F.when(goes_right(f, at), _case(right, goes_right)).otherwise(_case(left, goes_right))


def _counted(rows: DataFrame, mean: float, most: int) -> Trees:
    """A model with suffix statistics and no trees yet; rows: tail1, tail2, _url, and y, null for unlabelled ones."""
    tails = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"tail{k}").alias("tail")) for k in (1, 2))))
    sums = (F.coalesce(F.sum("y"), F.lit(0)).alias("blocked"), F.count("y").alias("labelled"))
    by_fold = rows.select("y", _fold("_url").alias("fold"), tails.alias("x")).groupBy("x.k", "x.tail", "fold").agg(F.count("*").alias("size"), *sums)
    own = lambda c, i: F.coalesce(F.sum(F.when(F.col("fold") == i, F.col(c))), F.lit(0)).alias(c)
    folds = F.array(*(F.struct(own("blocked", i), own("labelled", i)) for i in range(FOLDS)))
    counts = by_fold.groupBy("k", "tail").agg(F.sum("size").alias("size"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), folds.alias("folds"))
    counts = stored(counts, "url-suffixes")
    if counts.count() <= most:
        return Trees(mean, counts, [], mean=mean)
    frequent = stored(counts.orderBy(F.desc("size"), "k", "tail").limit(most), "url-frequent-suffixes", rows=most)
    # of a suffix without labels nothing is known, and a missing one says the same
    return Trees(mean, frequent, [], counts.filter("labelled > 0").join(F.broadcast(frequent.select("k", "tail")), ["k", "tail"], "left_anti"), mean=mean)


def _threshold(sample: DataFrame, score: Column) -> float:
    """The score at which the shares of both kinds that are judged right add up to most; of equal ones that nearest to one half."""
    at = F.least(F.floor(score * STEPS), F.lit(STEPS - 1)).cast("int").alias("at")
    rows = {r["at"]: (r["n"] - r["ones"], r["ones"]) for r in sample.groupBy(at).agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()}
    zeros, ones = (sum(x[i] for x in rows.values()) for i in (0, 1))
    right = lambda t: sum(x[0] for a, x in rows.items() if a < t) / zeros + sum(x[1] for a, x in rows.items() if a >= t) / ones
    return max(range(1, STEPS), key=lambda t: (round(right(t), 9), -abs(2 * t - STEPS))) / STEPS


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, unlabelled: DataFrame | None = None, folded: bool = False, most: int = SUFFIXES) -> Trees:
    """labelled: lexical() columns, _url, and y, 1 for block, the same for equal urls; unlabelled: rows that only the sizes of suffixes count.

    folded: each row is fitted on suffix statistics without its own fold, the rows of the first fold on none.
    """
    n, blocked, urls = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.approx_count_distinct("_url")).first()
    if not n or blocked in (0, n):
        return Trees(float(bool(n and blocked)), None, [], mean=float(bool(n and blocked)))
    use = ("y", "_url", "tail1", "tail2")
    every = labelled.select(*use)
    if unlabelled is not None:
        every = every.unionByName(unlabelled.withColumn("y", F.lit(None).cast("int")).select(*use))
    out = _counted(every, blocked / n, most)
    chance = F.pmod(F.xxhash64(F.lit("urls"), "_url"), F.lit(1 << 30)) / float(1 << 30)
    once = labelled.filter(chance < rows / urls).groupBy("_url").agg(*(F.first(c).alias(c) for c in ("y", *FEATURES[:-2], "tail1", "tail2")))
    paths: list[str] = []
    once = out.with_suffixes(once, _fold("_url") if folded else None)
    if folded:
        once = once.withColumns({f: F.when(_fold("_url") > 0, F.col(f)).otherwise(out.mean) for f in FEATURES[-2:]})
    sample = stored(once.coalesce(4), "url-sample", paths)
    size, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not size or ones in (0, size):
        return Trees(float(blocked * 2 >= n), None, [], mean=blocked / n)
    out.prior = prior = ones / size
    marks = [i / BINS for i in range(1, BINS)]
    cuts = sample.agg(*(F.percentile_approx(f, marks, 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    binned = sample.select("y", *(sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES))
    data = stored(binned.groupBy("y", *FEATURES).agg(F.count("*").alias("n")).coalesce(1), "url-bins", paths)
    total = F.lit(math.log(prior / (1 - prior)))
    for _ in range(TREES):
        grown = _grow(data, total, cuts)
        total = total + _case(grown, lambda f, at: F.col(f) > cuts[f].index(at))
        out.trees.append(grown)
    out.threshold = _threshold(sample, out.score())
    remove(labelled.sparkSession, *paths)
    return out


def _grow(data: DataFrame, total: Column, cuts: dict[str, list[float]]):
    """One tree on the gradients of the logistic loss; a level is one aggregate."""
    p = 1 / (1 + F.exp(-total))
    now = data.select(*FEATURES, (F.col("n") * (p - F.col("y"))).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
    splits: dict[int, tuple[str, int]] = {}  # node: (feature, last bin of the left side); the children of i are 2 i + 1 and 2 i + 2
    values: dict[int, float] = {}
    value = lambda g, h: -RATE * g / (h + SHRINK)
    for level in range(DEPTH):
        here = range(2**level - 1, 2 ** (level + 1) - 1)
        if level and not any((i - 1) // 2 in splits for i in here):
            break

        def at(i: int) -> Column:
            if i not in splits:
                return F.lit(i)
            f, b = splits[i]
            return F.when(F.col(f) > b, at(2 * i + 2)).otherwise(at(2 * i + 1))

        cells = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("b")) for f in FEATURES)))
        sums = now.select(at(0).alias("node"), "g", "h", cells.alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        seen: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
        for r in sums.collect():
            if r["node"] in here:
                seen.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (round(r["g"], 9), round(r["h"], 9))
        for node, features in sorted(seen.items()):
            first = features[FEATURES[0]].values()
            g_all, h_all = math.fsum(x[0] for x in first), math.fsum(x[1] for x in first)
            values[node] = value(g_all, h_all)
            best = (1e-6, None, None, 0.0, 0.0)
            for f in FEATURES:
                g = h = 0.0
                for b in sorted(features[f])[:-1]:
                    g, h = g + features[f][b][0], h + features[f][b][1]
                    if h < LEAST or h_all - h < LEAST:
                        continue
                    gain = round(g * g / (h + SHRINK) + (g_all - g) ** 2 / (h_all - h + SHRINK) - g_all * g_all / (h_all + SHRINK), 6)
                    if gain > best[0]:
                        best = (gain, f, b, g, h)
            if best[1]:
                splits[node] = best[1:3]
                values[2 * node + 1], values[2 * node + 2] = value(best[3], best[4]), value(g_all - best[3], h_all - best[4])

    def build(i: int):
        if i not in splits:
            return float(values.get(i, 0.0))
        f, b = splits[i]
        return (f, cuts[f][b], build(2 * i + 1), build(2 * i + 2))

    return build(0)


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url", rules=RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (the trees' probability of block)."""
    df = pages.select(F.col(ident), F.col(url).alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    df = lexical(df.withColumns({"rule": rule, "_verdict": verdict}), "_url")
    model = train(df.filter(F.col("rule").isNotNull()).withColumn("y", (F.col("_verdict") == "block").cast("int")), rows, df.filter(F.col("rule").isNull()), True)
    df = model.with_suffixes(df).withColumn("score", model.score())
    return df.select(ident, "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("score") >= model.threshold, "block").otherwise("allow")).alias("verdict"), "score")
