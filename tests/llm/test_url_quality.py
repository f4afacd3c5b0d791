"""URL verdicts where no rule names the url, and suffix statistics by either join."""

import random

from pyspark.sql import functions as F

from zonewright.llm import urlfilter

RULES = (("allow", "good.zz", "/"), ("block", "bad.zz", "/"), ("block", "mixed.ww", "/es/"))


def url(rng, host, bad):
    words = lambda n: "/".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    if bad:
        return f"http://{host}/{words(1)}/{rng.randrange(10**11, 10**12)}?a={rng.randrange(10**6)}&b=1&c=2"
    return f"http://{host}/{words(rng.randrange(1, 4))}" + (f"/{rng.randrange(10)}" if rng.random() < 0.3 else "")


def test_verdicts_of_urls_that_no_rule_names(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        bad = rng.random() < 0.8  # the labelled kinds are far from balanced
        rows.append((i, url(rng, f"s{rng.randrange(40)}.{'bad' if bad else 'good'}.zz", bad), None))
    for i in range(3000, 4000):
        bad = rng.random() < 0.5
        rows.append((i, url(rng, f"h{rng.randrange(90)}.{rng.choice(['other.yy', 'zz', 'more.xx'])}", bad), bad))
    judged = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, truth boolean"), rules=RULES)
    got = {r.page_id: r for r in judged.collect()}
    assert len(got) == len(rows)
    pairs = [(got[i].verdict == "block", bad) for i, _, bad in rows if bad is not None]
    assert all(got[i].rule is None for i, _, bad in rows if bad is not None)
    for kind in (True, False):
        hit = sum(v == bad == kind for v, bad in pairs)
        assert hit >= 0.9 * sum(v == kind for v, _ in pairs), "precision"
        assert hit >= 0.9 * sum(bad == kind for _, bad in pairs), "recall"


def prepared(spark, rows):
    df = spark.createDataFrame(rows, "i long, _url string, y int")
    df = urlfilter.lexical(df.withColumns({"host": urlfilter.host_of(F.col("_url")), "path": urlfilter.path_of(F.col("_url"))}), "_url")
    return df


def test_suffix_statistics_against_plain_ones_by_either_join(spark):
    rng = random.Random(2)
    rows = [(i, f"http://a{rng.randrange(9)}.{rng.choice(['hot', 'hot', 'hot', 'b', 'c', 'd', 'e'])}.{rng.choice(['x', 'x', 'y', 'z'])}/{i}", rng.choice([0, 1, None])) for i in range(600)] + [(600, None, None), (601, "no host", None)]
    df = prepared(spark, rows)
    labelled, rest = df.filter("y is not null"), df.filter("y is null")
    ys = [y for *_, y in rows if y is not None]
    mean = sum(ys) / len(ys)
    tail = lambda u, k: ".".join(u.split("://")[1].split("/")[0].split(".")[-k:]) if u and "://" in u else ""
    for most in (1000, 3):
        model = urlfilter.train(labelled, unlabelled=rest, most=most)
        assert (model.rare is None) == (most == 1000) and model.mean == mean
        whole = {r.i: r for r in model.with_suffixes(df).collect()}
        own = {r.i: r for r in model.with_suffixes(df.withColumn("fold", urlfilter._fold("_url")), F.col("fold")).collect()}
        fold = {i: r.fold for i, r in own.items()}
        assert len(whole) == len(own) == len(rows)
        for i, u, _ in rows:
            for k in (1, 2):
                same = [(j, y) for j, v, y in rows if tail(v, k) == tail(u, k)]
                for found, used in ((whole[i], [y for _, y in same if y is not None]), (own[i], [y for j, y in same if y is not None and fold[j] != fold[i]])):
                    want = (sum(used) + (10 + len(same) - len(used)) * mean) / (10 + len(same))
                    assert abs(found[f"suffix{k}"] - want) < 1e-9, (most, i, k)
