"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from zonewright.llm import merkle

from test_llm import DOCS, edge_docs, empty_docs


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, n):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(f(r[0]), f(r[3]), f(r[2]), f(n), f(r[1]))


def tree(level):
    """(root, for each leaf its [(sibling or None, whether the leaf's side is the right one)])"""
    paths, under = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        above, groups = [], []
        for a in range(0, len(level), 2):
            run = level[a : a + 2]
            for k in range(len(run)):
                for m in under[a + k]:
                    paths[m].append((run[1 - k] if len(run) == 2 else None, k == 1))
            above.append(digest(*run))
            groups.append(sum(under[a : a + 2], []))
        level, under = above, groups
    return level[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    trees = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append((own, *tree([leaf(r, r[4]) for r in own])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (own, sub, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur = leaf(r, r[4] + bad if r[4] is not None else None)
            for sibling, right in path + top:
                cur = digest(cur) if sibling is None else digest(sibling, cur) if right else digest(cur, sibling)
            out.append((r[0], leaf(r, r[4]), sub, root, digest(*(s for s, _ in path + top if s)), cur, cur == root))
    return out


def same(got, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize(("n", "langs", "fan"), [(1, 1, 10), (2, 2, 10), (57, 1, 2), (257, 3, 3), (130, 40, 2)])
def test_against_a_plain_tree(spark, n, langs, fan):
    rows = [(7 * i, f"text {i}" * (i % 3), None if i % langs == 0 and langs > 2 else f"l{i % langs}", "a" if i % 2 else None, None if i % 11 == 0 else i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    same(merkle.manifest(docs, fan=fan), rows)


def test_edges(spark):
    docs = edge_docs(spark).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit("clash"))
    same(merkle.manifest(docs), [tuple(r)[:5] for r in edge_docs(spark).collect()])
    big = [(0, "x", "e", "s", 2**63 - 1), (1, "y", "e", "s", -(2**63)), (7, "é\x00", "é", "", 0)]
    same(merkle.manifest(spark.createDataFrame(big, DOCS)), big)
    assert merkle.manifest(empty_docs(spark)).count() == 0


def test_the_sessions_bound_is_set_back(spark):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    merkle.manifest(edge_docs(spark))
    assert spark.conf.get(key) == before
