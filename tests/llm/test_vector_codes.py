"""Vector codes against plain k-means in integers."""

import hashlib
import math

import numpy as np
import pytest

from zonewright.llm import vector_codes
from zonewright.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def plain(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    kept = sorted(((i, v + [0] * (width - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // 4
    part = lambda v, p: v[w * p : w * p + w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(part(v, p), e), k) for k, e in enumerate(books[p])) for p in range(4)] for _, v, _ in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(4):
            for k in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(kept, codes) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), label) for (i, _, label), c in zip(kept, assign())]
    return [(i, code, e, sum(x[2] for x in out if x[3] == label), sha) for i, code, e, label in out]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string")


def same(spark, rows, **more):
    got = [tuple(r) for r in vector_codes.encode(table(spark, [(*r, "clash") for r in rows]), **more).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(plain(rows, **more), key=key)


def test_against_plain_k_means(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i), [float(x) for x in centres[i % 12] + rng.normal(scale=0.1, size=8)], int(i) % 3 if i % 5 else None) for i in range(300)]
    same(spark, rows, entries=16, rounds=3)
    same(spark, rows)


def test_ties_repeats_nulls_and_odd_lengths(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (2, [0.25] * 8, 2), (3, None, 1), (4, [1.0, None] * 4, 1), (5, [math.nan] * 8, 1), (6, [math.inf] * 8, 1), (None, [-0.001] * 8, None), (7, [1.0, 2.0, 3.0], None), (8, [], 4)]
    same(spark, rows, entries=4)
    same(spark, [(1, [1.0] * 9, None)])
    same(spark, [(1, [], 1), (2, [], None)])
    assert vector_codes.encode(table(spark, [])).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [float(i * 10**11), -1e10, 3.0, i / 7], i % 2) for i in range(20)]
    got = {r["vec_id"]: r for r in vector_codes.encode(table(spark, [(*r, "") for r in rows]), entries=4).collect()}
    want = {r[0]: r for r in plain(rows, entries=4)}
    assert all(got[i]["code"] == want[i][1] and got[i]["error"] == min(want[i][2], 2**63 - 1) and got[i]["codebooks_sha256"] == want[i][4] for i in got)
    assert vector_codes.encode(table(spark, [(1, [1.7e308] * 4, 1, ""), (2, [-1.7e308] * 4, 1, "")]), entries=1).count() == 2


def test_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, size=(256, 16))
    parts = centres[rng.integers(0, 256, 3000)] + rng.integers(-150, 150, size=(3000, 16))
    pivots = vector_codes.far_apart(centres, 8)
    code, best, evaluated = vector_codes.nearest(parts, vector_codes.distances(parts, pivots), centres, pivots)
    d = ((parts[:, None, :] - centres[None]) ** 2).sum(-1)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
    assert evaluated < 0.25 * d.size
