"""MinHash near-duplicates and the tiles that link, against brute force."""

import random

import numpy as np
import pytest

from zonewright.llm import linkage, minhash, ngram_join
from zonewright.llm.common import Words, ship, shingle_set

from test_llm import DOCS, brute_join, edge_docs, empty_docs, words


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        base = words(rng, rng.choice([4, 5, 9, 30, 80, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(["new", "word", "here"])
            texts.append(" ".join(w) + rng.choice(["", " tail"]))
    rng.shuffle(texts)
    got = found(minhash.near_duplicates(table(spark, texts)))
    want = brute_join(list(enumerate(texts)), 80)
    assert got == want


def family(n):
    """One component of texts near the threshold: common words and two of twenty blocks each."""
    common = [f"c{i}" for i in range(93)]
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20)] * -(-n // 190)
    return [" ".join(common + [f"b{x}{i}" for x in p for i in range(4)] + ([f"z{k // 190}"] if k >= 190 else [])) for k, p in enumerate(pairs[:n])]


def test_a_family_is_joined_without_trying_all_pairs(spark, monkeypatch):
    texts = family(190)
    split, tried = Words(), []
    sets = [shingle_set(next(iter(split.of([t.encode()])))[1][0], 4) for t in texts]
    assert found(minhash.near_duplicates(table(spark, texts))) == brute_join(list(enumerate(texts)), 80)
    import pyarrow as pa

    sigs = minhash.signatures(sets).view(np.int32)
    t = pa.table({"key": [1] * 190, "i": [0] * 190, "j": [0] * 190, "at": [0] * 190, "d": range(190), "n": [len(s) for s in sets], "label": range(190), "sig": pa.array(list(sigs), pa.list_(pa.int32())), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})
    real = linkage.links
    monkeypatch.setattr(linkage, "links", lambda *a: tried.append(1) or real(*a))
    out = linkage._joined(t, ["d", "n", "label", "sig", "at"], minhash._test(80, False), 80)
    assert len(out) <= 189 and len(tried) < 2000


def test_signatures_are_minima_over_whole_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (4, 1, 5000, 700, 700, 2)]
    salt, odd = minhash._seeds(64)
    for s, sig in zip(sets, minhash.signatures(sets)):
        assert (((s ^ salt) * odd).min(1) >> np.uint64(32) == sig).all()


def test_edges(spark):
    got = minhash.near_duplicates(edge_docs(spark))
    assert set(got.columns) == {"doc_id", "n_shingles", "component_id", "kept"}
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect())
    assert [r[1:] for r in rows if not r[0]] == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (5, 2, 5, True), (6, 1, 6, True), (7, 1, 7, True)]
    assert [(r[2], r[3], r[4]) for r in minhash.near_duplicates(edge_docs(spark).filter("doc_id is null")).select("doc_id", "doc_id", "n_shingles", "component_id", "kept").collect()] == [(1, None, True)]
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_ids_given_to_several_texts(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, None, None, 0), (1, "something else altogether here", None, None, 0), (2, text + " more", None, None, 0), (None, text, None, None, 0)], DOCS)
    got = sorted((r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (47, 1), (47, 1), (48, 1)]


def buckets(groups):
    """A tile: for each bucket (key, sets, labels), one row a set."""
    import pyarrow as pa

    rows = [(key, s, label) for key, sets, labels in groups for s, label in zip(sets, labels)]
    keys, sets, labels = zip(*rows)
    sigs = minhash.signatures(list(sets)).view(np.int32)
    zero = [0] * len(rows)
    return pa.table({"key": keys, "i": zero, "j": zero, "at": zero, "d": range(len(rows)), "n": [len(s) for s in sets], "label": labels, "sig": pa.array(list(sigs), pa.list_(pa.int32())), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})


def near(rng, n, size=60, pool=70):
    """Sets that overlap much: some pairs link, most don't quite."""
    tokens = rng.integers(0, 2**64, pool, dtype=np.uint64)
    return [np.unique(rng.choice(tokens, size + int(rng.integers(4)), replace=False)) for _ in range(n)]


COLUMNS = ["d", "n", "label", "sig", "at"]


def test_a_tile_of_many_buckets_pairs_only_within_them():
    rng = np.random.default_rng(3)
    groups = []
    for key in rng.permutation(400).tolist():
        n = int(rng.choice([2, 3, 5, 12]))
        groups.append((key, near(rng, n), (1000 * key + rng.integers(0, n, n)).tolist()))
    one = near(rng, 1)[0]
    groups += [(1000, [one, one[:-1]], [1, 2]), (1001, [one[:-2], one], [3, 3])]  # alike, in different buckets; and one component
    t = buckets(groups)
    key, label, sig = t["key"].to_pylist(), t["label"].to_pylist(), np.array(t["sig"].to_pylist())
    want = {(a, b) for a in range(len(key)) for b in range(a + 1, len(key)) if key[a] == key[b] and label[a] != label[b] and (sig[a] == sig[b]).sum() >= minhash.MATCHES}
    x, y, _ = linkage._candidates(t, COLUMNS, minhash._test(80, False))
    found = [tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())]
    assert len(found) == len(set(found)) and set(found) == want
    # one task's call handles them all; what it joins is what linked pairs join
    sets = [s for _, group, _ in groups for s in group]
    root = {}

    def find(v):
        while v in root:
            v = root[v]
        return v

    def join(pairs):
        root.clear()
        for a, b in pairs:
            if (p := find(label[a])) != (q := find(label[b])):
                root[p] = q
        return {frozenset(v for v in label if find(v) == r) for r in map(find, label)}

    out = linkage._joined(t, COLUMNS, minhash._test(80, False), 80)
    assert join(out) == join([p for p in want if linkage.links(sets[p[0]], sets[p[1]], 80)])


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 22])
def test_overlaps_in_bit_maps(bits, monkeypatch):
    monkeypatch.setattr(linkage, "BITS", bits)
    rng = np.random.default_rng(4)
    sets = near(rng, 30) + near(rng, 10, 500, 590) + [np.array([7], np.uint64), np.array([7], np.uint64), np.array([8], np.uint64)]
    x, y = np.triu_indices(len(sets), 1)
    both = linkage.Overlaps(sets, 80)
    want = [linkage.links(sets[a], sets[b], 80) for a, b in zip(x, y)]
    assert 0 < sum(want) < len(want) and both.link(x, y).tolist() == want
    assert both.link(x[:0], y[:0]).tolist() == []


def test_a_family_in_few_calls(monkeypatch):
    """Candidates that don't link are tried many at a time, and those within what has been joined aren't tried."""
    sets = [shingle_set(next(iter(Words().of([t.encode()])))[1][0], 4) for t in family(190)]
    tried, real = [], linkage.Overlaps.link
    monkeypatch.setattr(linkage.Overlaps, "link", lambda self, x, y: tried.append(len(x)) or real(self, x, y))
    out = linkage._joined(buckets([(1, sets, range(190))]), COLUMNS, minhash._test(80, False), 80)
    assert len(out) <= 189 and sum(tried) < 2000
    tried.clear()
    sets = near(np.random.default_rng(5), 150, 60, 78)  # similarity about 0.63, where almost none links
    linkage._joined(buckets([(1, sets, range(150))]), COLUMNS, minhash._test(80, False), 80)
    assert sum(tried) > 5000 and len(tried) < 100


def test_digests_of_a_run_are_those_of_its_sets():
    sets = [s for s in near(np.random.default_rng(6), 20)] + [np.empty(0, np.uint64), np.array([5], np.uint64)]
    assert [tuple(k) for k in linkage.digests_of(sets).tolist()] == [linkage.digest_of(s) for s in sets] and linkage.digest_of(sets[-2]) == (0, 0)
    assert linkage.digests_of([]).shape == (0, 2)


def test_small_buckets_share_tiles(spark, monkeypatch):
    """Buckets of one block meet in tiles of many, larger ones in tiles of two blocks; no link is lost either way."""
    rng = random.Random(9)
    texts = []
    for k in range(40):
        base = [f"t{k}x{i}" for i in range(80)]
        for j in range(rng.randrange(2, 7)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(80)] = f"n{k}x{j}"
            texts.append(" ".join(w))
    want = brute_join(list(enumerate(texts)), 80)
    for block, size in ((1024, 256), (2, 8)):
        monkeypatch.setattr(linkage, "BLOCK", block)
        monkeypatch.setattr(linkage, "BIN", size)
        assert found(minhash.near_duplicates(table(spark, texts))) == want


def test_buckets_of_different_rungs_share_no_tile(spark):
    """Signatures are as wide as their rung asks for; buckets of two rungs in one tile could not be read as one matrix."""
    ladder, rng = ngram_join.Ladder(), np.random.default_rng(1)
    members, marks, sets = [], [], []
    for d, n in enumerate((40, 40, 200, 200, 200)):
        tokens = np.sort(rng.integers(0, 2**63, n, np.uint64)) if d in (0, 2) else np.sort(np.append(tokens[:-1], np.uint64(d)))
        c = ladder.rungs(n)[0]
        members.append((1 if n == 40 else 2, c, d, n, n, d))
        marks.append((d, c, ngram_join.signature(tokens, ladder, c)))
        sets.append((d, tokens.view(np.int64).tolist()))
    frames = [spark.createDataFrame(*x) for x in ((members, "key long, c long, d long, n long, s long, label long"), (marks, "d long, c long, sig binary"), (sets, "d long, tokens array<long>"))]
    out = {frozenset(r) for r in linkage.tile_links(frames[0], frames[1], ["d", "c"], frames[2], ngram_join._test(85), 85, []).collect()}
    assert len(out) == 3 and frozenset((0, 1)) in out and frozenset().union(*out - {frozenset((0, 1))}) == {2, 3, 4}
