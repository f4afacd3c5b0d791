"""Operators of the llm subpackage against brute force, libraries, exact round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from zonewright.llm import bpe, chat, langid, license_scan, mixing, ngram_join, topk, transport_stream, urlfilter, warc
from zonewright.llm.common import Words, rolling, ship, shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_docs(spark):
    """Nulls, empty and repeated rows, a very long text, and a column with a clashing name."""
    long = "lorem ipsum " * 200_000
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "One  two\tthree", "en", "a", 1), (3, "One  two\tthree", "en", "a", 1), (None, "x", None, "b", 1), (5, long, "fr", None, 1), (6, "\u00e9t\u00e9 \U0001f600\x00 z", "fr", "b", 1), (7, "123 !!", "de", "b", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("payload_bytes", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("_id", F.lit("clash"))


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1: transport streams


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 11_519, 11_520, 11_521, 200_000])
def test_stream_round_trip(n):
    payload = transport_stream.padded(random.Random(n).randbytes(n))
    s = transport_stream.demux(transport_stream.mux(payload))
    assert s.payload == {transport_stream.ES_PID: payload}
    assert (s.continuity_errors, s.crc_errors, s.sync_errors) == (0, 0, 0)
    units = -(-len(payload) // transport_stream.UNIT)
    assert s.timestamps[transport_stream.ES_PID] == [90_000 + 3_600 * k for k in range(units)]
    assert s.random_access[transport_stream.ES_PID] == list(range(0, units, 8))


def test_stream_faults_are_counted():
    data = transport_stream.mux(bytes(5000))
    assert transport_stream.demux(data[: 188 * 6] + data[188 * 7 :]).continuity_errors == 1
    assert transport_stream.demux(data[:10] + b"\xff" + data[11:]).crc_errors == 1
    assert transport_stream.demux(b"\x00" + data[1:]).sync_errors == 1


def test_media_rows(spark):
    got = transport_stream.stream_index(transport_stream.media_column(edge_docs(spark))).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in edge_docs(spark).collect()}
    assert len(got) == 8
    for r in got:
        want = transport_stream.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert transport_stream.stream_index(transport_stream.media_column(empty_docs(spark))).count() == 0


# ---- 2: mixing


def brute_mix(docs, weights=(5, 2, 1)):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs]
    sources = sorted({d.source for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for d, n in zip(docs, size) if d.source == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        open_ = [s for s in sources if s not in full]
        target = {s: 2.0 * total[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in sources}
        over = {s for s in open_ if target[s] > 2 * total[s]}
        if not over:
            return size, total, target
        full |= over


def test_mix_against_brute_force(spark):
    rng = random.Random(5)
    docs = [Row(doc_id=i, text=" ".join(words(rng, rng.choice([0, 1, 5, 40]))), source=rng.choice(["hot"] * 5 + ["a", "b", "c", None])) for i in range(300)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    size, total, target = brute_mix(docs)
    for d, n in zip(docs, size):
        r = got[d.doc_id]
        assert (r.size, r.source_size) == (n, total[d.source])
        assert r.target == pytest.approx(target[d.source])
        assert 0 <= r.taken <= 2 * n
    for s in total:
        assert sum(got[d.doc_id].taken for d in docs if d.source == s) == int(target[s] + 1e-9)


def test_mix_edges(spark):
    assert mixing.mix(edge_docs(spark)).count() == 8
    assert mixing.mix(empty_docs(spark)).count() == 0


# ---- 3: WARC


def test_warc_revisits(spark):
    rows = [(1, "http://a", "x" * 10), (2, "http://b", "x" * 10), (3, None, None), (4, "u\nv", ""), (5, "http://e", "caf\u00e9" * 50_000), (None, "n", "only"), (6, "http://f", "solo"), (6, "http://f", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_payload", F.lit(1))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.round_trip(pages).collect()), key=str)
    size = {i: len((h or "").encode()) for i, _, h in rows}
    digest = {i: warc.digest((h or "").encode()) for i, _, h in rows}
    refers = {1: 2, 3: 4}
    assert got == sorted(((i, "revisit" if i in refers else "response", refers.get(i), size[i], digest[i]) for i, _, _ in rows), key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reader_checks():
    good = warc.record("response", "1", "http://x", b"abc" * 1000)

    def reader(data):
        parts = [data[i : i + 97] for i in range(0, len(data), 97)]
        return lambda n: parts.pop(0) if parts else b""

    (head, http, payload), (_, _, again) = warc.records(reader(good + good))
    assert (payload, again, http["content-length"], head["warc-type"]) == (b"abc" * 1000, b"abc" * 1000, "3000", "response")
    with pytest.raises(warc.WarcError):
        list(warc.records(reader(good[:-20])))
    wrong = warc.record("response", "1", "http://x", b"abc", sha1="A" * 32)
    with pytest.raises(warc.WarcError):
        list(warc.records(reader(wrong)))


# ---- 4: chat


def test_layouts():
    m = chat.Mappings()
    assert m.turns({"prompt": "p", "response": "r", "extra": 1}) == ("prompt-response", [("user", "p"), ("assistant", "r")])
    assert m.turns({"instruction": "i", "input": "x", "output": "o"})[1] == [("user", "i\n\nx"), ("assistant", "o")]
    assert m.turns({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]})[1] == [("user", "a"), ("assistant", "")]
    assert m.turns({"conversations": [{"from": "human", "value": "a"}], "system": "s"})[1] == [("system", "s"), ("user", "a")]
    assert m.turns({"something": 1}) == (None, [])


@pytest.mark.parametrize("text", ["", "\\", "</turn>", "\\</turn>\\\\<turn>", "a\nb", chat.PROBE, "<turn", "\\\\"])
def test_template_is_reversible(text):
    turn, start = chat.render("as\nsist<turn>", text)
    (role, back, a, b), = chat.parse(turn)
    assert (role, back, a) == ("as\nsist<turn>", text, start)
    assert chat.unescape(turn[a:b]) == text


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "x\\y", "</turn>", "z" * 50])) for c in (1, 2, None) for t in [*range(9), 4, None]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0))
    for part in (1, 100, 1 << 20):
        got = {r.conv_id: r for r in chat.read_formatted(chat.format_turns(table, part=part)).collect()}
        for c in (1, 2, None):
            own = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
            assert got[c].n_turns == len(own)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
            loss = "".join(x for _, r, x in own if r == "assistant")
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_formatted(chat.format_turns(table.limit(0))).count() == 0


# ---- 5: top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=8).tolist() for _ in range(300)]
    rows = [(i, vectors[i % 60] if i % 3 == 0 else vectors[i]) for i in range(300)]
    rows += [(300, None), (350, [float("nan")] * 8), (400, [None] * 8), (450, [1.0] * 3), (500, [2.0] * 3), (50, rows[50][1]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, query_block=3, shard=20).orderBy("query_id", "rank").collect()]
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in good if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == want
    assert topk.top_k(table.limit(0)).count() == 0


def test_tile_beyond_doubles():
    big = np.array([[2.0**40, 1.0]])
    assert topk.tile(np.array([1]), big, np.array([2, 3]), np.array([[2.0**20, 3.0], [2.0**20, 4.0]]), 2)[2].tolist() == [2**60 + 4, 2**60 + 3]


# ---- 6: BPE


def test_bpe_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.Bpe(open(path, encoding="utf-8").read())
    rng = random.Random(2)
    chars = [*map(chr, range(0x250)), "\u2019", "\u3000", "\u4e2d", "\U0001f600", "\u088f", "\U0001dfcd", "  ", "\n ", " \n", "'s", "<|endoftext|>", "ing", " the"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(600)] + ["", "a" * 5000, " " * 999, "ab" * 3000, "x\n \n \ny "]
    ids = own.encode_many(texts)
    for t, mine in zip(texts, ids):
        assert mine == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert own.decode(mine) == t == lib.decode(mine, skip_special_tokens=False)
    for w in (" merging", "aaaaaaa", "\u00e9\u00e9\u00e9"):
        assert list(own.word(w)) == own.encode(w)


def test_bpe_rows(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs = edge_docs(spark)
    got = bpe.digests(docs, path, keep=("doc_id", "n_chars")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got) and len(got) == 8
    back = bpe.decoded(bpe.encoded(docs, path), path).collect()
    assert all(r.text == texts[r.doc_id] for r in back)
    assert bpe.digests(empty_docs(spark), path).count() == 0


# ---- 7: URLs


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/2?x=1", "http://x.net/es/", "http://com/", "http://com", "no host", None, "", "ftp://x.org?q=1&r=2#f", "http://x.net:80/fr/", "://com/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert got[2] == ("x.net", "/es/", "net/es/", "block")
    assert got[3] == ("com", "/", "com/", "allow")
    assert got[4][:3] == ("com", "", None)
    assert got[5][:3] == got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][:3] == ("x.org", "", None)
    assert got[9][:3] == ("x.net:80", "/fr/", None)
    assert got[10][:3] == ("com", "/a", "com/")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_trees_learn(spark):
    rng = random.Random(4)
    rows = [(i, f"http://s{rng.randrange(9)}.{'bad-x' if i % 2 else 'good'}.org/p/{'9' * 12 if i % 2 else 'abc'}{i}") for i in range(400)]
    df = urlfilter.lexical(spark.createDataFrame(rows, "i long, url string").withColumns({"host": urlfilter.host_of(F.col("url")), "path": urlfilter.path_of(F.col("url"))}), "url")
    labelled = df.withColumns({"y": (F.col("i") % 2).cast("int"), "_url": F.col("url")})
    model = urlfilter.train(labelled.filter("i < 200"))
    held = model.with_suffixes(labelled.filter("i >= 200")).withColumn("p", model.score())
    assert held.filter((F.col("p") >= 0.5) == (F.col("y") == 1)).count() >= 195


# ---- 8: n-gram join


def brute_join(docs, percent=85, k=4):
    sets = {}
    for i, t in docs:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs, passage = [], words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.choice([3, 6, 9, 30, 80, 200]), 5000)
        for _ in range(rng.randrange(1, 10)):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 15) + 1)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            docs.append(own)
    docs += [words(rng, 20, 5000) + passage for _ in range(15)] + [passage] * 3 + [[], ["a"], ["a"], ["A"], ["a", "b"]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)


def test_linked_sets_share_a_key():
    rng, ladder = np.random.default_rng(3), ngram_join.Ladder()
    for n in [*range(7, 60), 150, 400, 1500]:
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = rng.integers(0, n - -(-85 * n // 100) + 1)
        y = np.sort(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, 1, dtype=np.uint64)]))
        same = len(np.intersect1d(x, y))
        if 100 * same >= 85 * (len(x) + len(y) - same):
            assert len(np.intersect1d(ngram_join.combination_keys(x, ladder)[0], ngram_join.combination_keys(y, ladder)[0]))


def test_join_edges(spark):
    assert ngram_join.classes(edge_docs(spark)).count() == 8
    assert ngram_join.classes(empty_docs(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(60).selectExpr("id * 7 % 61 as a", "(id + 1) * 7 % 61 as b")
    assert {r.label for r in ngram_join.components(edges, []).collect()} == {0}


# ---- 9: language


def test_language(spark):
    rng = random.Random(6)
    kinds = {"aa": "abcde", "bb": "vwxyz", "cc": "\u00e9\u00e8\u00fc\u00f6"}
    rows = []
    for i in range(300):
        lang = rng.choice([*kinds])
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(4)) for _ in range(rng.randrange(5, 40))), lang))
    rows += [(300, None, "aa"), (301, "12 !", "aa"), (302, "", None), (None, "abcd", "bb"), (303, "abcde " * 300_000, "aa")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(300))
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (300, 301, 302, 303)] == ["und", "und", "und", "aa"]
    assert got[300].rejected and not got[303].rejected
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


# ---- 10: licences


def test_license_places(spark):
    texts = ["CC BY cc-by x", "the GNU General Public License, general public", "All rights reserved. all  rights\nreserved all rights", None, "", "nothing", "ccby cc byx", "cc by " * 3]
    texts.append("Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files")
    rows = [*enumerate(texts), (0, texts[0])]
    got = sorted(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in got:
        w = find.findall((texts[r.doc_id] or "").translate(LOWER))
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
    assert got[-1].labels == "mit" and 0.75 <= got[-1].score < 1
    assert license_scan.scan(empty_docs(spark)).count() == 0


# ---- words


def test_word_hashes():
    split = Words()
    texts = [b"One two\tTHREE", None, b"", b"one TWO three", b"x " * 700_000, b"a\x00b", b"y" * 1_500_000]
    arrays = [h for _, hs in split.of(texts) for h in hs]
    assert [len(h) for h in arrays] == [3, 0, 0, 3, 700_000, 1, 1]
    assert (arrays[0] == arrays[3]).all() and len(set(arrays[4].tolist())) == 1
    assert len(rolling(arrays[0], 4)) == 0 and len(shingle_set(arrays[0], 4)) == 1


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 30, 3000)) + (" abc" if i % 2 else " xyz"), "en" if i % 2 else "fr", rng.choice(["s1", "s2", None]), 1) for i in range(80)]
    rows += [(100 + i, *rows[i][1:]) for i in range(20)] + [(200, None, "en", "s1", 0), (201, "12", "en", "s1", 0), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows, DOCS)
    kept = pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {200, 201} and len(ids) >= 90
    alone = pipeline.near_duplicates(spark, docs.filter("doc_id < 200"), "")
    assert sorted(r.doc_id for r in alone.collect()) == list(range(80))
    mixed = pipeline.mixture(spark, alone, "")
    assert mixed.columns == docs.columns
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(alone).collect()}
    copies = {i: 0 for i in taken}
    for r in mixed.collect():
        copies[r.doc_id] += 1
    assert copies == taken
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.n_tokens == len(r.ids) > 0 for r in out)


def test_stage_links_from_four_fifths_on(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(9)
    rows = []
    for i in range(12):  # copies whose five-word similarity is 0.83, 0.81 to 0.82 and 0.79
        base = [f"d{i}x{j}" for j in range(100 + 50 * i)]
        n = len(base)
        rows += [(10 * i, base), (10 * i + 1, base + [f"e{i}x{j}" for j in range((n - 4) // 5)]), (10 * i + 2, [f"f{i}x{j}" for j in range((n - 4) * 23 // 100)] + base), (10 * i + 3, base + [f"g{i}x{j}" for j in range((n - 4) * 27 // 100)])]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in rows]
    want = sorted({root for _, root in brute_join(rows, 80, 5).values()})
    assert len(want) < len({root for _, root in brute_join(rows).values()})
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_stages_know_rows_by_id_and_text(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(10)
    a, b, c, d, e, f = (" ".join(words(rng, 40, 10**6)) for _ in range(6))
    near = a + " end"
    # null ids with different texts; one id with two unlinked texts; ids that represent one text and lose with another
    rows = [(None, a), (None, b), (None, near), (1, c), (1, d), (2, d), (2, e), (3, e), (3, f), (3, f), (4, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    first = [(None, a)] if (None, a) in got else [(None, near)]
    assert got == sorted([*first, (None, b), (1, c), (1, d), (2, e), (3, f), (4, ""), (None, None), (None, None)], key=str)

    rows = [(i, " ".join(words(rng, 10)), s) for i in (None, 1, 2, 3) for s in ("s1", "s1", "s2", None) for _ in range(3)]
    rows += [(7, a, "s1")] * 9 + [(None, a, None)] * 9
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)
    taken, copies = {}, {}
    for r in mixing.mix(docs).collect():
        key = (r.doc_id, r.source)
        taken[key] = taken.get(key, 0) + (-(-r.taken // r.size))
    for r in pipeline.mixture(spark, docs, "").collect():
        copies[r.doc_id, r.source] = copies.get((r.doc_id, r.source), 0) + 1
    assert copies == {k: n for k, n in taken.items() if n}


def test_top_k_keeps_all_vectors_of_an_id(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 70, rng.normal(size=4).tolist()) for i in range(200)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_block=1, shard=30).orderBy("query_id", "rank").collect()]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q in (0, 50):
        s = sorted((-sum(x * y for x, y in zip(v, w)), i) for j, v in whole if j == q for i, w in whole if i != q)[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == want


def test_all_languages_take_part(spark):
    rows = [(3 * i + j, chr(0x4E00 + i) * 5, f"l{i:03}") for i in range(300) for j in range(3)]
    docs = spark.createDataFrame([(i, t, x) for i, t, x in rows], "doc_id long, text string, lang string")
    want = {x for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(want) > 256 and set(langid.fit(docs).languages) == want


def test_formatted_parts_in_any_order(spark):
    table = spark.createDataFrame([(c, t, "assistant", f"text {t}") for c in (1, 2, None) for t in range(9)], "conv_id long, turn long, role string, text string")
    parts = chat.format_turns(table, part=1)
    mixed = parts.repartition(3, "part").sortWithinPartitions(F.desc("part"))
    assert sorted(chat.read_formatted(mixed).collect(), key=str) == sorted(chat.read_formatted(parts).collect(), key=str)


def test_streams_and_chats_are_stored(spark, tmp_path, monkeypatch):
    from zonewright.llm import queries

    seen = []
    monkeypatch.setattr(queries, "stored", lambda df, name: seen.append(name) or df, raising=False)
    edge_docs(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op1_transport_stream(spark, str(tmp_path)).count() == 8
    assert queries.op4_chat(spark, str(tmp_path)).count() == 2
    assert seen == ["media", "formatted"]


# ---- countries


def test_long_country_table_is_an_error(spark, tmp_path):
    from zonewright.functions import countries

    rows = ["ordinal,code,name", *(f"{i},C{i},N{i}" for i in range(1001))]
    for n in (1000, 1001):
        (tmp_path / f"{n}.csv").write_text("\n".join(rows[: n + 1]))
    assert len(countries.read_rows(spark, str(tmp_path / "1000.csv"))) == 1000
    with pytest.raises(ValueError):
        countries.read_rows(spark, str(tmp_path / "1001.csv"))


def test_stages_with_clashing_columns_against_brute_force(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    base = [" ".join(words(rng, 40, 10**6)) for _ in range(12)]
    rows = [(i, base[i % 12] + (" end" if i % 3 == 0 else ""), "en", rng.choice(["s1", "s2", None]), 1) for i in range(40)]
    rows += [(None, base[0], "en", None, 1), (3, base[5], "en", "s1", 1), (50, "x" * 3_000_000, "en", "s1", 1), (51, None, "en", "s1", 0), (52, "", "en", "s1", 0), (53, "12 !", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    extra = ("rejected", "score", "lang_pred", "_has", "_t", "_id", "_n", "n", "least", "row", "hash", "id", "key", "size", "taken", "again", "c0", "text_", "source_size")
    wide = docs.withColumns({c: F.lit("clash") for c in extra} | {"a b.c": F.lit(1)})
    kept = pipeline.language(spark, wide, "")
    assert kept.columns == wide.columns
    assert not {r.doc_id for r in kept.collect()} & {51, 52, 53}
    alone = pipeline.near_duplicates(spark, wide, "")
    assert alone.columns == wide.columns
    ids = list(enumerate(rows))
    groups = {}
    for n, (_, root) in brute_join([(n, r[1]) for n, r in ids], 80, 5).items():
        groups.setdefault(root if (rows[n][1] or "").split() else (n,), []).append(n)
    want = [min(g, key=lambda n: (rows[n][0] is None, rows[n][0] or 0)) for g in groups.values()]
    assert sorted((str(r.doc_id), r.text or "") for r in alone.collect()) == sorted((str(rows[n][0]), rows[n][1] or "") for n in want)
    mixed = pipeline.mixture(spark, wide, "")
    assert mixed.columns == wide.columns
    assert all(r.rejected == r.n == "clash" for r in mixed.collect())
    for stage in (pipeline.language, pipeline.near_duplicates, pipeline.mixture):
        empty = stage(spark, wide.limit(0), "")
        assert empty.columns == wide.columns and empty.count() == 0


def test_a_word_longer_than_any_chunk():
    split = Words()
    long = b"z" * 3_500_000
    texts = [b"a b " + long + b" c", long.upper(), b"c", b"q" * 4096, b"q" * 4097, long + b" a"]
    arrays = [h.tolist() for _, hs in split.of(texts) for h in hs]
    assert [len(a) for a in arrays] == [4, 1, 1, 1, 1, 2]
    assert arrays[0][2] == arrays[1][0] == arrays[5][0] and arrays[0][3] == arrays[2][0] and len({arrays[0][2], arrays[3][0], arrays[4][0]}) == 3


def test_memo_of_words_is_bounded(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "MEMO", 100)
    coder = bpe.Bpe(open(path, encoding="utf-8").read())
    rng = random.Random(1)
    texts = [" ".join(words(rng, 300, 10**6)) + "中" * 20_000 for _ in range(5)]
    again = bpe.Bpe(open(path, encoding="utf-8").read())
    assert coder.encode_many(texts) == [again.encode(t) for t in texts]
    assert len(coder.known) <= 100 and max(map(len, coder.known)) <= bpe.MEMO_CHARS


def test_language_sample_counts_repeated_texts_once(spark):
    rows = [(3 * i, "same text here", "aa") for i in range(3000)] + [(9000 + i, f"other {chr(97 + i % 26) * 5} {i}", "bb") for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert model.languages == ["aa", "bb"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i] == x for i, _, x in rows) >= 0.97 * len(rows)


def test_language_prediction_against_plain_sums(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc éXYZ1.") for _ in range(rng.randrange(0, 60))), rng.choice(["aa", "bb"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)

    def plain(text):
        low = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text.encode()) + b"    "
        bag = np.zeros(langid.BUCKETS)
        for k in (2, 3, 4):
            for a in range(len(text.encode()) + 1):
                w = low[a : a + k]
                if w.strip():
                    key = int.from_bytes(w, "little") ^ (k - 2) * 0x85EBCA6B & 0xFFFFFFFF
                    bag[(key * 2654435761 & 0xFFFFFFFF) >> 19] += 1
        x = bag @ model.table / max(1, bag.sum()) + model.bias
        p = np.exp(x - x.max())
        return p / p.sum()

    for r in langid.predict(docs, model).collect():
        text = rows[r.doc_id][1]
        if re.search(r"[A-Za-zé]", text):
            p = plain(text)
            assert r.score == pytest.approx(p.max(), abs=1e-6) and r.lang_pred == model.languages[int(p.argmax())]
        else:
            assert r.lang_pred == "und"


# ---- transport streams that others write, and damaged ones


def packet(pid, payload, start, count, adaptation=None):
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if adaptation is not None else 0x10) | count & 15])
    body = (bytes([len(adaptation)]) + adaptation if adaptation is not None else b"") + payload
    assert len(body) == 184
    return head + body


def test_tables_over_several_packets_with_adaptation_fields():
    ts = transport_stream
    streams = b"".join(bytes([6]) + (0xE000 | 0x200 + k).to_bytes(2, "big") + b"\xf0\x00" for k in range(60))
    body = b"\x02" + (0xB000 | 9 + 4 + len(streams)).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + b"\xe2\x00\xf0\x00" + streams
    section = b"\x00" + body + ts.crc32_mpeg(body).to_bytes(4, "big")
    data, at, count = ts._PAT, 0, 0
    while at < len(section):
        room = 184 - 4
        part = section[at : at + room]
        at += len(part)
        data += packet(0x1000, part + b"\xff" * (room - len(part)), count == 0, count, b"\x00\xff\xff")
        count += 1
    s = ts.demux(data)
    assert count > 1 and sorted(s.streams) == list(range(0x200, 0x200 + 60)) and (s.crc_errors, s.continuity_errors) == (0, 0)
    assert ts.demux(data[:-188]).crc_errors == 1
    broken = bytearray(data)
    broken[2 * 188 + 50] ^= 1
    assert ts.demux(bytes(broken)).crc_errors == 1 and not ts.demux(bytes(broken)).streams


def test_damaged_streams_never_raise():
    rng = random.Random(7)
    whole = transport_stream.mux(transport_stream.padded(rng.randbytes(30_000)))
    head = whole[: 2 * 188]
    for pes in (b"\x00\x00\x01\xbd\x00\x03\x84\x80", b"\x00\x00\x01\xbd\x00", b"\x00\x00\x01\xbd\x00\x03\x84\x80\x05", b"\x00\x00\x02", b""):
        pad = 184 - len(pes)
        s = transport_stream.demux(head + packet(0x100, pes, True, 0, b"\x00" + b"\xff" * (pad - 2)))
        assert s.pes_errors == 1 or not pes
    for _ in range(60):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 200)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        transport_stream.demux(bytes(data[: rng.randrange(len(data))]))


# ---- chat: records of mixed layouts, and broken ones


def test_turns_come_back_from_records_of_three_layouts(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(20), rng.randrange(9), rng.choice(["user", "assistant", "human", "system", "", None]), rng.choice([None, "", 'a "q" \\ b', "é\U0001f600", "x" * 100])) for _ in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.as_records(table)
    layouts = {r.layout for r in chat.canonical_turns(records, ("conv_id", "turn"), "record").collect()}
    assert layouts == {"messages", "conversations", "turn-rows"}
    got = sorted(tuple(r) for r in chat.table_of(records).collect())
    assert got == sorted((c, t, r or "", x or "") for c, t, r, x in rows)


def test_no_record_breaks_the_job(spark):
    deep = "[" * 100_000 + "]" * 100_000
    bad = [
        '{"messages": [{"role": "user", "content": "a"}, null]}', '{"messages": [{"role": "user", "content": "a"}, "b"]}', '{"messages[].role": "x", "messages[].content": "y"}', deep, '{"a":' * 5000 + "1" + "}" * 5000,
        "{", "", None, "[]", "7", '{"messages": []}', '{"messages": null}', '{"messages.role": 1}',
    ]
    rows = [*enumerate(bad), (100, '{"prompt": "a\\ud800b", "response": null}'), (101, '{"messages": [{"role": "user", "content": 7}], "other": {"x": [null]}}')]
    got = {r.i: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(spark.createDataFrame(rows, "i long, record string"), ("i",), "record").collect()}
    assert all(got[i] == (None, []) for i in range(len(bad)))
    assert got[100] == ("prompt-response", [("user", "a�b"), ("assistant", "")])
    assert got[101] == ("messages", [("user", "7")])


def test_top_k_with_tiles_of_any_size(spark):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(2500)], "vec_id long, embedding array<double>")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(topk.top_k(table)) == key(topk.top_k(table, query_block=7, shard=90))


# ---- URLs: trees against a plain computation, quality on urls that no rule fits, repeated rows


def url_rows(spark, rows):
    df = spark.createDataFrame(rows, "i long, url string, y int").withColumns({"host": urlfilter.host_of(F.col("url")), "path": urlfilter.path_of(F.col("url")), "_url": F.col("url")})
    return urlfilter.lexical(df, "url")


def test_features_and_trees_against_plain_ones(spark):
    rng = random.Random(11)
    rows = [(i, f"http://h{rng.randrange(30)}.{rng.choice(['aa', 'bb.cc', 'dd'])}/{'/'.join(rng.choice(['x9', 'abc', '77', 'q-r']) for _ in range(rng.randrange(6)))}?{'&'.join('k=1' for _ in range(rng.randrange(4)))}") for i in range(500)]
    rows = [(i, u, int(("77" in u) != (".dd" in u))) for i, u in enumerate(sorted({u for _, u in rows}))]  # repeated urls count once
    df = url_rows(spark, rows)
    model = urlfilter.train(df)
    found = {r.i: r for r in model.with_suffixes(df).withColumn("p", model.score()).collect()}
    blocked = sum(y for *_, y in rows)

    def walk(t, x):
        while not isinstance(t, float):
            t = t[3] if x[t[0]] > t[1] else t[2]
        return t

    for i, u, y in rows:
        r = found[i]
        host, rest = u.split("://")[1].split("/", 1)
        n, query = len(u), u.partition("?")[2]
        want = {"length": n, "depth": ("/" + rest.partition("?")[0]).count("/"), "digits": sum(c.isdigit() for c in u) / n, "parameters": query.count("&") + 1 if query else 0, "labels": host.count(".") + 1, "hyphens": host.count("-")}
        want["entropy"] = round(-sum(u.count(c) / n * np.log2(u.count(c) / n) for c in set(u)), 6)
        for k in (1, 2):
            same = [z for j, _, z in rows if found[j][f"tail{k}"] == r[f"tail{k}"]]
            want[f"suffix{k}"] = (sum(same) + 10 * blocked / len(rows)) / (len(same) + 10)
        for f, v in want.items():
            assert r[f] == pytest.approx(v, abs=1e-5), f
        total = np.log(model.prior / (1 - model.prior)) + sum(walk(t, {f: r[f] for f in urlfilter.FEATURES}) for t in model.trees)
        assert r.p == pytest.approx(1 / (1 + np.exp(-total)))
    assert sum((found[i].p >= 0.5) == (y == 1) for i, _, y in rows) >= 0.85 * len(rows)
    # the first split of the first tree is the best of all bins, by the gain of the logistic loss
    feature, at, *_ = model.trees[0]
    g = np.array([model.prior - y for *_, y in rows])
    h = model.prior * (1 - model.prior)
    gain = lambda right: sum(g[m].sum() ** 2 / (h * m.sum() + urlfilter.SHRINK) for m in (right, ~right))
    own = gain(np.array([found[i][feature] > at for i, *_ in rows]))
    marks = [k / urlfilter.BINS for k in range(1, urlfilter.BINS)]
    cuts = model.with_suffixes(df).agg(*(F.percentile_approx(f, marks, 10_000).alias(f) for f in urlfilter.FEATURES)).first()
    for f in urlfilter.FEATURES:
        values = np.array([found[i][f] for i, *_ in rows])
        for cut in cuts[f]:
            right = values > cut
            assert not urlfilter.LEAST <= h * right.sum() <= h * len(rows) - urlfilter.LEAST or gain(right) <= own + 1e-6


def test_rules_judge_whole_hosts_and_repeated_urls(spark):
    urls = [f"http://s{i % 40}.{('net' if i % 2 else 'com')}/{'es' if i % 4 == 1 else 'xx'}/{'9' * (i % 5)}p{i}" for i in range(400)] + ["http://hot.net/fr/1"] * 800 + ["http://a.com/" + "y" * 200_000]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        rule = next((r for r in sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2])) if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None)
        assert got[i].rule == (rule and rule[1] + rule[2]) and (not rule or got[i].verdict == rule[0])
    assert len({(got[i].verdict, got[i].score) for i in range(400, 1200)}) == 1


# ---- licences: notices in order, against a plain search


def test_longest_ascending_run():
    rng = random.Random(1)
    for _ in range(200):
        pairs = [(rng.randrange(8), rng.randrange(12)) for _ in range(rng.randrange(10))]
        best = [0] * len(pairs)
        for k, (t, p) in sorted(enumerate(pairs), key=lambda x: x[1]):
            best[k] = 1 + max((best[j] for j, (u, q) in enumerate(pairs) if u < t and q < p), default=0)
        got = license_scan.ascending(np.array([t for t, _ in pairs], int), np.array([p for _, p in pairs], int))
        assert got == max(best, default=0)


def test_notices_must_stand_in_order(spark):
    notice = next(iter(license_scan.TEMPLATES)).split()
    rng = random.Random(2)
    docs, want = [], []
    for i in range(60):
        lost = sorted(rng.sample(range(len(notice)), i % 4 // 2))
        own = [w for k, w in enumerate(notice) if k not in lost]
        shuffled = i % 3 == 0
        if shuffled:  # the same runs of words, in the wrong order
            cut = len(own) // 2
            own = own[cut:] + own[:cut]
        docs.append((i if i else None, " ".join([f"x{k}" for k in range(i)] + own + ["end"])))
        grams = {tuple(notice[k : k + 3]): k for k in range(len(notice) - 2)}
        words_ = docs[-1][1].split()
        seen = [grams[g] for k in range(len(words_) - 2) if (g := tuple(words_[k : k + 3])) in grams]
        run = []
        for t in seen:
            run.append(1 + max((r for r, u in zip(run, seen) if u < t), default=0))
        want.append(max(run, default=0) / (len(notice) - 2) >= license_scan.COVER)
    table = spark.createDataFrame([*docs, docs[1], (99, "é" * 1_200_000 + " cc by")], "doc_id long, text string").withColumns({"hits": F.lit(1), "gram": F.lit(1), "_t": F.lit(1)})
    got = license_scan.scan(table).collect()
    assert len(got) == 62
    by = {r.doc_id: r for r in got}
    assert [by[i].labels == "mit" for i, _ in docs] == want and True in want and False in want
    assert (by[99].n_base, by[99].first_word) == (1, 1)


def test_pairs_to_verify_stay_near_linear_in_a_hot_bucket(spark, monkeypatch):
    """Near copies around the threshold, all of one base text: in one component by brute force, and far fewer pairs are verified than there are."""
    rng = random.Random(13)
    base = [f"b{j}" for j in range(80)]
    rows = []
    for i in range(700):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base[: 40 + i % 30] + [f"t{i}x{j}" for j in range(40)])) for i in range(100)]
    seen = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, sets, percent: seen.append(pairs.count()) or verified(pairs, sets, percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)
    assert sum(seen) < 8 * len(rows)


def test_join_with_edges_against_brute_force(spark):
    docs = edge_docs(spark).filter("doc_id is not null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect()}
    assert got == brute_join(dict(rows).items())


# ---- queries on edge tables against brute force


def test_mix_edges_against_brute_force(spark):
    docs = edge_docs(spark).select("doc_id", "text", "source").collect()
    size, total, target = brute_mix(docs)
    got = mixing.mix(edge_docs(spark)).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6)) for r in got) == sorted((str(d.doc_id), n, total[d.source], round(target[d.source], 6)) for d, n in zip(docs, size))
    for s in total:
        assert sum(r.taken for r in got if r.source == s) == int(target[s] + 1e-9)


def test_tokens_of_the_query_equal_the_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from zonewright.llm import queries

    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(21)
    rows = [(i, "".join(rng.choice(["word ", "  ", "\n", "é", "中文", "123", "<|endoftext|>", "don't ", ".\n\n", "\t x"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "long " * 300_000), (103, "z" * 20_000), (0, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_bpe(spark, str(tmp_path)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_stored_streams_against_single_ones(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in edge_docs(spark).collect()}
    for r in transport_stream.stream_index(transport_stream.media_column(edge_docs(spark))).collect():
        data = transport_stream.mux(transport_stream.padded(texts[r.doc_id]))
        units = -(-r.payload_bytes // transport_stream.UNIT)
        assert (r.media_bytes, r.media_sha256, r.packets) == (len(data), hashlib.sha256(data).hexdigest(), len(data) // 188)
        assert r.feature == f"programs=1;pid=256;type=6;packets={r.packets};pes={units};cc=0;pts=90000-{90000 + 3600 * (units - 1)};rap={-(-units // 8)}"
        assert (r.continuity_errors, r.crc_errors, r.sync_errors, r.pes_errors) == (0, 0, 0, 0)


def test_language_with_clashing_columns_and_repeated_rows(spark):
    rows = [(i, "abc abd " * (i % 5 + 1) if i % 2 else "xyz xzz " * (i % 7 + 1), "aa" if i % 2 else "bb") for i in range(90)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("lang_pred", "score", "rejected", "held_out", "c0", "has", "_l", "_t")})
    got = langid.identify(docs).collect()
    assert len(got) == 180 and all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") and 0 <= r.score <= 1 for r in got)
    assert len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 90


def test_a_very_long_turn(spark):
    text = "</turn> \\ " * 300_000
    table = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", "x"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_formatted(chat.format_turns(chat.table_of(chat.as_records(table)))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert (got[None].n_turns, got[None].loss_chars) == (1, 0)
