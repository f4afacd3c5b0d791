"""The pipeline as a whole against plain stages: what the language stage keeps, then brute-force links, a plain cut of the mixture, and the library's tokens."""

import hashlib
import random
from collections import Counter

import pytest

from test_llm import DOCS, brute_join, brute_mix, words
from zonewright.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def plain_copies(docs):
    """How often the mixture takes each document: sources cut at their budgets in the order of hashed ids, epochs before that."""
    size, total, target = brute_mix(docs)
    out = Counter()
    for s in total:
        budget, before = int(target[s] + 1e-9), 0
        whole = budget // total[s] if total[s] else 0
        for d, n in sorted(((d, n) for d, n in zip(docs, size) if d.source == s), key=lambda x: hashlib.md5(f"mix:{x[0].doc_id}".encode()).hexdigest()):
            taken = whole * n + max(0, min(n, budget - whole * total[s] - before))
            before += n
            out[d.doc_id] += -(-taken // n) if taken > 0 else 0
    return +out


def test_multiplicities_of_the_mixture(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    rows = [(i, " ".join(words(rng, rng.choice([1, 3, 40, 200]))), "en", rng.choice(["a", "b", "b", "b", "c", None]), 1) for i in range(150)] + [(900, "", "en", "a", 0), (901, None, "en", None, 0), (902, "x", "en", "tiny", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    want = plain_copies(docs.collect())
    assert max(want.values()) == 2 and Counter(r.doc_id for r in pipeline.mixture(spark, docs, "").collect()) == want


def test_all_stages_in_a_row(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline
    from zonewright.llm.queries import vocabulary

    rng = random.Random(22)
    base = [" ".join(words(rng, 60, 10**6)) for _ in range(40)]
    rows = [(i, base[i % 40] + rng.choice(["", " end", " two more words"]) + (" abc" if i % 2 else " xyz"), "en" if i % 2 else "fr", rng.choice(["s1", "s2", "s2", None]), 1) for i in range(90)]
    rows += [(200, None, "en", "s1", 0), (201, "12 !", "en", "s1", 0), (202, "", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = pipeline.language(spark, docs, "").collect()
    assert {r.doc_id for r in kept} <= {r[0] for r in rows} - {200, 201, 202} and len(kept) > 60
    firsts = {root for _, root in brute_join([(r.doc_id, r.text) for r in kept], 80, 5).values()}
    copies = plain_copies([r for r in kept if r.doc_id in firsts])
    library = tokenizers.Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    text = {r.doc_id: r.text for r in kept}
    want = Counter({(i, tuple(library.encode(text[i], add_special_tokens=False).ids)): n for i, n in copies.items()})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
