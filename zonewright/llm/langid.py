r"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy, with calibrated rejection.

Subwords are the 2-, 3- and 4-byte windows of the lower-cased UTF-8 text in which ASCII characters other than letters count as spaces; each
is hashed to one of BUCKETS rows of an embedding table. A text is the mean of its subwords' rows, and a linear softmax on
it gives the languages' probabilities. The model is fitted on a bounded sample: about PER_LANGUAGE different labelled texts of each
language, chosen by a hash of the text, whole; beyond FULL_LANGUAGES languages all take part and share the sample of that many. However often a
text is repeated, it counts once. A fifth of the sample fits the temperature and the rejection threshold: a text is rejected if its probability is below
what all but REJECTED of the sample's texts reach, and below HALF.

Prediction reads every whole text once, without a shuffle; the model (BUCKETS x languages) is broadcast.

Defined results: a null text, or one without letters, is `und` with score 0 and rejected; without labelled rows all are. A null id is
not held out and not learned from. Repeated rows get equal results; other columns are ignored. A text is read CHUNK bytes at a time, however long it
is; a text that ties between languages is the first one's, by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK

BUCKETS, DIM, PER_LANGUAGE, FULL_LANGUAGES = 1 << 13, 16, 500, 256
EPOCHS, BATCH, RATE, REJECTED, HALF = 30, 32, 0.5, 0.001, 0.5
UNKNOWN = "und"

_CODE = np.arange(256, dtype=np.uint8)
_CODE[:128] = 32
_CODE[65:91] = np.arange(97, 123)
_CODE[97:123] = np.arange(97, 123)
_SPACES = (0x2020, 0x202020, 0x20202020)


def _indexes(b: np.ndarray, n: int) -> list[np.ndarray]:
    """Buckets of the windows that start at the first n bytes (BUCKETS: only spaces); b is 3 bytes longer at least."""
    b = b.astype(np.uint32)
    key = b[: n] | b[1 : n + 1] << np.uint32(8)
    out = []
    for k, space in enumerate(_SPACES):
        if k:
            key = key | b[k + 1 : n + k + 1] << np.uint32(8 * (k + 1))
        h = (key ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(2654435761) >> np.uint32(32 - 13)
        out.append(np.where(key == space, np.uint32(BUCKETS), h).astype(np.int32))
    return out


def bags(texts):
    """Yields each text's subword counts; texts are bytes or None."""
    run, size = [], 0

    def many(run):
        b = _CODE[np.frombuffer(b"    ".join(run) + b"    ", np.uint8)]
        ends = np.cumsum([len(t) + 4 for t in run])
        idx = _indexes(b, len(b) - 3)
        for a, e in zip([0, *ends], ends):
            yield np.bincount(np.concatenate([x[a : e - 3] for x in idx]), minlength=BUCKETS + 1)[:BUCKETS]  # the next text's start isn't this one's end

    for t in texts:
        t = t or b""
        if len(t) > CHUNK:
            yield from many(run)
            run, size = [], 0
            total = np.zeros(BUCKETS, np.int64)
            b = np.frombuffer(t + b"    ", np.uint8)
            for a in range(0, len(t), CHUNK):
                n = min(CHUNK, len(b) - 3 - a)
                for x in _indexes(_CODE[b[a : a + n + 3]], n):
                    total += np.bincount(x, minlength=BUCKETS + 1)[:BUCKETS]
            yield total
            continue
        run.append(t)
        size += len(t) + 4
        if size >= CHUNK:
            yield from many(run)
            run, size = [], 0
    if run:
        yield from many(run)


@dataclass
class Model:
    """table: BUCKETS x languages, the embeddings times the softmax weights, divided by the temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    threshold: float

    def scores(self, bag: np.ndarray) -> np.ndarray:
        x = (bag @ self.table) / max(1, bag.sum()) + self.bias
        e = np.exp(x - x.max())
        return e / e.sum()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], seed: int = 7) -> Model:
    """rows: (language's index, buckets, counts) of each text, in a fixed order."""
    rng = np.random.default_rng(seed)
    n_lang = len(languages)
    e = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, n_lang)), np.zeros(n_lang)
    y = np.array([r[0] for r in rows], int)
    held = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    weight = len(fit) / (n_lang * np.maximum(1, np.bincount(y[fit], minlength=n_lang)))  # rare languages count as much
    ge, gw, gb = np.full((BUCKETS, 1), 1e-8), np.full(w.shape, 1e-8), np.full(n_lang, 1e-8)

    def dense(which):
        x = np.zeros((len(which), BUCKETS))
        for k, i in enumerate(which):
            x[k, rows[i][1]] = rows[i][2]
        return x / np.maximum(1, x.sum(1, keepdims=True))

    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            which = order[a : a + BATCH]
            x = dense(which)
            used = np.flatnonzero(x.any(0))
            x = x[:, used]
            mean = x @ e[used]
            d = _softmax(mean @ w + bias)
            d[np.arange(len(which)), y[which]] -= 1
            d *= weight[y[which], None] / len(which)
            de, dw, db = x.T @ (d @ w.T), mean.T @ d, d.sum(0)
            ge[used] += (de**2).mean(1, keepdims=True)  # AdaGrad
            gw += dw**2
            gb += db**2
            e[used] -= RATE * de / np.sqrt(ge[used])
            w -= RATE * 0.2 * dw / np.sqrt(gw)
            bias -= RATE * 0.2 * db / np.sqrt(gb)
    check = np.flatnonzero(held) if held.any() else fit
    logits = np.concatenate([dense(check[a : a + 256]) @ e @ w + bias for a in range(0, len(check), 256)])
    right = (np.arange(len(check)), y[check])
    heat = min(np.geomspace(0.25, 16, 25), key=lambda t: -np.log(_softmax(logits / t)[right] + 1e-12).mean())
    best = _softmax(logits / heat).max(1)
    return Model(languages, (e @ w / heat), bias / heat, float(min(HALF, np.quantile(best, REJECTED))))


def remainder(ident: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(ident.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """None if no row is labelled."""
    usable = docs.select(F.col(lang).alias("_l"), F.col(ident).alias("_i"), F.col(text).alias("_t")).filter(F.col("_l").isNotNull() & F.col("_t").isNotNull() & (remainder(F.col("_i")) != 1))
    counts = usable.groupBy("_l").agg(F.approx_count_distinct(F.xxhash64("_t")).alias("n")).collect()  # a row for each language
    if not counts:
        return None
    languages = sorted(r["_l"] for r in counts)
    per_language = min(per_language, per_language * FULL_LANGUAGES / len(counts))
    part = F.create_map(*(F.lit(x) for r in counts for x in (r["_l"], per_language / max(1, r["n"]))))
    key = F.xxhash64(F.lit("langid"), F.col("_t"))
    chance = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(chance < part[F.col("_l")]).groupBy("_l", key.alias("_k")).agg(F.first("_t").cast("binary").alias("_t"))

    def run(batches):
        for b in batches:
            at, n = [], []
            for bag in bags(x.as_py() for x in b.column("_t")):
                used = np.flatnonzero(bag)
                at.append(used.astype(np.uint16).tobytes())
                n.append(np.minimum(bag[used], 2**32 - 1).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_l"), b.column("_k"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["_l", "_k", "at", "n"])

    rows = sorted(sample.mapInArrow(run, "_l string, _k long, at binary, n binary").collect(), key=lambda r: (r["_k"], r["_l"]))
    if not rows:
        return None
    number = {x: i for i, x in enumerate(languages)}
    return train([(number[r["_l"]], np.frombuffer(r["at"], np.uint16).astype(np.int32), np.frombuffer(r["n"], np.uint32)) for r in rows], languages)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred, score and rejected to the columns kept, which may have any names."""
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    cols = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), has.alias("has"), F.col(text).cast("binary").alias("text"))
    kept = [f"c{i}" for i in range(len(keep))]
    names = [*kept, "lang_pred", "score", "rejected"]
    schema = T.StructType([*(cols.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            pred, score, out = [], [], []
            for ok, bag in zip(b.column("has").to_pylist(), bags(x.as_py() for x in b.column("text"))):
                if ok and m is not None:
                    p = m.scores(bag)
                    i = int(p.argmax())
                    pred.append(m.languages[i])
                    score.append(float(p[i]))
                    out.append(bool(p[i] < m.threshold))
                else:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    out.append(True)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=names)

    found = cols.mapInArrow(run, schema)
    return found.select(*(F.col(k).alias(c) for k, c in zip(kept, keep)), "lang_pred", "score", "rejected")


def identify(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Fits on the rows that are not held out and predicts all."""
    model = fit(docs, ident)
    held = F.coalesce(remainder(F.col(ident)) == 1, F.lit(False))
    return predict(docs.select(ident, "text", held.alias("held_out")), model, keep=(ident, "held_out"))
