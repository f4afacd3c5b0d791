"""Helpers shared by the training-data operators: shared storage and word splitting."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a regex class and as what bytes.split() splits on.
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
        found = tempfile.mkdtemp(prefix="zonewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{found.rstrip('/')}/{app}-tables"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended already: its folder is the cluster's to clear
        return


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables written by stored()."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch between the JVM and a Python worker, where the session doesn't say otherwise.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that their Python workers need no installed copy; and makes Arrow batches small."""
    app = spark.sparkContext.applicationId
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="zonewright-")) / f"{top.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        spark.sparkContext.addPyFile(str(path))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of a file of a table whose size is known before it is written.
FILE_ROWS = 100_000


def stored(df: DataFrame, name: str, paths: list[str] | None = None, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor costs a reread only.

    paths, if given, gets the path, for remove(). rows, if given, is the most that df can have: it is written in as few files as that asks for, not one per shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", codec).parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


# ---- words and their hashes, whole batches at a time -------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)

#: Bytes handled at once, and the longest word that is hashed in arrays; both bound the temporary arrays, not the texts.
CHUNK, LONGEST = 1 << 20, 1 << 12
_POW = np.multiply.accumulate(np.append(np.uint64(1), np.full(LONGEST - 1, _BASE)))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The separators of WORD_RE.
SPACES = frozenset([0x20, *range(0x09, 0x0E)])


class Words:
    """Splits texts into words and hashes them, 64 bits a word, vectorized over many texts.

    separators: byte values between words. A-Z are lower-cased first.
    """

    def __init__(self, separators: frozenset[int] = SPACES):
        self.space = np.zeros(256, bool)
        self.space[list(separators)] = True
        low = np.arange(256)
        low[65:91] += 32
        self.code = _BYTE[low]
        self.space &= ~((np.arange(256) >= 65) & (np.arange(256) <= 90))  # they are lower-cased before
        self.gap = bytes([min(separators)])

    def _hashes(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of one buffer that ends with a separator."""
        inside = ~self.space[b]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        if not len(edge):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        starts, lens = edge[0::2], edge[1::2] - edge[0::2]
        first = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=first[1:])
        place = np.arange(int(lens.sum())) - np.repeat(first, lens)  # of a byte within its word
        if lens.max() > LONGEST:
            place %= LONGEST
        terms = self.code.take(b[inside]) * _POW.take(place)
        out = mix(np.add.reduceat(terms, first) + lens.astype(np.uint64) * _BASE)
        for i in np.flatnonzero(lens > LONGEST):
            out[i] = self._word(b[starts[i] : starts[i] + lens[i]])
        return out, starts

    def _word(self, b: np.ndarray) -> np.uint64:
        """A word beyond LONGEST bytes, in steps."""
        h = hashlib.blake2b(digest_size=8)
        for a in range(0, len(b), CHUNK):
            h.update(b[a : a + CHUNK].tobytes().lower())
        return np.uint64(int.from_bytes(h.digest(), "little"))

    def of(self, texts: list):
        """Yields (index of the first text, list of word-hash arrays) for runs of texts (bytes or None)."""
        run, size, begin = [], 0, 0
        for i, t in enumerate(texts):
            t = t or b""
            if len(t) > CHUNK:
                if run:
                    yield begin, self._run(run)
                yield i, [self._long(t)]
                run, size, begin = [], 0, i + 1
                continue
            run.append(t)
            size += len(t) + 1
            if size >= CHUNK:
                yield begin, self._run(run)
                run, size, begin = [], 0, i + 1
        if run:
            yield begin, self._run(run)

    def _run(self, run: list[bytes]) -> list[np.ndarray]:
        h, starts = self._hashes(np.frombuffer(self.gap.join(run) + self.gap, np.uint8))
        ends = np.cumsum([len(t) + 1 for t in run])
        return np.split(h, np.searchsorted(starts, ends[:-1]))

    def _long(self, t: bytes) -> np.ndarray:
        """A long text, cut behind separators; what grows with it are its words' hashes only."""
        parts, at, b = [], 0, np.frombuffer(t, np.uint8)
        while at < len(b):
            gaps = np.flatnonzero(self.space[b[at : at + CHUNK]])
            if at + CHUNK >= len(b) or len(gaps):
                end = len(b) if at + CHUNK >= len(b) else at + int(gaps[-1]) + 1
                parts.append(self._hashes(np.append(b[at:end], np.uint8(self.gap[0])))[0])
            else:  # within a word that is longer than a chunk
                end = at + CHUNK
                while end < len(b) and not len(gaps := np.flatnonzero(self.space[b[end : end + CHUNK]])):
                    end += CHUNK
                end = min(len(b), end + int(gaps[0]) if len(gaps) else len(b))
                parts.append(np.array([self._word(b[at:end])]))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = h[:n] * _STEP[0]
    for j in range(1, k):
        s = s + h[j : j + n] * _STEP[j]
    return mix(s + np.uint64(k))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle as a whole; no words: none."""
    if not len(h):
        return h
    s = rolling(h, min(k, len(h)))
    if len(s) > 1:
        s = np.sort(s)
        s = s[np.append(True, s[1:] != s[:-1])]
    return s
