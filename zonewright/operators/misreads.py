"""What readers do to zones, and its measurement: noise with lost, added and confused characters and merged lines; edit scripts; the confusion matrix.

A script is a shortest one. Equal beginnings and ends are set aside first, then ties go to an exchange, then to a lost character. Texts whose table of distances would pass
CELLS are halved where the two halves' distances add up to least, so memory grows with the texts' length and not with its square. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksum import blindspot, sequence_blind
from ..schemas import ALPHABET
from ..shipping import ship
from .corpus import CONFUSED

#: Cells of a table of distances that is kept whole.
CELLS = 1 << 20
Change = tuple[int, str | None, str | None]


def degrade(lines: Column, seed: Column, confused: int = 0, lost: int = 0, added: int = 0, merged: int = 0) -> Column:
    """Lines as a reader may give them: each rate is in thousandths, of the characters or, for merged, of the line ends. The same seed gives the same noise."""
    draw = lambda tag, *at: F.pmod(F.xxhash64(seed, F.lit(tag), *at), F.lit(1000))
    wrong = F.create_map(*(F.lit(x) for kv in CONFUSED.items() for x in kv))

    def read(line: Column, k: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            kept = F.when(draw("lost", k, i) < lost, "").when(draw("confused", k, i) < confused, F.coalesce(wrong[c], c)).otherwise(c)
            more = F.substr(F.lit(ALPHABET), F.pmod(F.xxhash64(seed, F.lit("which"), k, i), F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1))
            return F.concat(kept, F.when(draw("added", k, i) < added, more).otherwise(""))

        return F.concat(F.array_join(F.transform(F.split(line, ""), one), ""), F.when((k < F.size(lines) - 1) & (draw("merged", k) >= merged), "\n").otherwise(""))

    return F.split(F.array_join(F.transform(lines, read), ""), "\n")


def punched(lines: Column, share: float = 0.4) -> Column:
    """Each line without the character at a share of its width, as a hole through the zone leaves it."""
    at = lambda x: F.floor(F.length(x) * share).cast("int")
    return F.transform(lines, lambda x: F.concat(F.substr(x, F.lit(1), at(x)), F.substr(x, at(x) + 2)))


def _last_row(a: str, b: np.ndarray) -> np.ndarray:
    """Distances of a from all beginnings of b."""
    row, steps = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for c in a:
        best = np.concatenate(([row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (b != ord(c)))))
        row = np.minimum.accumulate(best - steps) + steps
    return row


def _codes(text: str) -> np.ndarray:
    return np.fromiter(map(ord, text), np.int64, len(text))


def script(expected: str, got: str, at: int = 0) -> Iterator[Change]:
    """(place in expected, its character, the character read) of each change, in order; None for one lost or added."""
    start = 0
    while start < min(len(expected), len(got)) and expected[start] == got[start]:
        start += 1
    end = 0
    while end < min(len(expected), len(got)) - start and expected[-1 - end] == got[-1 - end]:
        end += 1
    a, b, at = expected[start : len(expected) - end], got[start : len(got) - end], at + start
    if not a or not b:
        yield from ((at + i, c, None) for i, c in enumerate(a))
        yield from ((at, None, c) for c in b)
    elif len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmin(_last_row(a[:half], _codes(b)) + _last_row(a[half:][::-1], _codes(b[::-1]))[::-1]))
        yield from script(a[:half], b[:cut], at)
        yield from script(a[half:], b[cut:], at + half)
    else:
        yield from _traced(a, b, at)


def _traced(a: str, b: str, at: int) -> list[Change]:
    codes, table = _codes(b), [np.arange(len(b) + 1)]
    steps = table[0]
    for c in a:
        row = table[-1]
        best = np.concatenate(([row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))))
        table.append(np.minimum.accumulate(best - steps) + steps)
    i, j, out = len(a), len(b), []
    while i or j:
        here = table[i][j]
        if i and j and table[i - 1][j - 1] + (a[i - 1] != b[j - 1]) == here:
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append((at + i, a[i], b[j]))
        elif i and table[i - 1][j] + 1 == here:
            i -= 1
            out.append((at + i, a[i], None))
        else:
            j -= 1
            out.append((at + i, None, b[j]))
    return out[::-1]


def scripts(df: DataFrame, key: str, expected: Column, got: Column) -> DataFrame:
    """(key, changes) of each row: array<struct<at, expected, got>>. Equal texts go to Python as nulls."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    text = lambda c: F.coalesce(c, F.lit(""))
    change = "array<struct<at: int, expected: string, got: string>>"
    both = F.struct(text(expected).alias("e"), text(got).alias("g"))
    # a generator is a barrier: the texts are computed once, however often they are read below
    rows = df.select(F.col(key), F.explode(F.array(both)).alias("x")).select(key, *(F.when(F.col("x.e") != F.col("x.g"), F.col(f"x.{c}")).alias(c) for c in "eg"))
    arrow = pa.list_(pa.struct([("at", pa.int32()), ("expected", pa.string()), ("got", pa.string())]))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("at", "expected", "got"), x)) for x in script(e.as_py() or "", g.as_py() or "")] for e, g in zip(b.column("e"), b.column("g"))]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(found, arrow)], names=[key, "changes"])

    return rows.mapInArrow(run, f"`{key}` {kind}, changes {change}")


def confusions(changed: DataFrame) -> DataFrame:
    """Of scripts(): (expected, got, n, kind, blind_share); kind: lost, added, or what a check digit makes of the exchange; blind_share: of all exchanges, those it doesn't see."""
    pairs = changed.select(F.explode("changes").alias("x")).groupBy("x.expected", "x.got").agg(F.count("*").alias("n"))
    kind = F.when(F.col("got").isNull(), "lost").when(F.col("expected").isNull(), "added").otherwise(blindspot(F.col("expected"), F.col("got"))["kind"])
    pairs = pairs.withColumn("kind", kind)
    exchanged = ~F.col("kind").isin("lost", "added")
    share = pairs.agg((F.sum(F.when(F.col("kind") == "blind", F.col("n")).otherwise(0)) / F.sum(F.when(exchanged, F.col("n")))).alias("blind_share"))
    return pairs.crossJoin(F.broadcast(share))


def unseen(df: DataFrame, expected: Column, got: Column) -> DataFrame:
    """(differing, n, unseen): misread fields of the right length by how many characters differ, and how many of them their check digit can't tell from the truth."""
    differ = F.size(F.filter(F.arrays_zip(F.split(expected, "").alias("a"), F.split(got, "").alias("b")), lambda x: x["a"] != x["b"]))
    rows = df.filter((F.length(expected) == F.length(got)) & (expected != got)).select(differ.alias("differing"), sequence_blind(expected, got).alias("blind"))
    return rows.groupBy("differing").agg(F.count("*").alias("n"), F.count_if("blind").alias("unseen"))
