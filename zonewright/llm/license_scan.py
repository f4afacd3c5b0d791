r"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed; Spark joins them to the positions of the templates' k-grams, each match votes for its
diagonal (place in the text minus place in the template), neighbouring diagonals are merged, and spans are verified: what counts is the longest run of
matches that ascends in the text and in the template alike, and it must hold enough of the template's k-grams. Before the join, grams that
occur in no template are dropped by a bitmap of the templates' hashes, sized to their number (a runtime filter: no template's gram is lost). The
templates' table has one row per k-gram; up to BROADCAST rows it is broadcast, beyond that the join shuffles.

PHRASES are exact: a place counts if all its words stand consecutively. TEMPLATES are notices found by votes: up to SLACK words may be
inserted or lost between neighbours, and COVER of the notice's grams must be there, in order. Both are parameters of scan().

Defined results: a null text has no words; overlapping places all count; rows that repeat an id and text get equal results, and rows of one id with
different texts are kept apart by a hash of the text; a null id is an id. Other columns are ignored; an empty table gives no rows. A text of any
length is hashed in pieces, and its matches are one row's list: those of its grams that occur in a template.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Words, rolling, stored

#: Word separators: all of ASCII but digits and small letters (A-Z are lower-cased first).
SEPARATORS = frozenset([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Usual opening words of licence notices.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "released under the mit license": "mit",
    "licensed under the apache license": "apache-2.0",
}
K_PHRASE, K_TEMPLATE, SLACK, COVER, BROADCAST = 2, 3, 2, 0.75, 100_000


def _table(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple[int, int, int, int, str, bool]]:
    """(gram, template, position, grams of the template, label, exact)."""
    out, words = [], Words(SEPARATORS)
    for number, (text, label, k, exact) in enumerate([*((t, x, K_PHRASE, True) for t, x in phrases.items()), *((t, x, K_TEMPLATE, False) for t, x in templates.items())]):
        (_, (h,)), = words.of([text.encode()])
        grams = rolling(h, k)
        if not len(grams):
            raise ValueError(f"fewer than {k} words: {text!r}")
        out += [(int(g.view(np.int64)), number, i, len(grams), label, exact) for i, g in enumerate(grams)]
    return out


def _grams(docs: DataFrame, grams: list[int], ident: str, text: str) -> DataFrame:
    """Per row: id, hash of the text, n_words, and the (position, gram) pairs that pass the bitmap."""
    kind = docs.schema[ident].dataType.simpleString()
    cols = docs.select(F.col(ident).alias("_i"), F.xxhash64(text).alias("_h"), F.col(text).cast("binary").alias("_t"))
    places = min(26, max(16, (64 * len(grams)).bit_length()))
    shift = np.uint64(64 - places)
    bits = np.zeros(1 << places, bool)
    bits[np.array(grams, np.int64).view(np.uint64) >> shift] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        words, known = Words(SEPARATORS), np.unpackbits(sent.value).view(bool)
        for b in batches:
            n, sizes, pos, gram = [], [0], [], []
            for _, arrays in words.of([x.as_py() for x in b.column("_t")]):
                for h in arrays:
                    n.append(len(h))
                    found = 0
                    for k in (K_PHRASE, K_TEMPLATE):
                        g = rolling(h, k)
                        at = np.flatnonzero(known[g >> shift])
                        found += len(at)
                        pos.append(at)
                        gram.append(g[at].view(np.int64))
                    sizes.append(found)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x or [np.empty(0, np.int64)]), pa.int64()) for x in (pos, gram)], ["pos", "gram"])
            hits = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), hits], names=["_i", "_h", "n_words", "hits"])

    return cols.mapInArrow(run, f"_i {kind}, _h long, n_words long, hits array<struct<pos: long, gram: long>>")


def template_table(spark: SparkSession, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(_table(phrases, templates), "gram long, template int, tpos int, grams int, label string, exact boolean")


def ascending(tpos: np.ndarray, pos: np.ndarray) -> int:
    """The length of the longest run of matches that ascends strictly in both places."""
    ends: list[int] = []  # the smallest last place of a run of each length
    for p in pos[np.lexsort((-pos, tpos))].tolist():
        k = bisect_left(ends, p)
        ends[k : k + 1] = [p]
    return len(ends)


def spans(scan: DataFrame, table: DataFrame, small: bool = True) -> DataFrame:
    """The verified places: _i, _h, template, label, exact, first (the word where the template would begin), cover. small: whether the table may be broadcast."""
    votes = scan.select("_i", "_h", F.explode("hits").alias("x")).select("_i", "_h", "x.pos", "x.gram").join(F.broadcast(table) if small else table, "gram")
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    lines = votes.groupBy("_i", "_h", "template", "label", "exact", "grams", "diagonal").agg(F.collect_set("tpos").alias("at"))
    order = Window.partitionBy("_i", "_h", "template").orderBy("diagonal")
    far = F.when(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK), 1).otherwise(0)
    groups = lines.withColumn("_new", far).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = groups.groupBy("_i", "_h", "template", "label", "exact", "grams", "_g").agg(
        F.min_by("diagonal", F.struct(-F.size("at"), "diagonal")).alias("first"), F.flatten(F.collect_list(F.transform("at", lambda t: F.struct(t.alias("tpos"), (t + F.col("diagonal")).alias("pos"))))).alias("pairs")
    )
    enough = F.size(F.array_distinct(F.transform("pairs", lambda x: x["tpos"]))) >= F.when(F.col("exact"), F.col("grams")).otherwise(COVER * F.col("grams"))
    merged = merged.filter(enough)  # a bound of what verification can find

    def run(batches):
        for b in batches:
            n = [ascending(*(x.values.field(k).to_numpy() for k in range(2))) for x in b.column("pairs")]
            yield b.drop_columns(["pairs"]).append_column("n", pa.array(n, pa.int64()))

    found = merged.mapInArrow(run, T.StructType([*(f for f in merged.schema if f.name != "pairs"), T.StructField("n", T.LongType())]))
    cover = F.col("n") / F.col("grams")
    return found.withColumn("cover", cover).filter(F.when(F.col("exact"), F.col("n") == F.col("grams")).otherwise(cover >= COVER))


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base place, else the best notice's cover)."""
    rows = _table(phrases, templates)
    table = template_table(docs.sparkSession, phrases, templates)
    grams = stored(_grams(docs, [r[0] for r in rows], ident, text), "license-grams")
    base = F.col("exact")
    found = spans(grams.filter(F.size("hits") > 0), table, len(rows) <= BROADCAST).groupBy("_i", "_h").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(base, 1.0).otherwise(F.col("cover"))).alias("score"),
    )
    found = found.withColumnsRenamed({"_i": "_fi", "_h": "_fh"})
    return grams.join(found, F.col("_i").eqNullSafe(F.col("_fi")) & (F.col("_h") == F.col("_fh")), "left").select(
        F.col("_i").alias(ident), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
