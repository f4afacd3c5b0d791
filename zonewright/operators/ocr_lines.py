"""Recognized lines with boxes: zone scores, the zone's band, page geometry, and the portrait's free area."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksum import let
from ..functions.text import strip_space
from ..schemas import ALPHABET

#: Line lengths of zones, their tolerance, a glyph's width by height, and the least band score.
LENGTHS, TOLERANCE, ASPECT, LEAST = (30, 36, 44), 6.0, 0.62, 0.15
GRID, PORTRAIT_ASPECT, PORTRAIT_TOLERANCE, LEAST_AREA = 20, 0.75, 0.35, 0.03
#: How many times the score of the page as it is a turned one must exceed.
MARGIN = 1.2


def line_score(text: Column, width: Column, height: Column) -> Column:
    """Share of zone characters, times how near the length is to a zone's, times how near a glyph's aspect is."""

    def of(t: Column) -> Column:
        n = F.length(t).cast("double")
        density = F.length(F.regexp_replace(t, f"[^{ALPHABET}]", "")) / n
        near = F.greatest(*(F.greatest(F.lit(0.0), 1 - F.abs(n - w) / TOLERANCE) for w in LENGTHS))
        shape = F.when(height > 0, F.greatest(F.lit(0.0), 1 - F.abs(width.cast("double") / n / height.cast("double") - ASPECT) / ASPECT)).otherwise(0.0)
        return F.when(n == 0, 0.0).otherwise(density * near * shape)

    return let(strip_space(text), of)


def union_box(boxes: Column) -> Column:
    """struct<x, y, w, h> around an array of boxes; null for none."""
    low = lambda f: F.array_min(F.transform(boxes, lambda b: b[f]))
    high = lambda f, s: F.array_max(F.transform(boxes, lambda b: b[f] + b[s]))
    return F.when(F.size(boxes) > 0, F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h")))


def box_from_points(xs: Column, ys: Column) -> Column:
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def band(lines: Column) -> Column:
    """struct<start, len, score, box> of the best two or three neighbouring lines of a page (array<struct<text, bbox, ..>>); null below the least score.

    Pairs come before triples, and the first of equals wins. Lines, their scores and the best window are computed once a page, not again for each use.
    """
    scores = lambda page: F.transform(page, lambda x: line_score(x["text"], x["bbox"]["w"], x["bbox"]["h"]))
    return let(lines, lambda page: let(scores(page), lambda s: _best_window(page, s)))


def _best_window(lines: Column, scores: Column) -> Column:
    def windows(k: int) -> Column:
        at = F.when(F.size(lines) >= k, F.sequence(F.lit(0), F.size(lines) - k)).otherwise(F.array().cast("array<int>"))
        mean = lambda i: reduce(lambda a, b: a + b, (F.get(scores, i + j) for j in range(k))) / k
        return F.transform(at, lambda i: F.struct((-mean(i)).alias("s"), F.lit(k).alias("k"), i.alias("i")))

    def found(best: Column) -> Column:
        boxes = F.transform(F.slice(lines, best["i"] + 1, best["k"]), lambda x: x["bbox"])
        return F.when(-best["s"] >= LEAST, F.struct(best["i"].alias("start"), best["k"].alias("len"), (-best["s"]).alias("score"), union_box(boxes).alias("box")))

    return let(F.array_min(F.concat(windows(2), windows(3))), found)


def guess_format(lines: Column) -> Column:
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    return F.when(F.size(lines) >= 3, "td1").when((F.size(lines) == 2) & (longest > 36), "td3").when(F.size(lines) == 2, "td2")


def free_area(width: float, height: float, boxes: list[tuple[float, float, float, float]]) -> tuple[float, float, float, float] | None:
    """The largest free rectangle of a portrait's shape, measured in cells, of a GRID x GRID raster over the upper left quarter; null below LEAST_AREA of the raster.

    Each cell that a box touches is used. For a rectangle's top row, the free height below each column shrinks from left to right, so all rectangles that
    start in a cell are walked with a running minimum of those heights. Of equal areas the topmost, then the leftmost, then the flattest wins.
    """
    cell = (width / 2 / GRID, height / 2 / GRID)
    if min(cell) <= 0:
        return None
    free = np.ones((GRID, GRID), bool)
    for x, y, w, h in boxes:
        if x + w <= 0 or y + h <= 0 or x >= GRID * cell[0] or y >= GRID * cell[1]:
            continue
        (c0, c1), (r0, r1) = (
            (first := int(max(low, 0) // size), max(first + 1, min(GRID, math.ceil(min(low + extent, GRID * size) / size)))) for low, extent, size in ((x, w, cell[0]), (y, h, cell[1]))
        )
        free[r0:r1, c0:c1] = False
    below = np.zeros((GRID + 1, GRID), int)  # free cells from each cell down
    for r in reversed(range(GRID)):
        below[r] = np.where(free[r], below[r + 1] + 1, 0)
    best = None
    for r in range(GRID):
        for c in range(GRID):
            tallest = np.minimum.accumulate(below[r, c:])
            for w, most in enumerate(tallest[tallest > 0].tolist(), 1):
                fitting = [h for h in range(1, most + 1) if abs(w / h - PORTRAIT_ASPECT) <= PORTRAIT_ASPECT * PORTRAIT_TOLERANCE]
                if fitting:
                    rank = (-w * fitting[-1], r, c, fitting[-1])
                    best = min(best or (rank, w), (rank, w))
    if best is None or -best[0][0] < GRID * GRID * LEAST_AREA:
        return None
    (_, r, c, h), w = best
    return c * cell[0], r * cell[1], w * cell[0], h * cell[1]


def orientation_score(lines: Column) -> Column:
    """Of a page's text lines, each an array of word boxes: the mean over lines of the words' widths by their mean height; 0 without words."""
    total = lambda ws, f: F.aggregate(ws, F.lit(0.0), lambda a, b: a + b[f])
    one = lambda ws: F.when(total(ws, "h") > 0, total(ws, "w") / (total(ws, "h") / F.size(ws))).otherwise(0.0)
    return F.when(F.size(lines) > 0, F.aggregate(F.transform(lines, one), F.lit(0.0), lambda a, x: a + x) / F.size(lines)).otherwise(0.0)


def rotation(scores: dict[int, Column]) -> Column:
    """The angle whose score is the best of those beyond MARGIN times that of 0 degrees (the first of equals), else 0. A null score takes no part."""
    zero = F.coalesce(scores[0], F.lit(0.0))
    turned = F.array(*(F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(a).alias("angle")) for i, (a, s) in enumerate(scores.items()) if a))
    return F.coalesce(F.array_min(F.filter(turned, lambda x: -x["s"] > zero * MARGIN))["angle"], F.lit(0))


def upside_down(upright: Column, flipped: Column) -> Column:
    """Whether the page turned by 180 degrees has the clearly better zone band."""
    return (flipped > upright * MARGIN) & (flipped > 0)


def portraits(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, portrait): pages are struct columns width, height, lines."""
    kind = pages.schema[key].dataType.simpleString()
    box = pa.struct([(n, pa.float64()) for n in "xywh"])

    def run(batches):
        for b in batches:
            out = []
            for w, h, lines in zip(b.column("width"), b.column("height"), b.column("lines")):
                found = free_area(w.as_py() or 0, h.as_py() or 0, [tuple(x["bbox"][n] for n in "xywh") for x in lines.as_py() or []])
                out.append(found and dict(zip("xywh", found)))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, box)], names=[key, "portrait"])

    return pages.select(key, "width", "height", "lines").mapInArrow(run, f"`{key}` {kind}, portrait struct<x: double, y: double, w: double, h: double>")
