"""Finding zones in free text.

A ranked search with an early exit: formats in a fixed order, start lines from the top, readings of each line from the likeliest on; the first
reading whose checks all hold wins, else the one with the most checks, the earliest of equals. If none holds but one was found, lines with one lost or
confused character are searched among the readings that the check digits leave (see damage), and an answer counts only if all answers agree. Catalyst has no early exit, so the search itself runs on Arrow
batches; a native filter in front drops texts without any line of a zone's shape, and the winning lines are parsed by the native parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksum import DIGIT_FROM, DIGIT_TO, LETTER_FROM, LETTER_TO, WEIGHTS, normalize_line
from ..functions.dates import PIVOT
from ..functions.normalize import trim
from ..schemas import ALPHABET, FORMATS, MRV_A, MRV_B, TD1, TD2, TD3, Layout
from ..shipping import ship
from .damage import Damaged, Line
from .parse import all_valid, parse_by_format
from .solve import ALTERNATIVES

#: Format order of the search, and how far below a line the next may stand.
ORDER, REACH = (TD3, MRV_B, MRV_A, TD1, TD2), 3
DAMAGED_ORDER = (TD3, MRV_A, TD2, MRV_B)
_DIGITS, _LETTERS, _UPPER = str.maketrans(DIGIT_FROM, DIGIT_TO), str.maketrans(LETTER_FROM, LETTER_TO), str.maketrans({chr(c): chr(c - 32) for c in range(97, 123)})
_VALUE = {c: i % 36 for i, c in enumerate(ALPHABET)}
_LEGAL = re.compile(r"[A-Z0-9<]*")


@lru_cache(1 << 12)
def normal(line: str) -> str:
    return "".join(line.split()).replace("«", "<<").replace("≪", "<<").replace("‹", "<").translate(_UPPER)


@lru_cache(1 << 14)
def digit_of(field: str) -> int:
    return sum(_VALUE[c] * WEIGHTS[i % 3] for i, c in enumerate(field)) % 10


def holds(field: str, digit: str) -> bool:
    return digit_of(field) == (0 if digit == "<" else int(digit) if digit.isdigit() else -1)


def _fill_runs(s: str) -> str:
    if "K" not in s and "L" not in s:
        return s
    return re.sub(r"[KL][KL<]*", lambda m: "<" * len(m[0]) if len(m[0]) >= 4 and len(m[0]) - m[0].count("<") >= 3 else m[0], s)


def _fill_neighbours(s: str) -> str:
    if "K" not in s and "L" not in s:
        return s
    s = re.sub(r"[KL](?=[KL]*<)", "<", s)
    return re.sub(r"<[KL]+", lambda m: "<" * len(m[0]), s)


def _split_name(s: str) -> str:
    body = s.rstrip("<")
    at = body.find("KK")
    return s if "<<" in body or at < 0 else s[:at] + "<<" + s[at + 2 :]


@lru_cache(1 << 13)
def repaired(s: str, layout: Layout, line: int) -> str:
    rules = layout.repairs[line]
    for start, end, kind in rules:
        if kind in ("digit", "letter"):
            s = s[:start] + s[start:end].translate(_DIGITS if kind == "digit" else _LETTERS) + s[end:]
    if line == 0 and s[1:2] == "K":
        s = s[0] + "<" + s[2:]
    for start, end, kind in rules:
        if kind == "filler":
            s = s[:start] + _fill_neighbours(_fill_runs(s[start:end])) + s[end:]
        elif kind == "name":
            s = s[:start] + _split_name(_fill_runs(s[start:]))
    return s


def unshifted(s: str, layout: Layout, line: int) -> str:
    """A first line that lost the filler behind its first letter."""
    s = repaired(s, layout, line)
    return s if s[1:2] == "<" or len(s) != layout.width else s[0] + "<" + s[1:-1]


def fits(n: str, width: int) -> list[str]:
    """Readings at the width: the longest filler run stretched or shrunk, then the line padded, or its head and tail."""
    gap = width - len(n)
    if not gap:
        return [n]
    run = max(re.finditer("<+", n), key=lambda m: len(m[0]), default=None)
    out = [n[: run.start()] + "<" * (len(run[0]) + gap) + n[run.end() :]] if run and len(run[0]) + gap > 0 else []
    return [*out, n + "<" * gap] if gap > 0 else [*out, n[:width], n[-width:]]


@lru_cache(1 << 12)
def readings(raw: str, layout: Layout, line: int, fix=repaired) -> tuple[str, ...]:
    n = normal(raw)
    if not layout.width - 14 <= len(n) <= layout.width + 4 or not _LEGAL.fullmatch(n):
        return ()
    forms = []
    for x in fits(n, layout.width):
        r = fix(x, layout, line)
        forms += (r, x, _fill_neighbours(r))
    return tuple(dict.fromkeys(forms))


def damaged_readings(raw: str, layout: Layout, line: int, lost: bool) -> tuple[str, ...]:
    """With one character put back anywhere (the line is one short), or one confusable character exchanged."""
    n = normal(raw)
    if len(n) != layout.width - lost or not _LEGAL.fullmatch(n):
        return ()
    if lost:
        forms = (n[:i] + c + n[i:] for i in range(len(n) + 1) for c in ALPHABET)
    else:
        forms = (n[:i] + c + n[i + 1 :] for i, old in enumerate(n) for c in ALTERNATIVES.get(old, ""))
    return tuple(dict.fromkeys(y for x in forms for y in (repaired(x, layout, line), x)))


def score(lines: tuple[str, ...], f: Layout) -> int | None:
    """How many of the five checks hold; None if the lines are no zone of the format."""
    if lines[0][0] not in f.first:
        return None
    at = lambda s: lines[s[0]][s[1] : s[2]]
    after = lambda s: lines[s[0]][s[2]]
    number, check = at(f.number), at(f.number_check)
    found = number_holds(number, check, at(f.optional[0])) if f.overflow else holds(number, check)
    total = found + holds(at(f.birth), after(f.birth)) + holds(at(f.expiry), after(f.expiry))
    total += holds(at(f.optional[0]), at(f.personal_check)) if f.personal_check else 1
    return total + (holds("".join(map(at, f.composite[0])), at(f.composite[1])) if f.composite else 1)


def number_holds(number: str, check: str, optional: str) -> bool:
    m = re.match(r"([^<]+)([0-9])<", optional) if check == "<" and number.strip("<") else None
    if not m:
        return holds(number, check)
    return holds(number + m[1], m[2]) or number[-1] == "<" and holds(number[:8].rstrip("<") + m[1], m[2])


def text_lines(text: str) -> list[str]:
    """Lines; one with two long tokens is a row of merged zone lines and gives those instead."""
    out = []
    for line in re.split(r"\r?\n", text.replace("&lt;", "<")):
        tokens = [t for t in line.split() if len(t.encode()) >= 20]
        out += tokens if len(tokens) >= 2 else [line]
    return out


def _merged(line: str, f: Layout) -> Iterator[tuple[str, ...]]:
    """All lines of a zone read as one."""
    n = normal(line)
    whole = f.width * f.lines
    if not (n and n[0] in f.first and whole - 4 <= len(n) <= whole + 4 and _LEGAL.fullmatch(n)):
        return
    parts = [n[f.width * k : f.width * (k + 1)] for k in range(f.lines - 1)]
    heads = [[repaired(p, f, k), p] for k, p in enumerate(parts)]
    if f.lines == 3:
        heads[0].insert(1, unshifted(parts[0], f, 0))
    yield from product(*heads, readings(n[f.width * (f.lines - 1) :], f, f.lines - 1))


def _starts(n: str, f: Layout) -> bool:
    """False only for lines no reading of which begins as the format does: a reading's first character is the line's, as read or repaired, or that of its tail if it is too long."""
    heads = n[:1] + (n[-f.width] if len(n) > f.width else "")
    return any(c in f.first for c in heads + heads.translate(_DIGITS) + heads.translate(_LETTERS))


def _apart(lines: list[str], i: int, f: Layout, reach: int) -> Iterator[tuple[str, ...]]:
    """A zone that starts at line i, each next line within reach of the one before."""
    if not _starts(normal(lines[i]), f):
        return
    first = readings(lines[i], f, 0) + (readings(lines[i], f, 0, unshifted) if f.lines == 3 else ())

    def rest(line: int, k: int) -> Iterator[tuple[str, ...]]:
        for j in range(line + 1, min(len(lines), line + 1 + reach)):
            for x in readings(lines[j], f, k):
                if k + 1 == f.lines:
                    yield (x,)
                else:
                    yield from ((x, *more) for more in rest(j, k + 1))

    for x in first:
        if x[0] in f.first:
            yield from ((x, *more) for more in rest(i, 1))


def candidates(lines: list[str]) -> Iterator[tuple[Layout, tuple[str, ...]]]:
    """All readings of a text's zone, in rank order. A two-line card has merged lines before all others, and adjacent lines only."""
    for f in ORDER:
        if f is TD2:
            for line in lines:
                yield from ((f, x) for x in _merged(line, f))
            for i in range(len(lines) - 1):
                yield from ((f, x) for x in _apart(lines, i, f, 1))
            continue
        for i, line in enumerate(lines):
            yield from ((f, x) for x in _merged(line, f))
            yield from ((f, x) for x in _apart(lines, i, f, REACH))


def _real(f: Layout, lines: tuple[str, ...]) -> bool:
    """Both dates exist."""
    days = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    for s, birth in ((f.birth, True), (f.expiry, False)):
        d = lines[s[0]][s[1] : s[2]]
        if not (d.isdigit() and 1 <= int(d[2:4]) <= 12 and 1 <= int(d[4:]) <= days[int(d[2:4]) - 1]):
            return False
        year = int(d[:2]) + (1900 if birth and int(d[:2]) > PIVOT else 2000)
        if d[2:] == "0229" and (year % 4 or year % 100 == 0 and year % 400):
            return False
    return True


def _identity(f: Layout, lines: tuple[str, ...]) -> tuple:
    at = lambda s: lines[s[0]][s[1] : s[2]]
    body = at(f.name_at).rstrip("<")
    surname, _, given = body.partition("<<")
    return at(f.number).rstrip("<"), at(f.birth), at(f.expiry), surname.replace("<", " ").strip(), given.replace("<", " ").strip(), at(f.nationality).rstrip("<")


@lru_cache(1 << 10)
def _undamaged(raw: str, f: Layout, line: int) -> Line:
    return Line(f, line, [x for x in readings(raw, f, line) if line or x[0] in f.first])


@lru_cache(1 << 10)
def _damaged(raw: str, f: Layout, line: int, lost: bool) -> Damaged | None:
    n = normal(raw)
    return Damaged(n, f, line, lost, repaired.__wrapped__) if len(n) == f.width - lost and _LEGAL.fullmatch(n) else None


def damaged(lines: list[str], budget: int | None = None) -> tuple[tuple[Layout, tuple[str, ...]] | None, bool]:
    """Adjacent lines of which one is damaged: the zone, None unless all valid readings name the same person and document; and whether a budget, if one is set,
    ended the search (unanimity is that of the readings tried, then). Only readings that the check digits leave are tried, so no budget is needed."""

    def shapes():
        for i in range(len(lines) - 2):
            for lost in (True, False):
                for k in range(3):
                    yield TD1, i, k, lost
        for i in range(len(lines) - 1):
            for f in DAMAGED_ORDER:
                for lost in (True, False):
                    for k in range(2):
                        yield f, i, k, lost

    first, names = None, set()
    for n, (f, i, k, lost) in enumerate(shapes()):
        n_k = normal(lines[i + k])
        if len(n_k) != f.width - lost or k == 0 and not lost and not any(_starts(c, f) for c in n_k[0] + ALTERNATIVES.get(n_k[0], "")):
            continue
        others = [_undamaged(lines[i + line], f, line) for line in range(f.lines) if line != k]
        if not all(o.readings for o in others):
            continue  # before the damaged line's many readings are made
        places = _damaged(lines[i + k], f, k, lost)
        if places is None:
            continue
        for chosen in product(*(range(len(o.readings)) for o in others)):
            if budget is not None:
                if budget < len(places.rows):
                    return (first and first[1:] if len(names) == 1 else None), True
                budget -= len(places.rows)
            for rank, reading in places.fitting(list(zip(others, chosen))):
                x = [o.readings[c] for o, c in zip(others, chosen)]
                x.insert(k, reading)
                if x[0][0] not in f.first or score(tuple(x), f) != 5 or not _real(f, tuple(x)):
                    continue
                order = (n, *chosen[:k], rank, *chosen[k:])
                names.add(_identity(f, tuple(x)))
                if len(names) > 1:
                    return None, False
                if first is None or order < first[0]:
                    first = (order, f, tuple(x))
    return (first and first[1:]), False


def find(text: str) -> tuple[Layout, tuple[str, ...], bool] | None:
    """(format, lines, whether it was found as damaged), or None."""
    found = search(text)
    return found and found[:3]


def search(text: str | None, budget: int | None = None) -> tuple[Layout, tuple[str, ...], bool, bool] | None:
    """As find(), and whether the damaged search ran out of a budget, if one is set."""
    if text is None:
        return None
    lines = text_lines(text)
    best, most = None, -1
    for f, x in candidates(lines):
        n = score(x, f)
        if n == 5:
            return f, x, False, False
        if n is not None and n > most:
            best, most = (f, x, False), n
    if not best:
        return None
    hit, exhausted = damaged(lines, budget)
    return (*hit, True, exhausted) if hit else (*best, exhausted)


def may_hold_zone(text: Column) -> Column:
    """False only for texts without a line or token of a zone line's length and characters."""
    shaped = lambda x: normalize_line(x).rlike(r"\A[A-Z0-9<]{16,94}\z")
    t = F.replace(text, F.lit("&lt;"), F.lit("<"))
    return F.coalesce(F.exists(F.split(t, r"\r?\n"), shaped) | F.exists(F.split(t, r"(?U)\s+"), shaped), F.lit(False))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pivot: int = PIVOT, budget: int | None = None) -> DataFrame:
    """Adds zone_format, mrz_lines, repaired (whether the damaged search found it), exhausted (whether that search ended at a budget of places, if one is set), mrz and error (kind
    NotFound where there is none). One pass: a text without any line of a zone's shape reaches Python as null."""
    ship(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    names = [*keep, "zone_format", "mrz_lines", "repaired", "exhausted"]

    def run(batches):
        for b in batches:
            found = [search(t.as_py(), budget) for t in b.column("_text")]
            lines = pa.array([x and list(x[1]) for x in found], pa.list_(pa.string()))
            flags = [pa.array([bool(x and x[k]) for x in found], pa.bool_()) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([x and x[0].name for x in found], pa.string()), lines, *flags], names=names)

    rows = df.select(*keep, F.when(may_hold_zone(F.col(text)), F.col(text)).alias("_text"))
    found = rows.mapInArrow(run, f"{kinds}, zone_format string, mrz_lines array<string>, repaired boolean, exhausted boolean")
    out = parse_by_format(found, "zone_format", "mrz_lines", pivot)
    missing = F.struct(F.lit("NotFound").alias("kind"), F.lit(None).cast("int").alias("expected"), F.lit(None).cast("int").alias("got"), F.lit(None).cast("string").alias("detail"))
    return out.withColumn("error", F.when(F.col("zone_format").isNull(), missing).otherwise(F.col("error")))


def zone_shaped_lines(text: Column) -> Column:
    """The trimmed lines with at least 20 visible characters."""
    lines = F.transform(F.split(text, r"\r?\n"), trim)
    return F.array_join(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"(?U)\s", "")) >= 20), "\n")


def with_retries(df: DataFrame, text: str = "text", retries: str = "retries", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds rescanned: the text with the zone-shaped lines of its retries (array<string>) appended, in order, up to the first that holds a valid zone by itself;
    none if the text holds one. Each text and retry is scanned once; scan the result as usual."""
    rows = df.select(F.struct(*keep).alias("k"), F.col(text).alias("t"), F.col(retries).alias("r")).withColumn("id", F.struct("k", F.xxhash64("t", "r")))
    pieces = rows.select("id", F.posexplode(F.concat(F.array("t"), F.transform(F.coalesce("r", F.array().cast("array<string>")), zone_shaped_lines))).alias("n", "piece"))
    done = scan(pieces.select(F.struct("id", "n").alias("at"), "piece"), "piece", ("at",)).groupBy("at.id").agg(F.min(F.when(all_valid(F.col("mrz.checks")), F.col("at.n"))).alias("first"))
    both = rows.join(done, "id", "left")
    last = F.when(F.col("first") == 0, 0).otherwise(F.coalesce("first", F.size("r")))
    kept = F.filter(F.slice(F.transform("r", zone_shaped_lines), F.lit(1), F.greatest(last, F.lit(0))), lambda x: x != "")
    return both.select("k.*", F.array_join(F.concat(F.array(F.coalesce("t", F.lit(""))), F.coalesce(kept, F.array().cast("array<string>"))), "\n").alias("rescanned"))


__all__ = ["FORMATS", "damaged", "find", "may_hold_zone", "scan", "search"]
