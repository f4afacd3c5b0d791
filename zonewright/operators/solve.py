"""Solving damaged fields by their check digit: unknown characters, confused characters, lost characters. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checksum import WEIGHTS, char_value, check_digit, fit_length, let, rtrim_filler, verify
from ..functions.dates import is_well_formed
from ..schemas import ALPHABET

#: The mark of an unreadable character; the most of them that are solved, and the most exchanges that are tried: beyond, the answer is Unresolvable by definition.
UNKNOWN, MAX_UNKNOWNS, MAX_SUBSTITUTIONS = "?", 2, 256
#: Digits and the letters that are read for them.
CONFUSABLES = {"0": "ODQ", "1": "ILTU", "2": "Z", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B", "9": "G"}
#: Both ways: each character to what it may stand for, in the table's order.
ALTERNATIVES = {c: "".join([*CONFUSABLES.get(c, ""), *(d for d, g in CONFUSABLES.items() if c in g)]) for c in sorted({*CONFUSABLES, *"".join(CONFUSABLES.values())})}

DOCUMENT_NUMBER, PERSONAL_NUMBER, DATE, OTHER = "document_number", "personal_number", "date", "other"


def satisfies(c: Column, kind: str) -> Column:
    """Numbers have fillers at their end only; dates exist in the 1900s or the 2000s."""
    if kind in (DOCUMENT_NUMBER, PERSONAL_NUMBER):
        return ~rtrim_filler(c).contains("<")
    if kind == DATE:
        n = lambda i: F.substring(c, i, 2).try_cast("int")
        real = is_well_formed(n(1) + 1900, n(3), n(5)) | is_well_formed(n(1) + 2000, n(3), n(5))
        return F.coalesce(c.rlike(r"\A[0-9]{6}\z") & real, F.lit(False))
    return F.lit(True)


def _unknowns(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, UNKNOWN, ""))


def concrete_fillings(c: Column) -> Column:
    """Every way to fill at most two unknowns; the text itself if there are none; no way for more."""
    n = len(ALPHABET)
    at = F.instr(c, UNKNOWN)
    fill = lambda x, i: F.overlay(x, F.substr(F.lit(ALPHABET), i + 1, F.lit(1)), F.instr(x, UNKNOWN), F.lit(1))
    one = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: fill(c, i))
    two = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: fill(fill(c, i % n), F.floor(i / n).cast("int")))
    return F.when(at == 0, F.array(c)).when(_unknowns(c) == 1, one).when(_unknowns(c) == 2, two).otherwise(F.array().cast("array<string>"))


def resolution(hits: Column) -> Column:
    """struct<kind, candidates>: Unique, Ambiguous or Unresolvable, candidates sorted."""
    kind = lambda h: F.when(F.size(h) == 0, "Unresolvable").when(F.size(h) == 1, "Unique").otherwise("Ambiguous")
    return let(F.array_sort(hits), lambda h: F.struct(kind(h).alias("kind"), h.alias("candidates")))


def unique(r: Column) -> Column:
    """Of a resolution: the only candidate, else null."""
    return F.when(r["kind"] == "Unique", F.get(r["candidates"], F.lit(0)))


#: The alphabet's characters by the last digit of their value; by a position's weight, the factor that undoes it modulo 10.
_BY_RESIDUE = [[c for i, c in enumerate(ALPHABET) if i % 36 % 10 == r] for r in range(10)]
_UNDO = {w: next(k for k in range(10) if w * k % 10 == 1) for w in WEIGHTS}


def solve_field(field: Column, check: Column, kind: str = OTHER, width: int | None = None) -> Column:
    """All fillings of at most MAX_UNKNOWNS unknowns that its check digit and its kind allow; more unknowns are Unresolvable.

    What a missing character must add to the sum is the check digit less the known characters' sum; divided by its place's weight, modulo 10, that is
    the last digit of its value, so its candidates come from a table and nothing is tried.
    """
    at = F.instr(field, UNKNOWN)
    second = F.position(F.lit(UNKNOWN), field, at + 1)
    table = F.array(*(F.array(*map(F.lit, group)) for group in _BY_RESIDUE))
    weight = lambda i: F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(i - 1, F.lit(3)) + 1)
    undo = lambda i: F.element_at(F.array(*(F.lit(_UNDO[w]) for w in WEIGHTS)), F.pmod(i - 1, F.lit(3)) + 1)
    digit = F.when(check == "<", 0).when(check.rlike(r"\A[0-9]\z"), check.try_cast("int"))
    known = F.translate(field, UNKNOWN, "0")
    put = lambda x, c, i: F.overlay(x, c, i, F.lit(1))

    def fillings(need: Column) -> Column:
        one = F.transform(F.get(table, F.pmod(need * undo(at), F.lit(10))), lambda c: put(field, c, at))
        rest = lambda c: F.get(table, F.pmod((need - weight(at) * char_value(c)) * undo(second), F.lit(10)))
        two = F.flatten(F.transform(F.array(*map(F.lit, ALPHABET)), lambda c: F.transform(rest(c), lambda d: put(put(field, c, at), d, second))))
        none = F.array().cast("array<string>")
        return F.when(need.isNull(), none).when(at == 0, F.when(need == 0, F.array(field)).otherwise(none)).when(second == 0, one).when(_unknowns(field) == 2, two).otherwise(none)

    return resolution(F.filter(let(F.pmod(digit - check_digit(known, width), F.lit(10)), fillings), lambda x: satisfies(x, kind)))


def alternatives(ch: Column) -> Column:
    table = F.create_map(*(x for k, v in ALTERNATIVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(table[ch], F.array().cast("array<string>"))


def substitution_candidates(c: Column) -> Column:
    """All texts with exactly one confusable character exchanged, by position; none for a text with unknowns or beyond ASCII."""
    at = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
    all_ = F.flatten(F.transform(at, lambda i: F.transform(alternatives(F.substr(c, i, F.lit(1))), lambda a: F.overlay(c, a, i, F.lit(1)))))
    ok = (F.octet_length(c) == F.length(c)) & ~c.contains(UNKNOWN)
    return F.when(ok, F.slice(F.array_distinct(all_), 1, MAX_SUBSTITUTIONS)).otherwise(F.array().cast("array<string>"))


def solve_substitution(field: Column, check: Column, kind: str = OTHER, width: int | None = None) -> Column:
    """The field itself if it holds, else all single exchanges that do."""
    good = lambda x: verify(x, check, width) & satisfies(x, kind)
    return resolution(F.when(good(field) & (check != UNKNOWN), F.array(field)).otherwise(F.filter(substitution_candidates(field), lambda x: good(x) & (check != UNKNOWN))))


def width_candidates(c: Column, width: int) -> Column:
    """Readings at a width: those of fit_length(), and for up to two lost characters unknowns put in at every place."""
    t = F.regexp_replace(c, r"(?U)\s", "")
    gap = width - F.length(t)
    at = F.sequence(F.lit(0), F.length(t))
    marks = F.rpad(F.lit(""), gap, F.lit(UNKNOWN))
    put = F.transform(at, lambda i: F.concat(F.substr(t, F.lit(1), i), marks, F.substr(t, i + 1)))
    out = F.concat(fit_length(t, width), F.when(gap.between(1, MAX_UNKNOWNS), put).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(out, lambda x: F.length(x) == width))
