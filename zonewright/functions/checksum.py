"""Check digits and zone-text repair as column functions. Nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ALPHABET

WEIGHTS = (7, 3, 1)
#: The last digit of each character's value, in the alphabet's order; decimal places of one number.
RESIDUES, PLACES = "".join(str(i % 36 % 10) for i in range(37)), 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGIT_FROM, DIGIT_TO = "OQDILZSGB", "000112568"
LETTER_FROM, LETTER_TO = "012568", "OIZSGB"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_upper(c: Column) -> Column:
    """a-z to A-Z; any other letter stays, so that it is still an illegal one."""
    return F.when(c.rlike("[a-z]"), F.translate(c, LOWER, UPPER)).otherwise(c)


def rtrim_filler(c: Column) -> Column:
    return F.rtrim(c, F.lit("<"))


def is_mrz_charset(c: Column) -> Column:
    return c.rlike(r"\A[A-Z0-9<]*\z")


def char_value(ch: Column) -> Column:
    """0-9, then A-Z from 10 on; the filler counts as 0."""
    return (F.position(ch, F.lit(ALPHABET)) - 1) % 36


def check_digit(c: Column, width: int | None = None) -> Column:
    """The 7-3-1 sum modulo 10; null if a character has no value; 0 for an empty field.

    With a known width the characters become their values' last digits, up to 18 of them one number, and each three places of that number are one look
    into a table of a thousand sums; otherwise it is an aggregate over positions.
    """
    if width is None:
        at = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
        weight = lambda i: F.element_at(F.array(*map(F.lit, WEIGHTS)), (i - 1) % 3 + 1)
        total = F.aggregate(at, F.lit(0), lambda a, i: a + char_value(F.substr(c, i, F.lit(1))) * weight(i))
        return F.when(is_mrz_charset(c), total % 10)
    if not width:
        return F.when(is_mrz_charset(c), 0)
    digits = F.rpad(F.when(c.rlike(r"\A[0-9]*\z"), c).otherwise(F.translate(c, ALPHABET, RESIDUES)), -(-width // 3) * 3, "0")
    parts = []
    for start in range(0, width, PLACES):
        n = min(PLACES, -(-(width - start) // 3) * 3)
        number = F.substring(digits, start + 1, n).try_cast("long")
        parts.append(let(number, lambda v: number_sum(v, n)))  # noqa: B023  once, in interpreted contexts too
    return ((reduce(add, parts) % 10).cast("int") + F.when(is_mrz_charset(c), 0)).cast("int")


def number_sum(number: Column, places: int) -> Column:
    """The weighted sum of a number's decimal places, a multiple of three of them, of which the first has the first weight."""
    table = F.from_json(F.lit(str([sum(w * int(d) for w, d in zip(WEIGHTS, f"{i:03d}")) for i in range(1000)])), "array<int>")  # folded into one literal
    of = lambda k: F.call_function("div", number, F.lit(10**k)) if k else number
    return reduce(add, (F.get(table, ((of(k) % 1000) if k < places - 3 else of(k)).cast("int")) for k in range(places - 3, -1, -3)))


def verify(c: Column, digit: Column, width: int | None = None) -> Column:
    """True if digit is the field's check digit; a filler stands for 0."""
    want = F.when(digit == "<", 0).when(digit.rlike(r"\A[0-9]\z"), digit.try_cast("int"))
    return F.coalesce(check_digit(c, width) == want, F.lit(False))


def normalize_line(c: Column) -> Column:
    """Without white space, double angle quotes as two fillers, single ones as one, ASCII letters in upper case."""
    c = F.regexp_replace(c, r"(?U)\s", "")
    return ascii_upper(F.translate(F.replace(F.replace(c, F.lit("«"), F.lit("<<")), F.lit("≪"), F.lit("<<")), "‹", "<"))


def digitize(c: Column) -> Column:
    return F.translate(c, DIGIT_FROM, DIGIT_TO)


def letterize(c: Column) -> Column:
    return F.translate(c, LETTER_FROM, LETTER_TO)


def span(c: Column, start: int, end: int) -> Column:
    return F.substring(c, start + 1, end - start)


def replaced(c: Column, start: int, end: int, how) -> Column:
    """The line with how() applied to one range."""
    return let(c, lambda x: F.concat(F.substring(x, 1, start), how(span(x, start, end)), F.substr(x, F.lit(end + 1))))


def defiller(c: Column) -> Column:
    """Runs of K, L and < that start with K or L become fillers if they have 4 characters and 3 of K and L."""
    parts = F.regexp_extract_all(c, F.lit("([KL][KL<]*|[^KL])"), F.lit(1))
    fix = lambda t: F.when((F.length(t) >= 4) & t.rlike("^[KL]") & (F.length(F.translate(t, "<", "")) >= 3), F.rpad(F.lit(""), F.length(t), F.lit("<"))).otherwise(t)
    return F.array_join(F.transform(parts, fix), "")


def aggressive_defiller(c: Column) -> Column:
    """K and L next to a filler become fillers, until none is."""
    return F.regexp_replace(F.regexp_replace(c, "[KL](?=[KL]*<)", "<"), "(?<=<[KL]{0,64})[KL]", "<")


def fix_doc_code(c: Column) -> Column:
    return let(c, lambda x: F.when(span(x, 1, 2) == "K", F.overlay(x, F.lit("<"), F.lit(2), F.lit(1))).otherwise(x))


def fix_name_separator(c: Column) -> Column:
    """A name without << gets it at its first KK."""
    broken = lambda x: (F.instr(rtrim_filler(x), "<<") == 0) & (F.instr(x, "KK") > 0)
    return let(c, lambda x: F.when(broken(x), F.overlay(x, F.lit("<<"), F.instr(x, "KK"), F.lit(2))).otherwise(x))


def longest_filler_run(c: Column) -> Column:
    """struct<start, len> of the first longest run of fillers, 0-based; null if there is none."""
    runs = F.regexp_extract_all(c, F.lit("([^<]+|<+)"), F.lit(1))
    ends = F.aggregate(
        runs, F.struct(F.lit(0).alias("at"), F.lit(-1).alias("start"), F.lit(0).alias("len")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t)).alias("at"),
            F.when(t.startswith("<") & (F.length(t) > a["len"]), a["at"]).otherwise(a["start"]).alias("start"),
            F.when(t.startswith("<") & (F.length(t) > a["len"]), F.length(t)).otherwise(a["len"]).alias("len"),
        ),
    )
    return F.when(c.contains("<"), F.struct(ends["start"].alias("start"), ends["len"].alias("len")))


def fit_length(c: Column, width: int) -> Column:
    """Readings of a line as one of the given width: its longest filler run stretched or shrunk, and its ends padded or cut."""
    return let(longest_filler_run(c), lambda run: _fitted(c, run, width))


def _fitted(c: Column, run: Column, width: int) -> Column:
    n = F.length(c)
    fill = lambda k: F.rpad(F.lit(""), k, F.lit("<"))
    stretched = F.concat(F.substr(c, F.lit(1), run["start"] + run["len"]), fill(width - n), F.substr(c, run["start"] + run["len"] + 1))
    shrunk = F.concat(F.substr(c, F.lit(1), run["start"]), fill(run["len"] - (n - width)), F.substr(c, run["start"] + run["len"] + 1))
    short = F.array(F.when(run.isNotNull(), stretched), F.rpad(c, width, "<"))
    long = F.array(F.when(run["len"] > n - width, shrunk), F.substring(c, 1, width), F.right(c, F.lit(width)))
    return F.filter(F.when(n == width, F.array(c)).when(n < width, short).otherwise(long), lambda x: x.isNotNull())


def variants(raw: Column, width: int, repair) -> Column:
    """Candidate readings of a line, each repaired, as it is, and with every doubtful filler; none if it isn't near the width."""

    def forms(c: Column) -> Column:
        three = lambda x: let(repair(x), lambda r: F.array(r, x, aggressive_defiller(r)))
        ok = F.length(c).between(width - 14, width + 4) & is_mrz_charset(c)
        return F.when(ok, F.array_distinct(F.flatten(F.transform(fit_length(c, width), three)))).otherwise(F.array().cast("array<string>"))

    return let(normalize_line(raw), forms)


def repair_line(c: Column, layout, line: int) -> Column:
    """A format's own repairs of one of its lines: digits where digits stand, letters where letters stand, fillers where none do."""
    rules = layout.repairs[line]
    for start, end, kind in rules:
        if kind == "digit":
            c = replaced(c, start, end, digitize)
        elif kind == "letter":
            c = replaced(c, start, end, letterize)
    if line == 0:
        c = fix_doc_code(c)
    for start, end, kind in rules:
        if kind == "filler":
            c = replaced(c, start, end, lambda x: aggressive_defiller(defiller(x)))
        elif kind == "name":
            c = replaced(c, start, layout.width, lambda x: fix_name_separator(defiller(x)))
    return c


# ---- what a check digit cannot see --------------------------------------------------------------------


def blindspot(a: Column, b: Column) -> Column:
    """struct<kind, value> for reading b in place of a: identical, caught (difference mod 10), blind (residue) or not_mrz_charset."""
    legal = lambda c: c.rlike(r"\A[A-Z0-9<]\z")
    x, y = char_value(a), char_value(b)
    kind = F.when(~(legal(a) & legal(b)), "not_mrz_charset").when(a == b, "identical").when(x % 10 == y % 10, "blind").otherwise("caught")
    value = F.when(kind == "blind", x % 10).when(kind == "caught", F.pmod(x - y, F.lit(10)))
    return F.struct(kind.alias("kind"), value.cast("int").alias("value"))


def residue_class(a: Column) -> Column:
    return F.when(a.rlike(r"\A[A-Z0-9<]\z"), (char_value(a) % 10).cast("int"))


def is_blind(spot: Column) -> Column:
    """Of a blindspot()."""
    return spot["kind"] == "blind"


def sequence_blind(a: Column, b: Column) -> Column:
    """Whether reading b in place of a, texts of one length, changes something that their check digit doesn't see."""
    return (F.length(a) == F.length(b)) & (a != b) & F.coalesce(check_digit(a) == check_digit(b), F.lit(False))


def collisions(a: Column) -> Column:
    """The other characters of the same residue, in alphabet order."""
    return F.filter(F.array(*map(F.lit, ALPHABET)), lambda x: (residue_class(x) == residue_class(a)) & (x != a))


def blind_positions(lines: Column) -> Column:
    """Characters whose misreading as another of their class no check digit sees: every character of the alphabet has one."""
    return F.length(F.regexp_replace(lines, "[^A-Z0-9<]", ""))
