"""Transliteration and name encoding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksum import ascii_upper, let

EXPANDED, SIMPLE, XX_SUFFIX = "expanded", "simple", "xx_suffix"
STYLES = (EXPANDED, SIMPLE, XX_SUFFIX)

#: Letters whose substitute isn't their base letter, all variants, the preferred one first (public transliteration table).
SPECIAL = {
    "Ä": ("AE", "A"), "Å": ("AA", "A"), "Æ": ("AE",), "Ð": ("D",), "Ñ": ("N", "NXX"), "Ö": ("OE", "O"), "Ø": ("OE",), "Ü": ("UE", "UXX", "U"), "Þ": ("TH",), "Đ": ("D",), "Ħ": ("H",),
    "ı": ("I",), "Ĳ": ("IJ",), "Ŀ": ("L",), "Ł": ("L",), "Ŋ": ("N",), "Œ": ("OE",), "Ŧ": ("T",), "ẞ": ("SS",),
}
_STYLED = {SIMPLE: {"Ä": "A", "Å": "A", "Ö": "O", "Ü": "U"}, XX_SUFFIX: {"Ñ": "NXX", "Ü": "UXX"}}


def table() -> dict[str, tuple[str, ...]]:
    """Each capital of Latin-1 and Latin Extended-A to its variants: accents fall away by decomposition, the rest is SPECIAL."""
    out = dict(SPECIAL)
    for cp in [*range(0xC0, 0xDF), *range(0x100, 0x180)]:
        c = chr(cp)
        base = unicodedata.normalize("NFD", c)[0]
        if c not in out and c.isupper() and base != c and base.isascii():
            out[c] = (base,)
    return dict(sorted(out.items()))


def mapping(style: str) -> dict[str, str]:
    return {c: _STYLED.get(style, {}).get(c, v[0]) for c, v in table().items()}


def _mapped(c: Column, style: str) -> Column:
    """Each character replaced by its substitute: those of one letter by translate, the others one by one."""
    pairs = mapping(style)
    one = {k: v for k, v in pairs.items() if len(v) == 1}
    c = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in pairs.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def transliterate(c: Column, style: str = EXPANDED) -> Column:
    """Full upper case, then the table; characters that it lacks stay."""
    return let(F.upper(c), lambda u: F.when(u.rlike(r"[^\x00-\x7F]"), _mapped(u, style)).otherwise(u))


def variants_of(ch: Column) -> Column:
    """All substitutes of one character; none for one that the table lacks."""
    flat = F.create_map(*(x for k, v in table().items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(flat[ch], F.array().cast("array<string>"))


def encode_name_component(c: Column) -> Column:
    """A name's zone form: letters and digits; hyphen, comma and white space as one filler; apostrophes and all else dropped."""
    c = transliterate(c)
    c = F.regexp_replace(c, r"(?U)[^A-Z0-9,\s-]", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[,\s-]+", "<"), r"\A<+|<+\z", "")


def clean(c: Column) -> Column:
    return F.regexp_replace(ascii_upper(c), "[^A-Z0-9]", "<")


def fixed(c: Column, width: int) -> Column:
    """clean(), cut or filled to the width."""
    return F.rpad(clean(F.coalesce(c, F.lit(""))), width, "<")


def truncated(primary: Column, secondary: Column, width: int) -> Column:
    """Components appended while they fit; the first that doesn't gives what letters fit, with its separator if a letter follows it."""
    split = lambda c: F.filter(F.split(c, "<"), lambda x: x != "")
    part = lambda c, first: F.transform(split(c), lambda x, i: F.struct(F.when(i == 0, first).otherwise("<").alias("sep"), x.alias("word")))
    parts = F.concat(part(primary, ""), part(secondary, "<<"))

    def step(a, p):
        room = width - F.length(a["out"])
        whole = F.length(p["sep"]) + F.length(p["word"]) <= room
        cut = F.when(F.length(p["sep"]) < room, F.concat(p["sep"], F.substr(p["word"], F.lit(1), room - F.length(p["sep"])))).otherwise(F.substr(p["word"], F.lit(1), room))
        grown = F.concat(a["out"], F.when(whole, F.concat(p["sep"], p["word"])).otherwise(cut))
        stop = a["stop"] | (room <= 0)
        return F.struct(F.when(stop, a["out"]).otherwise(grown).alias("out"), (stop | ~whole).alias("stop"))

    return F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(False).alias("stop")), step)["out"]


def name_field(surname: Column, given: Column, width: int) -> Column:
    parts = F.struct(encode_name_component(F.coalesce(surname, F.lit(""))).alias("p"), encode_name_component(F.coalesce(given, F.lit(""))).alias("s"))

    def joined(x: Column) -> Column:
        both = F.concat(x["p"], F.lit("<<"), x["s"])
        return F.rpad(F.when(F.length(both) <= width, both).otherwise(truncated(x["p"], x["s"], width)), width, "<")

    return let(parts, joined)
