"""Text kernels: HTML entities, JSON repair, noise, sanity of recognized text, distances, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import trim

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))  # the last undoes doubled escapes
#: Characters that count as readable.
LATIN = r"""A-Za-z0-9<>/:.,\-_()'"*#|=+&%!?;"""
SANE = r"\p{L}\p{N}.,\-/<'"


def unescape_html(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s", "")


def drop_non_latin_noise(c: Column) -> Column:
    """Without the lines in which more than half of the visible characters are neither Latin nor usual punctuation."""
    lines = F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n")
    seen = lambda x: F.length(strip_space(x))
    odd = lambda x: F.length(F.regexp_replace(strip_space(x), f"[{LATIN}]", ""))
    return F.array_join(F.filter(lines, lambda x: ~((seen(x) > 0) & (odd(x) * 2 > seen(x)))), "\n")


def is_json_object(c: Column) -> Column:
    return F.coalesce(trim(c).startswith("{") & F.try_parse_json(trim(c)).isNotNull(), F.lit(False))


def needs_repair(c: Column) -> Column:
    """Whether a model's output isn't one JSON object as it stands."""
    return ~is_json_object(c)


def repair_json_text(c: Column) -> Column:
    """Without a code fence, prose around the outermost braces, and commas before a closing bracket."""
    t = trim(c)
    t = F.regexp_replace(t, r"(?s)\A```(?:[^\n]*\n)?", "")
    t = trim(F.regexp_replace(t, r"(?s)```\s*\z", ""))
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(F.when(inner == "", t).otherwise(inner), r"(?U),(?=\s*[}\]])", "")


def text_sanity(c: Column) -> Column:
    """The share of visible characters that are letters, digits or usual in documents; 0 for none."""
    t = strip_space(c)
    return F.when(F.length(t) == 0, 0.0).otherwise(F.length(F.regexp_replace(t, f"[^{SANE}]", "")) / F.length(t))


def page_sanity(c: Column) -> Column:
    """Null for a blank page."""
    return F.when(F.length(strip_space(c)) > 0, text_sanity(c))


def is_noise_line(c: Column, most: int = 2, share: float = 0.5) -> Column:
    """Very short, or at least half neither letters nor digits."""
    t = strip_space(c)
    return (F.length(t) <= most) | (F.length(F.regexp_replace(t, r"[\p{L}\p{N}]", "")) / F.length(t) >= share)


def noise_fraction(lines: Column) -> Column:
    """Of an array of lines that aren't zone lines; null for none."""
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: is_noise_line(x))) / F.size(lines))


def keyword_hits(c: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Names of the groups of which a word occurs, in upper case."""
    up = F.upper(c)
    found = [F.when(F.greatest(*(up.contains(w) for w in words), F.lit(False)), F.lit(g)) for g, words in groups.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def character_error_rate(expected: Column, got: Column) -> Column:
    """Edits a character of what was expected; 0 for both empty and 1 for a text where none was expected."""
    return F.when(expected == got, 0.0).when(F.length(expected) == 0, 1.0).otherwise(F.levenshtein(expected, got) / F.length(expected))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def encrypt(c: Column, key: Column) -> Column:
    """AES-GCM: 12 bytes of nonce, ciphertext, tag."""
    return F.aes_encrypt(c, key, F.lit("GCM"))


def decrypt(c: Column, key: Column) -> Column:
    """Null if the key or the tag is wrong."""
    return F.try_aes_decrypt(c, key, F.lit("GCM"))


def prompt(template: str, **slots: Column) -> Column:
    """A template with {name} filled in."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def prompt_digest(c: Column) -> Column:
    return F.substring(sha256_hex(c), 1, 8)
