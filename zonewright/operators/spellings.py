"""Names joined with zone names under all spellings that transliteration allows, and with zone names that were cut to fit, by equal keys alone.

A name of n ambiguous letters has up to 3^n spellings, so they aren't written out. Both sides get a folded key that is the same for all spellings of a name; names meet by
it, and a pattern built from the name tells whether the zone's is one of its spellings. Zone names that were cut meet by the folded key of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import table

_MANY = {k: v for k, v in table().items() if len(v) > 1}


def encoded(name: Column) -> Column:
    """A name's zone form in which letters with several substitutes still stand."""
    c = F.upper(name)
    one = {k: v[0] for k, v in table().items() if len(v) == 1}
    c = F.translate(c, "".join(k for k, v in one.items() if len(v) == 1), "".join(v for v in one.values() if len(v) == 1))
    for k, v in one.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    c = F.regexp_replace(c, rf"(?U)[^A-Z0-9,\s{''.join(_MANY)}-]", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[,\s-]+", "<"), r"\A<+|<+\z", "")


def folded(spelt: Column) -> Column:
    """Of a spelling: what can follow a letter as a part of its substitute falls away, however often it does, so that all spellings of a name give the same."""
    c = F.translate(spelt, "".join(_MANY), "".join(v[0][0] for v in _MANY.values()))
    for letters, rest in (("A", "[AE]"), ("O", "E"), ("U", "(?:E|XX)"), ("N", "(?:XX)")):
        c = F.regexp_replace(c, f"({letters}){rest}+", "$1")
    return c


def pattern(form: Column) -> Column:
    """Of encoded(): matches its spellings."""
    for k, v in _MANY.items():
        form = F.replace(form, F.lit(k), F.lit(f"(?:{'|'.join(v)})"))
    return F.concat(F.lit(r"\A"), form, F.lit(r"\z"))


def begun(form: Column) -> Column:
    """Of encoded(): matches all beginnings of its spellings."""

    def one(rest: Column, c: Column) -> Column:
        step = None
        for k, v in _MANY.items():
            parts = "".join(f"|{x}" for x in sorted({y[:i] for y in v for i in range(1, len(y))}))
            piece = F.concat(F.lit(f"(?:(?:{'|'.join(v)})"), rest, F.lit(f"{parts})?"))
            step = F.when(c == k, piece) if step is None else step.when(c == k, piece)
        return step.otherwise(F.concat(F.lit("(?:"), c, rest, F.lit(")?")))

    letters = F.filter(F.reverse(F.split(form, "")), lambda c: c != "")
    return F.concat(F.lit(r"\A"), F.aggregate(letters, F.lit(""), one), F.lit(r"\z"))


def matched(people: DataFrame, zones: DataFrame, name: str = "name", zone_name: str = "zone_name", cut: str = "cut") -> DataFrame:
    """(name, zone_name, cut, n_people, n_zones): each different name with each different zone name that is a spelling of it or, where cut, the beginning of one.

    Zone names hold letters, digits and fillers; those of one name and one length of folded key meet, so the pairs tried are the pairs of one key. Equal names are counted
    before they meet, however many there are. Null and empty names match nothing.
    """
    p = people.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n_people")).withColumn("form", encoded(F.col("name"))).filter("form <> ''")
    # a generator is a barrier: keys are computed once a name; patterns, which are far longer than names, are built of the pairs that meet and never shuffled
    p = p.select("name", "n_people", "form", F.explode(F.array(folded(F.col("form")))).alias("fold"))
    z = zones.groupBy(F.col(zone_name).alias("zone_name"), F.coalesce(F.col(cut), F.lit(False)).alias("cut")).agg(F.count("*").alias("n_zones")).filter("zone_name <> ''")
    # a cut may fall into UXX or NXX; without its last X a beginning folds to the beginning of the whole's key
    z = z.withColumn("key", folded(F.when(F.col("cut"), F.regexp_replace("zone_name", r"X+\z", "")).otherwise(F.col("zone_name"))))
    n = z.filter("cut").agg(F.sort_array(F.collect_set(F.length("key"))).alias("n")).first()["n"]  # no more than a zone is wide
    # neither side has a proven bound, so none may be broadcast, which would gather it on the driver
    whole = p.join(z.filter("not cut").hint("merge"), F.col("fold") == F.col("key")).filter(F.regexp_like("zone_name", pattern(F.col("form"))))
    keys = F.filter(F.array(*map(F.lit, n)).cast("array<int>"), lambda i: i <= F.length("fold"))
    starts = p.withColumn("i", F.explode(keys)).withColumn("head", F.substr("fold", F.lit(1), F.col("i")))
    part = starts.join(z.filter("cut").hint("merge"), F.col("head") == F.col("key")).filter(F.regexp_like("zone_name", begun(F.col("form"))))
    cols = ("name", "zone_name", "cut", "n_people", "n_zones")
    return whole.select(*cols).unionByName(part.select(*cols))
