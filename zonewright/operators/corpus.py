"""Synthetic labelled identities as rows: seeds to people, people to zones, and readings with typical recognition errors. No images are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FORMATS, MRV_A, MRV_B, TD1, TD2, TD3
from .emit import emit

PROFILES = ("clean", "mobile", "scanner", "worn", "border-kiosk")
SURNAMES = ("ANDERSON", "BERGER", "COSTA", "DUBOIS", "ERIKSSON", "FISCHER", "GARCIA", "HORVAT", "IVANOVA", "JANSEN", "KOWALSKI", "LINDQVIST")
GIVEN = ("ANNA", "BRUNO", "CLARA", "DAVID", "EMMA", "FILIP", "GRETA", "HUGO", "IDA", "JONAS", "KATJA", "LUCA")
STATES = ("UTO", "DEU", "FRA", "ITA", "ESP", "POL", "HRV", "SRB", "NLD", "SWE", "CHE", "AUT")
#: Characters that readers confuse, by how often a profile does it, in thousandths of the characters.
CONFUSED = {"0": "O", "O": "0", "1": "I", "I": "1", "8": "B", "B": "8", "5": "S", "S": "5", "2": "Z", "Z": "2", "<": "K"}
RATES = {"clean": 0, "mobile": 2, "scanner": 3, "worn": 8, "border-kiosk": 12}


def draw(seed: Column, tag: str, n: int) -> Column:
    """A uniform number below n that depends on the seed and the tag only."""
    return F.pmod(F.xxhash64(seed, F.lit(tag)), F.lit(n)).cast("int")


def pick(seed: Column, tag: str, pool: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), draw(seed, tag, len(pool)) + 1)


def characters(seed: Column, tag: str, n: int, pool: str = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    return F.concat(*(F.substr(F.lit(pool), draw(seed, f"{tag}{i}", len(pool)) + 1, F.lit(1)) for i in range(n)))


def identities(seeds: DataFrame, start: int = 0) -> DataFrame:
    """One identity per row's seed: born 1950 to 2008, expiring 2027 to 2036, days to 28, issued by their own state; profiles in turn."""
    s = F.col("seed")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = lambda tag, first, years: F.concat_ws("-", (draw(s, f"{tag}y", years) + first).cast("string"), two(draw(s, f"{tag}m", 12) + 1), two(draw(s, f"{tag}d", 28) + 1))
    state = pick(s, "state", STATES)
    return seeds.select(
        "seed",
        F.element_at(F.array(*map(F.lit, PROFILES)), ((s - start) % len(PROFILES) + 1).cast("int")).alias("profile"),
        F.element_at(F.array(*(F.lit(f) for f in FORMATS)), draw(s, "format", len(FORMATS)) + 1).alias("format"),
        pick(s, "surname", SURNAMES).alias("surname"), pick(s, "given", GIVEN).alias("given_names"), state.alias("issuing_country"), state.alias("nationality"),
        characters(s, "number", 9).alias("document_number"), characters(s, "personal", 14).alias("personal_number"),
        date("birth", 1950, 59).alias("date_of_birth"), date("expiry", 2027, 10).alias("date_of_expiry"), pick(s, "sex", ("M", "F", "X")).alias("sex"),
    )


def yymmdd(c: Column) -> Column:
    return F.concat(F.substring(c, 3, 2), F.substring(c, 6, 2), F.substring(c, 9, 2))


CODES = {"Td3": "P", "Td2": "I", "Td1": "I", "MrvA": "V", "MrvB": "V"}


def with_zones(df: DataFrame) -> DataFrame:
    """Adds mrz_lines by the row's format. A personal number goes where the format has room, cut to it."""
    common = {c: F.col(c) for c in ("issuing_country", "document_number", "surname", "given_names", "nationality", "sex")}
    common |= {"date_of_birth": yymmdd(F.col("date_of_birth")), "date_of_expiry": yymmdd(F.col("date_of_expiry"))}
    out = None
    for f in (TD3, TD2, TD1, MRV_A, MRV_B):
        more = {"optional2": F.col("personal_number")} if f is TD1 else {"optional": F.col("personal_number")} if f in (TD3, TD2) else {}
        zone = emit(f, document_code=F.lit(CODES[f.name]), **common, **more)
        out = F.when(F.col("format") == f.name, zone) if out is None else out.when(F.col("format") == f.name, zone)
    return df.withColumn("mrz_lines", out)


def noisy(lines: Column, seed: Column, profile: Column) -> Column:
    """Lines with characters confused at the profile's rate, by position and seed."""
    rate = F.create_map(*(F.lit(x) for kv in RATES.items() for x in kv))[profile]
    wrong = F.create_map(*(F.lit(x) for kv in CONFUSED.items() for x in kv))

    def read(line, k):
        chars = F.split(line, "")
        hit = lambda i: F.pmod(F.xxhash64(seed, k, i), F.lit(1000)) < rate
        return F.array_join(F.transform(chars, lambda c, i: F.when(hit(i), F.coalesce(wrong[c], c)).otherwise(c)), "")

    return F.transform(lines, read)


def corpus(spark: SparkSession, start: int, count: int) -> DataFrame:
    """corpus_of() a range of seeds."""
    return corpus_of(spark.range(start, start + count).withColumnRenamed("id", "seed"), start)


def corpus_of(seeds: DataFrame, start: int = 0) -> DataFrame:
    """Identities, zones, and the text that a reader would give for each."""
    df = with_zones(identities(seeds, start))
    text = F.concat_ws("\n", F.lit("SPECIMEN"), F.array_join(noisy(F.col("mrz_lines"), F.col("seed"), F.col("profile")), "\n"), F.lit("VOID"))
    return df.withColumn("text", text)


#: Page size by format in millimetres, and the zone's first line: (width, height, left, top, line height).
PAGES = {"Td3": (125, 88, 5, 70, 7), "Td2": (105, 74, 5, 58, 7), "Td1": (86, 54, 4, 33, 7), "MrvA": (120, 80, 5, 64, 7), "MrvB": (105, 74, 5, 58, 7)}


def zone_rects(format_column: Column, lines: Column) -> Column:
    """array<struct<x, y, w, h>> of a zone's lines on its page."""
    out = None
    for name, (w, _, x, y, h) in PAGES.items():
        rects = F.transform(lines, lambda _, i: F.struct(F.lit(x).alias("x"), (F.lit(y) + i.cast("int") * h).alias("y"), F.lit(w - 2 * x).alias("w"), F.lit(h).alias("h")))  # noqa: B023
        out = F.when(format_column == name, rects) if out is None else out.when(format_column == name, rects)
    return out


def labels(df: DataFrame) -> DataFrame:
    """The label sidecars' rows."""
    return df.select("seed", "profile", "format", "document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "mrz_lines", F.array_join("mrz_lines", "\n").alias("mrz_string"), zone_rects(F.col("format"), F.col("mrz_lines")).alias("mrz_rects"))
