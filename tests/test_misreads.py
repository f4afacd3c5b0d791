"""Noise, edit scripts and the confusion matrix; names under all spellings."""

import itertools
import random

from pyspark.sql import functions as F

from zonewright.operators import misreads, spellings

TABLE = {"Ä": ("AE", "A"), "Å": ("AA", "A"), "Ñ": ("N", "NXX"), "Ö": ("OE", "O"), "Ü": ("UE", "UXX", "U")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def replayed(expected, changes):
    out, at = [], 0
    for place, e, g in changes:
        out.append(expected[at:place])
        at = place + (e is not None)
        assert e is None or expected[place] == e
        out.append(g or "")
    return "".join(out) + expected[at:]


def test_scripts_are_shortest_and_lead_from_one_text_to_the_other(monkeypatch):
    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("AB<") for _ in range(rng.randrange(14))) for _ in range(2)) for _ in range(600)]
    for cells in (misreads.CELLS, 4):  # 4: texts are halved down to single characters
        monkeypatch.setattr(misreads, "CELLS", cells)
        for a, b in pairs:
            got = list(misreads.script(a, b))
            assert replayed(a, got) == b and len(got) == distance(a, b), (a, b, got)


def test_long_texts_need_no_square_table(monkeypatch):
    monkeypatch.setattr(misreads, "CELLS", 1 << 12)
    rng = random.Random(1)
    a = "".join(rng.choice("ABC<") for _ in range(1500))
    b = a[:200] + a[205:700] + "XYZ" + a[700:]
    got = list(misreads.script(a, b))
    assert replayed(a, got) == b and len(got) == distance(a, b)


def test_confusions_count_what_the_noise_did(spark):
    rows = [(1, "A0<", "AO<"), (2, "A0<", "AU<"), (3, "AB<", "B<"), (4, "AB", "AKB"), (5, None, "Q"), (6, None, None), (7, "SAME", "SAME"), (7, "SAME", "SAME")]
    changed = misreads.scripts(spark.createDataFrame(rows, "i int, e string, g string"), "i", F.col("e"), F.col("g"))
    assert changed.count() == len(rows)
    got = {(r.expected, r.got, r.n, r.kind) for r in misreads.confusions(changed).collect()}
    assert got == {("0", "O", 1, "caught"), ("0", "U", 1, "blind"), ("A", None, 1, "lost"), (None, "K", 1, "added"), (None, "Q", 1, "added")}
    assert {r.blind_share for r in misreads.confusions(changed).collect()} == {0.5}
    assert misreads.confusions(changed.limit(0)).count() == 0


def test_noise_goes_by_seed_and_rate(spark):
    lines = F.array(F.lit("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"), F.lit("L898902C36UTO7408122F1204159ZE184226B<<<<<10"))
    df = spark.range(2000)
    none, every = df.select(misreads.degrade(lines, F.col("id")).alias("x")).distinct().collect(), df.select(misreads.degrade(lines, F.col("id"), merged=1000).alias("x")).distinct().collect()
    assert len(none) == 1 and [len(x) for x in none[0].x] == [44, 44] and [len(x) for x in every[0].x] == [88]
    noisy = misreads.degrade(lines, F.col("id"), 10, 20, 5, 100)
    rows = df.select("id", F.array_join(lines, "\n").alias("e"), F.array_join(noisy, "\n").alias("g")).persist()
    assert rows.collect() == df.select("id", F.array_join(lines, "\n").alias("e"), F.array_join(noisy, "\n").alias("g")).collect()
    n = {r.kind: r.n for r in misreads.confusions(misreads.scripts(rows, "id", F.col("e"), F.col("g"))).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert 2000 * 88 * 0.012 < n["lost"] < 2000 * 88 * 0.025 and n["added"] > 2000 * 88 * 0.002 and n["caught"] > 100
    assert df.limit(1).select(misreads.punched(lines).alias("x")).first().x[1] == "L898902C36UTO740822F1204159ZE184226B<<<<<10"


def test_unseen_misreads(spark):
    rows = [("L898902C3", "L898902C3"), ("0", "U"), ("0", "O"), ("AB", "A"), ("00", "UU"), (None, "A"), ("12", "31")]
    got = {(r.differing, r.n, r.unseen) for r in misreads.unseen(spark.createDataFrame(rows, "e string, g string"), F.col("e"), F.col("g")).collect()}
    weigh = lambda s: sum("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c) * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10
    assert got == {(1, 2, 1), (2, 2, 1 + (weigh("12") == weigh("31")))}


def test_names_meet_their_spellings_and_beginnings(spark):
    rng = random.Random(3)
    people = ["".join(rng.choice("ÄÅÑÖÜAEXNU -") for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["Müller", "müller", "O'Ñandú", "Łódź", None, "", "--", "中"]
    forms = {}
    for name in {p for p in people if p}:
        base = "".join({"Ł": "L", "Ó": "O", "Ź": "Z", "Ú": "U"}.get(c, c) for c in name.upper())
        base = "<".join(w for w in "".join("<" if c in " -" else c if c in TABLE or c.isascii() and c.isalnum() else "" for c in base).split("<") if w)
        forms[name] = {"".join(x) for x in itertools.product(*(TABLE.get(c, (c,)) for c in base))} - {""}
    spelt = sorted({s for x in forms.values() for s in x})
    zones = [(s, False) for s in spelt] + [(s[: rng.randrange(1, len(s) + 1)], True) for s in spelt] + [("MUELLER", False), (None, True), ("", True), ("MUX", None), ("Q", True)]
    want = {(n, z, bool(cut)) for n, x in forms.items() for z, cut in zones if z and any(s.startswith(z) if cut else s == z for s in x)}
    df = spellings.matched(spark.createDataFrame([(p,) for p in people], "name string"), spark.createDataFrame(zones, "zone_name string, cut boolean"))
    rows = df.collect()
    assert {(r.name, r.zone_name, r.cut) for r in rows} == want and len(rows) == len(want)
    assert all(r.n_people == people.count(r.name) and r.n_zones == sum(z == r.zone_name and bool(c) == r.cut for z, c in zones) for r in rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spellings.matched(spark.createDataFrame([], "name string"), spark.createDataFrame([], "zone_name string, cut boolean")).count() == 0


def test_no_side_of_the_names_is_broadcast(spark):
    """However small the tables look, neither names nor zone names are gathered on the driver."""
    people = spark.createDataFrame([("MÜLLER",), ("NUÑEZ",)], "name string")
    zones = spark.createDataFrame([("MUELLER", False), ("MUXXL", True), ("NUNXXEZ", False)], "zone_name string, cut boolean")
    df = spellings.matched(people, zones)
    assert {(r["name"], r["zone_name"]) for r in df.collect()} == {("MÜLLER", "MUELLER"), ("MÜLLER", "MUXXL"), ("NUÑEZ", "NUNXXEZ")}
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
