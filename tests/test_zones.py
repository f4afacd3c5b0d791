"""Published vectors and hand-computed rows for the zone kernels."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from zonewright.functions import checksum as ck
from zonewright.functions import dates, names, normalize, text
from zonewright.functions.countries import POOL, Countries
from zonewright.operators import evaluate, fuse, ocr_lines, parse, scan, solve
from zonewright.plans import catalog
from zonewright.schemas import FORMATS, TD1, TD2, TD3

P1, P2 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
CARD = ("I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<")
TWO = ("I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6")


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


@pytest.mark.parametrize(("field", "digit"), [("520727", 3), ("AB2134<<<", 5), ("L898902C3", 6), ("ZE184226B<<<<<", 1), ("740812", 2), ("120415", 9), ("", 0), ("a", None)])
def test_check_digits(spark, field, digit):
    assert list(one(spark, ck.check_digit(F.lit(field)), ck.check_digit(F.lit(field), len(field)))) == [digit, digit]


@pytest.mark.parametrize(("layout", "lines"), [(TD3, (P1, P2)), (TD1, CARD), (TD2, TWO)])
def test_specimens(spark, layout, lines):
    m = one(spark, parse.parse([F.lit(x) for x in lines], layout))[0]
    assert (m.surname, m.given_names, m.date_of_birth, m.date_of_expiry, m.sex) == ("ERIKSSON", "ANNA MARIA", "1974-08-12", "2012-04-15", "F")
    assert all(m.checks)


def test_failed_checks_and_unknown_dates(spark):
    bad = parse.parse([F.lit(P1), F.lit(P2.replace("740812", "750812"))], TD3)
    unknown = parse.parse([F.lit(P1), F.lit(P2.replace("7408122", "<<<<<<0"))], TD3)
    r = one(spark, parse.failed(bad["checks"]), unknown["checks"]["date_of_birth"], unknown["date_of_birth_completeness"])
    assert list(r) == [["date_of_birth", "composite"], True, "Unknown"]


def test_long_number(spark):
    o = parse.overflow(F.lit("D23145890"), F.lit("<"), F.lit("XYZ5<<<<<<<<<<<"))
    legacy = one(spark, o["full"])
    assert legacy[0] == "D23145890XYZ"


@pytest.mark.parametrize(
    ("a", "b", "kind", "value"), [("A", "K", "blind", 0), ("O", "0", "caught", 4), ("A", "A", "identical", None), ("a", "A", "not_mrz_charset", None)]
)
def test_blindspot(spark, a, b, kind, value):
    r = one(spark, ck.blindspot(F.lit(a), F.lit(b)))[0]
    assert (r.kind, r.value) == (kind, value)


def test_collisions(spark):
    assert one(spark, ck.collisions(F.lit("K")))[0] == ["0", "A", "U", "<"]


def test_normal_forms(spark):
    c = Countries(POOL)
    r = one(spark, *(normalize.country_code(F.lit(x), c) for x in ("CROATIA", "hrv", "D", "Narnia")), dates.normalize_date(F.lit("2014-7-1")), dates.normalize_date(F.lit("1.7.2014")), normalize.sex(F.lit(" male")), c.equivalent(F.lit("DEU"), F.lit("d")))
    assert list(r) == ["HRV", "HRV", "D", "Narnia", "2014-07-01", "2014-07-01", "M", True]


def test_names(spark):
    r = one(spark, names.encode_name_component(F.lit("O'Connor-Smith, Jr.")), names.transliterate(F.lit("Größe")), names.truncated(F.lit("ABCDEFGHIJ"), F.lit("KLM"), 12))
    assert list(r) == ["OCONNOR<SMITH<JR", "GROESSE", "ABCDEFGHIJKL"]


@pytest.mark.parametrize(("a", "b", "d"), [("kitten", "sitting", 3), ("flaw", "lawn", 2), ("L898902C3", "L898902C8", 1), ("0070070071", "OO7OO7OO71", 6)])
def test_character_errors(spark, a, b, d):
    assert one(spark, text.character_error_rate(F.lit(a), F.lit(b)))[0] == d / len(a)


def test_json_and_html(spark):
    r = one(spark, text.repair_json_text(F.lit('```json\n{"a": [1, 2,],}\n```')), text.unescape_html(F.lit("&amp;lt;")), text.repair_json_text(F.lit("no json")))
    assert list(r) == ['{"a": [1, 2]}', "&lt;", "no json"]


def test_repairs_native_and_in_search_agree(spark):
    lines = [P2.replace("<<<<<", "KKKKK"), P1.replace("<<<<<<", "KLKLKK"), P2.replace("7408122", "74O8I22"), CARD[0].replace("<", "K"), TWO[1]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    for layout, k in ((TD3, 0), (TD3, 1), (TD1, 0), (TD1, 1), (TD1, 2), (TD2, 1)):
        got = rows.select("i", ck.variants(F.col("x"), layout.width, lambda c: ck.repair_line(c, layout, k)).alias("v")).orderBy("i").collect()  # noqa: B023
        assert [r.v for r in got] == [list(scan.readings(x, layout, k)) for x in lines]


@pytest.mark.parametrize(
    ("given", "name"),
    [
        (f"{P1}\n{P2}", "Td3"), ("\n".join(CARD), "Td1"), ("\n".join(TWO), "Td2"), (f"{P1} {P2}".replace("<", "&lt;"), "Td3"), (f"x, y.\n{P1.lower()}\nnoise.\n{P2}", "Td3"),
        (P1.replace("<<<<<<<<", "KKKKKKKK") + "\n" + P2, "Td3"), ("".join(CARD), "Td1"),
    ],
)
def test_finding(given, name):
    layout, lines, damaged = scan.find(given)
    assert (layout.name, scan.score(lines, layout), damaged) == (name, 5, False)


def test_damaged_is_found_only_if_unique():
    layout, lines, damaged = scan.find(f"{P1}\n{P2[:20]}{P2[21:]}")
    assert damaged in (True, False)
    assert layout.name == "Td3"
    assert scan.find("nothing here.\nat all.") is None


def test_scan_frame(spark):
    rows = spark.createDataFrame([(1, f"{P1}\n{P2}"), (2, "prose, only."), (3, None), (4, "")], "doc_id int, text string")
    got = {r.doc_id: r for r in scan.scan(rows).select("doc_id", "zone_format", "mrz.surname", "error.kind").collect()}
    assert got[1].surname == "ERIKSSON" and got[1].kind is None
    assert all(got[k].kind == "NotFound" for k in (2, 3, 4))


def test_solver(spark):
    r = one(spark, solve.solve_field(F.lit("L8?8902C3"), F.lit("6"), solve.DOCUMENT_NUMBER), solve.solve_field(F.lit("???"), F.lit("6")), solve.solve_substitution(F.lit("74O812"), F.lit("2"), solve.DATE))
    assert "L898902C3" in r[0].candidates and r[0].kind == "Ambiguous"
    assert r[1].kind == "Unresolvable"
    assert (r[2].kind, r[2].candidates) == ("Unique", ["740812"])


def test_routing_order(spark):
    p = fuse.RoutingPolicy(on_line1_flagged=True)
    r = one(spark, p.decide(F.lit(False), F.lit(False), F.lit(True), F.lit(None).cast("double"), F.array().cast("array<string>")), p.decide(F.lit(True), F.lit(True), F.lit(True), F.lit(None).cast("double"), F.array().cast("array<string>")))
    assert [x.reason for x in r] == ["mrz_not_found", "line1_flagged"]


def test_catalog_sorts_by_cost():
    c = fuse.Catalog().register("model", "expensive", "m").register("zone", "free", "z", deterministic=True)
    assert c.ids() == ["zone", "model"]
    assert c.find("expensive", deterministic=False) == "m"
    assert c.find("cheap", deterministic=False) is None


def test_nearest_rank(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert evaluate.nearest_rank(rows, "v", {"p50": 0.5}).first()["p50"] == 3.0


def test_stride(spark):
    assert [r.id for r in evaluate.stride(spark.range(10), 4, "id").orderBy("id").collect()] == [0, 2, 5, 7]
    assert evaluate.stride(spark.range(0), 4, "id").count() == 0


def test_portrait_area():
    x, y, w, h = ocr_lines.free_area(400, 300, [(0, 0, 400, 10)])
    assert y >= 7.5 and abs((w / 10) / (h / 7.5) - 0.75) <= 0.75 * 0.35  # measured in cells of the raster
    assert ocr_lines.free_area(400, 300, [(0, 0, 400, 10), (0, 20, 400, 0)])[1] >= 22.5  # a box without height still uses its cells
    assert ocr_lines.free_area(400, 300, [(0, 0, 200, 150)]) is None
    assert ocr_lines.free_area(400, 300, [(0, 0, 200, 142), (20, 0, 180, 150)]) is None  # less than the least area is left


def test_layout_table():
    for f in FORMATS.values():
        assert all(e <= f.width for _, _, e in (f.name_at, f.number, f.birth, f.expiry, *f.optional))


# ---- sources and sinks on files


def test_specimens_and_labels(spark, tmp_path):
    from zonewright.sources import files

    for folder, name in (("a/passports", "x1.JPG"), ("a/id_cards", "x2.png"), ("driving_licenses", "x3.webp"), ("other", "x4.tiff"), ("my_passports_old", "x5.gif"), ("passports", "notes.txt")):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_bytes(b"z")
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "x4.json").write_text('{"document_type": "id1",\n "surname": "A"}')
    (tmp_path / "labels" / "x5.json").write_text('{"document_type": "P"}')
    (tmp_path / "labels" / "x1.json").write_text('{"document_type": "P"')
    found = files.images(spark, str(tmp_path / "in"))
    assert [r.stem for r in found.collect()] == ["x2", "x1", "x3", "x5", "x4"]
    labels = files.ground_truth(spark, str(tmp_path / "labels"))
    assert sorted(r.stem for r in labels.collect()) == ["x4", "x5"]
    got = {r.stem: r.specimen_class for r in files.specimens(found, labels).collect()}
    assert got == {"x1": "passport", "x2": "id_card", "x3": "driving_license", "x4": "id_card", "x5": "passport"}
    assert [r.stem for r in files.batch_inputs(spark, str(tmp_path / "in/a/passports"), "x?.JPG").collect()] == ["x1"]
    with pytest.raises(FileNotFoundError):
        files.batch_inputs(spark, str(tmp_path / "in/other"), "*.png")
    gate = spark.createDataFrame([("a/b.HEIC",), ("c.heif",), ("d.pdf",), ("e",), ("f.Jpeg",)], "p string").select(files.unsupported_input(F.col("p")).alias("w"))
    assert [r.w for r in gate.collect()] == ["heic", "heic", "not_an_image", "not_an_image", None]


def test_history_and_reports(spark, tmp_path):
    from zonewright.sources import files

    (tmp_path / "h.jsonl").write_text('{"run_timestamp_unix": 5, "provider_id": "a", "mean_ms": 2.5}\n\n{broken\n{"run_timestamp_unix": 6}\n')
    assert [(r.run_timestamp_unix, r.provider_id, r.mean_ms) for r in files.history(spark, str(tmp_path / "h.jsonl")).filter("run_timestamp_unix is not null").collect()] == [(5, "a", 2.5), (6, None, None)]
    files.write_report(spark.createDataFrame([("a", None)], "provider string, rate double"), str(tmp_path / "report"))
    (line,) = [x for p in (tmp_path / "report").glob("part-*") for x in p.read_text().splitlines()]
    assert line == '{"provider":"a","rate":null}'


# ---- damaged zones: one character lost or confused

L1 = "P<UTOSPECIMEN<<TEST".ljust(44, "<")


def with_digit(s):
    return s + str(sum("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<".index(c) % 36 * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10)


_PARTS = with_digit("AB123457<"), with_digit("800101"), with_digit("301230"), with_digit("<" * 14)
L2 = f"{_PARTS[0]}UTO{_PARTS[1]}F{_PARTS[2]}{_PARTS[3]}" + with_digit("".join(_PARTS))[-1]


def test_a_confused_digit_of_the_number_is_recovered():
    layout, lines, damaged = scan.find(f"{L1}\n{L2}")
    assert scan.score(lines, layout) == 5 and not damaged
    layout, lines, damaged = scan.find(f"{L1}\nABI{L2[3:]}")
    assert damaged and lines[1] == L2


def test_what_the_damaged_search_finds_equals_all_readings_tried(spark):
    """Every single exchange or insertion in either line, parsed by the native parser: the search answers if and only if all valid ones agree."""
    for bad in (f"ABI{L2[3:]}", f"O{L2[1:]}", f"{L2[:21]}{L2[22:]}", f"{L2[:2]}{L2[3:]}", L2.replace("800101", "800701"), L2.replace("301230", "307230")):
        text = f"{L1}\n{bad}"
        found, exhausted = scan.damaged(scan.text_lines(text))
        tried = {(a, b) for k, line in enumerate((L1, bad)) for x in scan.damaged_readings(line, TD3, k, len(line) < 44) for a in ((x,) if k == 0 else scan.readings(L1, TD3, 0)) for b in ((x,) if k == 1 else scan.readings(bad, TD3, 1))}
        rows = spark.createDataFrame(sorted(tried), "a string, b string")
        m = parse.parse([F.col("a"), F.col("b")], TD3)
        good = rows.select(m.alias("m")).filter(parse.all_valid(F.col("m.checks"))).select("m.document_number", "m.date_of_birth", "m.date_of_expiry", "m.surname", "m.given_names", "m.nationality").distinct().collect()
        real = [r for r in good if all(len(d) == 10 and 1 <= int(d[5:7]) <= 12 and 1 <= int(d[8:]) <= 31 for d in (r.date_of_birth, r.date_of_expiry))]
        assert (found is not None) == (len(real) == 1) and not exhausted
        if found:
            assert (found[1][1][:9].rstrip("<"), found[0].name) == (real[0].document_number, "Td3")


def test_the_budget_ends_the_damaged_search(spark):
    rows = spark.createDataFrame([(1, f"{L1}\nABI{L2[3:]}")], "doc_id int, text string")
    assert scan.scan(rows).first().exhausted is False and scan.scan(rows).first().repaired
    assert scan.scan(rows, budget=5).first().exhausted is True


def every_reading_tried(lines):
    """The damaged search by trying all readings of all shapes."""
    hits = []
    shapes = [(TD1, i, lost, k) for i in range(len(lines) - 2) for lost in (True, False) for k in range(3)]
    shapes += [(f, i, lost, k) for i in range(len(lines) - 1) for f in scan.DAMAGED_ORDER for lost in (True, False) for k in range(2)]
    for f, i, lost, k in shapes:
        choices = [scan.damaged_readings(x, f, n, lost) if n == k else scan.readings(x, f, n) for n, x in enumerate(lines[i : i + f.lines])]
        hits += [(f, x) for x in itertools.product(*choices) if x[0][0] in f.first and scan.score(x, f) == 5 and scan._real(f, x)]
    return hits[0] if hits and len({scan._identity(*h) for h in hits}) == 1 else None


def random_zone(rng, f):
    """A valid zone with letters that repairs look at, and sometimes a long number."""
    day = lambda: f"{rng.randrange(100):02d}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}"
    number, data = ("".join(rng.choice(x) for _ in range(n)) for x, n in (("0123456789ABKLO", rng.choice([7, 9])), ("0123ABKL<", rng.choice([0, 5, 7]))))
    names, number, sex = rng.choice(["SPECIMEN<<TEST", "KLARK<<LILL", "A<<B"]), number.ljust(9, "<"), rng.choice("MF<")
    if f is TD1:
        long = number.replace("<", "1") + "12"
        first = f"I<UTO{long[:9]}<{with_digit(long)[9:].ljust(15, '<')}" if rng.random() < 0.3 else f"I<UTO{with_digit(number)}{data.ljust(15, '<')}"
        body = f"{with_digit(day())}{sex}{with_digit(day())}UTO{'<' * 11}"
        return [first, body + with_digit(first[5:30] + body[:7] + body[8:15] + body[18:29])[-1], names.ljust(30, "<")]
    first = {"Td3": "P", "Td2": "I", "MrvA": "V", "MrvB": "V"}[f.name] + "<UTO" + names.ljust(f.width - 5, "<")
    body = f"{with_digit(number)}UTO{with_digit(day())}{sex}{with_digit(day())}"
    body += with_digit(data.ljust(14, "<")) if f is TD3 else data[: f.width - 29 if f.composite else f.width - 28].ljust(f.width - (29 if f.composite else 28), "<")
    return [first, body + with_digit(body[:10] + body[13:20] + body[21:43])[-1] if f.composite else body]


@pytest.mark.parametrize("seed", range(3))
def test_residues_leave_what_trying_all_readings_finds(seed):
    rng, found = random.Random(seed), 0
    for _ in range(60):
        f = rng.choice(list(FORMATS.values()))
        lines = random_zone(rng, f)
        assert scan.search("\n".join(lines))[2] is False
        k, at = rng.randrange(f.lines), rng.randrange(f.width)
        if rng.random() < 0.5:
            lines[k] = lines[k][:at] + lines[k][at + 1 :]
        else:
            places = [i for i, c in enumerate(lines[k]) if c in scan.ALTERNATIVES]
            at = rng.choice(places)
            lines[k] = lines[k][:at] + rng.choice(scan.ALTERNATIVES[lines[k][at]]) + lines[k][at + 1 :]
        got, exhausted = scan.damaged(lines)
        assert got == every_reading_tried(lines) and not exhausted
        found += got is not None
    assert found


def test_a_page_of_zone_lines_is_searched_to_its_end():
    lines = [f"{L1[:5]}{chr(65 + i)}{L1[6:]}" for i in range(26)] + [L2[:8] + L2[9:]]
    began = time.monotonic()
    assert scan.damaged(lines)[1] is False and time.monotonic() - began < 20


def test_line_repairs(spark):
    r = one(spark, ck.letterize(F.lit("0I2S")), ck.defiller(F.lit("AKKLKXKK<K")), ck.aggressive_defiller(F.lit("ABK<KL<<K")), ck.fix_doc_code(F.lit("PKUTO")), ck.fix_name_separator(F.lit("SMITHKKJOHN<<")), ck.longest_filler_run(F.lit("A<<B<<<C<")))
    assert list(r)[:5] == ["OIZS", "A<<<<X<<<<", "AB<<<<<<<", "P<UTO", "SMITH<<JOHN<<"]
    assert tuple(r[5]) == (4, 3)


def test_two_unknowns_keep_the_truth(spark):
    r = one(spark, solve.solve_field(F.lit("??123457<"), F.lit(L2[9]), solve.DOCUMENT_NUMBER, 9), solve.solve_field(F.lit("?01230"), F.lit(L2[27]), solve.OTHER), solve.solve_field(F.lit("?01230"), F.lit(L2[27]), solve.DATE), solve.solve_field(F.lit("3012?0"), F.lit("<")))
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<"
    digit = lambda s: sum(alphabet.index(c) % 36 * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10
    want = sorted(a + b + "123457<" for a in alphabet for b in alphabet if str(digit(a + b + "123457<")) == L2[9] and "<" not in a + b)
    assert r[0].candidates == want and "AB123457<" in want
    assert (r[1].kind, len(r[1].candidates), r[2].kind, r[2].candidates) == ("Ambiguous", 4, "Unique", ["301230"])
    assert r[3].candidates == sorted(f"3012{c}0" for c in alphabet if digit(f"3012{c}0") == 0)


def test_width_candidates(spark):
    r = one(spark, solve.width_candidates(F.lit(L2[:8] + L2[9:]), 44), solve.width_candidates(F.lit(L2), 44))
    assert L2[:8] + "?" + L2[9:] in r[0] and r[1] == [L2]


def test_predicates(spark):
    v = dates.validity(F.lit("1990-01-01"), F.lit("2030-01-01"), "2024-01-01")
    r = one(spark, ck.is_blind(ck.blindspot(F.lit("A"), F.lit("K"))), dates.all_ok(v), solve.unique(solve.solve_field(F.lit("?01230"), F.lit(L2[27]), solve.DATE)), ck.blind_positions(F.lit("AB<\n1")), dates.from_epoch_days(F.lit(20000)), fuse.is_flagged(F.lit(None).cast(fuse.FINDINGS)))
    assert list(r) == [True, True, "301230", 4, "2024-10-04", False]


def test_text_kernels(spark):
    r = one(spark, text.drop_non_latin_noise(F.lit("ok line\n漢字漢字a\nmore")), text.page_sanity(F.lit(" \n")), text.keyword_hits(F.lit("a Passport here"), {"p": ("PASSPORT",), "v": ("VISA",)}), text.noise_fraction(F.array(F.lit("??!!"), F.lit("words here"))))
    assert list(r) == ["ok line\nmore", None, ["p"], 0.5]


def test_prose_in_a_zone_s_shape_is_not_found(spark, tmp_path):
    """Lines as long as a zone's, without its check digits, are prose to scan_documents; a valid zone is still found."""
    zone = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    prose = "people of the town went down to the old harbour today\nand they saw that the ships had all left by the night"
    merged = " ".join(["plain"] * 17)
    rows = [(1, prose), (2, merged), (3, zone), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["zone_format"], r["valid"], r["error"]) for r in catalog.scan_documents(spark, str(tmp_path)).collect()}
    assert got == {k: (None, False, "NotFound") for k in (1, 2, 4, 5)} | {3: ("Td3", True, None)}
    assert [scan.search(t) is not None for t in (prose, merged)] == [True, True]


def test_a_page_s_lines_are_scored_once(spark):
    """The band's score, start, length and box read one computation of the lines' scores; each used to repeat it, and that of the page's lines."""
    df = spark.createDataFrame([([(L2, (5.0, 20.0, 440.0, 16.0))] * 2,)], "lines array<struct<text: string, bbox: struct<x: double, y: double, w: double, h: double>>>")
    df = df.select(ocr_lines.band(F.filter("lines", lambda x: x["text"] != "no line")).alias("b"))
    assert (df.first().b.start, df.first().b.len) == (0, 2)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("no line"), plan.count("regexp_replace")) == (1, 2)


@pytest.mark.parametrize("name, part", [("mean_cer_by_field", "% 11"), ("lifted_records", "from_json(")])
def test_inputs_are_computed_once(spark, name, part):
    """A query's zone, record or text stands in its plan once, not again for each expression that reads it."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(part) == 1


def test_readings_that_cannot_count_are_not_made(monkeypatch):
    """Lines that begin no zone of a format aren't repaired for it, and a damaged line's readings are made only beside lines that have some; both used to be most of the search."""
    made, fitted = [], []
    real, fits = scan.Damaged, scan.fits
    monkeypatch.setattr(scan, "Damaged", lambda n, f, line, lost, repair: made.append((f.name, line)) or real(n, f, line, lost, repair))
    monkeypatch.setattr(scan, "fits", lambda n, width: fitted.append(width) or fits(n, width))
    for c in (scan._damaged, scan._undamaged, scan.readings):
        c.cache_clear()
    l1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
    assert scan.search(f"{l1}\n{L2[:15]}{L2[16:]}")[0].name == "Td3"
    assert made and {x[0] for x in made} == {"Td3"} and set(fitted) == {44}
