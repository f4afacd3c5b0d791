"""Noise and what it does: the confusion matrix of misread zones, misreadings that no check digit sees, and names under all their spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import misreads, spellings
from ..schemas import ALPHABET, TD3
from .catalog import _kept, query
from .derived import HOLDERS, cd, holders, spread, table, zone_of, zone_sql

#: Digits as readers confuse them, and as letters of the same residue, which no check digit tells from them.
CONFUSED, BLIND = ("0123456789", "OIZEASGTBG"), ("0123456789", "UVWXYZQRST")


def _at(line, p, how):
    """A line with the character at a place changed."""
    return F.concat(F.substr(line, F.lit(1), p), how(F.substr(line, p + 1, F.lit(1))), F.substr(line, p + 2))


def _misread(spark, sf_dir):
    """Passports as text and as a reader gives it: lines merged, a digit confused, a character lost or added, two digits exchanged for others of their residue, or all right."""
    z = holders(spark, sf_dir).select("doc_id", _kept(zone_of(TD3)).alias("z"))
    k, p = F.col("doc_id") % 6, (F.col("doc_id") * 7 % 44).cast("int")
    q = (F.col("doc_id") % 5).cast("int")
    l2 = F.col("z")[1]
    blind = lambda c: F.translate(c, *BLIND)
    added = F.concat(F.substr(l2, F.lit(1), p), F.substr(F.lit(ALPHABET), (F.col("doc_id") % 37).cast("int") + 1, F.lit(1)), F.substr(l2, p + 1))
    got = (
        F.when(k == 1, _at(l2, p, lambda c: F.translate(c, *CONFUSED))).when(k == 2, _at(l2, p, lambda c: F.lit(""))).when(k == 3, added)
        .when(k == 4, _at(_at(l2, q, blind), q + 4, blind)).otherwise(l2)
    )
    return z.select("doc_id", F.array_join("z", "\n").alias("expected"), F.concat(F.col("z")[0], F.when(k == 0, "").otherwise("\n"), got).alias("got"))


_RESIDUE = lambda c: f"(CASE {c} WHEN '<' THEN 0 ELSE (instr('{ALPHABET}', {c}) - 1) % 10 END)"


@query(
    f"""WITH {HOLDERS}, {zone_sql(TD3)}, d AS (SELECT doc_id, l2, doc_id % 6 AS k, (doc_id * 7 % 44)::INTEGER AS p, (doc_id % 5)::INTEGER AS q FROM z),
x AS (SELECT chr(10) AS expected, NULL AS got FROM d WHERE k = 0
  UNION ALL SELECT substr(l2, p + 1, 1), translate(substr(l2, p + 1, 1), '{CONFUSED[0]}', '{CONFUSED[1]}') FROM d WHERE k = 1
  UNION ALL SELECT substr(l2, p + 1, 1), NULL FROM d WHERE k = 2
  UNION ALL SELECT NULL, substr('{ALPHABET}', (doc_id % 37)::INTEGER + 1, 1) FROM d WHERE k = 3
  UNION ALL SELECT substr(l2, q + i + 1, 1), translate(substr(l2, q + i + 1, 1), '{BLIND[0]}', '{BLIND[1]}') FROM d, (VALUES (0), (4)) v(i) WHERE k = 4),
n AS (SELECT expected, got, count(*) AS n FROM x WHERE expected IS DISTINCT FROM got GROUP BY ALL),
m AS (SELECT *, CASE WHEN got IS NULL THEN 'lost' WHEN expected IS NULL THEN 'added' WHEN {_RESIDUE('expected')} = {_RESIDUE('got')} THEN 'blind' ELSE 'caught' END AS kind FROM n)
SELECT *, (SELECT sum(n) FILTER (kind = 'blind') / sum(n) FILTER (kind IN ('blind', 'caught')) FROM m) AS blind_share FROM m"""
)
def misread_confusions(spark, sf_dir):
    """The confusion matrix of misread passports, counted from edit scripts that are found from the two texts alone."""
    return misreads.confusions(misreads.scripts(_misread(spark, sf_dir), "doc_id", F.col("expected"), F.col("got")))


@query(
    f"""WITH {HOLDERS}, d AS (SELECT num, (doc_id % 9)::INTEGER AS p, (doc_id % 4)::INTEGER AS k FROM h),
g AS (SELECT num, CASE k WHEN 0 THEN substr(num, 1, p) || translate(substr(num, p + 1, 1), '{CONFUSED[0]}', '{CONFUSED[1]}') || substr(num, p + 2)
  WHEN 1 THEN translate(num, '{BLIND[0]}', '{BLIND[1]}') WHEN 2 THEN substr(num, 2, 1) || substr(num, 1, 1) || substr(num, 4, 1) || substr(num, 3, 1) || reverse(substr(num, 5, 5)) ELSE num END AS got FROM d)
SELECT list_sum(list_transform(range(1, 10), lambda i: (substr(num, i, 1) <> substr(got, i, 1))::INTEGER))::INTEGER AS differing, count(*) AS n, count(*) FILTER ({cd('num')} = {cd('got')}) AS unseen
FROM g WHERE num <> got GROUP BY 1"""
)
def unseen_misreads(spark, sf_dir):
    """Misread document numbers by how many characters differ, and those with the check digit of the truth."""
    n, p, k = F.col("num"), (F.col("doc_id") % 9).cast("int"), F.col("doc_id") % 4
    turned = F.concat(*(F.substring(n, i, 1) for i in (2, 1, 4, 3)), F.reverse(F.substring(n, 5, 5)))
    got = F.when(k == 0, _at(n, p, lambda c: F.translate(c, *CONFUSED))).when(k == 1, F.translate(n, *BLIND)).when(k == 2, turned).otherwise(n)
    return misreads.unseen(holders(spark, sf_dir).select(n, got.alias("got")), n, F.col("got"))


_STYLES = (("Ä", ("AE", "A", "AE")), ("Ö", ("OE", "O", "OE")), ("Ü", ("UE", "U", "UXX")), ("Ñ", ("N", "N", "NXX")))
_LETTERS = ("0123456789", "AÄOÖUÜNÑKL")
_styled = lambda k: "name" if k == -1 else f"replace({_styled(k - 1)}, '{_STYLES[k][0]}', {list(_STYLES[k][1])!r}[(c_custkey % 3 + 1)::INTEGER])"


@query(
    f"""WITH RECURSIVE c AS (SELECT c_custkey, translate(c_mktsegment, 'U', 'Ü') || ' ' || translate(c_custkey::VARCHAR, '{_LETTERS[0]}', '{_LETTERS[1]}') AS name FROM customer),
f AS (SELECT c_custkey, replace({_styled(3)}, ' ', '<') AS whole FROM c),
z AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN whole[1:(9 + c_custkey % 7)::INTEGER] ELSE whole END AS zone_name, c_custkey % 4 = 0 AS cut FROM f),
v(c, s) AS (VALUES ('Ä', 'AE'), ('Ä', 'A'), ('Ö', 'OE'), ('Ö', 'O'), ('Ü', 'UE'), ('Ü', 'UXX'), ('Ü', 'U'), ('Ñ', 'N'), ('Ñ', 'NXX')),
p AS (SELECT name, replace(name, ' ', '<') AS form, count(*) AS n_people FROM c GROUP BY 1),
s(name, form) AS (SELECT name, form FROM p UNION ALL SELECT name, regexp_replace(form, '[ÄÖÜÑ]', v.s) FROM s JOIN v ON v.c = regexp_extract(form, '[ÄÖÜÑ]')),
t AS (SELECT DISTINCT name, form FROM s WHERE NOT regexp_matches(form, '[ÄÖÜÑ]')),
q AS (SELECT zone_name, cut, count(*) AS n_zones FROM z GROUP BY ALL),
m AS (SELECT name, zone_name, cut FROM t JOIN q ON NOT cut AND zone_name = form UNION SELECT name, zone_name, cut FROM t JOIN q ON cut AND starts_with(form, zone_name))
SELECT name, zone_name, cut, n_people, n_zones FROM m JOIN p USING (name) JOIN q USING (zone_name, cut)"""
)
def spelling_matches(spark, sf_dir):
    """Customers' names with diacritics, joined with zone names that spell them in one style each, a quarter of them cut."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    k = F.col("c_custkey")
    c = c.select(k, F.concat(F.translate("c_mktsegment", "U", "Ü"), F.lit(" "), F.translate(k.cast("string"), *_LETTERS)).alias("name"))
    whole = F.element_at(F.array(*(names.encode_name_component(names.transliterate(F.col("name"), s)) for s in (names.EXPANDED, names.SIMPLE, names.XX_SUFFIX))), (k % 3 + 1).cast("int"))
    cut = k % 4 == 0
    z = c.select(F.when(cut, F.substr(whole, F.lit(1), (9 + k % 7).cast("int"))).otherwise(whole).alias("zone_name"), cut.alias("cut"))
    return spellings.matched(c, z)
