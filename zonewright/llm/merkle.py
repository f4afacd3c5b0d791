r"""A Merkle manifest of a dataset: leaf digests by row, a tree by group, one root, and a proof for each row.

1. Leaves are ranked within their group (language) by a range sort and the counts of its partitions, so a group with most rows is spread over many tasks.
2. Levels are built HOP at a time: a run of 2^HOP neighbours makes its part of the tree in one expression, and its top is a node of the next hop. A node's row
   is linked to its parent's and holds its siblings on the way there. The groups' roots are the leaves of one more tree of the same make.
3. The climb is a recursive query over these rows: it starts at each leaf and joins its parent's row, appends the siblings and folds the digest (of the row as
   tampered with) until there is no parent. So that no key of that join gets many leaves, a row above n leaves is written in n / 2^HOP copies, and
   each run of leaves climbs by copies of its own. A hop's copies are a row for 2^HOP leaves, so the copies together are far fewer than the leaves.

The state of a climb is one row a leaf and grows by 32 bytes a level. What is collected is the root and the depth of the deepest group. The session's bound on rows of a recursive query
(a guard against endless ones) is lifted while this one runs and set back then; links go up only, so it ends after as many steps as there are hops.

Defined results: nulls are `-` in a leaf; a null id comes first in its group and is never tampered with; rows equal in all columns are leaves each, in any order among themselves; rows equal in
id are ordered by their leaves; a row without siblings has the digest of nothing as its proof; a null count stays null under tampering; a text of any length is
digested whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove, stored
from .mixing import ranked

#: The columns of a leaf, in order, and the one that tampering changes; levels of a hop.
COLUMNS, TAMPERED, HOP = ("doc_id", "source", "lang", "n_chars", "text"), "n_chars", 10


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def netstring(c: Column) -> Column:
    """`-` for null, else UTF-8 bytes, `:`, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def is_tampered(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def depth(n: Column) -> Column:
    """Levels above n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _pairs(level: Column) -> Column:
    """The level above."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1)), lambda j: digest(F.get(level, 2 * j), F.coalesce(F.get(level, 2 * j + 1), F.lit(""))))


def _runs(nodes: DataFrame, hop: int, fan: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (tree, i, h, m leaves below, depth) to runs (tree, up, depth, m, x: nodes in order, levels: from theirs to the one below the top, top)."""
    member = F.struct("i", "h", "m", *extra)
    runs = nodes.filter(F.col("depth") > hop * fan).groupBy("tree", F.shiftright("i", fan).alias("up"), "depth").agg(F.sort_array(F.collect_list(member)).alias("x"), F.sum("m").alias("m"))
    first = F.array(F.transform("x", lambda y: y["h"]))
    steps = F.least(F.lit(fan), F.col("depth") - hop * fan)
    levels = F.aggregate(F.sequence(F.lit(1), steps), first, lambda acc, _: F.concat(acc, F.array(_pairs(F.element_at(acc, -1)))))
    return runs.withColumn("all", levels).select("tree", "up", "depth", "m", "x", F.slice("all", F.lit(1), F.size("all") - 1).alias("levels"), F.element_at("all", -1)[0].alias("top"))


def _path(levels: Column, at: Column) -> Column:
    """The siblings on the way from the node at a place of its run to the run's top, null where there is none."""
    place = lambda k: F.call_function("shiftright", at, k)
    return F.transform(levels, lambda level, k: F.struct(F.get(level, place(k).bitwiseXOR(F.lit(1))).alias("s"), (place(k).bitwiseAND(F.lit(1)) == 1).alias("left")))


def _copies(m: Column, fan: int) -> Column:
    return F.ceil(m / (1 << fan)).cast("long")


def _rows(runs: DataFrame, hop: int, fan: int, last: tuple[Column, Column, Column], columns: list[Column]) -> DataFrame:
    """A row for each node of the runs: its siblings and its parent, which is last where the tree ends."""
    one = runs.select("tree", "up", "depth", "m", "levels", F.posexplode("x").alias("at", "y"))
    over = F.col("depth") > (hop + 1) * fan
    up = [F.when(over, own).otherwise(end) for own, end in zip((F.col("tree"), F.lit(hop + 1), F.col("up")), last)]
    return one.select("tree", "y.i", *columns, _path(F.col("levels"), F.col("at")).alias("path"), up[0].cast("long").alias("p_tree"), up[1].cast("int").alias("p_hop"), up[2].cast("long").alias("p_i"), _copies(F.col("m"), fan).alias("p_copies"))


def _placed(rows: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves with their tree and place, and the trees (tree, n). Trees are numbered by group, null first."""
    by = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "merkle-leaves", paths)
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = stored(placed.groupBy("_part", "grp").agg(F.count("*").alias("n"), F.min("_at").alias("first")), "merkle-counts", paths)
    groups = counts.groupBy("grp").agg(F.sum("n").alias("size"))
    trees = stored(ranked(groups, [F.col("grp").asc_nulls_first()], "merkle-groups", paths).select(F.col("grp").alias("_grp"), "size", F.col("_rank").alias("tree")), "merkle-trees", paths)
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(trees, F.col("grp").eqNullSafe(F.col("_grp")))
    counts = counts.select(F.col("_part").alias("_p"), "_grp", "tree", "size", (F.col("before") - F.col("first")).alias("shift"))
    out = placed.join(counts, (F.col("_part") == F.col("_p")) & F.col("grp").eqNullSafe(F.col("_grp")))
    return out.select("tree", (F.col("_at") + F.col("shift")).alias("i"), F.col("leaf").alias("h"), F.lit(1).cast("long").alias("m"), depth(F.col("size")).alias("depth"), "id", "start"), trees


_NODE = "tree long, i long, sub string, hop int, m long, path array<struct<s: string, left: boolean>>, p_tree long, p_hop int, p_i long, p_copies long"

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT * FROM {leaves}
  UNION ALL
  SELECT c.id, c.leaf, c.lane, n.sub AS sub, concat(c.proof, unhex(array_join(transform(n.path, x -> x.s), ''))) AS proof,
    unhex(aggregate(n.path, lower(hex(c.cur)), (h, x) -> CASE WHEN x.s IS NULL THEN sha2(h, 256) WHEN x.left THEN sha2(concat(x.s, h), 256) ELSE sha2(concat(h, x.s), 256) END)) AS cur,
    n.p_tree, n.p_hop, n.p_i, n.p_copies, coalesce(c.subroot, n.sub) AS subroot
  FROM climb c JOIN {nodes} n ON n.tree = c.p_tree AND n.hop = c.p_hop AND n.i = c.p_i AND n.copy = pmod(c.lane, c.p_copies))
SELECT id, leaf, subroot, proof, cur FROM climb WHERE p_tree IS NULL
"""


def _climbed(leaves: DataFrame, nodes: DataFrame, paths: list[str]) -> DataFrame:
    """The recursive query, written out."""
    spark, key, tag = leaves.sparkSession, "spark.sql.cteRecursionRowLimit", uuid.uuid4().hex[:12]
    names = {"leaves": f"merkle_leaves_{tag}", "nodes": f"merkle_nodes_{tag}"}
    leaves.createOrReplaceTempView(names["leaves"])
    nodes.createOrReplaceTempView(names["nodes"])
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return stored(spark.sql(CLIMB.format(**names)), "merkle-climb", paths)
    finally:
        spark.conf.set(key, old)
        for name in names.values():
            spark.catalog.dropTempView(name)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, ident: str = "doc_id", group: str = "lang", tampered: str = TAMPERED, fan: int = HOP) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256 (of what is stored), folded_root (of the row as tampered with and the stored siblings), verified."""
    spark = docs.sparkSession
    paths: list[str] = []
    value = {c: F.col(f"`{c}`") for c in columns}
    other = value | {tampered: value[tampered].cast("decimal(20,0)") + 1}
    leaf = lambda v: digest(*(netstring(v[c]) for c in columns))
    rows = docs.select(value[ident].alias("id"), F.col(f"`{group}`").alias("grp"), leaf(value).alias("leaf"), F.when(is_tampered(value[ident]), leaf(other)).alias("start"))
    leaves, trees = _placed(rows, paths)
    deepest = trees.agg(F.max(depth(F.col("size"))).alias("d"), F.count("*").alias("n")).first()
    if deepest["d"] is None:
        remove(spark, *paths)
        kind = docs.schema[ident].dataType.simpleString()
        return spark.createDataFrame([], f"`{ident}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    # the groups' trees
    end = (F.lit(-1), F.lit(0), F.col("tree"))
    nodes, upper, roots, hop, climbs = leaves, [], [], 0, None
    while hop == 0 or hop * fan < deepest["d"]:
        runs = stored(_runs(nodes, hop, fan, ("id", "start") if hop == 0 else ()), "merkle-runs", paths)
        if hop == 0:
            alone = nodes.filter("depth = 0")
            climbs = _rows(runs, 0, fan, end, [F.col("y.id").alias("id"), F.col("y.h").alias("leaf"), F.col("y.start").alias("start")])
            alone_rows = alone.select("tree", "i", "id", F.col("h").alias("leaf"), "start", F.array().cast("array<struct<s: string, left: boolean>>").alias("path"), F.lit(-1).cast("long").alias("p_tree"), F.lit(0).alias("p_hop"), F.col("tree").alias("p_i"), F.lit(1).cast("long").alias("p_copies"))
            climbs = climbs.unionByName(alone_rows)
            roots.append(alone.select("tree", F.col("h").alias("top"), "m"))
        else:
            upper.append(_rows(runs, hop, fan, end, [F.lit(None).cast("string").alias("sub"), F.lit(hop).alias("hop"), F.col("y.m").alias("m")]))
        roots.append(runs.filter(F.col("depth") <= (hop + 1) * fan).select("tree", "top", "m"))
        nodes = runs.select("tree", F.col("up").alias("i"), F.col("top").alias("h"), "m", "depth")
        hop += 1

    # the tree of the groups
    tops = roots[0]
    for r in roots[1:]:
        tops = tops.unionByName(r)
    deep = depth(F.lit(deepest["n"]))
    nodes = stored(tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("i"), F.col("top").alias("h"), "m", deep.alias("depth")), "merkle-roots", paths)
    none, top, hop = (F.lit(None), F.lit(None), F.lit(None)), None, 0
    if deepest["n"] == 1:
        top = nodes.first()["h"]
        upper.append(nodes.select("tree", "i", F.col("h").alias("sub"), F.lit(0).alias("hop"), "m", F.array().cast("array<struct<s: string, left: boolean>>").alias("path"), *(F.lit(None).cast(t).alias(c) for c, t in (("p_tree", "long"), ("p_hop", "int"), ("p_i", "long"), ("p_copies", "long")))))
    while top is None:
        runs = stored(_runs(nodes, hop, fan), "merkle-runs", paths)
        upper.append(_rows(runs, hop, fan, none, [(F.col("y.h") if hop == 0 else F.lit(None).cast("string")).alias("sub"), F.lit(hop).alias("hop"), F.col("y.m").alias("m")]))
        nodes = runs.select("tree", F.col("up").alias("i"), F.col("top").alias("h"), "m", "depth")
        hop += 1
        if hop * fan >= (deepest["n"] - 1).bit_length():
            top = nodes.first()["h"]

    links = upper[0]
    for u in upper[1:]:
        links = links.unionByName(u)
    links = links.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("m"), fan) - 1)))
    links = stored(links.repartition("tree", "hop", "i", "copy"), "merkle-nodes", paths)
    fold = F.aggregate("path", F.coalesce("start", "leaf"), lambda h, x: F.when(x["s"].isNull(), digest(h)).when(x["left"], digest(x["s"], h)).otherwise(digest(h, x["s"])))
    begin = climbs.select(
        "id", F.unhex("leaf").alias("leaf"), F.xxhash64("tree", F.shiftright("i", fan)).alias("lane"), F.lit(None).cast("string").alias("sub"),
        F.unhex(F.array_join(F.transform("path", lambda x: x["s"]), "")).alias("proof"), F.unhex(fold).alias("cur"), "p_tree", "p_hop", "p_i", "p_copies", F.lit(None).cast("string").alias("subroot"),
    )
    kept: list[str] = []
    out = _climbed(begin, links, kept)
    remove(spark, *paths)
    text = lambda c: F.lower(F.hex(c))
    folded = text(F.col("cur"))
    return out.select(F.col("id").alias(ident), text(F.col("leaf")).alias("leaf"), "subroot", F.lit(top).alias("root"), F.sha2(text(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.lit(top)).alias("verified"))


#: The same in DuckDB SQL, level by level; CRC-32 bit by bit, as a fold over each byte and its eight shifts.
SQL = r"""
WITH RECURSIVE v AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS b,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_prepend(ord(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) % 7 = 0 AS bad
  FROM documents),
d AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
    CASE WHEN bad THEN sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || b) END AS other FROM v),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
t(g, level, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM r
  UNION ALL
  SELECT g, any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, i // 2),
s AS (SELECT g, h FROM t WHERE n = 1),
u(level, i, n, h) AS (
  SELECT 0, g, (SELECT count(*) FROM s), h FROM s
  UNION ALL
  SELECT any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 2),
nodes AS (SELECT g, level, i, n, h FROM t WHERE n > 1 UNION ALL SELECT -1, level, i, n, h FROM u WHERE n > 1),
tops AS (SELECT g, max(level) + 1 AS levels FROM nodes GROUP BY g),
climb(g, pos, tree, level, i, proof, cur) AS (
  SELECT r.g, r.i, CASE WHEN n > 1 THEN r.g ELSE -1 END, 0, CASE WHEN n > 1 THEN r.i ELSE r.g END, '', coalesce(other, leaf) FROM r
  UNION ALL
  SELECT c.g, c.pos, CASE WHEN c.tree >= 0 AND c.level + 1 = p.levels THEN -1 ELSE c.tree END, CASE WHEN c.tree >= 0 AND c.level + 1 = p.levels THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.tree >= 0 AND c.level + 1 = p.levels THEN c.g ELSE c.i // 2 END, c.proof || coalesce(b.h, ''),
    sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(b.h, '') || c.cur ELSE c.cur || coalesce(b.h, '') END)
  FROM climb c JOIN tops p ON p.g = c.tree LEFT JOIN nodes b ON b.g = c.tree AND b.level = c.level AND b.i = xor(c.i, 1)
  WHERE c.level < p.levels),
last AS (SELECT c.g, pos, proof, cur FROM climb c LEFT JOIN tops p ON p.g = -1 WHERE tree = -1 AND level = coalesce(p.levels, 0))
SELECT r.doc_id, r.leaf, s.h AS subroot, x.h AS root, sha256(l.proof) AS proof_sha256, l.cur AS folded_root, l.cur = x.h AS verified
FROM r JOIN s ON s.g = r.g JOIN last l ON l.g = r.g AND l.pos = r.i CROSS JOIN (SELECT h FROM u WHERE n = 1) x
"""
