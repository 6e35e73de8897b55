"""Merkle manifest of a dataset: a 16-ary hash tree per source and one over the sources, with each document's proof.

A level is a table of nodes by (tree, position). Windows over the level give each node its run's other digests by fixed-offset lag and lead
columns, masked by its slot and the length of its run; the rows of first children hash their parents. A node's path is its own step (the
run's digests with a mark for itself) and its parent's path, handed down from the roots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.ranks import BROADCAST_GROUPS, running_totals

from .common import LOWER, UPPER, cut, table

#: Children of a node.
ARITY = 16
#: In a path: the node itself, and the end of a step. Digests are hexadecimal.
OWN, END = "*", "|"
#: Documents are tampered with whose crc32 of the id this divides.
TAMPERED = 5


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(text: Column) -> Column:
    """Digest of a row's fields in order: '-' for null, else bytes, ':' and the value."""
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text]
    return sha(F.concat(*[F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in fields]))


def _steps(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, node, n, ...; n: nodes of the tree at this level) with up (the parent's position), step and, for first children,
    parent. A run is a window partition, so that a tree of any size is many tasks."""
    over = "OVER (PARTITION BY tree, up ORDER BY pos)"
    left = {f"left{k}": f"CASE WHEN slot >= {k} THEN lag(node, {k}) {over} END" for k in range(ARITY - 1, 0, -1)}
    right = {f"right{k}": f"CASE WHEN slot + {k} < length THEN lead(node, {k}) {over} END" for k in range(1, ARITY)}
    placed = nodes.selectExpr("*", f"pos % {ARITY} AS slot", f"floor(pos / {ARITY}) AS up").selectExpr("*", f"least({ARITY}, n - (pos - slot)) AS length")
    near = placed.selectExpr("*", *[f"{x} AS {name}" for name, x in (left | right).items()])
    before, after = ("concat(" + ", ".join(f"coalesce({name}, '')" for name in side) + ")" for side in (left, right))
    return near.selectExpr(*nodes.columns, "up", f"concat({before}, '{OWN}', {after}, '{END}') AS step", f"CASE WHEN slot = 0 THEN sha2(concat(node, {after}), 256) END AS parent")


def climb(leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the trees over leaves (tree, pos, node, n, ...), from the lowest on: nodes with their steps, of trees with several nodes
    there; and the roots (tree, node, height). most: leaves of the largest tree, so that the number of levels is known."""
    levels, roots, nodes = [], [], leaves
    while True:
        roots.append(nodes.filter("n = 1").select("tree", "node", F.lit(len(levels)).alias("height")))
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, roots)
        level = _steps(nodes.filter("n > 1"))
        # steps of leaves are long and read twice: they are made anew rather than written
        levels.append(cut(level, "level") if levels else level)
        parents = levels[-1].filter("parent is not null").select("tree", F.col("up").alias("pos"), F.col("parent").alias("node"), F.ceil(F.col("n") / ARITY).alias("n"))
        nodes = cut(parents, "nodes") if len(levels) == 1 else parents
        most = -(-most // ARITY)


def paths(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, *carried: str) -> DataFrame:
    """leaves with path and the carried columns of their tree's root. roots (tree, height, path, carried): what stands above each root."""
    above = None
    for k in reversed(range(len(levels))):
        # the parents of this level's nodes: nodes of the level above, and the roots of trees that end there
        own = roots.filter(F.col("height") == k + 1).select("tree", F.lit(0).cast("long").alias("up"), F.col("path").alias("up_path"), *carried)
        above = own if above is None else above.select("tree", F.col("pos").alias("up"), F.col("path").alias("up_path"), *carried).unionByName(own)
        above = levels[k].join(above.hint("merge"), ["tree", "up"]).withColumn("path", F.concat("step", "up_path"))
    lone = leaves.filter("n = 1").join(roots.filter("height = 0").select("tree", "path", *carried).hint("merge"), "tree")
    columns = [*leaves.columns, "path", *carried]
    return lone.select(*columns) if above is None else above.select(*columns).unionByName(lone.select(*columns))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    steps = F.filter(F.split(path, r"\|"), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda node, s: sha(F.replace(s, F.lit(OWN), node)))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs (doc_id, text, lang, source, n_chars).

    Leaves of a source ascend by doc_id, null first, rows of one doc_id by their digest; rows equal in all five columns are leaves each, side
    by side, and differ in their proofs only. A null source is a source of its own, the first; the leaf of a source with one row is its
    subroot, and a single source's subroot the root. Empty and long texts are texts as any; a null text is not an empty one, and stays null
    when tampered with. A null doc_id is not tampered with. An empty table gives an empty result; other columns are not read.

    Texts are read once, for digests. Positions come from ranges of (source, doc_id), so that a hot source is many tasks."""
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))  # null sorts first
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    rows = docs.select(
        "doc_id", tree.alias("tree"), leaf_digest(F.col("text")).alias("node"),
        F.when(tampered, leaf_digest(F.translate("text", UPPER, LOWER))).alias("changed"), F.monotonically_increasing_id().alias("row"))
    placed = cut(running_totals(cut(rows, "leaves"), ["tree"], ["doc_id", "node", "row"], "pos").drop("row"), "placed")
    sizes = cut(placed.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    most, sources = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    leaves = placed.join(F.broadcast(sizes) if sources <= BROADCAST_GROUPS else sizes.hint("merge"), "tree")
    levels, roots = climb(leaves, most)
    roots = cut(roots, "roots")
    # the tree over the sources
    subroots = running_totals(roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "node", F.col("height").alias("ends")), ["tree"], ["own"], "pos").withColumn("n", F.lit(sources).cast("long"))
    upper, top = climb(subroots, sources)
    top = top.select("tree", "height", F.lit("").alias("path"), F.col("node").alias("root"))
    over = paths(subroots, upper, top, "root").select(F.col("own").alias("tree"), "ends", "path", F.col("node").alias("subroot"), "root")
    over = cut(over.withColumnRenamed("ends", "height"), "over")
    found = paths(leaves, levels, over, "subroot", "root")
    found = found.withColumn("folded_root", fold(F.coalesce("changed", "node"), F.col("path")))
    return found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", sha(F.translate("path", OWN + END, "")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# --- the same in SQL; crc32 by the table of its 256 bytes ------------------------------------------------------------

_CRC = """bits_(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits_ WHERE k < 8),
crc_ AS (SELECT list(c ORDER BY i) AS t FROM bits_ WHERE k = 8)"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, count: int) -> str:
    """name0 (tree, pos, node, n): the next levels; of trees that have ended, the root goes on up with an empty step."""
    out = []
    for k in range(count):
        here = f"{name}{k}"
        out.append(f"""{here}g AS (SELECT tree, pos // {ARITY} AS up, list(node ORDER BY pos) AS run, any_value(n) AS n FROM {here} GROUP BY ALL),
{name}{k + 1} AS (SELECT tree, up AS pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS node, (n + {ARITY - 1}) // {ARITY} AS n FROM {here}g),
{here}s AS (SELECT x.tree, x.pos, CASE WHEN x.n = 1 THEN '' ELSE array_to_string(run[:x.pos % {ARITY}], '') END AS l, CASE WHEN x.n = 1 THEN '' ELSE array_to_string(run[x.pos % {ARITY} + 2:], '') END AS r, x.n > 1 AS inner_ FROM {here} x JOIN {here}g g ON g.tree = x.tree AND g.up = x.pos // {ARITY})""")
    return ",\n".join(out)


def _walk(count: int, upper: int) -> tuple[str, str, str]:
    """Joins of a leaf's steps at all levels, its siblings in order, and the root that x gives."""
    joins = [f"JOIN a{k}s AS p{k} ON p{k}.tree = d.tree AND p{k}.pos = d.pos // {ARITY ** k}" for k in range(count)] + [f"JOIN b{k}s AS q{k} ON q{k}.pos = o.pos // {ARITY ** k}" for k in range(upper)]
    steps = [f"p{k}" for k in range(count)] + [f"q{k}" for k in range(upper)]
    x = "coalesce(changed, d.node)"
    for s in steps:
        x = f"CASE WHEN {s}.inner_ THEN sha256({s}.l || {x} || {s}.r) ELSE {x} END"
    return " ".join(joins), " || ".join(f"{s}.l || {s}.r" for s in steps), x


def _sql(count: int, upper: int) -> str:
    joins, proof, folded = _walk(count, upper)
    return f"""WITH RECURSIVE {_CRC},
rows_ AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS node, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {TAMPERED} = 0
  THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents, crc_),
docs_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
a0 AS (SELECT tree, pos, node, n FROM docs_),
{_levels('a', count)},
over_ AS MATERIALIZED (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{count}),
b0 AS (SELECT '' AS tree, pos, node, n FROM over_),
{_levels('b', upper)}
SELECT doc_id, leaf, subroot, b{upper}.node AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = b{upper}.node AS verified
FROM (SELECT d.doc_id, d.node AS leaf, o.node AS subroot, {proof} AS proof, {folded} AS folded_root FROM docs_ d JOIN over_ o ON o.tree = d.tree {joins}), b{upper}"""


#: Levels enough for 16^5 documents a source and 16^3 sources.
OP12_SQL = _sql(5, 3)


def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest(table(spark, sf_dir, "documents"))
