"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources.

Rows get their rank within the source from a range partitioning and prefix counts, so that no source is ranked by one
task. The rank's digits become columns. Within a block of at most `FANOUT ** LEVELS` consecutive leaves the digit columns
are grouped away from the last one on: each step nests the structs of up to `FANOUT` nodes in that of their parent, and
all steps share one shuffle by block. A block's hash is a leaf of the next tier, which is made in the same way, until one
node is left. Down again, every tier's blocks are put beside what the tier above has found for them by one more grouping,
and one transform over the nested structs and one explode give each node the siblings on its way to the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfmart.llm.common import table, written

FANOUT, LEVELS = 3, 6
ROWS_A_RANGE, RANGES, LEAST_ROWS_A_RANGE = 1_000_000, 64, 4_096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TREE = "tree"  # the tree a node is of


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def measured(value: Column) -> Column:
    """A field as hashed: its bytes behind their count, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """`doc_id, source, leaf, tampered_leaf` of every row. Tampering deletes line feeds from the texts whose id has an
    even check sum; a null id or text is left as it is."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    without = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    as_hashed = lambda text: [measured(text if f == "text" else F.col(f)) for f in fields]
    return docs.select(
        "doc_id", "source", digest(*as_hashed(F.col("text"))).alias("leaf"), digest(*as_hashed(without)).alias("tampered_leaf")
    )


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `pos`, the rank from 0 within `tree` by `order`, and `n`, the rows of the tree. Ties fall by row number."""
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "unranked")
    by = [TREE, *order, "_row"]
    count = rows.count()
    ranges = max(1, -(-count // ROWS_A_RANGE), min(RANGES, -(-count // LEAST_ROWS_A_RANGE)))
    dealt = written(rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(TREE, "_range").agg(F.count("*").alias("_n"))
    of_tree = Window.partitionBy(TREE)
    before = of_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        TREE, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(of_tree).alias("n")
    )
    inside = F.row_number().over(Window.partitionBy(TREE, "_range").orderBy(*order, "_row"))
    placed = dealt.withColumn("_inside", inside).join(bases, [TREE, "_range"])
    return placed.withColumn("pos", F.col("_base") + F.col("_inside") - 1).drop("_row", "_range", "_base", "_inside")


def _steps(n: Column, levels: int) -> Column:
    """Levels of a tree of `n` leaves that lie in one block: how often it must be grouped until one node is left."""
    return reduce(lambda total, k: total + (n > FANOUT**k).cast("int"), range(levels), F.lit(0))


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per block of nodes (`tree, pos, n, node`, where node is a struct with a `hash`): `tree, n, pos` in the
    tier above, and `node`, whose `kids` hold the nodes of the level below, down to those given."""
    digits = [F.expr(f"pos div {FANOUT**k} % {FANOUT}").cast("int").alias(f"d{k}") for k in range(levels)]
    rows = nodes.select(TREE, "n", F.expr(f"pos div {FANOUT**levels}").alias("block"), *digits, "node")
    rows = rows.repartition(TREE, "block")
    for level in range(levels):
        above = [f"d{k}" for k in range(level + 1, levels)]
        kids = F.transform(F.array_sort(F.collect_list(F.struct(f"d{level}", "node"))), lambda k: k["node"])
        rows = rows.groupBy(TREE, "block", "n", *above).agg(kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        # where the tree has ended below, its only node is handed up
        own = F.when(F.col("n") > FANOUT**level, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["hash"])
        rows = rows.select(TREE, "block", "n", *above, F.struct(own.alias("hash"), "kids").alias("node"))
    above = F.expr(f"(n + {FANOUT**levels - 1}) div {FANOUT**levels}")
    return rows.select(TREE, F.col("n").alias("below"), above.alias("n"), F.col("block").alias("pos"), "node")


def _siblings(kids: Column, i: Column) -> Column:
    """Hashes of the nodes before and after the i-th of a run."""
    joined = lambda some: F.array_join(F.transform(some, lambda k: k["hash"]), "")
    return F.struct(joined(F.slice(kids, 1, i)).alias("left"), joined(F.slice(kids, i + 2, FANOUT)).alias("right"))


def _nodes_with_paths(node: Column, levels: int, steps: Column, path: Column) -> Column:
    """All nodes of the lowest level below `node`, each with its siblings from there up to the end of `path`."""

    def kid_paths(kid, i):
        here = F.when(steps >= levels, F.concat(F.array(_siblings(node["kids"], i)), path)).otherwise(path)
        if levels == 1:
            return F.array(F.struct(kid.alias("node"), here.alias("path")))
        return _nodes_with_paths(kid, levels - 1, steps, here)

    return F.flatten(F.transform(node["kids"], kid_paths))


def grown(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """The root node of every tree (`tree, hash`), and the tiers of blocks below it, lowest first."""
    tiers: list[DataFrame] = []
    while not tiers or (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tiers.append(written(blocks(nodes, levels), f"tier{len(tiers)}"))
        nodes = tiers[-1].select(TREE, "n", "pos", F.struct("node.hash").alias("node"))
    return tiers[-1].select(TREE, F.col("node.hash").alias("hash")), tiers


def spread(tiers: Sequence[DataFrame], roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each leaf's `node`, with `path`, its siblings up to the root of its tree and on along the path in `roots` (`tree,
    path` and further columns, which all leaves of the tree receive)."""
    carried = [c for c in roots.columns if c not in (TREE, "path")]
    found = roots.withColumn("pos", F.lit(0).cast("long"))
    for depth, tier in reversed(list(enumerate(tiers))):
        both = tier.select(TREE, "pos", "below", "node").unionByName(
            found.select(TREE, "pos", "path", *carried), allowMissingColumns=True
        )
        beside = [F.first(c, ignorenulls=True).alias(c) for c in ("below", "node", "path", *carried)]
        met = both.groupBy(TREE, "pos").agg(*beside)
        below = _nodes_with_paths(F.col("node"), levels, _steps(F.col("below"), levels), F.col("path"))
        number = F.col("pos") * FANOUT**levels
        found = met.select(TREE, number.alias("first"), *carried, F.posexplode(below).alias("at", "found")).select(
            TREE, (F.col("first") + F.col("at")).alias("pos"), *carried, "found.node", "found.path"
        )
        if depth:
            found = found.drop("node")
    return found


def manifest(docs: DataFrame, levels: int = LEVELS, fields: Sequence[str] = FIELDS) -> DataFrame:
    """`doc_id, leaf, subroot, root, proof_sha256, folded_root, verified` of every row.

    Nulls in any field are hashed as a dash; rows without a source are one tree, the first. Leaves ascend by doc_id, null
    ids first and equal ids by their leaves, so repeated rows are leaves each. A tree of one leaf has that leaf as its
    subroot, and the only subroot is the root. Columns that are not hashed are not returned. An empty table gives no rows.
    """
    # a name of the tree that is never null and sorts as the source does, null first
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    rows = ranked(leaves(docs, fields).withColumn(TREE, name).drop("source"), ["doc_id", "leaf"])
    low = rows.select(TREE, "pos", "n", F.struct(F.col("leaf").alias("hash"), "doc_id", "tampered_leaf").alias("node"))
    subroots, tiers = grown(low, levels)
    whole = F.lit("").alias(TREE)
    order = ranked(subroots.select(F.col(TREE).alias("name"), "hash").withColumn(TREE, whole), ["name"])
    roots, top = grown(order.select(TREE, "pos", "n", F.struct("hash", "name").alias("node")), levels)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    of_sources = spread(top, roots.select(TREE, no_path.alias("path"), F.col("hash").alias("root")), levels)
    starts = of_sources.select(F.col("node.name").alias(TREE), "path", "root", F.col("node.hash").alias("subroot"))
    found = spread(tiers, written(starts, "subroots"), levels)
    node = F.col("node")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    folded = F.aggregate("path", node["tampered_leaf"], lambda h, p: digest(p["left"], h, p["right"]))
    out = found.select(
        node["doc_id"].alias("doc_id"), node["hash"].alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
