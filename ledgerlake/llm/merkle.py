"""A Merkle manifest of a dataset, its nodes kept in Parquet by level, with a proof for every row.

Each row is a leaf: the SHA-256 of its fields. A tree for each value of a column
(``tree``) has its leaves in order; every two consecutive nodes make one of the next
level, a last single one too, until one is left. The trees' tops are the leaves of one
more tree, whose top is the dataset's root.

The store (``NODES``) holds a row for each node, partitioned by level. Levels are
made ten at a time: a task reads blocks of 1,024 consecutive nodes and streams them
up; the next pass reads only the last of those levels. Proofs are extracted the other
way, from the top down: a block's rows are merged with the nodes above them by
coordinate, and get what leads from the block to the root from the pass before. No
group is larger than a block, whatever a tree's size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, small, stash, unstash

#: Levels that one pass makes, and so 2 ** BAND nodes at most in a block.
BAND = 10
NODES = "tree string, at long, n long, digest string"
#: What leads from a node up: sides of the siblings (L, R, or N where there is none), their digests, and the tops of the trees passed.
WAY = "sides string, siblings array<string>, tops array<string>"


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def encoded(field: Column) -> Column:
    """A field as its UTF-8 byte count, a colon and its text; ``-`` if null."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column | str) -> Column:
    return F.sha2(F.concat(*[encoded(F.col(f) if isinstance(f, str) else f) for f in fields]), 256)


def new_store(spark: SparkSession) -> str:
    """A folder for a manifest, in the folder that all machines share."""
    return f"{shared_dir(spark)}/ledgerlake-manifest-{uuid.uuid4().hex}"


def tree_key(value: Column) -> Column:
    """A tree's name: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves(tree, digest, ...)`` with ``at``, the place in the tree by ``order`` (nulls first) and digest, and ``n``, the tree's size.

    Sorted runs are written, of which each holds a range of the whole order; a run's
    part of a tree starts after those of earlier runs. Equal rows may lie in several
    runs, so that a row that is repeated without end doesn't fill one.
    """
    by = ["tree", *[F.asc_nulls_first(c) for c in order], "digest", "__row"]
    leaves = leaves.withColumn("__row", F.monotonically_increasing_id())
    runs = leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__run": F.spark_partition_id(), "__mark": F.monotonically_increasing_id()})
    runs = stash(runs.drop("__row"), "leaf-runs")
    parts = runs.groupBy("tree", "__run").agg(F.min("__mark").alias("__least"), F.count("*").alias("__size"))
    w = Window.partitionBy("tree")
    before = F.sum("__size").over(w.orderBy("__run")) - F.col("__size")
    parts = parts.select("tree", "__run", (before - F.col("__least")).alias("__shift"), F.sum("__size").over(w).alias("n"))
    parts = stash(parts, "leaf-parts")
    return runs.join(small(parts), ["tree", "__run"]).withColumn("at", F.col("__mark") + F.col("__shift")).drop("__run", "__mark", "__shift")


def _levels(n: int, level: int, band: int) -> Iterator[tuple[int, int]]:
    """The levels above ``level`` that a pass makes in a tree that has ``n`` nodes there, with their sizes."""
    for k in range(level + 1, level + band + 1):
        if n == 1:
            return
        n = (n + 1) // 2
        yield k, n


def _climb(batches: Iterator[dict[str, list]], level: int, band: int) -> Iterator[dict[str, list]]:
    """Levels above ``level`` of whole blocks, whose rows come in order."""
    rows = ((t, at >> band, n, d) for b in batches for t, at, n, d in zip(b["tree"], b["at"], b["n"], b["digest"], strict=True))
    for (tree, block, n), nodes in groupby(rows, key=lambda r: r[:3]):
        row = [r[3] for r in nodes]
        out: dict[str, list] = {c: [] for c in ("level", "tree", "at", "n", "digest")}
        for k, size in _levels(n, level, band):
            row = [_hash(*row[i : i + 2]) for i in range(0, len(row), 2)]
            first = block << (band - (k - level))
            for c, values in zip(out, ([k] * len(row), [tree] * len(row), range(first, first + len(row)), [size] * len(row), row), strict=True):
                out[c].extend(values)
        yield out


def read_level(spark: SparkSession, path: str, *levels: int) -> DataFrame:
    """Nodes of the given levels; other levels' files aren't read."""
    return spark.read.schema(f"{NODES}, level int").parquet(path).where(F.col("level").isin(list(levels)))


def build(leaves: DataFrame, path: str, band: int = BAND) -> int:
    """Write all levels over ``leaves`` (``NODES``) to ``path``; returns the highest level that starts a pass."""
    spark = leaves.sparkSession

    def put(rows: DataFrame) -> None:
        rows.write.partitionBy("level").mode("append").option("compression", "zstd").parquet(path)

    put(leaves.select("tree", "at", "n", "digest", F.lit(0).alias("level")))
    level = 0
    while True:
        below = read_level(spark, path, level).where("n > 1").drop("level")
        if below.isEmpty():
            return max(0, level - band)
        block = F.shiftright("at", band)
        blocks = below.repartition("tree", block).sortWithinPartitions("tree", "at")
        put(map_batches(blocks, f"level int, {NODES}", lambda b, at=level: _climb(b, at, band), rows=4096))
        level += band


def tops(spark: SparkSession, path: str) -> DataFrame:
    """``tree, digest``: each tree's top, the only node of its level."""
    return spark.read.schema(f"{NODES}, level int").parquet(path).where("n = 1").select("tree", "digest")


def _extract(level: int, band: int, rows: pa.Table, nodes: pa.Table) -> pa.Table:
    """One block: ``rows`` with the way from each up; ``nodes`` are those above and beside them, and one row with the block's own way."""
    at = {}
    n, own = 0, ("", [], [])
    for r in nodes.to_pylist():
        if r["sides"] is not None:
            own = (r["sides"], r["siblings"], r["tops"])
        else:
            at[r["level"], r["at"]] = r["digest"]
            n = r["n"] if r["level"] == level else n
    sides, siblings = [], []
    for place in rows.column("at").to_pylist():
        text, found, k = "", [], level
        for up, _ in _levels(n, level, band):
            beside = at.get((k, place ^ 1))
            text += "N" if beside is None else "R" if place % 2 == 0 else "L"
            found.append(beside)
            place, k = place >> 1, up
        sides.append(text + own[0])
        siblings.append(found + own[1])
    out = rows.drop_columns(["__block"])
    for name, values, kind in (("sides", sides, pa.string()), ("siblings", siblings, pa.list_(pa.string())), ("tops", [own[2]] * len(sides), pa.list_(pa.string()))):
        out = out.append_column(name, pa.array(values, type=kind))
    return out


def _extractor(level: int, band: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda rows, nodes: _extract(level, band, rows, nodes)


def proofs(wanted: DataFrame, path: str, above: DataFrame, highest: int, band: int = BAND) -> DataFrame:
    """``wanted(tree, at, ...)``, coordinates of leaves, with ``WAY`` from each to the root.

    ``above``: ``tree`` and ``WAY``, the way from each tree's top. ``highest``: what
    ``build`` returned. Levels are read from the top down, ``band`` at a time.
    """
    spark, names = wanted.sparkSession, [c.split()[0] for c in NODES.split(", ")]
    block, none = F.shiftright("at", band).alias("__block"), lambda kind: F.lit(None).cast(kind)
    way, ways = above.select("tree", F.lit(0).cast("long").alias("__block"), "sides", "siblings", "tops"), None
    for level in range(highest, -1, -band):
        here = read_level(spark, path, *range(level, level + band))
        nodes = here.select(*names, "level", F.expr(f"shiftright(at, {band + level} - level)").alias("__block"), none("string").alias("sides"), none("array<string>").alias("siblings"), none("array<string>").alias("tops"))
        # Trees that end in this pass have one block, which starts from their top; others' blocks start from what the pass before found.
        ending = read_level(spark, path, level).where(f"at = 0 and n between {2 if level else 1} and {1 << band}")
        starts = way.join(ending.select("tree"), "tree", "left_semi")
        starts = starts if ways is None else starts.unionByName(ways.withColumnRenamed("at", "__block"))
        starts = starts.select("tree", none("long").alias("at"), none("long").alias("n"), none("string").alias("digest"), none("int").alias("level"), "__block", "sides", "siblings", "tops")
        rows = wanted if level == 0 else read_level(spark, path, level).where("n > 1").select("tree", "at")
        rows = rows.select(*rows.columns, block)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__block").schema) + ", " + WAY
        both = rows.groupBy("tree", "__block").cogroup(nodes.unionByName(starts).groupBy("tree", "__block"))
        got = both.applyInArrow(_extractor(level, band), schema)
        ways = stash(got, f"ways-{level}") if level else got
    return ways


def folded(leaf: Column, sides: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    steps = F.arrays_zip(F.split(F.regexp_replace(sides, "(?<=.)(?=.)", ","), ",").alias("side"), siblings.alias("beside"))

    def up(digest: Column, step: Column) -> Column:
        left, right = F.when(step["side"] == "L", step["beside"]).otherwise(""), F.when(step["side"] == "R", step["beside"]).otherwise("")
        return F.sha2(F.concat(left, digest, right), 256)

    return F.when(F.char_length(sides) == 0, leaf).otherwise(F.aggregate(steps, leaf, up))


def manifest(docs: DataFrame, path: str, fields: tuple[str, ...], tree: str, order: str, forged: Column | None = None, band: int = BAND) -> DataFrame:
    """Write the trees of ``docs`` under ``path`` and return every row's leaf, tree tops and proof.

    A row for each row of ``docs``: the ``order`` column, ``leaf``, ``forged`` (a
    digest given for the row, to be checked in the leaf's place; else null),
    ``subroot``, ``root``, ``sides`` and ``siblings``. Null values are a tree of their
    own, before the others; null keys come first in their tree. Rows that share a key
    are in order of their digests. Empty texts are fields like others. An empty table
    has no rows and no root. ``path/trees`` and ``path/root`` hold the nodes.
    """
    spark = docs.sparkSession
    leaves = docs.select(tree_key(F.col(tree)).alias("tree"), F.col(order).alias("key"), leaf(*fields).alias("digest"), (F.lit(None).cast("string") if forged is None else forged).alias("forged"))
    leaves = stash(leaves, "leaves")
    placed = stash(numbered(leaves, "key"), "placed")
    unstash(leaves)
    highest = build(placed, f"{path}/trees", band)
    subroots = stash(numbered(tops(spark, f"{path}/trees").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "of"), "subroots")
    roof = build(subroots, f"{path}/root", band)
    root = tops(spark, f"{path}/root").select("tree", F.lit("").alias("sides"), F.array().cast("array<string>").alias("siblings"), F.array("digest").alias("tops"))
    above = proofs(subroots, f"{path}/root", root, roof, band)
    above = stash(above.select(F.col("of").alias("tree"), "sides", "siblings", F.concat(F.array("digest"), "tops").alias("tops")), "above")
    found = proofs(placed, f"{path}/trees", above, highest, band)
    return found.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "forged", F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"), "sides", "siblings")
