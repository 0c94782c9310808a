"""Merkle manifests: a proof for every row, by appending leaves and extending open witnesses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from prefdeck.llm.common import concat_schema, map_arrow, stored

ARITY = 8
BLOCK_LEVELS = 4  # of a block, which a task holds as a whole: 4,096 leaves
PART_ROWS = 1_000_000  # leaves that are sorted and numbered together
DIGEST = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


class Appender:
    """A tree that grows by aligned appends.

    Every level has one open run of up to ``arity`` digests. A digest comes with the witnesses of the
    leaves below it: what has to stand before and after a leaf's own branch, level by level. A full
    run closes: its members learn their siblings, and its digest goes to the level above together
    with all of their witnesses.
    """

    def __init__(self, arity: int = ARITY) -> None:
        self.arity = arity
        self.open: list[list[tuple[str, list]]] = []
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self._put(0, node, [self.witnesses[-1]])

    def _put(self, level: int, node: str, below: list) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        gathered = []
        for place, (_, below) in enumerate(run):
            sides = "".join(nodes[:place]), "".join(nodes[place + 1 :])
            for witness in below:
                witness.append(sides)
            gathered += below
        self._put(level + 1, digest("".join(nodes)), gathered)

    def finish(self, levels: int | None = None) -> str:
        """The one node that remains. Short runs close; with ``levels``, so many levels are closed even
        where one node is left, as in a block of a larger tree."""
        level = 0
        while True:
            last = level == levels if levels is not None else not any(self.open[level + 1 :])
            if len(self.open[level]) == 1 and last:
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
            level += 1


def fold(node: str, witness: Sequence[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its witness."""
    for before, after in witness:
        node = digest(before + node + after)
    return node


def _block(rows: list[tuple[int, str]], n: int, levels: int) -> tuple[str, list]:
    """Root and witnesses of the tree over ``rows (pos, node)``, in the order of ``pos``. ``n``: all nodes of
    the tree that this is a block of."""
    tree = Appender()
    for _, node in sorted(rows):
        tree.append(node)
    return tree.finish(levels if n > ARITY**levels else None), tree.witnesses


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes (tree, ...)`` with ``pos``, the place from 0 along ``order`` within the tree, and ``n``, the
    size of the tree.

    Rows are range-partitioned by tree and order, numbered inside each partition, and moved on by
    the rows of their tree in earlier partitions: one number per tree and partition. A tree that
    holds most rows is spread over many partitions, and so are rows equal in all of ``order``.
    """
    spark = nodes.sparkSession
    nodes = stored(nodes.withColumn("row", F.monotonically_increasing_id()))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // PART_ROWS))
    by = ["tree", *order, "row"]
    ranged = nodes.repartitionByRange(n_parts, *by).sortWithinPartitions(*by).drop("row")
    tree_at = ranged.columns.index("tree")
    schema = StructType([*ranged.schema, StructField("part", IntegerType()), StructField("nth", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, nth = TaskContext.get().partitionId(), None, 0
        for rows in batches:
            places = []
            for tree in rows.column(tree_at).to_pylist():
                nth = nth + 1 if tree == last else 0
                last = tree
                places.append(nth)
            columns = [*rows.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "part", "nth"])

    placed = stored(map_arrow(ranged, number, schema))
    sizes = placed.groupBy("tree", "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "tree", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
        F.sum("size").over(Window.partitionBy("tree")).alias("n"),
    )
    return placed.join(starts, ["tree", "part"]).withColumn("pos", F.col("start") + F.col("nth")).drop("part", "nth", "start")


def _table(fields: pa.Schema, *columns: Sequence) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.types)], schema=fields)


def _cells(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("cell", F.floor(F.col("pos") / ARITY**levels))


def block_roots(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``tree, pos, node, n``: the roots of the blocks of ``nodes (tree, pos, node, n)``, which are the
    nodes of the tree above."""
    fields = concat_schema(tree=pa.string(), pos=pa.int64(), node=pa.string(), n=pa.int64())

    def root(key, rows):
        n = rows.column("n")[0].as_py()
        top, _ = _block(list(zip(rows.column("pos").to_pylist(), rows.column("node").to_pylist())), n, levels)
        return _table(fields, [key[0].as_py()], [key[1].as_py()], [top], [-(-n // ARITY**levels)])

    cells = _cells(nodes, levels).select("tree", "cell", "pos", "node", "n")
    return cells.groupBy("tree", "cell").applyInArrow(root, "tree string, pos long, node string, n long")


def witnesses(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``tree, pos, path, root`` per node of ``nodes (tree, pos, node, n)``: its witness up to the root of
    its tree, and that root.

    Blocks of some thousand nodes become one node each; these are appended to the tree above, by
    blocks again, until each tree is one block. Then the witnesses of the blocks extend those of the
    nodes inside. So no task holds more than a block.
    """
    if (nodes.agg(F.max("n")).first()[0] or 0) <= ARITY**levels:
        above = nodes.where("pos = 0").select(
            "tree", F.lit(0).cast("long").alias("above"), F.array().cast(DIGEST).alias("path"), F.lit(None).cast("string").alias("root")
        )
    else:
        above = witnesses(stored(block_roots(nodes, levels)), levels).withColumnRenamed("pos", "above")

    fields = concat_schema(
        tree=pa.string(), pos=pa.int64(), path=pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])), root=pa.string()
    )

    def extend(key, rows, upper):
        members = sorted(zip(rows.column("pos").to_pylist(), rows.column("node").to_pylist()))
        top, inside = _block(members, rows.column("n")[0].as_py(), levels)
        beyond = upper.column("path")[0].as_py()
        paths = [[{"before": a, "after": b} for a, b in w] + beyond for w in inside]
        root = upper.column("root")[0].as_py() or top
        trees = [key[0].as_py()] * len(members)
        return _table(fields, trees, [p for p, _ in members], paths, [root] * len(members))

    cells = _cells(nodes, levels).select("tree", "cell", "pos", "node", "n")
    found = cells.groupBy("tree", "cell").cogroup(above.groupBy("tree", "above")).applyInArrow(
        extend, f"tree string, pos long, path {DIGEST}, root string"
    )
    return stored(found)


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded_case(text: Column) -> Column:
    """A-Z as a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(
    docs: DataFrame,
    tampered: dict[str, Column],
    where: Column,
    columns: Sequence[str] = LEAF_COLUMNS,
    group_col: str = "lang",
    id_col: str = "doc_id",
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``docs``.

    A leaf is the digest of ``columns``; the leaves of a group form a tree in the order of their ids,
    the roots of the groups (NULL first, then bytewise) another one. ``proof_sha256`` digests all
    siblings from the leaf to the root. ``folded_root`` is recomputed from the witness and the leaf
    or, ``where`` that holds, the leaf with ``tampered`` in place of some columns; ``verified`` says
    whether it equals the root. NULL ids come first and rows of one id in the order of their leaves;
    repeated rows are a leaf each. NULL and empty values differ. Other columns are ignored; no rows
    give none. Texts are read once, and only digests are shuffled.
    """
    def leaf(columns_of: dict[str, Column]) -> Column:
        return F.sha2(F.concat(*[field(columns_of.get(c, F.col(c))) for c in columns]), 256)

    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),  # NULL first
        F.col(id_col).cast("long").alias("id"),
        leaf({}).alias("node"),
        F.when(where, leaf(tampered)).alias("claimed"),
    )
    placed = stored(numbered(leaves, ["id", "node"]))
    blocks = witnesses(stored(block_roots(placed, block_levels)), block_levels)
    groups = stored(blocks.where("pos = 0").select("tree", F.col("root").alias("node")))
    top = numbered(groups.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
    top = stored(top)
    over = witnesses(top, block_levels).select("pos", F.col("path").alias("rest"), F.col("root").alias("whole"))
    named = top.join(over, "pos").select(F.col("name").alias("tree"), "rest", "whole")
    above = blocks.join(named, "tree").select(
        "tree", F.col("pos").alias("above"), F.concat("path", "rest").alias("path"),
        F.col("root").alias("subroot"), "whole",
    )

    fields = concat_schema(
        id=pa.int64(), leaf=pa.string(), subroot=pa.string(), root=pa.string(),
        proof_sha256=pa.string(), folded_root=pa.string(), verified=pa.bool_(),
    )

    def prove(rows, upper):
        members = sorted(zip(*(rows.column(c).to_pylist() for c in ("pos", "node", "id", "claimed"))))
        _, inside = _block([(pos, node) for pos, node, _, _ in members], rows.column("n")[0].as_py(), block_levels)
        beyond = [(s["before"], s["after"]) for s in upper.column("path")[0].as_py()]
        siblings = "".join(a + b for a, b in beyond)
        subroot, root = upper.column("subroot")[0].as_py(), upper.column("whole")[0].as_py()
        out = []
        for (_, node, row_id, claimed), witness in zip(members, inside):
            proof = digest("".join(a + b for a, b in witness) + siblings)
            folded = fold(fold(claimed or node, witness), beyond)
            out.append((row_id, node, subroot, root, proof, folded, folded == root))
        return _table(fields, *zip(*out))

    proved = _cells(placed, block_levels).groupBy("tree", "cell").cogroup(above.groupBy("tree", "above")).applyInArrow(
        prove, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return proved.withColumnRenamed("id", id_col)
