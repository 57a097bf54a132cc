"""Merkle manifest of a dataset: a digest for each row, for each source, for all, and a proof that joins them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transcript_jobs.plans.scratch import Scratch

#: A step of a proof: the digests, as bytes, of the nodes before and after one in its run.
STEPS = "array<struct<before: binary, after: binary>>"


@dataclass(frozen=True)
class Shape:
    """Nodes that are hashed together, and the levels that one block covers."""

    arity: int = 3
    levels: int = 5

    @property
    def size(self) -> int:
        return self.arity**self.levels

    def block(self) -> Column:
        """The block of a place in its tree."""
        return F.floor(F.col("pos") / self.size)

    def depth(self, n: int) -> int:
        """Levels within one block of a tree of ``n`` nodes: until one node remains, but all levels if there are more blocks, even for a last block of one node."""
        depth = 0
        while depth < self.levels and self.arity**depth < n:
            depth += 1
        return depth


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over fields, each with its length in bytes of UTF-8 before it, or a dash if it is null."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(field, values)), 256)


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(hex_text(s["before"]), d, hex_text(s["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 over all digests of a proof, in its order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(hex_text(s["before"]), hex_text(s["after"]))), ""), 256)


class Block:
    """Consecutive nodes of a tree, reduced to one digest; each node's siblings on the way are kept."""

    def __init__(self, digests: list[bytes], arity: int):
        self.digests, self.arity = digests, arity
        self.steps: list[list[tuple[bytes, bytes]]] = [[] for _ in digests]

    def reduce(self, start: int, depth: int) -> bytes:
        """The digest of the subtree of ``arity ** depth`` nodes from ``start``, after those of its parts, whose nodes get the other parts as siblings."""
        if not depth:
            return self.digests[start]
        width = self.arity ** (depth - 1)
        stop = min(start + self.arity * width, len(self.digests))
        parts = [self.reduce(at, depth - 1) for at in range(start, stop, width)]
        for k, at in enumerate(range(start, stop, width)):
            step = b"".join(parts[:k]), b"".join(parts[k + 1 :])
            for node in self.steps[at : at + width]:
                node.append(step)
        return sha256(b"".join(parts).hex().encode()).digest()


def reduce_blocks(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Reduce each block of rows (tree, block, pos, n, digest, others), which come in this order; a block may go on in the next batch.

    Returns tree, pos, n, digest, others, the steps of each node, and the block's digest.
    """
    held: list[pa.RecordBatch] = []

    def reduced(block: pa.RecordBatch) -> pa.RecordBatch:
        nodes = Block(block.column("digest").to_pylist(), shape.arity)
        top = nodes.reduce(0, shape.depth(block.column("n")[0].as_py()))
        ends = np.cumsum([0] + [len(s) for s in nodes.steps])
        flat = [s for steps in nodes.steps for s in steps]
        pairs = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.binary()), pa.array([b for _, b in flat], pa.binary())], ["before", "after"])
        kept = {c: block.column(c) for c in block.schema.names if c != "block"}
        return pa.RecordBatch.from_pydict(kept | {"steps": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), "top": pa.array([top] * block.num_rows, pa.binary())})

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(c)[0] == b.column(c)[0] for c in ("tree", "block"))

    for batch in batches:
        # Places rise within a block and a block begins at a place of its own, so that a new one is where they do not follow.
        block, pos = (batch.column(c).to_numpy() for c in ("block", "pos"))
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            piece = batch.slice(start, stop - start)
            if held and piece.num_rows and not same(held[0], piece):
                yield reduced(pa.concat_batches(held))
                held = []
            if piece.num_rows:
                held.append(piece)
    if held:
        yield reduced(pa.concat_batches(held))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows with their place ``pos`` within ``tree`` in the order of ``order``, and the tree's size ``n``.

    Rows are sorted by ranges of (tree, order) and counted by partition: a place is
    what the partitions before hold of the tree, plus the rows before it in its own.
    A large tree lies in many partitions, and no window runs over its rows.
    """
    by = ["tree", *order]
    parted = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    parted = scratch.save(parted, name)
    counts = parted.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("row").alias("first"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    return parted.join(starts, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def traverse(nodes: DataFrame, scratch: Scratch, name: str, shape: Shape) -> list[DataFrame]:
    """Reduce every tree of nodes (``tree, pos, n, digest``, others) to its root, round by round.

    Blocks of consecutive nodes are reduced apart from each other, a round for every
    ``levels`` levels; the blocks' digests are the nodes of the next round. Returns the
    rounds: the nodes of each with their ``steps`` within a block and its digest ``top``.
    """
    rounds: list[DataFrame] = []
    while True:
        dealt = nodes.withColumn("block", shape.block()).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        kept = [f for f in nodes.schema if f.name != "block"]
        made = T.StructType([*kept, *T.StructType.fromDDL(f"steps {STEPS}, top binary")])
        done = scratch.save(dealt.mapInArrow(lambda batches: reduce_blocks(batches, shape), made), f"{name}-{len(rounds)}")
        rounds.append(done)
        heads = done.where((F.col("pos") % shape.size == 0) & (F.col("n") > shape.size))
        nodes = heads.select("tree", shape.block().alias("pos"), F.ceil(F.col("n") / shape.size).alias("n"), F.col("top").alias("digest"))
        if nodes.isEmpty():
            return rounds


def roots(done: DataFrame, shape: Shape) -> DataFrame:
    """The trees that end in a round, and their roots."""
    return done.where((F.col("pos") == 0) & (F.col("n") <= shape.size)).select("tree", F.col("top").alias("root"))


def proofs(rounds: list[DataFrame], shape: Shape, ends: DataFrame | None = None) -> DataFrame:
    """The nodes of the first round with their ``proof``; ``ends`` (tree, proof, others) follows the last step of each tree.

    From the last round to the first, a block's row meets its own nodes alone: no join
    has a key with more than a block of rows, however large a tree.
    """
    above = None
    for done in reversed(rounds):
        rest = [] if ends is None else [roots(done, shape).drop("root").join(ends, "tree").withColumn("block", F.lit(0).cast("long")).withColumnRenamed("proof", "above")]
        rest += [] if above is None else [above.withColumnRenamed("pos", "block").withColumnRenamed("proof", "above")]
        found = done.drop("top").withColumn("block", shape.block())
        if rest:
            up = rest[0] if len(rest) == 1 else rest[0].unionByName(rest[1])
            found = found.join(up, ["tree", "block"], "left")
        more = F.coalesce("above", F.array().cast(STEPS)) if rest else F.array().cast(STEPS)
        found = found.withColumn("proof", F.concat("steps", more)).drop("steps", "above", "block")
        above = found.drop("n", "digest")
    return found


def build_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    source_col: str = "source",
    also: dict[str, Column] | None = None,
    shape: Shape = Shape(),
) -> DataFrame:
    """The leaf, subroot, root and proof of each row of a dataset.

    A leaf is the digest of the row's ``fields``. Of each source the leaves in
    ascending order of ``id_col``, and of all sources the subroots in the order of
    their bytes (null first), are reduced to one: three consecutive nodes, or what is
    left of them, become the digest of their digests. Digests are SHA-256, in
    lower-case hexadecimal text.

    Returns ``id_col, leaf, subroot, root, proof``, and the columns of ``also``, which
    are computed where the leaves are; ``folded(leaf, proof)`` gives the root. Null
    ids come first; rows of one id are ordered by their leaves, equal rows are leaves
    of their own. Other columns are ignored, whatever their names. An empty table
    gives no rows, and has no root.

    Texts are read once and not shuffled; leaves are sorted by ranges of (source, id),
    so that a large source lies in many tasks, and reduced in blocks of 243, whose
    digests feed another round. Each round is written to the scratch folder.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    extra = {f"also_{k}": name for k, name in enumerate(also or {})}
    source = F.col(source_col).cast("string")
    tree = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), F.unhex(leaf_digest(*map(F.col, fields))).alias("digest"), *[also[name].alias(k) for k, name in extra.items()])
    # Rows that are equal in all else still spread over ranges.
    leaves = numbered(rows.withColumn("read", F.monotonically_increasing_id()), ["id", "digest", "read"], scratch, "leaves").drop("read")
    rounds = traverse(leaves, scratch, "blocks", shape)
    subroots = roots(rounds[0], shape)
    for done in rounds[1:]:
        subroots = subroots.unionByName(roots(done, shape))
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), ["source"], scratch, "sources")
    tops = traverse(sources, scratch, "top", shape)
    # One row: the root of all.
    root = roots(tops[-1], shape).select("root")
    ends = proofs(tops, shape).select(F.col("source").alias("tree"), "proof", F.col("digest").alias("subroot")).crossJoin(F.broadcast(root))
    found = proofs(rounds, shape, ends)
    return found.select(
        F.col("id").alias(id_col), hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"), "proof", *[F.col(k).alias(name) for k, name in extra.items()]
    )
