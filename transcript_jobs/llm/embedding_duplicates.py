"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs.llm.components import components
from transcript_jobs.plans.scratch import Scratch

#: Single precision decides a cosine that is further than this from the threshold, a matrix product in double precision one further than CLOSE.
DOUBT, CLOSE = 1e-5, 1e-12


@dataclass(frozen=True)
class Settings:
    """``neighbours`` of a node at first; a list full of links may grow to twice as many in each round.

    The first graph links neighbours within ``window`` places in ``orders`` random
    orders. Rounds go on until ``audit`` nodes, compared with all others, show a
    recall of ``recall``, at least ``rounds`` and at most ``most_rounds`` times. Without
    it all nodes of a label are compared in blocks.
    """

    threshold: float = 0.98
    neighbours: int = 8
    orders: int = 5
    window: int = 5
    rounds: int = 2
    most_rounds: int = 6
    audit: int = 512
    recall: float = 0.999
    list_size: int = 40
    block: int = 512


def _matrix(column, kind: str = "<f8") -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def passes(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two tables of unit vectors have a cosine of the threshold or more.

    A cosine that is all but the threshold is summed without rounding on the way, so
    that every step decides it alike, whatever the order of its product.
    """
    c = x @ y.T
    out = c >= threshold
    for i, j in zip(*np.nonzero(np.abs(c - threshold) < CLOSE)):
        out[i, j] = math.fsum(x[i] * y[j]) >= threshold
    return out


def _nodes(vectors: DataFrame, scratch: Scratch, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """One node for each different usable vector of a label: unit vector in double and single precision, smallest id, rows."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & good)
    same = usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for x in batch.column(2).to_pylist():
                x = np.array(x, float)
                x /= np.abs(x).max()
                x /= np.sqrt((x * x).sum())
                both.append((x.tobytes(), x.astype("<f4").tobytes(), len(x)))
            double, single, size = zip(*both) if both else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(size, pa.int32()), pa.array(double, pa.binary()), pa.array(single, pa.binary())], ["node", "label", "v", "rep", "rows", "dim", "double", "single"])

    kind = same.schema["label"].dataType.simpleString()
    # The number is drawn once and written; whatever reads it later sees the same one.
    numbered = same.select(F.monotonically_increasing_id().alias("node"), "label", "v", "rep", "rows")
    return scratch.save(numbered.mapInArrow(unit, f"node long, label {kind}, v array<double>, rep long, rows long, dim int, double binary, single binary"), "nodes")


def _first_graph(nodes: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b, cosine) between neighbours in random orders: by the signs of projections, then by one projection."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, dims = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            vectors, bits = _matrix(batch.column(3), "<f4"), batch.column(4).to_numpy()
            for order in range(s.orders):
                code, value = np.zeros(len(dims), np.int64), np.zeros(len(dims), np.float64)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    planes = np.random.default_rng([order, int(d)]).standard_normal((49, int(d)))
                    p = np.stack([vectors[k] for k in at]) @ planes.T
                    for n in np.unique(bits[at]).tolist():
                        own = bits[at] == n
                        code[at[own]] = (p[own, 1 : n + 1] > 0) @ (1 << np.arange(n))
                    value[at] = p[:, 0]
                yield pa.RecordBatch.from_arrays([node, label, batch.column(2), batch.column(3), pa.array(np.full(len(dims), order, np.int32)), pa.array(code), pa.array(value)], ["node", "label", "dim", "single", "order", "code", "value"])

    kind = nodes.schema["label"].dataType.simpleString()
    keys = ["order", "label", "dim", "code", "value", "node"]
    # The bits follow the rows of the label, so that equal codes stay few.
    sizes = nodes.groupBy("label", "dim").agg(F.greatest(F.lit(12), F.least(F.lit(48), F.ceil(F.log2(F.count("*") / s.window)))).cast("int").alias("bits"))
    placed = nodes.join(sizes, ["label", "dim"]).select("node", "label", "dim", "single", "bits").mapInArrow(project, f"node long, label {kind}, dim int, single binary, order int, code long, value double")
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = held + list(zip(batch.column(0).to_pylist(), zip(batch.column(4).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()), _matrix(batch.column(3), "<f4")))
            out: list[tuple[int, int, float]] = []
            for at in range(len(held), len(rows)):
                node, group, x = rows[at]
                for k in range(max(0, at - s.window), at):
                    if rows[k][1] == group:
                        c = float(x @ rows[k][2])
                        out += [(node, rows[k][0], c), (rows[k][0], node, c)]
            held = rows[-s.window :]
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["a", "b", "c"])

    return placed.select("node", "label", "dim", "single", "order").mapInArrow(slide, "a long, b long, c double")


def _best(edges: DataFrame, s: Settings, round_: int) -> DataFrame:
    """Each node's nearest ``neighbours``; links beyond them stay while the enlarged list has room."""
    one = edges.groupBy("a", "b").agg(F.max("c").alias("c"), F.min("born").alias("born"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
    room = s.neighbours * 2 ** min(round_, 3)
    keep = (F.col("rank") <= s.neighbours) | ((F.col("c") >= s.threshold) & (F.col("rank") <= room))
    return one.withColumn("rank", rank).where(keep).drop("rank")


def _local_joins(graph: DataFrame, nodes: DataFrame, s: Settings, round_: int) -> DataFrame:
    """Candidates (a, b, cosine, link) among the neighbours and reverse neighbours of each node.

    Vectors travel to the lists they are in. Within a list all pairs with a new member
    are compared; those that improve a member's list leave it, and as many links as
    keep the list's linked members together.
    """
    new = (F.col("born") == round_ - 1).cast("int")
    both = graph.select(F.col("a").alias("at"), F.col("b").alias("node"), new.alias("new")).union(graph.select(F.col("b").alias("at"), F.col("a").alias("node"), new.alias("new")))
    lists = both.groupBy("at", "node").agg(F.max("new").alias("new"))
    lists = lists.join(lists.where("new = 1").select("at").distinct(), "at", "left_semi")
    # Lists of many reverse neighbours are cut into pieces of about list_size.
    pieces = lists.groupBy("at").agg(F.ceil(F.count("*") / s.list_size).cast("int").alias("pieces"))
    lists = lists.join(pieces, "at").withColumn("piece", F.pmod(F.xxhash64("node", F.lit(round_)), "pieces"))
    worst = graph.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= s.neighbours, F.min("c")).otherwise(-2.0).alias("worst"))
    sent = lists.join(nodes.select("node", "single"), "node").join(worst, "node", "left")
    sent = sent.select("at", "piece", "node", "new", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "single").repartition("at", "piece").sortWithinPartitions("at", "piece", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(5)] + [np.array(batch.column(5).to_pylist(), object)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            at, piece = cols[0], cols[1]
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (piece[1:] != piece[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = [c[last:] for c in cols]
            if last:
                yield compare([c[:last] for c in cols], cuts[:-1])
        if held is not None:
            yield compare(held, np.zeros(0, np.int64))

    def compare(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], []]
        _, _, node, new, worst, raw = cols
        for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)]):
            if e - b < 2:
                continue
            x = np.frombuffer(b"".join(raw[b:e]), "<f4").reshape(e - b, -1)
            c = (x @ x.T).astype(float)
            i, j = np.triu_indices(e - b, 1)
            value, fresh = c[i, j], (new[b:e][i] | new[b:e][j]) > 0
            near = (value >= s.threshold - DOUBT) & fresh
            tie = np.zeros(len(i), bool)
            # A linked member's first and next partner keep the linked members of a list together.
            if near.any():
                li, lj = i[near], j[near]
                first = np.zeros(len(li), bool)
                first[np.unique(li, return_index=True)[1]] = True
                order = np.lexsort((li, lj))
                first[order[np.unique(lj[order], return_index=True)[1]]] = True
                tie[np.flatnonzero(near)[first]] = True
            better = fresh & ((value > worst[b:e][i]) | (value > worst[b:e][j])) | tie
            for column, v in zip(out, (node[b:e][i[better]], node[b:e][j[better]], value[better], tie[better])):
                column.append(v)
        a, b, c, t = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(float)), pa.array(t.astype(bool))], ["a", "b", "c", "link"])

    return sent.mapInArrow(join, "a long, b long, c double, link boolean").groupBy("a", "b").agg(F.max("c").alias("c"), F.max("link").alias("link"))


def _links(edges: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Edges whose cosine passes; those that single precision leaves in doubt are computed again in double precision."""
    sure = edges.where(F.col("c") >= s.threshold + DOUBT).select("a", "b")
    doubt = edges.where(F.abs(F.col("c") - s.threshold) < DOUBT).select("a", "b").distinct()
    for side in "ab":
        doubt = doubt.join(nodes.select(F.col("node").alias(side), F.col("double").alias(f"d{side}")), side)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(passes(x[None], y[None], s.threshold)[0, 0]) for x, y in zip(_matrix(batch.column(2)), _matrix(batch.column(3)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sure.union(doubt.select("a", "b", "da", "db").mapInArrow(exact, "a long, b long"))


def _recall(grouped: DataFrame, s: Settings, scratch: Scratch, round_: int) -> float | None:
    """The audit's recall; None if no asked node has a link, though not all were asked. It is written beside the links.

    Where no asked node has a link, eight times as many are asked once more.
    """
    recall, asked, linked = _audit(grouped, s, s.audit)
    if recall is None:
        recall, asked, linked = _audit(grouped, s, 8 * s.audit)
    scratch.save(grouped.sparkSession.createDataFrame([(round_, recall, asked, linked)], "round int, recall double, asked int, linked int"), f"recall-{round_}")
    return recall


def _audit(grouped: DataFrame, s: Settings, most: int) -> tuple[float | None, int, int]:
    """The estimated share, averaged over nodes with links, of a node's links that lie within its component; the nodes asked, and those of them with links.

    Up to ``most`` nodes of those with a link so far, and as many of those without,
    are compared with every node; a large group's links count no more than its nodes.
    """
    sizes = {r["linked"]: r["count"] for r in grouped.groupBy("linked").count().collect()}
    first = lambda linked: grouped.where(F.col("linked") == linked).orderBy(F.xxhash64("node", F.lit(3)), "node").limit(most)
    sample = first(True).union(first(False)).select("node", "label", "dim", "double", "component", "linked").toArrow().to_pylist()
    asked = grouped.sparkSession.sparkContext.broadcast([tuple(x.values()) for x in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, component = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            place = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            vectors = _matrix(batch.column(3))
            all_, within = np.zeros(len(asked.value), np.int64), np.zeros(len(asked.value), np.int64)
            for group in set(place):
                at = [k for k, p in enumerate(place) if p == group]
                which = [k for k, q in enumerate(asked.value) if (q[1], q[2]) == group]
                if which:
                    some = [asked.value[k] for k in which]
                    c = passes(np.stack([vectors[k] for k in at]), np.stack([np.frombuffer(q[3], "<f8") for q in some]), s.threshold)
                    c &= node[at][:, None] != np.array([q[0] for q in some])[None, :]
                    all_[which] += c.sum(axis=0)
                    within[which] += (c & (component[at][:, None] == np.array([q[4] for q in some])[None, :])).sum(axis=0)
            has = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(all_[has]), pa.array(within[has])], ["k", "links", "within"])

    found = grouped.select("node", "label", "dim", "double", "component").mapInArrow(run, "k long, links long, within long").groupBy("k").agg(F.sum("links"), F.sum("within")).collect()
    shares = {True: [], False: []}
    for k, links, within in found:
        shares[sample[k]["linked"]].append(within / links)
    reached = total = 0.0
    for linked, known in shares.items():
        # As many nodes of this kind as have links, by the share of those asked.
        n = sizes.get(linked, 0) * len(known) / max(1, min(most, sizes.get(linked, 0)))
        total += n
        reached += n * float(np.mean(known)) if known else 0.0
    # Without a link among all nodes there is nothing to miss.
    none = 1.0 if len(sample) == sum(sizes.values()) else None
    return (reached / total if total else none), len(sample), len(found)


def _all_links(nodes: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) that join what is linked, from the comparison of all nodes of a label in blocks; each unit joins its nodes to the smallest they reach in it."""
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("one"), F.greatest(o, F.col("own")).alias("two")))
    cut = dealt.select("label", "dim", "node", "double", F.inline(pairs))
    # One key for a pair of blocks, so that a label's pairs are dealt to all tasks.
    cut = cut.select("node", "double", F.struct("label", "dim", "one", "two").alias("unit"))

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        x = np.stack([np.frombuffer(v, "<f8") for v in table["double"].to_pylist()])
        linked = passes(x, x, s.threshold)
        np.fill_diagonal(linked, True)
        low = np.arange(len(node))
        while True:
            after = np.where(linked, low[None, :], len(node)).min(axis=1)
            if (after == low).all():
                break
            low = after
        some = low != np.arange(len(node))
        return pa.table({"a": node[some], "b": node[low[some]]})

    return cut.groupBy("unit").applyInArrow(run, "a long, b long")


def _count_links(grouped: DataFrame, s: Settings) -> DataFrame:
    """For each node of a component of several: the rows of other nodes whose cosine passes, counted exactly, block by block."""
    sizes = grouped.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.ceil(F.col("n") / s.block).cast("int").alias("blocks"))
    dealt = grouped.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("one"), F.greatest(o, F.col("own")).alias("two")))
    units = dealt.select("component", "node", "rows", "double", "own", F.inline(pairs))
    # One key for a pair of blocks, so that a component's pairs are dealt to all tasks.
    units = units.select("node", "rows", "double", "own", "one", "two", F.struct("component", "one", "two").alias("unit"))

    def run(table: pa.Table) -> pa.Table:
        node, rows, own = (table[c].to_numpy() for c in ("node", "rows", "own"))
        x = np.stack([np.frombuffer(v, "<f8") for v in table["double"].to_pylist()])
        left, right = (np.flatnonzero(own == table[c][0].as_py()) for c in ("one", "two"))
        linked = passes(x[left], x[right], s.threshold)
        if table["one"][0].as_py() == table["two"][0].as_py():
            np.fill_diagonal(linked, False)
            return pa.table({"node": node[left], "n": linked @ rows[right]})
        return pa.table({"node": np.concatenate([node[left], node[right]]), "n": np.concatenate([linked @ rows[right], linked.T @ rows[left]])})

    return units.groupBy("unit").applyInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _grouped(scratch: Scratch, nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Nodes with the smallest node they reach, and whether they have a link."""
    joined = components(scratch, links, f"joined-{name}")
    return scratch.save(nodes.join(joined, "node", "left").withColumn("linked", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "node")), f"grouped-{name}")


def near_embeddings(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Groups of vectors of one label with a cosine of ``threshold`` or more: ``id_col, n_links, component_id, kept``, a row for each row.

    ``n_links`` counts the other rows that are linked directly, ``component_id`` is
    the smallest id reachable, ``kept`` whether it is the row's own. Vectors that are
    null, zero, or hold null or non-finite components, and rows with a null label or
    id, have no links; a null id has a null component and is kept. Vectors of
    different lengths are never linked. Rows that repeat an id are rows like any
    other. Other columns are ignored; an empty table gives no rows.

    Equal vectors form one node. NN-descent refines a neighbour graph from random
    orders: lists that are full of links are enlarged, and all links seen on the way
    join components. A fixed number of nodes is compared with all others to audit the
    recall, and rounds go on until it is reached; if the last round does not, or no
    node that was asked has a link to tell by, all nodes of a label are compared in
    blocks. Each round's recall is a table in the scratch folder. Links within a component are then
    counted exactly in blocks, so that no list bounds them and no pair is emitted.
    """
    s = settings
    scratch = Scratch(vectors.sparkSession, "near-embeddings")
    nodes = _nodes(vectors, scratch, id_col, vec_col, label_col)
    start = scratch.save(_first_graph(nodes, s).groupBy("a", "b").agg(F.max("c").alias("c")), "start")
    links = scratch.save(_links(start.where("a < b"), nodes, s).distinct(), "links-0")
    graph = scratch.save(_best(start.withColumn("born", F.lit(0)), s, 0), "graph-0")
    for k in range(1, s.most_rounds + 1):
        found = scratch.save(_local_joins(graph, nodes, s, k), f"found-{k}")
        more = _links(found.where("link"), nodes, s)
        links = scratch.save(links.union(more).distinct(), f"links-{k}")
        turned = found.select(F.col("b").alias("a"), F.col("a").alias("b"), "c").union(found.select("a", "b", "c")).withColumn("born", F.lit(k))
        graph = scratch.save(_best(graph.select("a", "b", "c", "born").union(turned), s, k), f"graph-{k}")
        scratch.drop(f"found-{k}", f"graph-{k - 1}", f"links-{k - 1}", "start")
        if k < s.rounds:
            continue
        grouped = _grouped(scratch, nodes, links, f"{k}")
        recall = _recall(grouped, s, scratch, k)
        if recall is not None and recall >= s.recall:
            break
    else:
        links = scratch.save(_all_links(nodes, s).distinct(), "links-all")
        grouped = _grouped(scratch, nodes, links, "all")
    counts = _count_links(grouped, s)
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("low"))
    known = grouped.join(smallest, "component").join(counts, "node", "left")
    known = known.select("label", "v", F.col("low").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    found = own.join(known, ["label", "v"], "left")
    named = F.col("id").isNotNull()
    found = found.select(
        F.col("id").alias(id_col),
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(named, F.coalesce("component_id", "id")).alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
