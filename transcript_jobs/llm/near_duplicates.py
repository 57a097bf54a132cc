"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_jobs.llm.batches import text_blocks
from transcript_jobs.llm.components import components
from transcript_jobs.plans.scratch import Scratch

FULL = np.uint64(2**64 - 1)
#: Bytes of text whose shingles a task holds at once. What a block needs stays with the Python worker.
BLOCK_BYTES = 500_000
#: Cells of the matrix of shingles that a unit multiplies at once (4 bytes each, two copies), and cells of its result that are judged at once.
MATRIX_CELLS, JUDGED_CELLS = 2_000_000, 65_536


@dataclass(frozen=True)
class Settings:
    """Documents are linked if ``100 * intersection >= percent * union`` of their sets of ``words``-word shingles.

    A sketch has ``bands * width`` coordinates. At a similarity of 0.85 two documents
    share none of 32 bands of 5 with a probability of 7e-9, at 0.8 with 3e-6. ``least``
    is the share of equal coordinates under which a candidate is not verified: six
    standard deviations below the threshold. ``block`` is how many documents a unit of
    the block comparison has on each side, ``weight`` how many shingles they may have
    together; both up to twice that.
    """

    words: int = 3
    percent: int = 85
    bands: int = 32
    width: int = 5
    block: int = 512
    weight: int = 1_500_000

    @property
    def size(self) -> int:
        return self.bands * self.width

    @property
    def least(self) -> float:
        p = self.percent / 100
        return p - 6 * (p * (1 - p) / self.size) ** 0.5


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as sorted 64-bit hashes, one text after the other, and how many each has.

    A to Z become small; words stand between white space of ASCII. A text with fewer
    words has all of them as its one shingle; one without words has none.
    """
    lists = pa.array([t.encode().lower().split() if t else [] for t in texts.to_pylist()], pa.list_(pa.binary()))
    n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    word = hashed[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    starts = np.cumsum(n_words) - n_words
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(n)), n)
    at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    shingle = mix(word[at], 1) if len(at) else np.zeros(0, np.uint64)
    length = np.minimum(n_words[owner], words)
    for k in range(1, words):
        here = np.flatnonzero(length > k)
        shingle[here] = mix(shingle[here] ^ mix(word[at[here] + k], k + 1), 101)
    short = length < words
    shingle[short] = mix(shingle[short], 999)
    ends = np.cumsum(n)
    for s, e in zip((ends - n).tolist(), ends.tolist()):
        shingle[s:e].sort()
    first = np.ones(len(shingle), bool)
    first[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[first], np.bincount(owner[first], minlength=len(n)).astype(np.int64)


def sketches(sets: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """A row of ``size`` coordinates for each non-empty set.

    In round i every element is thrown into a bin by a fresh hash, and a bin keeps the
    least value of the first round that reaches it; from round ``size`` on the
    elements all go to the one bin i - size, so that every coordinate fills in at
    most 2 * size rounds. Sets whose coordinates are full take no part in later rounds.
    """
    n = len(sizes)
    out = np.full(n * size, FULL, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    todo = sets
    for i in range(2 * size):
        if not len(todo):
            break
        h = mix(todo, 1000 + i)
        bins = (h % np.uint64(size)).astype(np.int64) if i < size else np.full(len(h), i - size)
        np.minimum.at(out, owner * size + bins, (np.uint64(i) << np.uint64(52)) | (h >> np.uint64(12)))
        open_ = (out.reshape(n, size) == FULL).any(axis=1) & (sizes > 0)
        keep = open_[owner]
        todo, owner = todo[keep], owner[keep]
    return out.reshape(n, size)


def set_names(sets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set: sums over its elements, whatever their order."""
    ends = np.cumsum(sizes)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets, k), dtype=np.uint64)]) for k in (7, 8)]
    return [(x[ends] - x[ends - sizes]).view(np.int64) for x in sums]


def _sketch_rows(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """For each row: a hash of its text, its set's size, a 128-bit hash of the set, its band keys, and eight bits of each coordinate."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            sets, sizes = shingle_sets(block.column(1), s.words)
            sk = sketches(sets, sizes, s.size)
            names = set_names(sets, sizes)
            keys = np.zeros((len(sizes), s.bands), np.uint64)
            for w in range(s.width):
                keys = mix(keys ^ mix(sk[:, w :: s.width], w), 55)
            keys = mix(keys ^ np.arange(s.bands, dtype=np.uint64), 56).view(np.int64)
            low = mix(sk.reshape(-1), 57).astype(np.uint8).tobytes()
            offsets = pa.array(np.arange(len(sizes) + 1) * s.bands, pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)), mask=pa.array(sizes == 0))
            bits = pa.array([low[k * s.size : (k + 1) * s.size] for k in range(len(sizes))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(2), pa.array(sizes), *(pa.array(x) for x in names), listed, bits],
                ["id", "text_hash", "n", "set1", "set2", "keys", "bits"],
            )

    return rows.mapInArrow(run, "id long, text_hash long, n long, set1 long, set2 long, keys array<long>, bits binary")


def _alike(pairs: DataFrame, s: Settings) -> DataFrame:
    """Those pairs whose sketches are not clearly too different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, s.size) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= s.least))

    return pairs.select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """The full sets of the classes ``wanted`` (rep, id, set1, set2), made again from the texts of their ids alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            sets, sizes = shingle_sets(block.column(1), s.words)
            same = np.all([x == block.column(k).to_numpy() for x, k in zip(set_names(sets, sizes), (2, 3))], axis=0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            out = pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(offsets, pa.array(sets.view(np.int64)))], ["rep", "shingles"])
            yield out.filter(pa.array(same))

    return rows.select("rep", "text", "set1", "set2").mapInArrow(run, "rep long, shingles array<long>").dropDuplicates(["rep"])


def _star_links(docs: DataFrame, pairs: DataFrame, about: DataFrame, s: Settings, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough, after what sizes and sketches rule out."""
    sides = [about.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"]
    near = pairs.join(sides[0], "a").join(sides[1], "b").where(100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b"))
    likely = scratch.save(_alike(near, s), "star-pairs")
    wanted = about.join(likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi").select("rep", "id", "set1", "set2")
    sets = scratch.save(_sets(docs, wanted, s, id_col, text_col), "star-sets")
    one, two = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    joined = likely.join(one, "a").join(two, "b")
    links = scratch.save(joined.where(100 * common >= s.percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "star-links")
    scratch.drop("star-sets")
    return links


def _dealt(open_: DataFrame, s: Settings) -> DataFrame:
    """``open_`` with the block of each member: by quantiles of the set's size, and those of one quantile that are too many by a hash.

    Counts and quantiles combine before they are shuffled, so that no task sees all
    members of a center.
    """
    # A number for a slice of each group; slices of members keep the quantiles' sketches apart until they are merged.
    found = open_.groupBy("center", "main").agg(F.count("*").alias("m"), F.percentile_approx("n", F.lit([k / 64 for k in range(1, 64)]), F.lit(1000)).alias("cuts")).where(F.col("m") > s.block)
    # Of 64 quantiles as many as there are blocks, at equal distances.
    step = F.greatest(F.lit(1), F.floor(F.lit(64) / F.ceil(F.col("m") / s.block))).cast("int")
    cuts = F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % step == 0))
    large = found.select("center", "main", cuts.alias("cuts"))
    placed = open_.join(large, ["center", "main"], "left").withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("n"))), F.lit(0))).drop("cuts")
    full = placed.groupBy("center", "main", "slice").agg(F.count("*").alias("count"), F.sum("n").alias("size")).where((F.col("count") > 2 * s.block) | (F.col("size") > 2 * s.weight))
    full = full.select("center", "main", "slice", F.greatest(F.ceil(F.col("count") / s.block), F.ceil(F.col("size") / s.weight)).alias("pieces"))
    placed = placed.join(full, ["center", "main", "slice"], "left")
    piece = F.coalesce(F.pmod(F.xxhash64("rep", F.lit(9)), F.col("pieces")), F.lit(0))
    return placed.withColumn("block", F.concat_ws(".", F.lpad(F.col("slice").cast("string"), 3, "0"), F.lpad(piece.cast("string"), 8, "0"))).drop("slice", "pieces")


def unit_links(table: pa.Table, percent: int) -> pa.Table:
    """A tree of links (a, b) for each component that a unit's links join: rows of ``rep, component, side, same, shingles``."""
    rep, comp, side = (table[c].to_numpy() for c in ("rep", "component", "side"))
    lists = table["shingles"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    left = np.flatnonzero(side == 1)
    right = left if table["same"][0].as_py() else np.flatnonzero(side == 2)
    common = _common(lists.flatten().to_numpy(), sizes, left, right)
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    out = []
    step = max(1, JUDGED_CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        both = common[at : at + step].astype(np.int64)
        linked = (100 * both >= percent * (sizes[rows][:, None] + sizes[right][None] - both)) & (comp[rows][:, None] != comp[right][None])
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
            a, b = int(rep[rows[i]]), int(rep[right[j]])
            x, y = find(a), find(b)
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((a, b))
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _common(flat: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of ``left`` has in common with each of ``right``: sets stand in ``flat`` one after the other.

    Elements of one set alone count for no pair and take no part in the products.
    """
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times > 1
    here = several[code]
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[here]
    code = (np.cumsum(several) - 1)[code[here]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    # Integers: sums in single precision would be exact to 2**24 alone.
    common = np.zeros((len(left), len(right)), np.int32)
    width = max(256, MATRIX_CELLS // max(1, len(sizes)))
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        some = slice(*np.searchsorted(code, [at, at + width]))
        has = np.zeros((len(sizes), width), np.float32)
        has[owner[some], code[some] - at] = 1
        one = has[left]
        common += (one @ (one if left is right else has[right]).T).astype(np.int32)
    return common


def _block_links(docs: DataFrame, open_: DataFrame, about: DataFrame, s: Settings, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Links between components among the members of each center: ``open_`` has (center, rep, component, main).

    A center's members are dealt to blocks of like size, those that are joined to it
    (main) apart from the rest. Pairs of blocks, but for two of main members, are
    units of work, unless their sizes alone rule links out. A unit intersects all its
    full sets by one matrix product and returns a tree of links for each component it
    joins, so that its output is no larger than its blocks.
    """
    dealt = scratch.save(_dealt(open_.join(about.select("rep", "n"), "rep"), s), "dealt")
    blocks = dealt.groupBy("center", "main", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sides = [blocks.select("center", *[F.col(c).alias(f"{c}{k}") for c in ("main", "block", "low", "high")]) for k in (1, 2)]
    order = F.struct("main1", "block1") <= F.struct("main2", "block2")
    fits = (100 * F.col("high1") >= s.percent * F.col("low2")) & (100 * F.col("high2") >= s.percent * F.col("low1"))
    units = sides[0].join(sides[1], "center").where(order & ~(F.col("main1") & F.col("main2")) & fits)
    units = units.withColumn("same", (F.col("main1") == F.col("main2")) & (F.col("block1") == F.col("block2")))
    ends = F.array(F.struct(F.lit(1).alias("side"), F.col("main1").alias("main"), F.col("block1").alias("block")), F.struct(F.lit(2).alias("side"), F.col("main2").alias("main"), F.col("block2").alias("block")))
    asked = units.select("center", F.concat_ws(":", F.col("main1").cast("string"), "block1", F.col("main2").cast("string"), "block2").alias("unit"), "same", F.inline(ends)).where(~F.col("same") | (F.col("side") == 1))
    wanted = about.join(dealt.select("rep").distinct(), "rep", "left_semi").select("rep", "id", "set1", "set2")
    sets = scratch.save(_sets(docs, wanted, s, id_col, text_col), "block-sets")
    rows = asked.join(dealt.select("center", "main", "block", "rep", "component"), ["center", "main", "block"]).join(sets, "rep")
    # One key for a unit, so that the units of a center are dealt to all tasks.
    rows = rows.withColumn("unit", F.struct("center", "unit"))

    def run(table: pa.Table) -> pa.Table:
        return unit_links(table, s.percent)

    links = scratch.save(rows.select("unit", "rep", "component", "side", "same", "shingles").groupBy("unit").applyInArrow(run, "a long, b long"), "block-links")
    scratch.drop("block-sets")
    return links


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near copies: ``id_col, n_shingles, component_id, kept``, a row for each row.

    ``component_id`` is the smallest id reachable by links, ``kept`` whether it is the
    row's own. Null and empty texts, and texts without words, have no shingles and no
    links. A row with a null id is linked with nothing, has a null component and is
    kept. Rows that repeat an id are rows like any other, each with the component of
    its own text. A last column ``text_hash`` (xxhash64 of the text) tells them apart.
    Other columns are ignored; an empty table gives no rows.

    Documents with one and the same set form a class, which has a number.
    Representatives that share a band key form a bucket. Its center is the member that
    shares most buckets with others, and is compared with all members of its buckets,
    not all pairs; links join documents to components. Members of one center that are
    still in different components are then compared with each other in blocks, each
    pair of documents at most once for a center and none within a component. Every
    pair of a bucket is thus compared, or already joined. Links are confirmed on full
    sets.
    """
    s, spark = settings, docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    sk = scratch.save(_sketch_rows(docs, s, id_col, text_col), "sketches")
    usable = sk.where("id IS NOT NULL AND n > 0")
    first = F.min_by(F.struct("id", "n", "keys", "bits"), "id").alias("r")
    # The number is drawn once and written; whatever reads it later sees the same one.
    reps = usable.groupBy("set1", "set2").agg(first).select(F.monotonically_increasing_id().alias("rep"), "r.id", "set1", "set2", "r.n", "r.keys", "r.bits")
    reps = scratch.save(reps, "classes")
    about = reps.select("rep", "id", "set1", "set2", "n", "bits")

    bands = reps.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.save(bands.join(shared, "key"), "members")
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    centers = members.join(degree, "rep").groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("center"))
    near = scratch.save(members.join(centers, "key").where("rep <> center").select("center", "rep").distinct(), "near-centers")
    links = _star_links(docs, near.select(F.col("center").alias("a"), F.col("rep").alias("b")), about, s, scratch, id_col, text_col)
    joined = scratch.save(components(scratch, links, "star-components"), "joined-1")

    # What is left: members of one center in different components.
    own = joined.select(F.col("node").alias("rep"), "component")
    named = near.join(own, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = named.join(own.select(F.col("rep").alias("center"), F.col("component").alias("main_component")), "center", "left")
    named = named.select("center", "rep", "component", (F.col("component") == F.coalesce("main_component", "center")).alias("main"))
    several = named.groupBy("center").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("center")
    open_ = scratch.save(named.join(several, "center", "left_semi"), "open")
    more = _block_links(docs, open_, about, s, scratch, id_col, text_col)
    if not more.isEmpty():
        joined = components(scratch, links.union(more), "all-components")

    groups = reps.select("rep", "id", "set1", "set2").join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = groups.groupBy("component").agg(F.min("id").alias("component_id"))
    groups = groups.join(lowest, "component").select("set1", "set2", "component_id")
    linked = usable.select("id", "n", "text_hash", "set1", "set2").join(groups, ["set1", "set2"]).select("id", "n", "component_id", "text_hash")
    alone = sk.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"), "text_hash")
    found = linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "text_hash")
    kept = F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    return found.select(id_col, "n_shingles", "component_id", kept.alias("kept"), "text_hash")
