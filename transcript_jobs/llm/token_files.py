"""Token ids in block files: one shared dictionary, each document compressed alone, with an offset index."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_jobs.llm.batches import gather, text_blocks
from transcript_jobs.llm.bpe import byte_letters, tokenizer_text
from transcript_jobs.llm.fingerprints import labels_apart

#: What the lower-casing tokenizer cuts off letters and white space, in texts of plain Latin letters alone. The capital dotted I becomes two letters.
BESIDE_LETTERS = r"('(?:s|t|re|ve|m|ll|d)|[^\s\x{a0}\pL\pN]+|\pN)"
PLAIN = r"\A[\t\n\r\x20-\x7e\x{a0}-\x{12f}\x{131}-\x{24f}]*\z"

#: Bytes of text encoded at once.
BLOCK_BYTES = 2_000_000
BLOCKS = "file_part int, block int, first_token long, n_tokens long, dictionary string, doc_ids array<{id}>, token_counts array<int>, offsets array<int>, frames binary"


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct word lately seen once.

    Texts in plain Latin letters are cut into words by Arrow, which the library's
    model then encodes. A tokenizer that drops white space and splits at it encodes
    the chunks between the spaces of other texts alone. The texts of any other
    tokenizer go to the library whole.
    """

    def __init__(self, text: str, memory: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(text)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and first["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and steps == ["NFC", "Replace", "Lowercase"]
            and spec.get("post_processor") is None
            and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        )
        self.letters = byte_letters()
        self.memory = memory
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def model(self, words: list[str]) -> list[bytes]:
        """Ids of words that the library's normalizer and pre-tokenizer would hand to its model as they are."""
        tokenize, letter = self.tokenizer.model.tokenize, self.letters.__getitem__
        ids = [[t.id for t in tokenize(w if w.isascii() else "".join(map(letter, w.encode())))] for w in words]
        ends = (4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist()
        raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return [raw[s:e] for s, e in zip([0, *ends], ends)]

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            ids = self.library(texts.to_pylist())
            return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|")))
        sides = [(plain, self._words), (pc.invert(plain), self._chunks)]
        flat, sizes, order = [], [], []
        for side, lists_of in sides:
            at = np.flatnonzero(side.to_numpy(zero_copy_only=False))
            if len(at):
                ids, ends = self._gathered(*lists_of(texts if len(at) == len(texts) else texts.take(pa.array(at))))
                flat.append(ids)
                sizes.append(np.diff(np.concatenate([[0], ends])))
                order.append(at)
        if len(order) < 2:
            return (flat[0], np.cumsum(sizes[0])) if flat else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        sizes, back = np.concatenate(sizes), np.argsort(np.concatenate(order))
        at, ends = gather(np.cumsum(sizes) - sizes, sizes, back)
        return np.concatenate(flat)[at], ends

    def _gathered(self, lists: pa.ListArray, codes: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of lists of codes, and where each list's ids end; ``ids`` has those of each code."""
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at, after = gather(np.cumsum(sizes) - sizes, sizes, codes)
        return np.frombuffer(b"".join(ids), "<u4")[at], np.concatenate([[0], after])[ends]

    def _words(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, list[bytes]]:
        """The words of plain texts, cut by Arrow alone, with the ids of each distinct one."""
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), BESIDE_LETTERS, r" \1 "))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        return lists, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), self._known(self.words, words, self.model)

    def _chunks(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, list[bytes]]:
        """The chunks between the spaces of any texts, with the ids that the library gives each distinct one."""
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        chunks = flat.dictionary.to_pylist()
        return lists, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), self._known(self.chunks, chunks, self.library)

    def _known(self, memo: dict[str, bytes], items: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each item, from ``memo`` or else encoded; a full memo keeps what these items need."""
        ids = list(map(memo.get, items))
        at = [k for k, x in enumerate(ids) if x is None]
        new = [items[k] for k in at]
        found = encode(new)
        for k, x in zip(at, found):
            ids[k] = x
        if len(memo) + len(new) > self.memory:
            memo.clear()
            memo.update(zip(items, ids))
        else:
            memo.update(zip(new, found))
        return ids


@lru_cache(maxsize=2)
def chunk_encoder(text: str) -> ChunkEncoder:
    return ChunkEncoder(text)


def train_dictionary(docs: DataFrame, shared, end_id: int, id_col: str, text_col: str, width: int, sample: int = 2000, bytes_each: int = 16_384, size: int = 65_536) -> bytes:
    """A compression dictionary from a bounded sample: the ``sample`` documents of the lowest hashes, ``bytes_each`` of serialized ids from each at most.

    Of a longer document pieces are taken evenly from its whole length. The bounds
    hold whatever the corpus; compression alone depends on it, no result does.
    """
    order = F.xxhash64(F.col(id_col), F.lit(7))
    chosen = docs.select(F.col(id_col).alias("id")).where(F.col(id_col).isNotNull()).orderBy(order, "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.distinct()), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(shared.value)
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            ids, ends = enc.encode(block.column(1))
            ids = ids.astype(f"<u{width}")
            starts = np.concatenate([[0], ends[:-1]])
            out = [_spread(np.append(ids[s:e], np.array([end_id], ids.dtype)), bytes_each // width) for s, e in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    samples = [r[0] for r in rows.mapInArrow(run, "ids binary").orderBy(F.crc32("ids"), "ids").limit(sample).collect()]
    try:
        return zstandard.train_dictionary(size, [bytes(s) for s in samples]).as_bytes()
    except zstandard.ZstdError:
        # Too few samples to train on: their own bytes serve as the dictionary.
        return b"".join(bytes(s) for s in samples)[:size]


def _spread(ids: np.ndarray, most: int, piece: int = 512) -> bytes:
    """At most ``most`` ids as bytes, in pieces at equal distances."""
    if len(ids) <= most:
        return ids.tobytes()
    starts = np.linspace(0, len(ids) - piece, max(1, most // piece)).astype(np.int64)
    return np.concatenate([ids[s : s + piece] for s in starts]).tobytes()


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 500_000, parts: int | None = None
) -> None:
    """Encode whole texts and write their ids to ``path`` in ascending order of ``id_col``.

    The format, in two Parquet folders: ``dictionary`` holds the shared zstandard
    dictionary with its SHA-256, the bytes of an id and the end id; ``blocks`` holds
    blocks of documents in order. A block has the dictionary's hash, the documents'
    ids, their token counts, the offset of each document's frame and the frames, each
    compressed alone, so that one document is read by one slice.

    ``end_id`` closes each document; a null text has no other id. Documents with a
    null id come first; repeated ids are ordered by their frames. Ids are integers. An
    empty table gives no blocks. Documents are dealt to parts by quantiles of the id and
    shuffled compressed; a part's ids before each block are counted as it is written.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_text(spark, tokenizer_path))
    spec = json.loads(shared.value)
    width = 2 if max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) < 65_536 else 4
    trained = train_dictionary(docs, shared, end_id, id_col, text_col, width)
    sha = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(sha, trained, width, end_id)], "sha256 string, dictionary binary, id_bytes int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    dictionary = spark.sparkContext.broadcast(trained)

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(id_col, [k / n for k in range(1, n)] or [0.5], 20 * n)).head()[0] or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64)
    # A part is a partition of its own: hashing the parts themselves would put several into one and leave others empty.
    labels = np.array(labels_apart(spark, n), dtype=np.int32)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cctx = chunk_encoder(shared.value), _compressor(dictionary.value)
        end = np.array([end_id], f"<u{width}").tobytes()
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            ids, ends = enc.encode(block.column(1))
            raw = ids.astype(f"<u{width}").tobytes()
            stops = (width * ends).tolist()
            frames = [cctx.compress(raw[s:e] + end) for s, e in zip([0, *stops], stops)]
            known = pc.fill_null(block.column(0), -(2**63) if kind == "bigint" else -(2**31)).to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts, known, side="right").astype(np.int32)
            counts = np.diff(np.concatenate([[0], ends])) + 1
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(labels[part]), block.column(0), pa.array(counts, pa.int32()), pa.array(frames, pa.binary())], ["file_part", "label", "id", "n", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, held, size = None, 0, 0, [], 0

        def flush():
            nonlocal block, before, held, size
            ids, counts, frames = zip(*held)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            row = [[part], [block], [before], [sum(counts)], [sha], [list(ids)], [list(counts)], [offsets], [b"".join(frames)]]
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], [f.name for f in schema])
            block, before, held, size = block + 1, before + sum(counts), [], 0
            return out

        for batch in batches:
            types[5] = pa.list_(batch.schema.field("id").type)
            for p, _, i, c, f in zip(*(x.to_pylist() for x in batch.columns)):
                if held and (p != part or size >= block_tokens):
                    yield flush()
                if p != part:
                    part, block, before = p, 0, 0
                held.append((i, c, f))
                size += c
        if held:
            yield flush()

    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), None, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    schema = spark.createDataFrame([], BLOCKS.format(id=kind)).schema
    (
        rows.mapInArrow(encode, f"file_part int, label int, id {kind}, n int, frame binary")
        .repartition(n, "label")
        .sortWithinPartitions("file_part", F.col("id").asc_nulls_first(), "frame")
        .mapInArrow(pack, schema)
        .write.parquet(f"{path}/blocks")
    )


def _compressor(trained: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=_dictionary(trained), write_checksum=False) if trained else zstandard.ZstdCompressor(level=3)


def _dictionary(trained: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(trained)


def read_token_files(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """Read documents back: ``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (little-endian 32-bit integers).

    With ``doc_ids`` only blocks that hold one of them are opened, and only their
    frames are decompressed. A block written with another dictionary is an error.
    """
    head = spark.read.parquet(f"{path}/dictionary").head()
    trained, sha, width = spark.sparkContext.broadcast(bytes(head["dictionary"])), head["sha256"], head["id_bytes"]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # One row for each part: their number is a setting of the writer and does not follow the data.
    totals = blocks.groupBy("file_part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(F.broadcast(totals.select("file_part", before.alias("part_start"))), "file_part")
    if doc_ids is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast(kind) for i in doc_ids])))
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = trained.value
        dctx = zstandard.ZstdDecompressor(dict_data=_dictionary(data)) if data else zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != sha:
                    raise ValueError(f"a block of part {row['file_part']} needs dictionary {row['dictionary']}")
                start, out = row["part_start"] + row["first_token"], ([], [], [])
                for i, n, s, e in zip(row["doc_ids"], row["token_counts"], row["offsets"], row["offsets"][1:]):
                    if wanted is None or i in wanted:
                        ids = np.frombuffer(dctx.decompress(row["frames"][s:e], max_output_size=n * width), f"<u{width}")
                        for column, x in zip(out, (i, start, ids.astype("<u4").tobytes())):
                            column.append(x)
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("doc_ids").type.value_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["doc_id", "start", "ids"])

    narrow = blocks.select("file_part", "dictionary", "part_start", "first_token", "doc_ids", "token_counts", "offsets", "frames")
    return narrow.mapInArrow(run, f"doc_id {kind}, start long, ids binary")
