"""Token-ID files: canonical length-limited Huffman codes over global id counts.

A file set is a folder with two Parquet tables:

* ``codebook(id, length)``: code lengths; canonical codes follow from them (shorter codes
  first, then smaller ids).
* ``blocks(part, seq, start, doc_ids, n_tokens, checkpoints, payload)``: whole documents
  in ascending doc_id order, at least ``BLOCK`` tokens where there are so many. ``payload``
  is the bit string of all ids, ``checkpoints`` the bits (unsigned 16) between every
  ``STRIDE``-th id, so a block decodes alone and its lanes decode side by side. ``start``
  counts ids before the block inside its part; parts follow one another.

Each text is encoded once; the ids go to the shared folder, are counted there, and are
read again for the range partitioning by doc_id. What passes the driver is one number per
vocabulary id. A lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokenizing
from .common import freed, parts_for, saved, sliced, small_batches

BLOCK = 65_536
STRIDE = 64

_BLOCKS = "part int, seq int, start long, doc_ids array<bigint>, n_tokens array<int>, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for unused ids."""
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.uint8)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, []
    for _ in range(limit):
        is_leaf.append(np.ones(n, bool) if not is_leaf else flags)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level, flags = both[by], by < n
    take = 2 * (n - 1)
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, right-aligned."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    used = np.flatnonzero(lengths)
    for i in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(checkpoints, payload) of a block."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    offsets = ends - n
    word = offsets >> 5
    values = codes[ids].astype(np.uint64) << (64 - n - (offsets & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))  # of the codes that start in one word of 32 bits; bits don't overlap
    values = np.add.reduceat(values, first) if len(first) else values
    bits = int(ends[-1]) if len(ends) else 0
    words = np.zeros((bits >> 5) + 2, np.uint64)
    words[word[first]] = values >> np.uint64(32)
    words[word[first] + 1] += values & np.uint64(0xFFFFFFFF)
    payload = words.astype(">u4").tobytes()[: bits + 7 >> 3]
    return np.diff(offsets[::STRIDE], prepend=0).astype("<u2").tobytes(), payload


class Decoder:
    """Decodes blocks with one table look-up per id."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        spans = 1 << (self.bits - lengths[used].astype(np.int64))
        self.ids = np.zeros(1 << self.bits, np.uint32)
        self.steps = np.ones(1 << self.bits, np.int64)
        filled = int(spans.sum())  # canonical codes fill the table from its start
        self.ids[:filled] = np.repeat(used, spans)
        self.steps[:filled] = np.repeat(lengths[used], spans)
        del codes

    def unpack(self, n: int, checkpoints: bytes, payload: bytes) -> np.ndarray:
        at = np.cumsum(np.frombuffer(checkpoints, "<u2"), dtype=np.int64)
        raw = np.frombuffer(payload + bytes(STRIDE * 4 + 8), np.uint8).astype(np.uint32)
        words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.empty((len(at), STRIDE), np.uint32)
        shift, mask, last = 32 - self.bits, (1 << self.bits) - 1, len(words) - 1
        for k in range(STRIDE):
            code = words[np.minimum(at >> 3, last)] >> (shift - (at & 7)).astype(np.uint32) & mask
            out[:, k] = self.ids[code]
            at = at + self.steps[code]
        return out.reshape(-1)[:n]


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        model = tokenizing.encoder(vocabulary)
        for batch in batches:
            at = 0
            for ids, begins in model.groups(batch.column("text")):
                n, ids = np.diff(begins) + 1, _ended(ids, begins[1:], end_id)
                offsets = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
                data = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(n)), pa.array(n, pa.int32()), data], names=["doc_id", "n", "ids"])
                at += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return saved(rows.mapInArrow(encode, "doc_id long, n int, ids binary"), "ids")


def _ended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """Ids with ``end_id`` at each end; two bytes an id where all fit, else four: the count of ids tells which."""
    narrow = max(int(ids.max(initial=0)), end_id) < 1 << 16
    return np.insert(ids.astype("<u2" if narrow else "<u4", copy=False), ends, end_id)


def _wide(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _counts(encoded: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in sliced(batches):
            joined: dict[bool, list[bytes]] = {True: [], False: []}
            for ids, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist()):
                joined[len(ids) == 2 * n].append(ids)
            for narrow, found in joined.items():
                more = np.bincount(np.frombuffer(b"".join(found), "<u2" if narrow else "<u4"))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = encoded.select("n", "ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in found), default=-1) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode every whole text of ``docs(doc_id, text)``, end each document with
    ``end_id``, and write the files to ``path`` in ascending doc_id order.

    Null text is empty: only the end id. Null ids come first; equal ids lie next to each
    other, ordered by a hash of their tokens. An empty table writes empty tables.
    Whole texts are encoded, however long; further columns are ignored, whatever their names.
    ``vocabulary`` must be readable at this path by every executor.
    """
    spark = docs.sparkSession
    encoded = _encoded(docs, vocabulary, end_id)
    counts = _counts(encoded)
    limit = max(16, int(np.count_nonzero(counts)).bit_length() + 2)
    lengths = code_lengths(counts, limit)
    codes = canonical_codes(lengths)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def block() -> pa.RecordBatch:
            stream = np.concatenate(ids)
            values = [part, seq, start, doc_ids, [len(x) for x in ids], *pack(stream, lengths, codes)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=_names(_BLOCKS))

        for batch in sliced(batches):
            for doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                ids.append(_wide(data, n))
                doc_ids.append(doc_id)
                size += n
                if size >= BLOCK:
                    yield block()
                    seq, start, size, ids, doc_ids = seq + 1, start + size, 0, [], []
        if ids:
            yield block()

    parts = parts or parts_for(encoded)
    rows = (
        encoded.withColumn("tie", F.xxhash64("ids"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "ids")
        .select("doc_id", "n", "ids")
    )
    with small_batches(spark):
        rows.mapInArrow(blocks, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set: doc_id, start (ids of all documents before
    it), n_tokens (with the end id), ids (little-endian unsigned 32-bit integers)."""
    book = spark.read.schema("id int, length int").parquet(f"{path}/codebook").collect()  # a row per vocabulary id
    lengths = np.zeros(max((r["id"] for r in book), default=-1) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in sliced(batches, 16):  # a row is a block
            for row in batch.to_pylist():
                n = np.array(row["n_tokens"], np.int64)
                data = decoder.unpack(int(n.sum()), row["checkpoints"], row["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(n)
                cut = [data[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(cut, pa.binary())],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "ids"],
                )

    stored = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # a row for each part: as many as the writer's partitions, so the broadcast is bounded
    sizes = stored.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    docs = stored.select(*_names(_BLOCKS)).mapInArrow(decode, "part int, doc_id long, start_in_part long, n_tokens long, ids binary")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")
