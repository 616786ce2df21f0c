"""Exact dedup by content sort.

Texts are normalised by deleting blanks. Sampled splitters range-partition the rows by the
first bytes of the normalised text, a hash of all of it and a hash of the row; Spark's
external sort then puts equal texts next to each other, and each text is compared in full
with the one before it. The hash of the text only spreads texts that begin alike; it decides
nothing. The hash of the row lets the splitters cut a group of copies, so one that holds a
third of the table is spread over a third of the tasks.

A group that is cut lies at the ends of its partitions. Only there a text is carried on: once
for each partition, to a second, small sort whose neighbours are compared in full again. The
table itself passes the shuffle once; what follows are ids and lengths.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, saved, sliced

_BLANK_BYTES = b" \t\n\x0b\x0c\r"
_PREFIX = 32  # bytes of a text in a splitter

_KEYED = "prefix binary, tie long, norm binary, n_points int, doc_id long"
_RUNS = "part int, run long, first boolean, shared boolean, doc_id long, n_points int, keep_id long, keep_points int, n long, digest binary, prefix binary, tie long, norm binary"
_MERGED = "part int, run long, keep_id long, n long, wins boolean"


def _tie(norm: bytes) -> int:
    return xxhash.xxh64_intdigest(norm) - 2**63


def _order(n_points: int, doc_id: int | None) -> tuple:
    """Sorts the row that stays first: most code points, then smallest id, null last."""
    return (-n_points, doc_id is None, doc_id or 0)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(_KEYED)
    for batch in sliced(batches):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        norms = [x.encode("utf-8").translate(None, _BLANK_BYTES) for x in texts]
        yield _batch(
            {"prefix": [x[:_PREFIX] for x in norms], "tie": [_tie(x) for x in norms], "norm": norms, "n_points": [len(x) for x in texts], "doc_id": batch.column("doc_id")}, schema
        )


class _Run:
    """Rows of one text in one partition: ids and lengths, and the text once."""

    def __init__(self, number: int, prefix: bytes, tie: int, norm: bytes):
        self.number, self.prefix, self.tie, self.norm = number, prefix, tie, norm
        self.ids, self.nulls, self.points = array("q"), array("b"), array("i")
        self.best, self.at = None, 0

    def add(self, doc_id: int | None, n_points: int) -> None:
        mine = _order(n_points, doc_id)
        if self.best is None or mine < self.best:
            self.best, self.at = mine, len(self.ids)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.points.append(n_points)

    def rows(self, part: int, shared: bool, size: int = 10_000) -> Iterator[dict[str, list]]:
        """Columns of its rows, some at a time; a shared run's text goes with its first row."""
        digest = hashlib.sha256(self.norm).digest()
        keep_id = None if self.nulls[self.at] else self.ids[self.at]
        for lo in range(0, len(self.ids), size):
            ids, nulls, points = (x[lo : lo + size].tolist() for x in (self.ids, self.nulls, self.points))
            n = len(ids)
            first = [i == self.at for i in range(lo, lo + n)]
            carried = [shared and x for x in first]
            yield {
                "part": [part] * n, "run": [self.number] * n, "first": first, "shared": [shared] * n, "doc_id": [None if z else i for i, z in zip(ids, nulls)], "n_points": points,
                "keep_id": [keep_id] * n, "keep_points": [self.points[self.at]] * n, "n": [len(self.ids)] * n, "digest": [digest] * n,
                "prefix": [self.prefix if x else None for x in carried], "tie": [self.tie] * n, "norm": [self.norm if x else None for x in carried],
            }


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (prefix, tie, norm). Runs of equal texts, neighbours compared in
    full; runs of the partition's first and last (prefix, tie) may go on in another one."""
    schema, part = _schema(_RUNS), TaskContext.get().partitionId()
    number, first_key, run = 0, None, None
    held: list[_Run] = []  # runs of the last key so far, the current one at the end
    out: dict[str, list] = {name: [] for name in schema.names}

    def put(runs: list[_Run], last: bool) -> Iterator[pa.RecordBatch]:
        for x in runs:
            for columns in x.rows(part, last or (x.prefix, x.tie) == first_key):
                for name, values in columns.items():
                    out[name] += values
                if len(out["run"]) >= 2_000:
                    yield _batch(out, schema)
                    for values in out.values():
                        values.clear()

    for batch in sliced(batches):
        for prefix, tie, norm, n_points, doc_id in zip(*(batch.column(c).to_pylist() for c in ("prefix", "tie", "norm", "n_points", "doc_id"))):
            if run is None or norm != run.norm:
                key = (prefix, tie)
                first_key = first_key or key
                if held and key != (held[0].prefix, held[0].tie):
                    yield from put(held, False)
                    held = []
                run = _Run(number, prefix, tie, norm)
                number += 1
                held.append(run)
            run.add(doc_id, n_points)
    yield from put(held, True)
    yield _batch(out, schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared runs, sorted by (prefix, tie, norm), one row each: equal neighbours are one
    group. Its best run wins, its sizes add up."""
    schema = _schema(_MERGED)
    norm, group = None, []

    def result() -> pa.RecordBatch:
        best = min(group, key=lambda r: (_order(r[2], r[3]), r[0], r[1]))
        n = sum(r[4] for r in group)
        return _batch({"part": [r[0] for r in group], "run": [r[1] for r in group], "keep_id": [best[3]] * len(group), "n": [n] * len(group), "wins": [r is best for r in group]}, schema)

    for batch in sliced(batches, 100):
        for text, *row in zip(*(batch.column(c).to_pylist() for c in ("norm", "part", "run", "keep_points", "keep_id", "n"))):
            if group and text != norm:
                yield result()
                group = []
            norm = text
            group.append(row)
    if group:
        yield result()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept,
    text_sha256.

    Texts are equal when identical without [\\x20\\x09-\\x0D]. Of equal texts the row
    with the most code points, then the smallest doc_id, stays. Null text counts as
    empty, and all empty texts are one group. A null doc_id stays only if the whole
    group has none. Rows that repeat doc_id and length of the row that stays count in
    group_size, but one of them only is kept. Texts may be as long as a task can hold one
    of; two are compared at a time. An empty table gives an empty result; further columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_for(rows)
    order = ["prefix", "tie", "norm"]
    spread = F.xxhash64("doc_id", "n_points")
    sorted_runs = rows.mapInArrow(_normalised, _KEYED).repartitionByRange(parts, "prefix", "tie", spread).sortWithinPartitions(*order).mapInArrow(_runs, _RUNS)
    found = saved(sorted_runs, "runs")
    # at most two texts of a partition and those that share their hash
    shared = found.where("shared and first").select(*order, "part", "run", "keep_points", "keep_id", "n")
    merged = saved(shared.repartitionByRange("prefix", "tie").sortWithinPartitions(*order).mapInArrow(_merge, _MERGED), "merged")
    own = found.where("not shared").select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("first").alias("kept"), "digest")
    cut = found.where("shared").drop("keep_id", "n").join(merged, ["part", "run"])
    cut = cut.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("first") & F.col("wins")).alias("kept"), "digest")
    return own.unionByName(cut).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
