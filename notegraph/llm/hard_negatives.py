"""Hard negatives out of Hilbert-ordered blocks with zone maps.

Rows are range-partitioned and sorted by their place on a Hilbert curve through the vector
space and written as blocks of some hundred rows, each with the least and the largest value of
every dimension: its zone map. For an anchor, interval arithmetic over a zone map bounds the
inner products of the whole block. A window of scores, such as "0.3 to 0.9 of the positive's",
needs only the blocks whose bounds meet it.

A search has two steps. First each anchor reads, for each window, the blocks of each page of
zone maps whose bounds reach highest into it; the k-th best score found so is a floor. Then
it reads the blocks that can hold a row at or over the floor and inside the window, and no
others. Nothing is approximate: every row is read or proven to be out of the answer.

Anchors stand in tiles, in the order of the curve as well, so that those of a tile need about the
same blocks. Pairs of a tile and a block are known before any block is read; blocks come to
tiles by a join on the block's number, in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_PARTS, parts_for, saved

#: Rows of a block, anchors of a tile, zone maps of a page; bits of each dimension on the curve.
BLOCK, TILE, PAGE, BITS = 512, 256, 256, 2
#: Blocks of a page that an anchor's window reads at first.
FIRST = 2
#: Tiles that meet a page together, blocks that meet a tile together: some 30 MB in a task.
PAGE_TILES, GROUP = 64, 128

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places on the Hilbert curve of points with ``bits`` bits a dimension, as bytes that
    order as the places do (after Skilling, "Programming the Hilbert curve", 2004)."""
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn).astype(np.uint32)
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> (bits - 1 - b)) & 1 for b in range(bits)]).astype(np.uint8)  # bit, dimension, point
    packed = np.packbits(planes.reshape(bits * dims, -1).T, axis=1)
    return [row.tobytes() for row in packed]


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers held as doubles; in four bytes each where that loses nothing."""
    return values.astype("<f4" if np.abs(values).max(initial=0) < 1 << 24 else "<f8").tobytes()


def _unpack(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * rows * dims else "<f8").reshape(rows, dims).astype(np.float64)


def quantised(rows: DataFrame, scale: int = 256, relabel: Column | None = None) -> DataFrame:
    """``rows(vec_id, embedding, label)`` that take part, as (vec_id, label, values): each
    component times ``scale``, to be floored. ``relabel`` is the label to use, by default the row's."""
    label = F.col("label") if relabel is None else relabel
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = plain.where("vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return usable.select("vec_id", "label", F.transform("embedding", lambda x: x * float(scale)).alias("values"))  # floored where they become a matrix


BLOCK_SCHEMA = "block long, n int, dims int, ids binary, labels binary, vectors binary, low binary, high binary"


def write_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of ``quantised`` rows, written: number, rows by id with labels and vectors,
    and their zone map. Vectors shorter than the longest end in zeros."""
    moments = rows.mapInArrow(_moments, "dim int, n long, total double, square double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("s"))
    found = sorted(moments.collect())  # a row for each dimension
    n = max((r["n"] for r in found), default=1)
    dims = len(found)
    mean = np.array([r["t"] / n for r in found])
    spread = np.sqrt(np.maximum([r["s"] / n for r in found] - mean**2, 0)) + 1e-9

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                x = _matrix(part.column("values"), dims)
                cells = np.clip(np.floor((x - mean) / spread + (1 << BITS) / 2), 0, (1 << BITS) - 1)
                keys = pa.array(hilbert_keys(cells) if dims else [b""] * len(x), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), keys, pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "label", "place", "vector"])

    ordered = rows.mapInArrow(keyed, "vec_id long, label long, place binary, vector binary")
    ordered = ordered.repartitionByRange(parts_for(rows), "place", "vec_id").sortWithinPartitions("place", "vec_id", "label", "vector")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        waiting: list[tuple] = []
        last = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector"))):
                if row == last:
                    continue  # a row that repeats entirely counts once; its copies are neighbours here
                last = row
                waiting.append(row)
                if len(waiting) == block:
                    yield _block(number, waiting, dims)
                    number, waiting = number + 1, []
        if waiting:
            yield _block(number, waiting, dims)

    return saved(ordered.mapInArrow(cut, BLOCK_SCHEMA), "vector-blocks")


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists as the rows of a matrix, with zeros behind those that are shorter."""
    sizes = np.asarray(lists.value_lengths(), np.int64)
    values = np.floor(np.asarray(lists.flatten(), np.float64))
    out = np.zeros((len(sizes), dims))
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("values")
        sizes = np.asarray(lists.value_lengths(), np.int64)
        if len(sizes) and sizes.max():
            x = np.clip(_matrix(lists, int(sizes.max())), -1e100, 1e100)  # only the order depends on these
            columns = [pa.array(np.arange(x.shape[1]), pa.int32()), pa.array(np.full(x.shape[1], len(x))), pa.array(x.sum(0)), pa.array((x * x).sum(0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "total", "square"])


def _record(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _block(number: int, rows: list[tuple], dims: int) -> pa.RecordBatch:
    rows = sorted(rows)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), dims)
    ids, labels = (np.array([r[j] for r in rows], "<i8").tobytes() for j in (0, 1))
    return _record([(number, len(rows), dims, ids, labels, _pack(x), _pack(x.min(0)), _pack(x.max(0)))], BLOCK_SCHEMA)


ANCHOR_SCHEMA = "query long, anchor_id long, label long, dims int, vector binary"


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of the blocks whose id is divisible by ``every``: (query, anchor_id, label, dims,
    vector), in the order of the curve by query, a number of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids, labels, x = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8"), _unpack(b["vectors"], b["n"], b["dims"])
                yield _record([(b["block"] * (1 << 16) + k, int(ids[k]), int(labels[k]), b["dims"], _pack(x[k])) for k in np.flatnonzero(ids % every == 0).tolist()], ANCHOR_SCHEMA)

    return blocks.select("block", "n", "dims", "ids", "labels", "vectors").mapInArrow(run, ANCHOR_SCHEMA)


TILE_SCHEMA = "tile long, m int, windows int, dims int, queries binary, anchors binary, labels binary, vectors binary, low binary, high binary, floor binary"


def tiles_of(queries: DataFrame, tile: int = TILE) -> DataFrame:
    """Anchors with their windows (query, anchor_id, label, dims, vector, low, high, floor), the last
    three arrays of as many bounds for each, packed by tiles, written."""
    ordered = queries.repartitionByRange(max(1, min(MOST_PARTS, -(-queries.count() // tile))), "query").sortWithinPartitions("query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        waiting: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                waiting.append(row)
                if len(waiting) == tile:
                    yield _tile(number, waiting)
                    number, waiting = number + 1, []
        if waiting:
            yield _tile(number, waiting)

    return saved(ordered.mapInArrow(run, TILE_SCHEMA), "anchor-tiles")


def _tile(number: int, rows: list[dict]) -> pa.RecordBatch:
    dims = rows[0]["dims"]
    x = np.stack([_unpack(r["vector"], 1, dims)[0] for r in rows])
    columns = [np.array([r[c] for r in rows], "<i8").tobytes() for c in ("query", "anchor_id", "label")]
    limits = [np.array([r[c] for r in rows], "<i8").tobytes() for c in ("low", "high", "floor")]
    return _record([(number, len(rows), len(rows[0]["low"]), dims, *columns, _pack(x), *limits)], TILE_SCHEMA)


PAGE_SCHEMA = "page long, n int, dims int, blocks binary, low binary, high binary"


def pages_of(blocks: DataFrame, page: int = PAGE) -> DataFrame:
    """Zone maps, so many on a page at most, written. Reads nothing else of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), page):
                some = rows[at : at + page]
                dims = some[0]["dims"]
                low, high = (np.stack([_unpack(r[c], 1, dims)[0] for r in some]) for c in ("low", "high"))
                yield _record([(some[0]["block"], len(some), dims, np.array([r["block"] for r in some], "<i8").tobytes(), _pack(low), _pack(high))], PAGE_SCHEMA)

    return saved(blocks.select("block", "dims", "low", "high").mapInArrow(run, PAGE_SCHEMA), "zone-pages")


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner products of each anchor with any vector of each box, widened by
    what doubles may round."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    slack = 1e-12 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T) + 1
    return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack


def needed(tiles: DataFrame, pages: DataFrame, first: bool) -> DataFrame:
    """The (tile, block, need) that a step reads; ``need`` has a bit for each anchor of the tile.

    At ``first`` those that reach highest into a window, by page; then all that meet a window
    above its floor. Every tile meets every page of zone maps, in groups of ``PAGE_TILES`` tiles and
    the pages of one number: a page stands for ``PAGE * BLOCK`` rows."""
    n_pages, n_groups = max(1, pages.count()), -(-tiles.count() // PAGE_TILES)
    by_number = pages.withColumn("number", F.pmod(F.xxhash64("page"), F.lit(n_pages))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_groups - 1)))))
    spread = tiles.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(max(1, n_groups))).cast("int")).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        maps = [(np.frombuffer(p["blocks"], "<i8"), _unpack(p["low"], p["n"], p["dims"]), _unpack(p["high"], p["n"], p["dims"])) for p in right.to_pylist()]
        for t in left.to_pylist():
            m = t["m"]
            vectors = _unpack(t["vectors"], m, t["dims"])
            w_low, w_high, floor = (np.frombuffer(t[c], "<i8").reshape(m, -1).astype(np.float64) for c in ("low", "high", "floor"))
            w_high = np.where(w_high >= _MOST, np.inf, w_high)
            for blocks, z_low, z_high in maps:
                lo, hi = bounds(vectors, z_low, z_high)
                need = _heads(lo, hi, w_low, w_high) if first else _meeting(lo, hi, np.maximum(w_low, floor), w_high)
                out += [(t["tile"], int(blocks[k]), np.packbits(need[:, k]).tobytes()) for k in np.flatnonzero(need.any(0)).tolist()]
        return pa.Table.from_batches([_record(out, PAIR_SCHEMA)])

    return spread.groupBy("part", "number").cogroup(by_number.groupBy("part", "number")).applyInArrow(run, PAIR_SCHEMA)


PAIR_SCHEMA = "tile long, block long, need binary"


def _meeting(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros(lo.shape, bool)
    for w in range(low.shape[1]):
        out |= (hi >= low[:, [w]]) & (lo <= high[:, [w]]) & (low[:, [w]] <= high[:, [w]])
    return out


def _heads(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each anchor and window the ``FIRST`` blocks of a page that reach highest into it; of
    those that reach over it, the ones with the lowest bounds."""
    out = np.zeros(lo.shape, bool)
    for w in range(low.shape[1]):
        meets = (hi >= low[:, [w]]) & (lo <= high[:, [w]]) & (low[:, [w]] <= high[:, [w]])
        key = np.where(meets, np.minimum(hi, 2 * high[:, [w]] - hi) if np.isfinite(high[:, w]).all() else hi, -np.inf)
        k = min(FIRST, key.shape[1])
        best = np.argpartition(-key, k - 1, axis=1)[:, :k]
        np.put_along_axis(out, best, np.take_along_axis(meets, best, 1) | np.take_along_axis(out, best, 1), 1)
    return out


FOUND_SCHEMA = "query long, window int, vec_id long, score long"


def read_blocks(pairs: DataFrame, tiles: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, window, vec_id, score): of every pair of a tile and a block the rows inside each
    window, with the anchor's label if ``same``, else with another; the ``k`` best of each group of a
    tile and about ``GROUP`` of its blocks, which is what a task holds at a time."""
    groups = max(1, -(-blocks.count() // GROUP))
    pairs = saved(pairs.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups))), "needed-blocks")
    payload = pairs.select("block", "need", F.col("tile").alias("for_tile"), F.col("part").alias("for_part")).join(blocks.select("block", "n", "dims", "ids", "labels", "vectors"), "block")
    wanted = pairs.select("tile", "part").distinct().join(tiles, "tile")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for t in left.to_pylist():
            best = _Best(t, k, same)
            for batch in right.to_batches(max_chunksize=16):
                for b in batch.to_pylist():
                    best.add(b)
            out += best.rows()
        return pa.Table.from_batches([_record(out, FOUND_SCHEMA)])

    return wanted.groupBy("tile", "part").cogroup(payload.groupBy("for_tile", "for_part")).applyInArrow(run, FOUND_SCHEMA)


class _Best:
    """The best rows so far of each anchor and window of a tile."""

    def __init__(self, t: dict, k: int, same: bool):
        m, self.k, self.same = t["m"], k, same
        self.queries, self.anchors, self.labels = (np.frombuffer(t[c], "<i8") for c in ("queries", "anchors", "labels"))
        self.vectors = _unpack(t["vectors"], m, t["dims"])
        low, self.high, floor = (np.frombuffer(t[c], "<i8").reshape(m, -1) for c in ("low", "high", "floor"))
        self.low = np.maximum(low, floor)
        self.found: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(self, b: dict) -> None:
        need = np.flatnonzero(np.unpackbits(np.frombuffer(b["need"], np.uint8), count=len(self.queries)))
        ids, labels = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8")
        scores = inner_products(self.vectors[need], _unpack(b["vectors"], b["n"], b["dims"]))
        alike = labels[None, :] == self.labels[need, None]
        fits = alike & (ids[None, :] != self.anchors[need, None]) if self.same else ~alike
        for w in range(self.low.shape[1]):
            inside = fits & (scores >= self.low[need, w][:, None]) & (scores <= self.high[need, w][:, None])
            for i in np.flatnonzero(inside.any(1)).tolist():
                at = np.flatnonzero(inside[i])
                if len(at) > self.k:  # rows of a block go by id, so the stable order of scores settles ties
                    at = at[np.argsort(~scores[i, at], kind="stable")[: self.k]]
                q = int(need[i])
                both = [*self.found.get((q, w), ()), *zip((~scores[i, at]).tolist(), ids[at].tolist())]
                self.found[q, w] = both = sorted(both)[: self.k]  # ~x falls where x rises
                if len(both) == self.k:  # from now on only what can replace one of these
                    self.low[q, w] = ~both[-1][0]

    def rows(self) -> list[tuple]:
        return [(int(self.queries[q]), w, vec_id, ~turned) for (q, w), best in self.found.items() for turned, vec_id in best]


def inner_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of all rows of two matrices of whole numbers, exactly, however large; those beyond a
    long become the least or the largest long."""
    if x.size and a.size and float((np.abs(x).max(0) * np.abs(a).max(0)).sum()) >= 1 << 53:
        whole = [np.array([[int(v) for v in row] for row in m], object) for m in (a, x)]
        return np.array([[min(max(v, _LEAST), _MOST) for v in row] for row in whole[0] @ whole[1].T], np.int64).reshape(len(a), len(x))
    return (a @ x.T).astype(np.int64)


def search(queries: DataFrame, blocks: DataFrame, pages: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, window, vec_id, score, rank), written: the ``k`` best rows of each window of scores
    of each anchor (query, anchor_id, label, dims, vector, low, high), by score, ties by id."""
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id")

    def step(floored: DataFrame, first: bool) -> DataFrame:
        tiles = tiles_of(floored)
        found = read_blocks(needed(tiles, pages, first), tiles, blocks, k, same)
        return saved(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")

    start = queries.withColumn("floor", F.transform("low", lambda x: F.lit(_LEAST)))
    floors = step(start, True).where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("known"))
    raised = F.transform(F.sequence(F.lit(0), F.size("low") - 1), lambda w: F.coalesce(F.try_element_at("known", w), F.lit(_LEAST)))
    return step(queries.join(floors, "query", "left").withColumn("floor", raised).drop("known"), False)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """Hard negatives of the anchors, which are the ``quantised`` rows whose vec_id is divisible by
    ``every``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product with the anchor. An anchor's positives are its ``positives`` best
    other rows of its label; for each, the ``negatives`` best rows of other labels follow whose score
    is from ``low`` to ``high`` per cent of the positive's. Ties go to the smaller vec_id. Where
    fewer rows fit, all of them are returned; a positive of a negative score has none.

    Rows with a null id, label or vector, or with a component that is null or not finite, were left
    out by ``quantised``. A row that repeats entirely counts once; rows that share only their id
    are rows of their own, and none is a positive of another. Vectors shorter than the longest count
    as if zeros followed. Scores are exact; beyond the range of a long they are held to its ends.
    An empty table gives an empty result; further columns are ignored, whatever their names.
    """
    blocks = write_blocks(rows, block)
    pages = pages_of(blocks)
    anchors = saved(anchors_of(blocks, every), "anchors")
    everything = {"low": F.array(F.lit(_LEAST)), "high": F.array(F.lit(_MOST))}
    found = search(anchors.withColumns(everything), blocks, pages, positives, True)
    known = found.select("query", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score").cast("decimal(20,0)")
    limit = F.struct(F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    limits = known.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", limit))).alias("limits"))
    never = F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    windows = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda w: F.coalesce(F.try_element_at("limits", w), never))
    queries = anchors.join(limits, "query").withColumn("windows", windows).withColumns({"low": F.col("windows.low"), "high": F.col("windows.high")}).drop("limits", "windows")
    hard = search(saved(queries, "windows"), blocks, pages, negatives, False)
    ids = anchors.select("query", "anchor_id")
    return hard.select("query", "window", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank").join(known, ["query", "window"]).join(ids, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
