"""SimHash near-dedup with bit-sliced comparison.

Fingerprints that are compared stand in vertical bit planes: plane k holds bit k of 64
fingerprints in each machine word. A query fingerprint is compared with all of them at
once; a carry-save counter of bit planes adds up 64 * n distances with word operations,
and words whose 64 distances all exceed the radius are abandoned as the planes go by. Pairs
out of many small buckets are compared the same way: the differing bits of 64 pairs are a
word of planes, and their distances to zero are counted.

Two ways use it:

* ``simhash_components``: 64-bit fingerprints linked within a small radius r. The bits are
  cut into r + 3 ranges; two fingerprints within r agree in three ranges at least, so every
  three ranges (38 bits at r = 2) are a key, and equal keys are searched. This finds every
  link, and keys that long hold few fingerprints by chance however many there are. A link is
  taken in the first of its keys only. Equal fingerprints are one node.
* ``near_duplicates``: documents at least 0.8 of whose words, in each of the two, stand in
  five-word shingles that both have. An edit breaks five shingles but covers a word, so this
  is the share of unedited words, less those between close edits; the shingle sets of such
  texts have a cosine of 0.56 where edits are scattered. Fingerprints of 512 bits within
  ``wide_radius``, found bit-sliced, make the groups of candidates; their shingles are then
  compared exactly. Which fingerprints meet is said by bands of min-hashes of the same
  shingles. (Keys of equal fingerprint bits can't serve here: some 30% of the bits differ, so
  keys short enough to agree hold unrelated documents.)

Large buckets are cut into tiles of at most ``TILE`` rows, and every pair of tiles is a
group of its own, so no task holds an unbounded bucket. A group returns a spanning forest
of its links, never all pairs: no reachability is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, row_key, saved, sliced
from .components import components

TILE = 2_048
#: Bytes of texts in a tile, some.
TILE_BYTES = 8 << 20
#: Buckets of up to so many rows are compared pair by pair, many buckets at once.
SMALL = 64
#: Words of a plane that are compared at a time, where prints have many bits.
BLOCK = 4_096
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included. Words are split at [\\x20\\x09-\\x0D]
    after A-Z are lower-cased; a text of fewer words is one shingle, of none has none."""
    w = (text or "").encode("utf-8").lower().split()  # of bytes: ASCII only
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


class BitPlanes:
    """Fingerprints of 64 bits, or of several such lanes, in vertical planes, for comparing
    one with many."""

    def __init__(self, prints: np.ndarray):
        self.n = len(prints)
        lanes = prints.reshape(self.n, -1) if self.n else prints.reshape(0, 1)
        self.bits = np.unpackbits(lanes.astype(">u8").view(np.uint8).reshape(self.n, -1), axis=1)
        rows = np.zeros((-(-self.n // 64) * 64, self.bits.shape[1]), np.uint8)
        rows[: self.n] = self.bits
        self.planes = np.ascontiguousarray(np.packbits(rows.T, axis=1)).view(np.uint64)  # a plane for each bit, a word for 64 prints

    def within(self, one: np.ndarray | None, radius: int, start: int = 0) -> np.ndarray:
        """Indices from ``start`` of the prints at most ``radius`` bits from ``one``, a row
        of ``bits`` (None: from zero)."""
        first = start // 64
        alive = np.arange(first, self.planes.shape[1])
        planes = self.planes[:, first:]
        digits = radius.bit_length() + 1
        count = [np.zeros(len(alive), np.uint64) for _ in range(digits)]
        over = np.zeros(len(alive), np.uint64)  # prints that have left the radius for good
        for k in range(0, len(planes), 4):
            a, b, c, d = (~planes[j] if one is not None and one[j] else planes[j] for j in range(k, k + 4))
            # carry-save: three planes of weight 1 make one of weight 1 and one of weight 2
            ab = a ^ b
            low, carry = ab ^ c, a & b | ab & c
            carry2 = low & d
            low = low ^ d
            add, two = low, carry ^ carry2
            four = carry & carry2
            for i in range(digits):
                plus = [add] if i == 0 else [two] if i == 1 else [four] if i == 2 else []
                for x in plus:
                    at = i
                    while at < digits:
                        x, count[at] = count[at] & x, count[at] ^ x
                        at += 1
                    over |= x
            if digits < 3:
                over |= four
            if digits < 2:
                over |= two
            over |= _above(count, radius)
            keep = over != ~np.uint64(0)
            if not keep.all():
                if not keep.any():
                    return np.zeros(0, np.int64)
                alive, planes, over = alive[keep], planes[:, keep], over[keep]
                count = [x[keep] for x in count]
        left = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1)
        word, bit = np.nonzero(left)
        found = alive[word] * 64 + bit
        return found[(found >= start) & (found < self.n)]

    def within_each(self, some: np.ndarray, radius: int) -> np.ndarray:
        """The same for several rows of ``bits`` at once, of prints of many bits, where hardly a word
        can be abandoned early: a row for each, true for prints in the radius."""
        flips = -some.T.astype(np.uint64)  # a word of ones for each bit that is set
        count: list[list[np.ndarray]] = []  # planes of each weight, two at most

        def add(plane: np.ndarray, digit: int) -> None:
            if digit == len(count):
                count.append([])
            count[digit].append(plane)
            if len(count[digit]) == 3:
                a, b, c = count[digit]
                ab = a ^ b
                count[digit] = [ab ^ c]
                add(a & b | ab & c, digit + 1)

        for plane, flip in zip(self.planes, flips):
            add(plane ^ flip[:, None], 0)
        digit = 0
        while digit < len(count):
            if len(count[digit]) == 2:
                a, b = count[digit]
                count[digit] = [a ^ b]
                add(a & b, digit + 1)
            digit += 1
        digits = [x[0] for x in count]
        digits += [np.zeros_like(digits[0])] * (radius.bit_length() - len(digits))
        left = ~_above(digits, radius)
        return np.unpackbits(left.view(np.uint8), axis=1)[:, : self.n].astype(bool)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Prints whose bit-sliced count exceeds the radius, by comparing digits from the top."""
    more = np.zeros_like(count[0])
    same = ~more
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            same = same & count[i]
        else:
            more = more | same & count[i]
            same = same & ~count[i]
    return more


class _Forest:
    def __init__(self, n: int):
        self.up, self.joined = list(range(n)), 0

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        self.joined += a != b
        return a != b


def _dealt(rows: DataFrame, bucket: list[str], sizes: DataFrame, spread: Column) -> DataFrame:
    """``rows`` with n_tiles and tile, from the written ``sizes(bucket, n_tiles)``; rows of
    other buckets go. Both sides are plain exchanges, so AQE splits hot buckets."""
    return rows.join(sizes, bucket).withColumn("tile", F.pmod(F.xxhash64(spread), F.col("n_tiles")).cast("int"))


def _paired(rows: DataFrame, bucket: list[str], parts: int) -> DataFrame:
    """Rows with n_tiles and tile to groups (bucket, tile_a, tile_b): every two rows of a
    bucket meet in one. ``side`` is 0 for rows of tile_a, 1 for rows of tile_b where the
    tiles differ. Groups are dealt by all of their key, not by bucket, and lie sorted."""
    other = F.transform(
        F.sequence(F.lit(0), F.col("n_tiles") - 1),
        lambda t: F.struct(F.least("tile", t).alias("tile_a"), F.greatest("tile", t).alias("tile_b"), (F.col("tile") > t).cast("int").alias("side")),
    )
    rows = rows.withColumn("pair", F.explode(other)).select("*", "pair.*").drop("pair", "tile", "n_tiles")
    key = [*bucket, "tile_a", "tile_b"]
    return rows.repartition(parts, *key).sortWithinPartitions(*key, "side")


def _parts(sizes: DataFrame, rows_each: int = 250_000) -> int:
    """Partitions by the pair work of the written ``sizes(n, n_tiles)``: rows count once for
    each tile they meet."""
    work = sizes.agg(F.sum(F.col("n") * F.col("n_tiles"))).first()[0] or 0
    return max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-work // rows_each))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, with the first row of each group and the
    number of rows at the end."""
    held: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            values = table.column(k).combine_chunks()
            different = pc.not_equal(values[1:], values[:-1]) if table.num_rows else []
            change |= np.asarray(different, bool)
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]]).astype(np.int64)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        starts = bounds(table)
        if len(starts) > 2:
            yield table.slice(0, int(starts[-2])).combine_chunks(), starts[:-1]
        held = table.slice(int(starts[-2]))
    if held is not None and held.num_rows:
        yield held.combine_chunks(), bounds(held)


def _pairs(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i < j, of all pairs inside small groups, groups of a size at once."""
    sizes = np.diff(starts)
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        at, (i, j) = starts[:-1][sizes == n], np.triu_indices(n, 1)
        for lo in range(0, len(at), max(1, 400_000 // len(i))):
            some = at[lo : lo + max(1, 400_000 // len(i)), None]
            yield (some + i).ravel(), (some + j).ravel()


def _near(prints: np.ndarray, starts: np.ndarray, sides: np.ndarray, radius: int, forest: _Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of prints within the radius, for groups of small and large size.
    A large group ends when ``forest``, to which the caller adds links, has all of it in one
    tree."""
    # a group of two tiles compares across them only
    two_tiles = np.repeat(np.maximum.reduceat(sides, starts[:-1]) > 0, np.diff(starts))
    for i, j in _pairs(starts):
        use = ~two_tiles[i] | (sides[i] != sides[j])
        i, j = i[use], j[use]
        found = BitPlanes(prints[i] ^ prints[j]).within(None, radius) if len(i) else np.zeros(0, np.int64)
        yield i[found], j[found]
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if hi - lo <= SMALL:
            continue
        planes, cut = BitPlanes(prints[lo:hi]), int((sides[lo:hi] == 0).sum())
        two, begun = cut < hi - lo, forest.joined
        last, block = cut if two else hi - lo - 1, max(1, BLOCK // planes.planes.shape[1])
        for i in range(last):
            if forest.joined - begun == hi - lo - 1:
                break
            if prints.ndim == 1:
                j = planes.within(planes.bits[i], radius, cut if two else i + 1)
            else:
                if i % block == 0:
                    near = planes.within_each(planes.bits[i : min(i + block, last)], radius)
                start = cut if two else i + 1
                j = start + np.flatnonzero(near[i % block, start:])
            yield np.full(len(j), lo + i), lo + j


# --- fingerprints within a radius --------------------------------------------------------


def _prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        prints = [fingerprint(shingle_hashes(x, words)) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "print"]
        )


def key_masks(radius: int) -> np.ndarray:
    """Bits of each key: three of ``radius + 3`` ranges."""
    edges = np.linspace(0, 64, radius + 4).round().astype(int).tolist()
    ranges = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return np.array([sum(x) for x in combinations(ranges, 3)], np.uint64)


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links within sorted groups of fingerprints."""
    masks = key_masks(radius)
    for table, starts in _runs(batches, ["bucket", "tile_a", "tile_b"]):
        values = table.column("print").to_numpy()
        prints, sides, keys = values.view(np.uint64), table.column("side").to_numpy(), table.column("key").to_numpy()
        forest, a, b = _Forest(len(prints)), [], []
        for i, j in _near(prints, starts, sides, radius, forest):
            x = prints[i] ^ prints[j]
            first = ((x[:, None] & masks) == 0).argmax(1)
            own = (x != 0) & (keys[i] == first) & (keys[j] == first)
            for p, q in zip(i[own].tolist(), j[own].tolist()):
                if forest.join(p, q):
                    a.append(values[p])
                    b.append(values[q])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def print_links(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """``prints(print)``, distinct, to links (a, b) that connect all prints within the
    radius. Complete: prints that differ in at most ``radius`` bits agree in at least three
    of ``radius + 3`` ranges of bits."""
    masks = key_masks(radius).view(np.int64).tolist()
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks)])
    # buckets that share a hash are compared together, which costs time only
    rows = prints.select("print", F.posexplode(keys).alias("key", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = saved(sizes.withColumn("n_tiles", F.ceil(F.col("n") / tile).cast("int")), "buckets")
    grouped = _paired(_dealt(rows, ["bucket"], sizes.drop("n"), F.col("print")), ["bucket"], _parts(sizes))
    return grouped.mapInArrow(lambda batches: _linked(batches, radius), "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable over links of at most ``radius`` bits).

    Null or blank text has fingerprint zero and links like any other. A null doc_id gets
    its component's smallest id, null if all are null. Repeated rows each give a row. Whole
    texts are read, however long. An empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = saved(rows.mapInArrow(lambda batches: _prints(batches, words), "doc_id long, print long"), "prints")
    nodes = saved(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    roots = saved(components(print_links(nodes.select("print"), radius)), "roots")
    joined = saved(nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root")), "rooted")
    smallest = saved(joined.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    # each step's aggregate is written before its join, so that a hot root or print splits
    classes = saved(joined.select("print", "root").join(smallest, "root").select("print", "component_id"), "classes")
    return prints.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- word shingles of at least a given similarity ------------------------------------------

#: Min-hash bands that say which fingerprints meet. A tenth of the words changed at random
#: leaves a Jaccard similarity of 0.42, and one of 40 bands of 3 agrees with a probability of
#: 0.95; a twentieth leaves 0.63, which none misses in a million.
BANDS, BAND_ROWS = 40, 3
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def _min_hashes(hashes: np.ndarray) -> np.ndarray:
    """Smallest of each remixed hash: BANDS * BAND_ROWS values."""
    out = np.full(len(_MULTIPLIERS), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 256):  # what a core's cache holds
        some = hashes[at : at + 256]
        mixed = some[None, :] * _MULTIPLIERS[:, None]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(out, mixed.min(1), out=out)
    return out


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(digest of the shingles in order, band keys, wide fingerprint) of each text."""
    for batch in sliced(batches):
        digests, bands, prints = [], [], []
        for text in batch.column("text").to_pylist():
            ordered = shingle_hashes(text, words)
            digests.append(xxhash.xxh3_128_digest(ordered.tobytes()))
            found = np.unique(ordered)
            lows = _min_hashes(found).reshape(BANDS, BAND_ROWS)
            bands.append([xxhash.xxh64_intdigest(x.tobytes(), k) - 2**63 for k, x in enumerate(lows)])
            prints.append(wide_fingerprint(found).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.binary())],
            names=["row", "doc_id", "digest", "bands", "print"],
        )


#: 64-bit lanes of the fingerprints of shingle sets.
LANES = 8
_LANE_STEPS = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, LANES + 1, dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of ``LANES`` lanes: each is the majority of the hashes, mixed anew."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        x = hashes[at : at + 255, None] + _LANE_STEPS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).view(">u8").astype(np.uint64)


def wide_radius(similarity: float, words: int) -> int:
    """Bits in which wide fingerprints of texts of at least this similarity differ, at most: the
    mean for the angle between their shingle sets and four deviations. Where a share q of the
    words is kept at random, q^words of the shingles are, and q^words * (words - (words - 1) * q)
    of the words stand in one. At 0.8 and five words that is 202 of 512; unrelated sets
    differ in 256, and 54 are over four deviations."""
    kept = np.linspace(0, 1, 10_001)
    q = kept[np.searchsorted(kept**words * (words - (words - 1) * kept), similarity)]
    n, share = 64 * LANES, np.arccos(q**words) / np.pi
    return int(min(n - 1, np.ceil(n * share + 4 * np.sqrt(n * share * (1 - share)))))


def _lanes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LANES)


def _wide_linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the wide fingerprints within the radius in sorted groups."""
    for table, starts in _runs(batches, ["bucket", "tile_a", "tile_b"]):
        prints, nodes = _lanes(table.column("print")), table.column("node")
        forest, a, b = _Forest(len(prints)), [], []
        for i, j in _near(prints, starts, table.column("side").to_numpy(), radius, forest):
            for p, q in zip(i.tolist(), j.tolist()):
                if forest.join(p, q):
                    a.append(nodes[p].as_py())
                    b.append(nodes[q].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 256):
        ordered = [shingle_hashes(x, words).tobytes() for x in batch.column("text").to_pylist()]
        columns = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(ordered, pa.binary())], names=[*columns, "shingles"])


def _similar(batches: Iterator[pa.RecordBatch], similarity: float, words: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links within sorted groups of candidates: fingerprints
    within the radius, then the exact similarity of the texts."""
    radius = wide_radius(similarity, words)
    for table, starts in _runs(batches, ["cluster", "tile_a", "tile_b"]):
        nodes, shingles, prints = table.column("node"), table.column("shingles"), _lanes(table.column("print"))
        forest, a, b = _Forest(len(prints)), [], []
        lo = hi = 0  # the group that ``texts`` has
        for some_i, some_j in _near(prints, starts, table.column("side").to_numpy(), radius, forest):
            # a row i with all of its j at once
            edges = np.flatnonzero(np.diff(some_i, prepend=-1, append=-1)).tolist() if len(some_i) else []
            for at, end in zip(edges, edges[1:]):
                i = int(some_i[at])
                root = forest.root(i)
                others = [j for j in some_j[at:end].tolist() if forest.root(j) != root]
                if not others:
                    continue
                if not lo <= i < hi:
                    lo, hi = starts[(group := int(np.searchsorted(starts, i, "right"))) - 1 : group + 1].tolist()
                    texts = _Texts([np.frombuffer(x, np.uint64) for x in shingles.slice(lo, hi - lo).to_pylist()], words)
                for j in texts.alike(i - lo, np.array(others) - lo, similarity).tolist():
                    if forest.join(i, lo + j):
                        a.append(nodes[i].as_py())
                        b.append(nodes[lo + j].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def covered(one: np.ndarray, two: np.ndarray, words: int) -> float:
    """The share of the words of ``one`` that stand in shingles which ``two`` has too; both
    are shingles in order."""
    shared = np.isin(one, two)
    inside = np.zeros(len(one) + words - 1, bool)
    for k in range(words):
        inside[k : k + len(one)] |= shared
    return float(inside.mean())


def alike(one: np.ndarray, two: np.ndarray, similarity: float, words: int) -> bool:
    """Whether at least this share of the words of each of two texts, given by their shingles
    in order, stands in shingles that the other has too. Two texts without words are alike."""
    if not len(one) or not len(two):
        return len(one) == len(two)
    return covered(one, two, words) >= similarity and covered(two, one, words) >= similarity


class _Texts:
    """The shingles of a group of texts as numbers, for comparing one with many: what ``alike`` says of
    each pair."""

    def __init__(self, shingles: list[np.ndarray], words: int):
        self.words, self.sizes = words, np.array([len(x) for x in shingles], np.int64)
        self.starts = self.sizes.cumsum() - self.sizes
        names, codes = np.unique(np.concatenate(shingles), return_inverse=True)
        self.codes, self.times = codes.astype(np.int32), np.zeros(len(names), np.int32)

    def _of(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i] + self.sizes[i]]

    def _shares(self, sizes: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of texts of these sizes, the share of words in the shingles ``at`` of ``text``."""
        whole = sizes + self.words - 1
        inside = np.zeros(int(whole.sum()), bool)
        firsts = whole.cumsum() - whole
        for k in range(self.words):
            inside[firsts[text] + at + k] = True
        return np.add.reduceat(inside, firsts, dtype=np.int64) / whole

    def alike(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of ``others`` that are alike to text ``i``. They are taken in parts of 4 million shingles."""
        if not self.sizes[i]:
            return others[self.sizes[others] == 0]
        others = others[self.sizes[others] > 0]
        one, part = self._of(i), np.maximum(self.sizes[others], self.sizes[i]).cumsum() >> 22
        np.add.at(self.times, one, 1)
        found = [self._alike(one, others[part == k], similarity) for k in np.unique(part)]
        self.times[one] = 0
        return np.concatenate([others[:0], *found])

    def _alike(self, one: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
        sizes = self.sizes[others]
        firsts = sizes.cumsum() - sizes
        times = self.times[self.codes[np.arange(int(sizes.sum())) + np.repeat(self.starts[others] - firsts, sizes)]]
        # no more words are in shingles of both than these have, counted as often as they stand
        least = similarity * (1 - 1e-9)
        of_two, of_one = np.add.reduceat(times > 0, firsts, dtype=np.int64), np.add.reduceat(times, firsts, dtype=np.int64)
        may = (of_two * self.words >= least * (sizes + self.words - 1)) & (of_one * self.words >= least * (len(one) + self.words - 1))
        if not may.any():
            return others[:0]
        text = np.repeat(np.arange(len(others)), sizes)
        at = np.flatnonzero((times > 0) & may[text])
        may &= self._shares(sizes, text[at], at - firsts[text[at]]) >= similarity
        # the words of text i: a row of its shingles for each text that is left
        others = others[may]
        names, places = np.unique(one, return_inverse=True)
        for lo in range(0, len(others), step := max(1, (1 << 22) // len(one))):
            some = others[lo : lo + step]
            shared = np.array([np.isin(names, self._of(j))[places] for j in some.tolist()])
            text, at = np.nonzero(shared)
            others[lo : lo + step][self._shares(np.full(len(some), len(one)), text, at) < similarity] = -1
        return others[others >= 0]


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: row (its key), doc_id, group_id (the
    smallest doc_id of its group) and kept (true for one row of each group).

    Two texts link if at least ``similarity`` of the words of each stand in ``words``-word
    shingles that the other has too; groups are what links connect. Texts of the same words are
    one node, null and blank texts too. A pair with a tenth of its words changed at random is
    missed with a probability of 0.05, with a twentieth of under 0.00001, and less often where
    other copies lie between; more often only if changes stand at even steps, so that hardly a
    shingle between them is left over. Null ids sort last; rows that repeat doc_id and text are one group,
    all of them kept if the group's smallest is theirs. Whole texts are read, however long. An
    empty table gives an empty result; further columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    kind = rows.schema["row"].dataType.simpleString()
    sketches = saved(rows.select("row", "doc_id", "text").mapInArrow(lambda b: _sketches(b, words), f"row {kind}, doc_id long, digest binary, bands array<bigint>, print binary"), "sketches")
    # a node for each distinct sequence of shingles, named by its 128-bit digest; its smallest row stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    nodes = sketches.groupBy("digest").agg(first.alias("first"), F.any_value("bands").alias("bands"), F.any_value("print").alias("print"))
    nodes = saved(nodes.select(F.col("digest").alias("node"), "first.row", F.col("first.id").alias("doc_id"), "bands", "print"), "nodes")
    # fingerprints meet in the buckets of their bands; what is within the radius there is a cluster
    met = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = saved(buckets.withColumn("n_tiles", F.ceil(F.col("n") / tile).cast("int")), "buckets")
    dealt = saved(_dealt(met, ["bucket"], buckets.drop("n"), F.col("node")), "met")
    grouped = _paired(dealt.join(nodes.select("node", "print"), "node"), ["bucket"], _parts(buckets, 50_000))
    near = grouped.mapInArrow(lambda b: _wide_linked(b, wide_radius(similarity, words)), "a binary, b binary")
    clusters = saved(components(near), "clusters")
    members = saved(nodes.join(clusters, "node").select("row", "node", "print", F.col("root").alias("cluster")), "members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("row.n", F.lit(0))).alias("bytes"))
    sizes = saved(sizes.withColumn("n_tiles", F.ceil(F.greatest(F.col("n") / tile, F.col("bytes") / tile_bytes, F.lit(1.0))).cast("int")), "cluster-sizes")
    wanted = saved(_dealt(members, ["cluster"], sizes.select("cluster", "n_tiles"), F.col("node")), "wanted")
    texts = rows.select("row", "text").join(broadcast_if_small(wanted, 160), "row")
    if not sketches.groupBy("row").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])  # repeated rows
    schema = "node binary, cluster binary, n_tiles int, tile int, print binary, shingles binary"
    sets = texts.select("node", "cluster", "n_tiles", "tile", "print", "text").mapInArrow(lambda b: _shingles(b, words), schema)
    links = _paired(sets, ["cluster"], _parts(sizes, 20_000)).mapInArrow(lambda b: _similar(b, similarity, words), "a binary, b binary")
    roots = saved(components(links), "roots")
    joined = saved(nodes.join(roots, "node", "left").select("node", "doc_id", "row", F.coalesce("root", "node").alias("root")), "grouped")
    best = saved(joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("best")), "best")
    classes = saved(joined.join(best, "root").select(F.col("node").alias("digest"), F.col("best.id").alias("group_id"), F.col("best.row").alias("keep")), "classes")
    return sketches.join(classes, "digest").select("row", "doc_id", "group_id", (F.col("row") == F.col("keep")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest
    doc_id. All columns stay, whatever their names; of rows that repeat doc_id and text one
    stays. Texts are moved only if the dropped keys are too many to broadcast."""
    found = saved(near_duplicates(docs, words, similarity).select("row", "kept"), "near-duplicates")
    name = free_name(docs, "row")
    keyed = docs.withColumn(name, row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))

    def keys(rows: DataFrame, label: str) -> DataFrame:
        return broadcast_if_small(saved(rows.select(F.col("row").alias(name)).distinct(), label), 64)

    left = keyed.join(keys(found.where("not kept"), "dropped"), name, "left_anti")
    repeats = found.where("kept").groupBy("row").count().where("count > 1")
    if not repeats.isEmpty():
        again = keys(repeats, "repeated")
        left = left.join(again, name, "left_anti").unionByName(left.join(again, name, "left_semi").dropDuplicates([name]))
    return left.drop(name)
