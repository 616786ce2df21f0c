"""Periodic runs: maximal stretches of words that repeat with a period.

A run with smallest period q ends in exactly one branching tandem repeat: a square of period q
whose two halves go on with different words. Its halves are suffixes with a longest common
prefix of q, so they stand in the same LCP interval of depth q of the enhanced suffix array,
under different children. For each interval all suffixes but those of its largest child are
asked whether the suffix q words before or behind them, by the inverse suffix array, stands in
the interval too. Each such square is rotated to the left as far as its words repeat, which
gives the run. Intervals come from one pass over the LCP array with a stack; there is no tree.

Suffix arrays are built only where runs can be. In a run of at least 4 periods every word but
those of the first period has stood at most q words before, and these are at least 3q words in
a row. Stretches of words are therefore cut wherever the way back to a word's last
occurrence is longer than a third of the stretch, again and again; what is left holds all
runs, and is little where nothing repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import slices, split_words

#: A run has at least so many words, and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of a sequence, its inverse, and the longest common prefixes of each
    suffix and the one before it, by doubling; the ranks of each step give the prefixes."""
    n = len(s)
    ranks = [np.unique(s, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while ranks[-1].max(initial=0) < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = ranks[-1][step:] + 1
        key = ranks[-1] * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        ranks.append(new)
        step *= 2
    inverse = ranks[-1]
    array = np.empty(n, np.int64)
    array[inverse] = np.arange(n)
    a, b = array[1:].copy(), array[:-1].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 2, -1, -1):  # suffixes whose ranks of step k agree share 2^k words
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        # a rank of words short of the end stands for fewer words; no two suffixes share such a rank
        common += same << k
        a, b = a + (same << k), b + (same << k)
    return array, inverse, np.concatenate([[0], common])


def intervals(lcp: list[int], most: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """LCP intervals of depth 1 to ``most``: first and last place, depth, and the first places of
    their children but the first."""
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]
    for i in range(1, len(lcp) + 1):
        depth, left = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack[-1][0] > depth:
            d, left, cuts = stack.pop()
            if d <= most:
                yield left, i - 1, d, cuts
        if stack[-1][0] < depth:
            stack.append((depth, left, [i]))
        elif depth:
            stack[-1][2].append(i)


def branching_squares(s: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(period, start) of all branching tandem repeats with a period up to ``most``."""
    n = len(s)
    order, rank, common = suffix_array(s)
    array, inverse = order.tolist(), rank.tolist()
    out: list[tuple[int, int]] = []
    for first, last, depth, cuts in intervals(common.tolist(), most):
        bounds = [first, *cuts, last + 1]
        largest = max(range(len(bounds) - 1), key=lambda k: bounds[k + 1] - bounds[k])
        for k in range(len(bounds) - 1):
            if k == largest:
                continue
            low, high = bounds[k], bounds[k + 1]
            for place in range(low, high):
                i = array[place]
                j = i + depth
                if j < n and first <= inverse[j] <= last and not low <= inverse[j] < high:
                    out.append((depth, i))
                j = i - depth
                # a partner in another smaller child reports the pair from its own side
                if j >= 0 and bounds[largest] <= inverse[j] < bounds[largest + 1]:
                    out.append((depth, j))
    return out


def stretches(back: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where the cores of runs can be: stretches of places, each with a way back to the same
    word of at most a third of the stretch. ``back`` is this way, 0 where the word is new."""
    known = np.flatnonzero(np.diff(np.concatenate([[0], (back > 0).view(np.int8), [0]])))
    todo = list(zip(known[::2].tolist(), known[1::2].tolist()))
    while todo:
        low, high = todo.pop()
        if high - low < MIN_WORDS - 1:
            continue
        wide = np.flatnonzero(back[low:high] * (MIN_PERIODS - 1) > high - low)
        if len(wide):
            ends = [low - 1, *(wide + low).tolist(), high]
            todo += [(a + 1, b) for a, b in zip(ends, ends[1:])]
        else:
            yield low, high


def runs_of(s: np.ndarray, back: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word codes, in order."""
    found: dict[tuple[int, int], int] = {}
    for low, high in stretches(back):
        widest = (high - low) // (MIN_PERIODS - 1)
        low = max(0, low - widest)
        by_end: dict[int, list[tuple[int, int]]] = {}
        for period, start in sorted(branching_squares(s[low:high], widest)):
            start, end = start + low, start + low + 2 * period
            if end < len(s) and s[end] == s[end - period]:
                continue  # cut by the stretch's end: not the end of a run
            if any(period % q == 0 and a <= start for a, q in by_end.get(end, ())):
                continue  # the same run, whose smallest period is known
            start = _rotated(s, start, period)
            by_end.setdefault(end, []).append((start, period))
            if end - start >= max(MIN_WORDS, MIN_PERIODS * period):
                found[start, end] = min(period, found.get((start, end), period))
    return sorted((start, end - start, period) for (start, end), period in found.items())


def _rotated(s: np.ndarray, start: int, period: int, block: int = 64) -> int:
    """The first place from which on all words up to ``start`` repeat after ``period``."""
    while start:
        low = max(0, start - block)
        other = np.flatnonzero(s[low:start] != s[low + period : start + period])
        if len(other):
            return low + int(other[-1]) + 1
        start, block = low, block * 4
    return 0


def way_back(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words from each word back to its last occurrence in its text; 0 if there is none."""
    order = np.lexsort((codes, text)) if len(codes) else np.zeros(0, np.int64)
    same = (codes[order][1:] == codes[order][:-1]) & (text[order][1:] == text[order][:-1])
    back = np.zeros(len(codes), np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


#: What a text's words become before they are searched: places of the words to take, or None for all as they are.
Rewrite = Callable[[int | None, int], np.ndarray | None]

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, n_dropped long, collapsed {}"


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None, digest: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, runs by start and period,
    runs_sha256, n_dropped, and collapsed: the text's words without those that a run repeats
    (all of a run but its first period), joined by a space; with ``digest`` its sha256.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared as they are. Null and empty
    texts have no words and no runs, and collapse to the empty text. Rows are handled one by one,
    so repeated rows and ids, and null ids, are passed through. Of runs that overlap all are
    returned; a word goes if any run repeats it. An empty table gives an empty result; further
    columns are ignored, whatever their names. A task holds some megabytes of texts at a time, at
    least one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _batch(batch, rewrite, digest)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA.format("string"))


def _batch(batch: pa.RecordBatch, rewrite: Rewrite | None, digest: bool) -> pa.RecordBatch:
    ids = batch.column("doc_id").to_pylist()
    codes, _, counts = split_words(batch.column("text"))
    first = np.cumsum(counts) - counts
    taken = [rewrite(i, int(n)) if rewrite else None for i, n in zip(ids, counts)]
    for at, n, take in zip(first, counts, taken):
        if take is not None:
            codes[at : at + n] = codes[at : at + n][take]
    back = way_back(codes, np.repeat(np.arange(len(counts)), counts))
    runs, digests, dropped, collapsed = [], [], [], []
    for k, (at, n) in enumerate(zip(first, counts)):
        found = runs_of(codes[at : at + n], back[at : at + n])
        words = (batch.column("text")[k].as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes split at just this white space
        if taken[k] is not None:
            words = [words[i] for i in taken[k].tolist()]
        keep = np.ones(n, bool)
        for start, length, period in found:
            keep[start + period : start + length] = False
        if found:
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        text = b" ".join(words)
        runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
        digests.append(hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest())
        dropped.append(int(n - keep.sum()))
        collapsed.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "surrogatepass"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    columns = [batch.column("doc_id"), pa.array(counts), pa.array(runs, kind), pa.array(digests, pa.string()), pa.array(dropped, pa.int64()), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "runs_sha256", "n_dropped", "collapsed"])
