"""Language ID: a byte convolutional network in numpy.

A text, lower-cased, is cut into windows of ``WINDOW`` UTF-8 bytes, the last one padded
with zero bytes. Filters of several widths read byte n-grams, each filter keeps its
largest activation over the window, and a softmax layer reads these. As a byte is one of
256 values, a filter of width k is k look-up tables of 256 weights, so the first layer is
table look-ups and sums. Windows are scored in batches and a text's probability is the
mean over all its windows: whole texts are read.

Training is on the driver, on a bounded sample: some ``windows_per_language`` windows of each
language, out of all windows of all labelled rows with equal chances. What is sent to the
tasks is the network, under 200 kB.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, sliced

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # for each width
UNDETERMINED = "und"

_CHUNK = 64  # windows scored together: their activations fit a core's cache


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, at least one."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageNet:
    """``tables[j]`` holds each filter's weights for the byte at offset j; a filter of
    width k has zeros from offset k on."""

    languages: list[str]
    tables: np.ndarray  # offsets, 256, filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _activations(self, windows: np.ndarray) -> np.ndarray:
        wide = np.pad(windows, ((0, 0), (0, len(self.tables) - 1)))
        total = self.tables[0][wide[:, :WINDOW]]
        for j in range(1, len(self.tables)):
            used = self.used[j]
            total[:, :, used:] += self.tables[j][:, used:][wide[:, j : j + WINDOW]]
        return total

    @property
    def used(self) -> list[int]:
        """First filter that reads the byte at each offset; filters go by width."""
        return [sum(FILTERS for w in WIDTHS if w <= j) for j in range(max(WIDTHS))]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), _CHUNK):
            pooled = np.maximum(self._activations(windows[at : at + _CHUNK]).max(1) + self.bias, 0)
            parts.append(_softmax(pooled @ self.out + self.out_bias))
        return np.concatenate(parts)

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [i for i, x in enumerate(texts) if self.languages and has_letter(x)]
        group: list[int] = []
        waiting: list[np.ndarray] = []
        size = 0
        for i in [*known, None]:
            if i is not None:
                group.append(i)
                waiting.append(windows_of(texts[i]))
                size += len(waiting[-1])
            if group and (i is None or size >= 4_096):
                each = self.probabilities(np.concatenate(waiting))
                counts = np.array([len(x) for x in waiting])
                mean = np.add.reduceat(each, np.cumsum(counts) - counts) / counts[:, None]
                for k, row in zip(group, mean):
                    best = int(row.argmax())
                    names[k], scores[k] = self.languages[best], float(min(1.0, row[best]))
                group, waiting, size = [], [], 0
        return names, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(windows: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 0) -> LanguageNet:
    """Train on windows and their languages with Adam; runs repeat exactly."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageNet([], *[np.zeros(0, np.float32)] * 4)
    rng = np.random.default_rng(seed)
    filters, offsets = FILTERS * len(WIDTHS), max(WIDTHS)
    tables = rng.normal(0, 0.3, (offsets, 256, filters)).astype(np.float32)
    mask = np.array([[w > j for w in WIDTHS for _ in range(FILTERS)] for j in range(offsets)], np.float32)[:, None, :]
    net = LanguageNet(languages, tables * mask, np.zeros(filters, np.float32), rng.normal(0, 0.3, (filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    index = {x: i for i, x in enumerate(languages)}
    y = np.array([index[x] for x in labels])
    weights = [net.tables, net.bias, net.out, net.out_bias]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    columns = np.arange(filters)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            x, n = windows[some], len(some)
            act = net._activations(x)
            where = act.argmax(1)
            top = np.take_along_axis(act, where[:, None, :], 1)[:, 0] + net.bias
            pooled = np.maximum(top, 0)
            error = _softmax(pooled @ net.out + net.out_bias)
            error[np.arange(n), y[some]] -= 1
            error /= n
            back = (error @ net.out.T) * (top > 0)
            grad = np.zeros_like(net.tables)
            wide = np.pad(x, ((0, 0), (0, offsets - 1)))
            for j in range(offsets):
                np.add.at(grad[j], (np.take_along_axis(wide, where + j, 1), columns[None, :]), back)
            grads = [grad * mask, back.sum(0), pooled.T @ error, error.sum(0)]
            step += 1
            for w, g, m, s in zip(weights, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, windows_per_language: int = 2_400, held_out: int = 2) -> LanguageNet:
    """A network from ``docs(doc_id, text, lang)`` with a language, a letter in the text,
    and a remainder other than ``held_out``.

    The sample: each window of a labelled row is taken if a hash of doc_id and its number
    falls under a share that yields some ``windows_per_language`` windows of its language.
    Rows with a null id are not learned from; repeated rows are drawn alike. Reruns learn the
    same. A table without such rows gives a network without languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = rows.where("lang is not null and text is not null").where(remainder(F.col("doc_id")) != held_out)
    # a text has as many windows as its bytes fill, and lower-casing rarely changes them
    usable = usable.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW)).cast("int"))
    shares = usable.groupBy("lang").agg(F.sum("n").alias("all")).select(F.col("lang").alias("lang_"), (windows_per_language / F.col("all")).alias("share"))
    # a row for each language, as the network has an output for each: small enough to broadcast
    drawn = usable.join(F.broadcast(shares), F.col("lang") == F.col("lang_"))
    uniform = lambda i: F.shiftrightunsigned(F.xxhash64("doc_id", i, F.lit(11)), 11) / float(1 << 53)
    drawn = drawn.withColumn("picks", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: uniform(i) < F.col("share"))).where(F.size("picks") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, langs, found = [], [], []
            for doc_id, text, lang, picks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "picks"))):
                if has_letter(text):
                    every = windows_of(text)
                    ids.append(doc_id)
                    langs.append(lang)
                    found.append(every[[i for i in picks if i < len(every)]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["doc_id", "lang", "windows"])

    got = drawn.select("doc_id", "text", "lang", "picks").mapInArrow(cut, "doc_id long, lang string, windows binary").collect()
    got.sort(key=lambda r: (r["lang"], zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["windows"])))
    each = [np.frombuffer(bytes(r["windows"]), np.uint8).reshape(-1, WINDOW) for r in got]
    labels = [r["lang"] for r, x in zip(got, each) for _ in x]
    return fit(np.concatenate(each) if each else np.zeros((0, WINDOW), np.uint8), labels)


def identify(docs: DataFrame, net: LanguageNet) -> DataFrame:
    """``docs`` with lang_pred and score added, or replaced where they exist.

    Null text, or text without a letter, is ``und`` with score 0; so is every text if the
    network has learned no language. Of languages that tie the first by name counts. Only
    the text is read, all of it, however long; repeated rows get the same. An empty table
    gives an empty result. Other columns stay, whatever their names.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    read = free_name(docs, "text_read")
    rows = docs.select(*kept, F.col("text").cast("string").alias(read))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, scores = net.identify(batch.column(read).to_pylist())
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, net: LanguageNet, held_out: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, lang_pred, score. A
    null id counts as not held out. Else as ``identify``; further columns are ignored."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"), "text")
    return identify(ids, net).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, net: LanguageNet, min_score: float = 0.4) -> DataFrame:
    """``docs`` without those that are ``und`` or whose best language has a mean
    probability under ``min_score``; columns stay as they are."""
    kept = {c: free_name(docs, f"own_{c}") for c in ("lang_pred", "score") if c in docs.columns}
    found = identify(docs.withColumnsRenamed(kept), net).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in kept.items()}).select(*docs.columns)
