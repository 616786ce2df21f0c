"""Toxicity: a linear-chain conditional random field over words, in numpy.

Each word of a text is tagged offending or not. A word's features are itself, its first and
last bytes, its shape and its neighbours, hashed into one table of weights; a 2 x 2 table
scores neighbouring tags. Forward and backward passes over sequences of at most ``SEQUENCE``
words give each word's marginal probability; neighbouring words over one half are a span, and
the marginals of all words make the document's features, which a logistic function turns into
its score.

Labels are given by document only, so the words to learn from are labelled first: a form (a
word or a beginning of one) is offending if a likelihood-ratio test over all labelled
documents says that it stands in toxic ones, and a word of a toxic document is labelled if one
of its forms is. The field learns from a bounded sample of sequences, on the driver; as
beginnings and neighbours are features, it tags words that no labelled text has.

Words are split, hashed and scored by Arrow and numpy on distinct words of a slice of
texts, whatever their number or length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, broadcast_if_small, free_name, saved

SEQUENCE = 64
#: Entries of the table of weights.
TABLE_BITS = 18
#: Bytes of text that are split and scored together.
SLICE_BYTES = 2 << 20

_EDGES = "".join(map(chr, range(33, 127))).translate({c: None for c in range(33, 127) if chr(c).isalnum()})
_HEADS, _TAILS = (3, 4, 5, 6), (3, 4)
#: Columns of the feature matrix: word, heads, tails, shape, bias; then the word as the one before and as the one behind.
_OWN = 1 + len(_HEADS) + len(_TAILS) + 2
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some ``SLICE_BYTES`` of text, at least one row each."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 8)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words as codes, one text after the other; the distinct words; each text's number of them."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = np.where(np.asarray(pc.binary_length(trimmed)) > 0, np.asarray(pc.list_value_length(lists)), 0).astype(np.int64)
    words = lists.flatten()
    coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
    return np.asarray(coded.indices, np.int64), coded.dictionary, counts


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each word, its heads and its tails (a column each); its shape."""
    n = len(words)
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=_EDGES)
    size = np.asarray(pc.binary_length(plain), np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer("".join(plain.to_pylist()).encode("utf-8", "surrogatepass") + bytes(8), np.uint8).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 8, _BASE, np.uint64))
    place = np.arange(int(size.sum())) - np.repeat(start, size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data[: len(place)] * powers[place])])
    out = np.empty((n, 1 + len(_HEADS) + len(_TAILS)), np.uint64)
    out[:, 0] = sums[start + size] - sums[start]
    for j, k in enumerate(_HEADS, 1):
        out[:, j] = sums[start + np.minimum(k, size)] - sums[start]
    for j, k in enumerate(_TAILS, 1 + len(_HEADS)):
        out[:, j] = sum((data[np.where(i < size, start + size - 1 - i, len(data) - 1)] * powers[i] for i in range(k)), np.zeros(n, np.uint64))
    upper = np.asarray(pc.utf8_is_upper(words)).astype(np.uint64)
    digit = np.asarray(pc.match_substring_regex(words, "[0-9]")).astype(np.uint64)
    return out, upper + np.uint64(2) * digit + np.uint64(4) * np.minimum(size, 3).astype(np.uint64)


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h + np.uint64(salt)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct words: their entries in the table of weights (``_OWN`` of a word's own and
    two for its neighbours), and their forms, as 64-bit hashes."""
    hashed, shape = _hashes(words)
    table = [_salted(hashed[:, j], j + 1) for j in range(hashed.shape[1])]
    table += [_salted(shape, 101), np.full(len(shape), 7 << 40, np.uint64), _salted(hashed[:, 0], 102), _salted(hashed[:, 0], 103)]
    forms = np.stack([_salted(hashed[:, j], 200 + j) for j in (0, 2, 3, 4)], 1)
    return (np.stack(table, 1) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), forms.view(np.int64)


def sequences(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts texts of so many words into sequences: first word and length of each."""
    each = -(-counts // SEQUENCE)
    text = np.repeat(np.arange(len(counts)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    first = (np.cumsum(counts) - counts)[text] + number * SEQUENCE
    return first, np.minimum(SEQUENCE, counts[text] - number * SEQUENCE)


@dataclass
class Field:
    """``weights`` score the tag 1 against 0 by feature, ``moves[i, j]`` the tag j after i;
    ``score`` has the logistic function's intercept and weights."""

    weights: np.ndarray
    moves: np.ndarray
    score: np.ndarray

    def emissions(self, table: np.ndarray, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the sequences' words for tag 1, places of the words, and which are words."""
        place = first[:, None] + np.arange(SEQUENCE)
        real = np.arange(SEQUENCE) < length[:, None]
        place = np.where(real, place, 0)
        code = codes[place] if len(codes) else np.zeros_like(place)
        each = self.weights[table]
        own, before, behind = each[:, :_OWN].sum(1), each[:, _OWN], each[:, _OWN + 1]
        out = own[code]
        out[:, 1:] += np.where(real[:, 1:], before[code[:, :-1]], 0)
        out[:, :-1] += np.where(real[:, 1:], behind[code[:, 1:]], 0)
        return out, place, real

    def marginals(self, emissions: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of tag 1 of each word; odds of the forward pass and of the backward pass, stacked.

        Odds of the two tags carry all that a chain of two tags needs."""
        x = np.exp(np.clip(emissions, -30, 30))
        m = np.exp(self.moves)
        ahead, back = np.ones_like(x), np.ones_like(x)
        ahead[:, 0] = x[:, 0]
        for t in range(1, SEQUENCE):
            a = ahead[:, t - 1]
            ahead[:, t] = x[:, t] * (m[0, 1] + a * m[1, 1]) / (m[0, 0] + a * m[1, 0])
        for t in range(SEQUENCE - 2, -1, -1):
            b = x[:, t + 1] * back[:, t + 1]
            back[:, t] = np.where(real[:, t + 1], (m[1, 0] + m[1, 1] * b) / (m[0, 0] + m[0, 1] * b), 1)
        odds = ahead * back
        return np.where(real, odds / (1 + odds), 0), np.stack([ahead, back])

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words, one text after the other; each text's number of words."""
        codes, distinct, counts = split_words(texts)
        out = np.zeros(len(codes))
        if len(codes):
            table, _ = features(distinct)
            emissions, place, real = self.emissions(table, codes, *sequences(counts))
            p, _ = self.marginals(emissions, real)
            out[place[real]] = p[real]
        return out, counts

    def scores(self, documents: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score[0] + documents @ self.score[1:], -30, 30)))


def document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text: its largest marginal, and the logarithm of 1 + the sum of the marginals'
    own log-odds where these are over 0, so that sure words weigh more than likely ones."""
    text = np.repeat(np.arange(len(counts)), counts)
    most = np.zeros(len(counts))
    np.maximum.at(most, text, p)
    sure = np.minimum(p, 1 - 1e-6)
    odds = np.where(p > 0.5, np.log(np.maximum(sure, 0.5) / (1 - np.maximum(sure, 0.5))), 0)
    return np.stack([most, np.log1p(np.bincount(text, odds, len(counts)))], 1)


def fit_field(table: np.ndarray, codes: np.ndarray, tags: np.ndarray, first: np.ndarray, length: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.3, decay: float = 1e-5, seed: int = 0) -> Field:
    """Maximises the likelihood of the tags by AdaGrad; runs repeat exactly."""
    field = Field(np.zeros(1 << TABLE_BITS), np.zeros((2, 2)), np.zeros(3))
    squares, move_squares = np.full(1 << TABLE_BITS, 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(first))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            emissions, place, real = field.emissions(table, codes, first[some], length[some])
            p, passes = field.marginals(emissions, real)
            y = np.where(real, tags[place], 0)
            error = np.where(real, y - p, 0)
            grad = np.zeros(1 << TABLE_BITS)
            code = codes[place]
            np.add.at(grad, table[code[real], :_OWN], error[real][:, None])
            pair = real[:, 1:]
            np.add.at(grad, table[code[:, :-1][pair], _OWN], error[:, 1:][pair])
            np.add.at(grad, table[code[:, 1:][pair], _OWN + 1], error[:, :-1][pair])
            # neighbouring tags: how often they stand together, less how often they should
            joint = _joint(field.moves, emissions, passes)
            seen = np.stack([[((y[:, :-1] == i) & (y[:, 1:] == j)) for j in (0, 1)] for i in (0, 1)]).astype(float)
            moved = ((seen - joint) * pair).sum((2, 3)) / len(some)
            grad /= len(some)
            used = grad != 0
            grad[used] -= decay * field.weights[used]
            squares += grad * grad
            field.weights += rate * grad / np.sqrt(squares)
            move_squares += moved * moved
            field.moves += rate * moved / np.sqrt(move_squares)
    return field


def _joint(moves: np.ndarray, emissions: np.ndarray, passes: np.ndarray) -> np.ndarray:
    """Probabilities of the tags (i, j) of each two neighbours."""
    x, m = np.exp(np.clip(emissions[:, 1:], -30, 30)), np.exp(moves)
    a, b = passes[0][:, :-1], passes[1][:, 1:]
    joint = np.stack([[m[0, 0] * np.ones_like(a), m[0, 1] * x * b], [a * m[1, 0], a * m[1, 1] * x * b]])
    return joint / joint.sum((0, 1))


def fit_score(documents: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method: intercept, then the weights."""
    if not len(labels):
        return np.array([-30.0, 0, 0])
    x = np.concatenate([np.ones((len(labels), 1)), documents], 1)
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * documents.shape[1]]) * len(labels) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def count_forms(rows: DataFrame) -> DataFrame:
    """``rows(text, toxic)`` to (form, toxic, clean): documents of each label that have a form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, distinct, counts = split_words(batch.column("text"))
            if not len(codes):
                continue
            label = np.asarray(batch.column("toxic"))
            text = np.repeat(np.arange(len(counts)), counts)
            once = np.unique(text * len(distinct) + codes)
            names, number = np.unique(features(distinct)[1], return_inverse=True)
            pairs = np.unique((once // len(distinct))[:, None] * len(names) + number.reshape(len(distinct), -1)[once % len(distinct)])
            toxic = label[pairs // len(names)] == 1
            found = [np.bincount(pairs[x] % len(names), minlength=len(names)) for x in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(x.astype(np.int64)) for x in found]], names=["form", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(run, "form long, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def offending_forms(forms: DataFrame, toxic: int, clean: int, share: float = 0.8) -> DataFrame:
    """The forms of a written ``forms`` table that stand in toxic documents: at least ``share``
    of a form's documents are toxic, and its likelihood ratio is so large that none of this
    many forms would reach it by chance."""
    base = toxic / max(1, toxic + clean)
    n = F.col("toxic") + F.col("clean")
    part = lambda x, q: F.when(x > 0, x * F.log(x / (n * F.lit(q)))).otherwise(F.lit(0.0))
    ratio = 2 * (part(F.col("toxic"), base) + part(F.col("clean"), 1 - base))
    if not 0 < base < 1:
        return forms.select("form").limit(0)
    least = 2 * np.log(max(1, forms.count())) + 4
    return forms.where((F.col("toxic") >= share * n) & (ratio > float(least))).select("form")


def train(docs: DataFrame, labels: DataFrame, sequences_per_label: int = 6_000, documents_per_label: int = 4_000, held_out: int = 1) -> Field:
    """A field from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, of rows with a label
    of 0 or 1, a text, and a remainder other than ``held_out``.

    Forms are counted over all these rows. The field learns from some ``sequences_per_label``
    sequences of each label, the score from some ``documents_per_label`` documents of each, both
    drawn by a hash of doc_id out of all of them; that bounds what reaches the driver. Rows with
    a null id are not learned from; of several labels of an id the largest counts. Reruns
    learn the same. Without toxic labels, or forms that tell them, every text gets the
    share of toxic labels as its score, and 0 if there are none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (remainder(F.col("doc_id")) != held_out))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = saved(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    rows = texts.join(broadcast_if_small(known, 12), "doc_id")
    rows = saved(rows, "labelled-texts")  # read three times; as large as the labelled texts
    totals = {r["toxic"]: (r["n"], r["size"]) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    n1, n0 = totals.get(1, (0, 0))[0], totals.get(0, (0, 0))[0]
    offending = offending_forms(saved(count_forms(rows), "forms"), n1, n0)

    shares = {k: min(1.0, sequences_per_label / max(1.0, size / (6 * SEQUENCE))) for k, (_, size) in totals.items()}
    sample = _draw(rows, shares).toArrow().sort_by([("toxic", "ascending"), ("doc_id", "ascending"), ("place", "ascending"), ("sequence", "ascending")])
    field = Field(np.zeros(1 << TABLE_BITS), np.zeros((2, 2)), np.zeros(3))
    codes, distinct, counts = split_words(sample.column("sequence").combine_chunks())
    if len(codes) and n1 and n0:
        table, forms = features(distinct)
        spark = docs.sparkSession
        here = spark.createDataFrame(pa.table({"form": np.unique(forms)}))
        bad = np.asarray(offending.join(here, "form", "left_semi").toArrow().column("form"), np.int64)
        marked = np.isin(forms, bad).any(1)
        tags = (marked[codes] & (np.repeat(np.asarray(sample.column("toxic")), counts) == 1)).astype(float)
        if tags.any():
            field = fit_field(table, codes, tags, *sequences(counts))
    draws = {k: min(1.0, documents_per_label / max(1, n)) for k, (n, _) in totals.items()}
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(13)), 11) / float(1 << 53)
    some = rows.where(uniform < F.when(F.col("toxic") == 1, F.lit(draws.get(1, 0.0))).otherwise(F.lit(draws.get(0, 0.0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = document_features(*field.words(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "toxic", "most", "sum"])

    got = some.mapInArrow(run, "doc_id long, toxic int, most double, sum double").toArrow().sort_by([("doc_id", "ascending"), ("most", "ascending"), ("sum", "ascending")])
    y = np.asarray(got.column("toxic"), float)
    field.score = fit_score(np.stack([np.asarray(got.column("most")), np.asarray(got.column("sum"))], 1), y)
    # the sample has as many of each label as it can: move the intercept to their real shares
    if 0 < y.sum() < len(y):
        field.score[0] += np.log(n1 / n0) - np.log(y.sum() / (len(y) - y.sum()))
    return field


def _draw(rows: DataFrame, shares: dict[int, float]) -> DataFrame:
    """Sequences (doc_id, toxic, place, sequence), each drawn with its label's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))):
                words = re.findall(WORD, text)
                number = -(-len(words) // SEQUENCE)
                for k in np.flatnonzero(np.random.default_rng([doc_id & (2**63 - 1), 11]).random(number) < shares[toxic]).tolist():
                    out.append((doc_id, toxic, k, " ".join(words[k * SEQUENCE : (k + 1) * SEQUENCE])))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["doc_id", "toxic", "place", "sequence"])

    return rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, place long, sequence string")


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words over one half: code points from start to end (exclusive), and their largest marginal."""
    out: list[dict] = []
    last = -2
    for k, m in enumerate(re.finditer(WORD, text)):
        if p[k] > 0.5:
            if k == last + 1:
                out[-1] |= {"end": m.end(), "probability": max(out[-1]["probability"], float(p[k]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "probability": float(p[k])})
            last = k
    return out


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and spans (start, end, probability)
    added, or replaced where they exist.

    Null and empty texts, and texts of white space, have no spans and the score of a text
    without any offending word. Whole texts are read, however long, and nothing but the text;
    repeated rows get the same. An empty table gives an empty result. Other columns stay.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "spans")]
    read = free_name(docs, "text_read")
    added = StructType.fromDDL("score double, spans array<struct<start:long,end:long,probability:double>>")
    schema = StructType([*docs.select(*kept).schema.fields, *added.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, read):
            texts = batch.column(read)
            p, counts = field.words(texts)
            ends = np.cumsum(counts)
            marked = np.flatnonzero(p > 0.5)
            spans: list[list[dict]] = [[] for _ in counts]
            for k in np.unique(np.searchsorted(ends, marked, "right")).tolist():
                spans[k] = _spans(texts[k].as_py(), p[ends[k] - counts[k] : ends[k]])
            scores = pa.array(field.scores(document_features(p, counts)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores, pa.array(spans, kind)], names=[*kept, "score", "spans"])

    return docs.select(*kept, F.col("text").cast("string").alias(read)).mapInArrow(run, schema)


def predict(docs: DataFrame, field: Field, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted, spans. A
    null id counts as not held out. Else as ``tag``; further columns are ignored."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"), "text")
    return tag(ids, field).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
