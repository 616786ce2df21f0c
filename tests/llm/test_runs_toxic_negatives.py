"""Periodic runs, toxicity and hard negatives, against brute force and by held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.llm import hard_negatives, periodic_runs, queries, toxicity

SMALL = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- periodic runs


def brute_runs(s: list) -> list[tuple[int, int, int]]:
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def run_row(doc_id: int, text: str | None) -> tuple:
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, b, q in runs for i in range(a + q, a + b)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_sequences():
    r = random.Random(5)
    for _ in range(1500):
        letters, s = r.choice([1, 2, 2, 3, 5, 30]), []
        while len(s) < r.randint(0, 90):
            word = [r.randrange(letters) for _ in range(r.randint(1, 6))]
            s += (word * 9)[: r.randint(1, 9 * len(word))] if r.random() < 0.5 else word
        a = np.array(s, np.int64)
        assert periodic_runs.runs_of(a, periodic_runs.way_back(a, np.zeros(len(a), np.int64))) == brute_runs(s), s


def test_suffix_array_and_squares():
    r = random.Random(2)
    for _ in range(300):
        s = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(1, 40))]
        array, inverse, lcp = periodic_runs.suffix_array(np.array(s))
        expected = sorted(range(len(s)), key=lambda i: s[i:])
        assert array.tolist() == expected and inverse[array].tolist() == list(range(len(s)))
        common = lambda a, b: next((k for k in itertools.count() if max(a, b) + k >= len(s) or s[a + k] != s[b + k]))
        assert lcp.tolist()[1:] == [common(a, b) for a, b in zip(expected, expected[1:])]
        squares = {(q, i) for q in range(1, len(s)) for i in range(len(s) - 2 * q + 1) if s[i : i + q] == s[i + q : i + 2 * q] and (i + 2 * q == len(s) or s[i + q] != s[i + 2 * q])}
        found = periodic_runs.branching_squares(np.array(s), len(s))
        assert set(found) == squares and len(found) == len(squares)


def test_long_runs_take_little_time():
    one = np.zeros(30_000, np.int64)
    assert periodic_runs.runs_of(one, periodic_runs.way_back(one, one)) == [(0, 30_000, 1)]
    wide = np.tile(np.arange(3_000), 8)
    assert periodic_runs.runs_of(wide, periodic_runs.way_back(wide, wide * 0)) == [(0, 24_000, 3_000)]


def test_op12_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, SMALL).select(columns).collect()))
    assert got == sorted(run_row(*r) for r in docs)
    assert any(r[1] for r in got)


def test_runs_of_odd_rows(spark):
    rows = [(1, "a " * 7, "x"), (1, "a " * 7, "x"), (None, None, "x"), (2, "", None), (3, " \t\n\x0b\x0c\r", "x"), (4, "é\xa0é " * 6 + "é\xa0", "x"), (5, "w" * 3_000_000, "x"), (6, "A a " * 3 + "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"][:9]) for r in periodic_runs.find_runs(docs).collect()}
    assert got == {(1, 7, ((0, 7, 1),), "a"), (None, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 7, ((0, 6, 1),), "é\xa0é é\xa0"), (5, 1, (), "w" * 9), (6, 7, (), "A a A a A")}
    assert periodic_runs.find_runs(docs).count() == len(rows)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity


def some_field(rng) -> toxicity.Field:
    return toxicity.Field(rng.normal(0, 1, 1 << toxicity.TABLE_BITS), rng.normal(0, 1, (2, 2)), np.zeros(3))


def path_score(emissions, moves, tags) -> float:
    return sum(e for e, t in zip(emissions, tags) if t) + sum(moves[a, b] for a, b in zip(tags, tags[1:]))


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        field = some_field(rng)
        e = np.zeros((1, toxicity.SEQUENCE))
        e[0, :n] = rng.normal(0, 2, n)
        real = np.arange(toxicity.SEQUENCE)[None, :] < n
        p, passes = field.marginals(e, real)
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.exp([path_score(e[0, :n], field.moves, t) for t in paths])
        weight /= weight.sum()
        assert np.allclose(p[0, :n], [sum(w for w, t in zip(weight, paths) if t[i]) for i in range(n)])
        joint = toxicity._joint(field.moves, e, passes)
        for t in range(n - 1):
            assert np.allclose(joint[:, :, 0, t], [[sum(w for w, x in zip(weight, paths) if (x[t], x[t + 1]) == (i, j)) for j in (0, 1)] for i in (0, 1)])


def test_words_and_sequences():
    import pyarrow as pa

    texts = ["a  b\ta", None, "", " \n", " x " * 70]
    codes, distinct, counts = toxicity.split_words(pa.array(texts, pa.string()))
    assert counts.tolist() == [3, 0, 0, 0, 70]
    assert [distinct[c].as_py() for c in codes[:4].tolist()] == ["a", "b", "a", " x"]
    first, length = toxicity.sequences(counts)
    assert list(zip(first.tolist(), length.tolist())) == [(0, 3), (3, 64), (67, 6)]
    table, forms = toxicity.features(pa.array(["Idiot!", "idiot", "idiots", "", "ü", "x" * 100_000]))
    assert forms[0].tolist() == forms[1].tolist() and forms[1, 1:3].tolist() == forms[2, 1:3].tolist() and forms[1, 0] != forms[2, 0]
    assert table.shape == (6, toxicity._OWN + 2) and table.min() >= 0 and table.max() < 1 << toxicity.TABLE_BITS


def test_held_out_toxicity(spark):
    """Labels of the given tables hold some that no word explains; of the documents with an
    offending word nearly all are found, and few clean ones are."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.predict(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hit")).collect()
    by = {r["toxic"]: (r["n"], r["hit"]) for r in got}
    assert by[1][1] >= 0.78 * by[1][0] and by[0][1] <= 0.01 * by[0][0], by


def made_docs(n: int = 600) -> tuple[list, list]:
    r = random.Random(8)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randint(5, 90))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(["zorkle", "vilyx" + r.choice("abcdefgh") * r.randint(1, 6)]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_unseen_endings_odd_rows_and_spans(spark):
    docs, labels = made_docs()
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7, None), (8, 5), (9, 1), (9, 0)], "doc_id long, toxic int")
    field = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(field.weights, again.weights) and np.array_equal(field.score, again.score)
    text = "abc def, VILYXqqq! gh zorkle"
    rows = [(1, text, "x"), (1, text, "x"), (None, None, "x"), (2, "", None), (3, "abc def gh abc", "y"), (4, "abc " * 400_000 + "zorkle zorkle zorkle", "z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.tag(odd, field).select("doc_id", "text", "score", "spans").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [text[s["start"] : s["end"]] for s in by[1]["spans"]] == ["VILYXqqq!", "zorkle"] and by[1]["score"] >= 0.7
    assert by[4]["score"] >= 0.7 and by[4]["spans"][-1]["end"] == 1_600_020
    assert by[2]["score"] == by[None]["score"] < 0.3 and by[3]["score"] < 0.3 and not by[2]["spans"]
    assert toxicity.predict(odd.limit(0), field).count() == 0
    assert {r["predicted"] for r in toxicity.predict(odd, field).collect()} == {0, 1}


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(0, 0), (4, 0), (5, 0)], 0.0), ([(0, 1), (4, 1), (5, 1)], 1.0)])
def test_labels_of_one_kind(spark, labels, score):
    docs, _ = made_docs(8)
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    field = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(abs(r["score"] - score) < 0.01 and not r["spans"] for r in toxicity.tag(docs, field).collect())


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows: list[tuple], every: int) -> list[tuple]:
    usable = {(i, label, tuple(int(np.floor(256 * float(v))) for v in x)) for i, x, label in rows if None not in (i, x, label) and all(v is not None and np.isfinite(v) for v in x)}
    dot = lambda a, b: min(max(sum(p * q for p, q in zip(a, b)), -(1 << 63)), (1 << 63) - 1)
    out = []
    for a in (r for r in usable if r[0] % every == 0):
        scored = sorted(((-dot(a[2], r[2]), r[0], r[1]) for r in usable))
        for p in [x for x in scored if x[2] == a[1] and x[1] != a[0]][:5]:
            fits = [x for x in scored if x[2] != a[1] and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]][:10]
            out += [(a[0], p[1], k, x[1], -p[0], -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more) -> list[tuple]:
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.quantised(df), **more).collect()))


def vectors(n: int, dims: int, seed: int, kinds: int = 3, grid: float | None = None) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.normal(0.2, 0.5, (n, dims))
    if grid:
        x = np.round(x / grid) * grid
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(kinds))) for i in range(n)]


@pytest.mark.parametrize("dims, seed, grid, block", [(2, 1, None, 4), (5, 2, 0.5, 8), (3, 3, 1.0, 512)])
def test_hard_negatives_of_many_blocks(spark, dims, seed, grid, block):
    rows = vectors(400, dims, seed, grid=grid)  # a coarse grid makes ties and repeated vectors
    assert mined(spark, rows, every=20, block=block) == brute_negatives(rows, 20)


def test_hard_negatives_of_odd_rows(spark):
    rows = [*vectors(60, 4, 7), (None, [1.0, 1.0, 1.0, 1.0], 1), (100, None, 1), (101, [1.0, None, 1.0, 1.0], 1), (102, [float("nan")] * 4, 1), (103, [float("inf"), 1.0, 1.0, 1.0], 1), (104, [1.0] * 4, None)]
    rows += [(200, [0.5, 0.25], 0), (201, [], 1), (202, [0.0] * 4, 2), (10, [0.75] * 4, 0), (10, [0.75] * 4, 0), (0, [0.5] * 4, 1)]
    rows += [(300 + i, [0.25] * 4, i % 2) for i in range(40)]  # one very common vector
    assert mined(spark, rows, every=10, block=8) == brute_negatives(rows, 10)
    assert mined(spark, [], every=10) == []
    assert mined(spark, [(0, [1.0], 1)], every=10) == []
    huge = [(i, [float(np.float32(x)) for x in ([3e38, 1.0] if i % 3 else [2e6 * i, -1e6])], i % 2) for i in range(30)]
    assert mined(spark, huge, every=10, block=4) == brute_negatives(huge, 10)


def test_bounds_and_the_curve(spark):
    rng = np.random.default_rng(4)
    a, x = rng.integers(-50, 50, (6, 7)).astype(float), rng.integers(-50, 50, (20, 7)).astype(float)
    lo, hi = hard_negatives.bounds(a, x.min(0)[None], x.max(0)[None])
    products = a @ x.T
    assert (lo[:, 0] <= products.min(1)).all() and (hi[:, 0] >= products.max(1)).all()
    cells = np.array(list(itertools.product(range(4), repeat=3)))
    walk = cells[np.argsort(hard_negatives.hilbert_keys(cells))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # a Hilbert curve goes from cell to neighbour


def test_few_blocks_are_read(spark):
    """In two dimensions the zone maps tell most blocks apart: the second step reads a part of them."""
    rng = np.random.default_rng(9)
    turn = rng.uniform(0, 2 * np.pi, 4_000)
    rows = spark.createDataFrame([(i, [float(np.cos(t)), float(np.sin(t))], i % 3) for i, t in enumerate(turn)], "vec_id long, embedding array<float>, label int")
    blocks = hard_negatives.write_blocks(hard_negatives.quantised(rows), 32)
    pages, n = hard_negatives.pages_of(blocks), blocks.count()
    anchors = hard_negatives.anchors_of(blocks, 100).withColumns({"low": F.array(F.lit(55_000).cast("long")), "high": F.array(F.lit(60_000).cast("long")), "floor": F.array(F.lit(0).cast("long"))})
    tiles = hard_negatives.tiles_of(anchors, 1)
    pairs = hard_negatives.needed(tiles, pages, False).count()
    assert n > 100 and pairs < 0.5 * n * anchors.count()
