"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The word stream of a source is its documents in hashed order, cut into blocks of
``block_words`` words. A source's quota is its target rounded to a word: whole passes over
all its blocks, then blocks until the quota is met, the last one in part. A binary tree deals
the quotas' blocks to output shards: each node halves its blocks, and how many of each source
go left is a hypergeometric draw given what the earlier sources took. So every shard gets an
exact count of blocks of each source. These counts cut a permuted order of the source's
blocks, a permutation for each pass, into one stretch for each shard: a shard draws the
blocks of its stretches, which are disjoint, and shuffles them locally.

DataFrame functions only. Placing works on slim rows, without texts; texts meet their places
once. A hot source is spread over buckets of some ``BUCKET`` documents: sums per bucket, a
running sum over buckets, and a window inside each bucket replace a window over the source.
What is kept per source is one row; the tree holds one count per source and node, and its
nodes are dealt to tasks at every level.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, free_name, parts_for, saved

WEIGHTS = (5, 2, 1)
#: Documents in a bucket of a source, on average.
BUCKET = 5_000
#: Words of a shard, some, as long as ``MOST_LEVELS`` levels of the tree suffice for that.
SHARD_WORDS, MOST_LEVELS = 4_000_000, 12
#: Multipliers of the block permutations: primes, so that they are coprime to any number that they don't divide.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """``sizes(source, source_size, docs)`` with sid, weight and target.

    Sources by code point, null last, take the weights in turn and share the sum of all
    sizes by weight; a target stops at ``max_repeat`` times its source's size and the
    excess is shared again. In the order of cap per weight the capped sources are a prefix,
    so one running sum finds the level at which the rest stand. The windows hold one row
    for each source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("room"), F.col("sid"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("sid", F.row_number().over(every))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights)).cast("int") + 1))
        .withColumn("cap", F.col("source_size") * F.lit(max_repeat))
        .withColumn("room", F.col("cap") / F.col("weight"))
    )
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("capped", F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0))) / F.col("rest"))
    )
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "sid", "level"))).over(whole)["level"]
    return (
        levels.withColumn("found", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("found") * F.col("weight"), F.lit(0.0))))
        .select("source", "source_size", "docs", "sid", "weight", "target")
    )


def _hypergeometric(population: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``population`` are among ``good``: inverse transform of
    the uniform ``u``, walking from the mode up, then down, over 12 deviations."""
    low = F.greatest(F.lit(0).cast("long"), draws + good - population)
    high = F.least(good, draws)
    mode = F.least(high, F.greatest(low, F.floor((draws + 1) * (good + 1).cast("double") / (population + 2)).cast("long")))
    share = good / F.greatest(population, F.lit(1))
    reach = F.ceil(12 * F.sqrt(draws * share * (1 - share))).cast("long") + 12
    bound = F.struct(population.alias("n"), good.alias("g"), draws.alias("d"), mode.alias("m"), F.least(high - mode, reach).alias("up"), F.least(mode - low, reach).alias("down"))

    def walk(b: Column) -> Column:
        def rise(k: Column) -> Column:  # weight of k + 1 over that of k
            return (b["g"] - k) * (b["d"] - k).cast("double") / ((k + 1) * (b["n"] - b["g"] - b["d"] + k + 1).cast("double"))

        def steps(n: Column) -> Column:
            return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))

        start = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("z"))
        go = lambda ratio: lambda a, j: F.struct((a["f"] * ratio(j)).alias("f"), (a["z"] + a["f"]).alias("z"))
        up = lambda j: rise(b["m"] + j - 1)
        down = lambda j: 1 / rise(b["m"] - j)
        total = lambda a: a["z"] + a["f"]
        z_up = F.aggregate(steps(b["up"]), start, go(up), total)
        z_down = F.aggregate(steps(b["down"]), start, go(down), total) - 1

        def pick(s: Column) -> Column:  # s: mass wanted, mass at and above the mode
            begin = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("z"), F.lit(0).cast("long").alias("k"))
            # counts the steps whose mass so far, the step before included, lies under what is wanted
            walk_up = F.aggregate(
                steps(b["up"]), begin, lambda a, j: F.struct((a["f"] * up(j)).alias("f"), (a["z"] + a["f"]).alias("z"), (a["k"] + (a["z"] + a["f"] <= s["want"]).cast("long")).alias("k")), lambda a: a["k"]
            )
            rest = s["want"] - s["upper"]
            walk_down = F.aggregate(
                steps(b["down"]),
                F.struct(F.lit(1.0).alias("f"), F.lit(-1.0).alias("z"), F.lit(0).cast("long").alias("k")),
                lambda a, j: F.struct((a["f"] * down(j)).alias("f"), (a["z"] + a["f"]).alias("z"), (a["k"] + (a["z"] + a["f"] <= rest).cast("long")).alias("k")),
                lambda a: a["k"],
            )
            return F.when(s["want"] < s["upper"], b["m"] + walk_up).otherwise(b["m"] - F.greatest(F.lit(1).cast("long"), F.least(walk_down, b["down"])))

        mass = F.transform(F.array(F.struct(z_up.alias("upper"), z_down.alias("lower"))), lambda z: F.struct((u * (z["upper"] + z["lower"])).alias("want"), z["upper"].alias("upper"), z["lower"].alias("lower")))
        return F.when(b["up"] + b["down"] == 0, b["m"]).otherwise(F.element_at(F.transform(mass, lambda s: F.when((s["lower"] <= 0) & (s["want"] >= s["upper"]), b["m"]).otherwise(pick(s))), 1))

    return F.element_at(F.transform(F.array(bound), walk), 1)


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def splitting_tree(counts: DataFrame, levels: int, seed: int) -> DataFrame:
    """``counts(sid, blocks)`` dealt to 2 ** levels shards: shard, counts (by sid)."""
    nodes = counts.groupBy().agg(
        F.lit(0).cast("long").alias("shard"),
        F.transform(F.array_sort(F.collect_list(F.struct("sid", "blocks"))), lambda x: x["blocks"]).alias("counts"),
    )
    for level in range(levels):

        def left(node: Column, row: Column, level=level) -> Column:
            total = F.aggregate(row, F.lit(0).cast("long"), lambda a, x: a + x)
            # a node with an odd number gives the odd block to a hashed side
            half = F.floor((total + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), node), F.lit(2))) / 2).cast("long")
            begin = F.struct(total.alias("n"), half.alias("d"), F.array().cast("array<bigint>").alias("out"))

            def draw(a: Column, good: Column) -> Column:
                u = _uniform(F.lit(seed + 1), F.lit(level), node, F.size(a["out"]))
                k = _hypergeometric(a["n"], good, a["d"], u)
                return F.element_at(
                    F.transform(F.array(k), lambda k: F.struct((a["n"] - good).alias("n"), (a["d"] - k).alias("d"), F.concat(a["out"], F.array(k)).alias("out"))), 1
                )

            return F.aggregate(row, begin, draw, lambda a: a["out"])

        split = nodes.withColumn("left", left(F.col("shard"), F.col("counts")))
        sides = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("counts")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("counts", "left", lambda c, x: c - x).alias("counts")),
        )
        nodes = split.select(F.explode(sides).alias("side")).select("side.*").repartition("shard")
    return nodes


def _row_hashes(docs: DataFrame, seed: int) -> list[Column]:
    """128 bits of hash of doc_id, source and text, where there."""
    fields = [F.col(c) for c in ("doc_id", "source", "text") if c in docs.columns]
    return [F.xxhash64(F.lit(seed + k), *fields).alias(name) for k, name in ((0, "key"), (9, "key2"))]


def mix_plan(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: int = 3,
    block_words: int = 1_024,
    shard_levels: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: key and key2 (its hashes), doc_id,
    source, size, source_size, target, taken, pieces.

    ``size`` counts words unless a column is given. ``pieces`` lists what the shards draw of
    the document: shard, slot (the shuffled order inside the shard), epoch, block, and words
    from (0 is the first) up to but without ``to``; ``taken`` are their words. A source's
    taken words are its target rounded; no word is taken over ``max_repeat`` times, since no
    pass repeats a word. There are 2 ** ``shard_levels`` shards, by default of some
    ``SHARD_WORDS`` words.

    Null or blank texts have size 0 and nothing is taken. Null is a source like others. Ids
    may be null or repeat: every row is a document. Texts may be of any length. Reruns agree:
    all order comes from hashes of the row and the seed. An empty table gives an empty
    result; further columns are ignored, whatever their names.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = saved(docs.select(*_row_hashes(docs, seed), F.col("doc_id"), F.col("source"), size.cast("long").alias("size")), "mix-rows")
    sizes = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "mix-sizes")
    if shard_levels is None:
        words = sizes.agg(F.sum("source_size")).first()[0] or 0
        shard_levels = min(MOST_LEVELS, max(0, ceil(log2(max(1, words / SHARD_WORDS)))))
    quota = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * max_repeat)
    lead = (
        source_targets(sizes, weights, max_repeat)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", quota - F.col("passes") * F.col("source_size"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("short", block_words - (F.col("blocks") * block_words - F.col("source_size")))
        .withColumn("buckets", F.ceil(F.col("docs") / BUCKET).cast("long"))
    )
    # the short last block of a source shifts what stands after it in the last pass
    short_at = _position(F.col("blocks") - 1, F.col("sid"), F.col("passes"), F.col("blocks"), seed)
    plain = F.ceil(F.col("rest") / block_words).cast("long")
    lead = (
        lead.withColumn("short_at", F.when(F.col("blocks") > 0, short_at))
        .withColumn("last", F.when(F.coalesce(plain <= F.col("short_at"), F.lit(True)), plain).otherwise(F.ceil((F.col("rest") + block_words - F.col("short")) / block_words).cast("long")))
    )
    lead = saved(lead, "mix-quotas")
    tree = splitting_tree(lead.select("sid", (F.col("passes") * F.col("blocks") + F.col("last")).alias("blocks")), shard_levels, seed)
    runs = tree.select("shard", F.posexplode("counts").alias("sid", "n")).select("shard", (F.col("sid") + 1).alias("sid"), "n")
    upper = F.sum("n").over(Window.partitionBy("sid").orderBy("shard"))
    bounds = runs.select("sid", "shard", upper.alias("upper")).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "upper"))), lambda x: x["upper"]).alias("bounds"))
    lead = saved(lead.join(bounds, "sid").withColumnRenamed("source", "source_"), "mix-lead")

    # one row for each source, with a number for each shard
    lead = broadcast_if_small(lead, F.coalesce(F.octet_length("source_"), F.lit(0)) + 160 + 8 * F.size("bounds"))
    placed = rows.join(lead, F.col("source").eqNullSafe(F.col("source_"))).withColumn("bucket", F.pmod(F.col("key"), F.col("buckets")))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("sid").orderBy("bucket")
    before = saved(sums.select("sid", "bucket", (F.sum("words").over(running) - F.col("words")).alias("before")), "mix-buckets")
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "key2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.join(before, ["sid", "bucket"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    pieces = _pieces(block_words, seed, shard_levels)
    return placed.withColumn("pieces", pieces).select(
        "key", "key2", "doc_id", "source", "size", "source_size", "target",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"]).alias("taken"),
        "pieces",
    )


def _position(block: Column, sid: Column, epoch: Column, blocks: Column, seed: int) -> Column:
    """Where a block stands in the permuted order of a pass."""
    key = F.xxhash64(F.lit(seed + 2), sid, epoch)
    coprime = F.filter(F.array(*[F.lit(p) for p in _PRIMES]), lambda p: blocks % p != 0)
    factor = F.pmod(F.element_at(coprime, (F.pmod(key, F.size(coprime)) + 1).cast("int")), blocks)
    # from 2^31 blocks on a product may pass 64 bits; decimals hold it exactly
    wide = F.pmod(block.cast("decimal(19,0)") * factor.cast("decimal(19,0)"), blocks.cast("decimal(19,0)")).cast("long")
    product = F.when(blocks < 1 << 31, F.pmod(block * F.when(blocks < 1 << 31, factor).otherwise(1), blocks)).otherwise(wide)
    return F.pmod(product + F.pmod(F.shiftright(key, 8), blocks), blocks)


def _shard(index: Column, levels: int) -> Column:
    """The shard whose stretch holds the index: the number of bounds at or below it, by
    bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(levels))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda low, step: low + F.when(F.get(F.col("bounds"), low + step - 1) <= index, step).otherwise(0))


def _pieces(block_words: int, seed: int, levels: int) -> Column:
    start, end = F.col("start"), F.col("start") + F.col("size")
    sid, blocks = F.col("sid"), F.col("blocks")
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(start / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    epochs = F.sequence(F.lit(0).cast("long"), F.col("passes"))

    def piece(block: Column, epoch: Column) -> Column:
        def drawn(at: Column) -> Column:
            ahead = at * block_words - F.when(at > F.col("short_at"), block_words - F.col("short")).otherwise(0)
            whole = F.lit(block_words).cast("long")
            part = F.least(whole, F.greatest(F.lit(0).cast("long"), F.col("rest") - ahead))
            upto = block * block_words + F.when(epoch < F.col("passes"), whole).otherwise(part)
            index = epoch * blocks + at
            # what lies beyond the stretch of the last shard is not drawn
            return F.when(
                index < F.element_at("bounds", -1),
                F.struct(
                    _shard(index, levels).alias("shard"),
                    F.xxhash64(F.lit(seed + 3), sid, epoch, block).alias("slot"),
                    epoch.cast("int").alias("epoch"),
                    block.alias("block"),
                    (F.greatest(start, block * block_words) - start).alias("from"),
                    (F.least(end, upto) - start).alias("to"),
                ),
            )

        return F.element_at(F.transform(F.array(_position(block, sid, epoch, blocks, seed)), drawn), 1)

    every = F.flatten(F.transform(touched, lambda block: F.transform(epochs, lambda epoch: piece(block, epoch))))
    return F.filter(every, lambda p: p["to"] > p["from"])


def _mixed(docs: DataFrame, shard: str, slot: str, **options) -> DataFrame:
    """A row for each document, pass and shard that draws words of it, with the columns of
    ``docs`` and its shard and slot; not in order."""
    seed = options.get("seed", 7)
    group = lambda p: F.struct(p["epoch"].alias("epoch"), p["shard"].alias("shard"))
    plan = mix_plan(docs, **options).where("taken > 0").select("key", "key2", F.col("size").alias("n"), "pieces", F.explode(F.array_distinct(F.transform("pieces", group))).alias("g"))
    mine = F.filter("pieces", lambda p: (p["epoch"] == F.col("g.epoch")) & (p["shard"] == F.col("g.shard")))
    spans = F.array_sort(F.transform(mine, lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to"))))
    places = plan.select(F.struct("key", "key2").alias("k"), "n", F.col("g.shard").alias("shard"), F.array_min(F.transform(mine, lambda p: p["slot"])).alias("slot"), spans.alias("spans"))
    places = saved(places.withColumn("words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"])), "mix-places")
    places = places.select("k", F.struct("n", "shard", "slot", "spans", "words").alias("p"))
    texts = docs.select(F.struct(*_row_hashes(docs, seed)).alias("k"), F.struct(*docs.columns).alias("row"))
    # rows that repeat have their places once each, so they bring their text only once
    repeats = saved(mix_repeats(docs, seed), "mix-repeats")
    if not repeats.isEmpty():
        texts = texts.join(repeats, "k", "left_anti").unionByName(texts.join(repeats, "k", "left_semi").dropDuplicates(["k"]))
    rows = texts.join(places, "k")
    # a word with what stands before it; what follows the last word ends the last piece
    parts = F.split(F.col("row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D]+[^\x20\x09-\x0D])", -1)
    cut = F.element_at(
        F.transform(F.array(parts), lambda w: F.array_join(F.flatten(F.transform("p.spans", lambda x: F.slice(w, (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")))), "")), 1
    )
    whole = F.col("p.words") == F.col("p.n")
    rows = rows.select("row", "p", whole.alias("whole"), F.when(whole, F.col("row.text")).otherwise(cut).alias("text"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            columns.append(F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col("row").getField(name).alias(name))
    return rows.select(*columns, F.col("p.shard").alias(shard), F.col("p.slot").alias(slot))


def mix_repeats(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Keys of rows that repeat doc_id, source and text: (k)."""
    return docs.select(F.struct(*_row_hashes(docs, seed)).alias("k")).groupBy("k").count().where("count > 1").select("k")


def _in_order(rows: DataFrame, docs: DataFrame, shard: str, slot: str) -> DataFrame:
    """Each shard's rows together, in a few stretches of slots, sorted by slot."""
    parts = parts_for(docs)
    stretch = F.shiftrightunsigned(slot, 58)  # of 64
    return rows.repartition(parts, F.col(shard), stretch).sortWithinPartitions(shard, slot)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix with its texts: a row for each document, pass and shard that draws words of
    it, with the columns of ``docs``, whatever their names. Where the shard draws all words
    of a pass the row is as it was; else its text is the drawn words with the white space
    before them, and n_chars, if there, is counted anew. Rows of a shard lie together in
    shuffled order. Rows that repeat doc_id, source and text share the columns of one of them.
    Options are those of ``mix_plan``. An empty table gives an empty result."""
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    return _in_order(_mixed(docs, shard, slot, **options), docs, shard, slot).drop(shard, slot)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The mix with its texts as Parquet, a folder for each shard, each file in slot order."""
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    _in_order(_mixed(docs, shard, slot, **options), docs, shard, slot).write.partitionBy(shard).parquet(path)
