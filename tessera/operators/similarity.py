"""Threshold similarity self-joins of sets, exact at any size."""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def word_shingles(text: Column, width: int) -> Column:
    """Distinct hashes of runs of ``width`` words; shorter texts have none."""
    words = F.split(F.trim(F.lower(text)), r"\s+")
    n = F.size(words) - (width - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " "))))


def shingle_rows(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, features) with each text split once."""
    words = df.select(F.col(key).alias("id"), F.split(F.trim(F.lower(text)), r"\s+").alias("w")).filter((F.size("w") >= width) & F.col("id").isNotNull())
    # each word is hashed once, a shingle is the hash of its words' hashes
    words = words.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    each = F.transform(F.sequence(F.lit(0), F.size("h") - width), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(width))))
    # a text's features move as one array
    made = words.select("id", F.array_distinct(each).alias("features")).groupBy("id").agg(F.collect_list("features").alias("l"))
    return made.select("id", F.when(F.size("l") == 1, F.get("l", 0)).otherwise(F.array_distinct(F.flatten("l"))).alias("features"))


def set_classes(sets: DataFrame) -> DataFrame:
    """Sets (id, features) with their class: id, cls (the smallest id of equal sets), n.

    Equal sets are told by their number of features and 128 bits of hashes over them in order.
    """
    features = F.sort_array("features")
    keyed = sets.filter("id IS NOT NULL AND size(features) > 0").select("id", F.size("features").alias("n"), F.xxhash64(features).alias("h"), F.xxhash64(F.lit(1), features).alias("g"))
    return keyed.withColumn("cls", F.min("id").over(Window.partitionBy("h", "g", "n"))).select("id", "cls", "n")


def set_class_pairs(sets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a < b of different classes of rows (id, features) with intersection / union >= num / den: a, b, inter, size_a, size_b.

    Prefix filter: with features in one global order, the rarest first, two sets that
    reach the threshold t share, of the larger, one of the first n - ceil(t n) + 1 features
    and, of the smaller, one of the first n - ceil(2 t n / (1 + t)) + 1. Candidates come from
    an equi-join on those and are cut by size and by what can still follow the
    feature they share; then they are verified on the full sets. The comparison is of integers.
    """
    first = classes.filter("id = cls").select("id")
    sets = sets.select("id", "features", F.size("features").alias("n")).filter("id IS NOT NULL AND n > 0")  # the same filter in all uses, so that the sets are made once
    sets = sets.join(first.hint("shuffle_hash"), "id", "left_semi")
    rows = sets.select("id", "n", F.explode("features").alias("f"))
    # features move once, to be counted; those of one set only meet nothing and go no further
    shared = rows.withColumn("df", F.count("*").over(Window.partitionBy("f"))).filter("df > 1")
    # counted from the last, a feature's place needs no number of all that are shared
    last = shared.withColumn("left", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("f"))))
    need, least = F.ceil(F.col("n") * num / F.lit(den) - 1e-9), F.ceil(F.col("n") * (2 * num) / F.lit(num + den) - 1e-9)
    prefix = last.filter(F.col("left") >= need).select("id", "n", "f", "left", (F.col("left") >= least).alias("small"))
    one, two = (prefix.select("f", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "left", "small"))) for k in "xy")
    n, m, most = F.least("n_x", "n_y"), F.greatest("n_x", "n_y"), F.least("left_x", "left_y")
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y")))
    near = F.when(smaller, F.col("small_x")).otherwise(F.col("small_y")) & (n * den >= m * num) & (most * den >= (n + m - most) * num)
    # conditions of both ends stay above the shuffle, which both sides then share
    found = one.join(two, "f").filter((F.col("id_x") < F.col("id_y")) & near).select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()
    for k in "ab":
        found = found.join(sets.select(F.col("id").alias(k), F.col("features").alias(f"f_{k}"), F.col("n").alias(f"size_{k}")), k)
    found = found.withColumn("inter", F.size(F.array_intersect("f_a", "f_b")))
    return found.filter(F.col("inter") * den >= (F.col("size_a") + F.col("size_b") - F.col("inter")) * num).select("a", "b", "inter", "size_a", "size_b")


def set_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a < b of rows (id, features) with intersection / union >= num / den: a, b, inter, size_a, size_b.

    Equal sets are compared once, as classes, and then written out.
    """
    classes = set_classes(sets)
    one, two = (classes.select(F.col("id").alias(f"id_{k}"), F.col("cls").alias(k), F.col("n").alias("inter")) for k in "ab")
    swap = F.col("id_a") > F.col("id_b")
    # merged: members of classes may be many, a plan's estimate may be of less
    apart = set_class_pairs(sets, classes, num, den).join(one.drop("inter").hint("merge"), "a").join(two.drop("inter").hint("merge"), "b").select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "inter",
        F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"),
    )
    equal = one.withColumnRenamed("a", "cls").hint("merge").join(two.withColumnRenamed("b", "cls").drop("inter"), "cls").filter("id_a < id_b")
    return apart.unionByName(equal.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "inter", F.col("inter").alias("size_a"), F.col("inter").alias("size_b")))


def sign_bits(vector: Column, size: int = 64) -> Column:
    """A long with bit i set where element i is positive."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.element_at(vector, i + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


#: Rows of a block where all blocks meet, and blocks at least; what a shuffled row costs in compared pairs; neighbours of a chunk's value at most.
BLOCK_ROWS, LEAST_BLOCKS, ROW_COST, MOST_NEIGHBOURS = 4096, 16, 10, 4096


def chunk_plan(size: int, sizes: dict[int, int], num: int, den: int) -> int | None:
    """The number of chunks at which sets of ``size`` bits (``sizes``: set bits -> sets) meet most cheaply; None where all blocks meeting is cheaper.

    A set of n bits differs from one that is no larger and reaches the threshold in at most
    d(n) bits, so of m chunks one differs in at most d(n) // m (the pigeonhole rule). Fewer
    chunks: more neighbours of each, smaller buckets.
    """
    rows = sum(sizes.values())
    best, least = None, rows * rows / 2 + rows * ROW_COST * (rows / BLOCK_ROWS + 1)
    for m in range(1, size + 1):
        width = -(-size // m)
        near = {n: sum(math.comb(width, k) for k in range(min(differ(n, num, den) // m, width) + 1)) for n in sizes}
        if max(near.values(), default=1) > MOST_NEIGHBOURS or any(differ(n, num, den) // m >= size // m for n in sizes):
            continue
        probes = sum(k * near[n] for n, k in sizes.items())
        cost = m * (rows + probes) * ROW_COST + m * rows * probes / 2 ** (size // m + 1)
        if cost < least:
            best, least = m, cost
    return best


def differ(n, num: int, den: int):
    """Bits by which a set of n differs at most from one no larger that reaches the threshold; for numbers and columns."""
    return (den - num) * 2 * n // (den + num) if isinstance(n, int) else F.floor(n * ((den - num) * 2) / (den + num)).cast("int")


def _likeness(met: DataFrame, num: int, den: int, compared: Observation | None) -> DataFrame:
    """Met pairs (x, y as bits, size_x, size_y) that reach the threshold, with inter; ``compared`` observes how many met (as n)."""
    if compared is not None:
        met = met.observe(compared, F.count("*").alias("n"))
    inter = F.bit_count(F.col("x").bitwiseAND(F.col("y")))
    return met.filter(inter * den >= (F.col("size_x") + F.col("size_y") - inter) * num).withColumn("inter", inter)


def bit_class_pairs(classes: DataFrame, m: int, sizes: dict[int, int], num: int, den: int, size: int = 64, compared: Observation | None = None) -> DataFrame:
    """Pairs of distinct sets (bits, n; x the larger, each pair once) with intersection / union >= num / den: x, y, inter, size_x, size_y. Exact.

    Sets meet on ``m`` chunks of their bits, the larger with all values within its radius, and a
    pair counts at its first chunk.
    """
    x, y = (classes.select(F.col("bits").alias(k), F.col("n").alias(f"size_{k}")) for k in "xy")
    radius = max(differ(n, num, den) // m for n in sizes)
    low = [size * j // m for j in range(m + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    mask = lambda j: signed((1 << (low[j + 1] - low[j])) - 1)
    cut = lambda c, j: F.shiftrightunsigned(c, low[j]).bitwiseAND(F.lit(mask(j)).cast("long"))
    flips = [[signed(sum(1 << b for b in on)) for k in range(radius + 1) for on in itertools.combinations(range(low[j + 1] - low[j]), k)] for j in range(m)]
    own = lambda j: F.filter(F.from_json(F.lit(json.dumps(flips[j])), "array<bigint>"), lambda f: F.bit_count(f) <= F.col("radius"))
    near = lambda j: F.transform(own(j), lambda f: F.struct(F.lit(j).alias("j"), cut(F.col("x"), j).bitwiseXOR(f).alias("v")))
    one = x.withColumn("radius", F.floor(differ(F.col("size_x"), num, den) / m).cast("int")).select("*", F.explode(F.flatten(F.array(*(near(j) for j in range(m))))).alias("c")).select("x", "size_x", "radius", "c.*")
    two = y.select("*", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), cut(F.col("y"), j).alias("v")) for j in range(m)))).alias("c")).select("y", "size_y", "c.*")
    larger = (F.col("size_x") > F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("x") < F.col("y")))
    met = one.join(two, ["j", "v"]).filter(larger & (F.col("size_y") * den >= F.col("size_x") * num))
    other = F.col("x").bitwiseXOR(F.col("y"))
    first = F.lit(True)
    for j in range(m - 1):
        first = first & ((F.col("j") <= j) | (F.bit_count(cut(other, j)) > F.col("radius")))
    return _likeness(met.filter(first), num, den, compared).select("x", "y", "inter", "size_x", "size_y")


def bit_block_pairs(rows: DataFrame, total: int, num: int, den: int, compared: Observation | None = None) -> DataFrame:
    """As ``bit_class_pairs`` where the threshold is so low that chunks save nothing: blocks of rows (id, bits, n, ...) meet, each two once.

    Pairs leave the join with all columns of both rows (``<name>_x``, ``<name>_y``), so none
    of them is shuffled again. The two blocks' numbers are a task's key; there are as many tasks.
    """
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_ROWS))
    tasks = blocks * (blocks + 1) // 2
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    named = lambda k, bits: rows.select(*(F.col(c).alias({"bits": k, "n": f"size_{k}"}.get(c, f"{c}_{k}")) for c in rows.columns), own.alias("own"), bits.alias("other"))
    key = lambda low, high: (F.col(high) * (F.col(high) + 1) / 2 + F.col(low)).cast("int").alias("key")
    one = named("x", F.explode(F.sequence(own, F.lit(blocks - 1))))
    two = named("y", F.explode(F.sequence(F.lit(0), own)))
    one = one.withColumns({"key": key("own", "other"), "alone": F.col("own") == F.col("other")}).drop("own", "other").repartition(tasks, "key")
    two = two.withColumn("key", key("other", "own")).drop("own", "other").repartition(tasks, "key")
    met = one.hint("merge").join(two, "key").filter(~F.col("alone") | (F.col("id_x") < F.col("id_y")))
    return _likeness(met, num, den, compared).drop("key", "alone")


def bit_pairs(df: DataFrame, num: int, den: int, size: int = 64, compared: Observation | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``set_pairs`` for short dense sets, given as (id, bits): a, b, inter, size_a, size_b and, for each column to ``keep``, <name>_a and <name>_b.

    Where sets meet on chunks, equal sets are compared once and then written out.
    """
    rows = df.select("id", "bits", F.bit_count("bits").alias("n"), *keep)
    classes = rows.select("bits", "n").distinct()
    sizes = {r["n"]: r["k"] for r in classes.filter("bits IS NOT NULL").groupBy("n").agg(F.count("*").alias("k")).collect()}  # at most as many as bits
    m = chunk_plan(size, sizes, num, den)
    swap = F.col("id_x") > F.col("id_y")
    ends = [c for n in ("id", "size", *keep) for c in (F.when(swap, F.col(f"{n}_y")).otherwise(F.col(f"{n}_x")).alias("a" if n == "id" else f"{n}_a"), F.when(swap, F.col(f"{n}_x")).otherwise(F.col(f"{n}_y")).alias("b" if n == "id" else f"{n}_b"))]
    names = ("a", "b", "inter", "size_a", "size_b", *(f"{c}_{k}" for c in keep for k in "ab"))
    if not m:
        return bit_block_pairs(rows, rows.count(), num, den, compared).select("inter", *ends).select(*names)
    one, two = (rows.select(F.col("bits").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("id", *keep))) for k in "xy")
    apart = bit_class_pairs(classes, m, sizes, num, den, size, compared).join(one, "x").join(two, "y").select("inter", *ends).select(*names)
    equal = one.withColumnRenamed("x", "bits").join(two.withColumnRenamed("y", "bits"), "bits").filter("id_x < id_y")
    n = F.bit_count("bits")
    return apart.unionByName(equal.withColumns({"inter": n, "size_x": n, "size_y": n}).select("inter", *ends).select(*names))
