"""MinHash near-duplicate detection (operator 9).

A document's set is its distinct word shingles. Documents with equal sets are one
class. Each class gets many universal hash minima; bands of them put classes that may
be alike into common buckets, and one bit of each is its signature. In each bucket the
lightest member (fewest shingles that no other member of a large bucket has) is the
pivot, and every other one is compared with it: by signature and sizes, then on the full
sets. What these links leave in different components is compared in a second round:
in small buckets each pair, in the same way; in large ones each member outside the
largest component with the others, by their exact differences from the pivot, which say
the same as the full sets without being moved again. So no bucket is capped, and a large
bucket of near copies yields about one pair for each member. Components come by
alternating large-star and small-star.

A pair at the threshold misses all bands with a chance below 1e-6 (0.85) or 1e-4
(0.8), and the signature test with one below SIGNATURE_MISS. Classes are named by 64
bits of a digest of their set; other 64 bits show whether two sets share a name, and
then all are named anew with another salt.

Defined results: keys are of any type with an order; null, empty and blank texts have an
empty set and are linked with nothing; a text of fewer words than a shingle has the whole
sequence as one; repeated rows are copies; the component id is the smallest non-null key
reachable, null where there is none, and a row with a null key is not kept; other columns
are neither read nor, by ``drop_duplicates``, changed, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, counted, durable, free_names, if_small

BANDS, ROWS = 24, 5
#: Chance of a pair at the threshold to fail the signature test.
SIGNATURE_MISS = 1e-6
#: Larger buckets are compared by differences from their pivot.
LARGE = 32
#: Edges that one task contracts or joins.
EDGES_A_TASK = 100_000
#: A worker remembers the hashes of so many words.
CACHE_WORDS = 200_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


WORDS = Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set as sorted 64-bit hashes. Words are divided by white space of ASCII; A-Z are lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([WORDS[w] for w in words], dtype=np.uint64)
    size = min(width, len(h))
    n = len(h) - size + 1
    x = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        x = (x ^ (h[i : i + n] * MIX[i % len(MIX)])) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return np.unique(x)


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the hash family, by a fixed seed."""
    rng = np.random.RandomState(9)
    draw = lambda: rng.randint(0, 1 << 62, BANDS * ROWS).astype(np.uint64)
    return (draw() * np.uint64(2) + np.uint64(1))[:, None], draw()[:, None]


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest of each hash function: multiply-add of the low halves, of which the upper half counts."""
    a, b = _family()
    low = values & np.uint64(0xFFFFFFFF)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, (low[None, at : at + 2048] * a + b).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _names(values: np.ndarray, salt: int) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16, salt=bytes([salt])).digest(), dtype=np.int64).tolist())


def sketches(text: Column, width: int, salt: int) -> Column:
    """Struct: n (set size), node and other (digests of the set; null if empty), bands, and a bit of each minimum in two longs."""

    @F.pandas_udf("n long, node long, other long, bands array<long>, bits_1 long, bits_2 long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        half = BANDS * ROWS // 2
        place = np.left_shift(np.uint64(1), np.arange(half, dtype=np.uint64))
        for texts in batches:
            made = []
            for t in texts:
                values = shingles(t, width)
                if not len(values):
                    made.append((0, None, None, None, None, None))
                    continue
                signature = minima(values)
                bits = (signature & np.uint32(1)).astype(np.uint64)
                made.append((len(values), *_names(values, salt), band_keys(signature), int(bits[:half] @ place), int(bits[half:] @ place)))
            made = pd.DataFrame(made, columns=["n", "node", "other", "bands", "bits_1", "bits_2"], dtype=object)
            yield made.astype({"n": "int64", "node": "Int64", "other": "Int64", "bits_1": "Int64", "bits_2": "Int64"})

    return run(text)


def least_agreement(share: float) -> int:
    """Bits of the signature that two sets of similarity ``share`` agree in, but for a chance of SIGNATURE_MISS.

    A bit agrees if the minima are equal, and else by half of all chances.
    """
    k, p = BANDS * ROWS, (1 + share) / 2
    below, at = 0.0, 0
    while at < k and below + math.comb(k, at) * p**at * (1 - p) ** (k - at) < SIGNATURE_MISS:
        below += math.comb(k, at) * p**at * (1 - p) ** (k - at)
        at += 1
    return at


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with each partition's replaced by edges from its nodes to the smallest of their local component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        made = [(x, find(x)) for x in list(parent)]
        yield pd.DataFrame([m for m in made if m[0] != m[1]], columns=["a", "b"], dtype="int64")

    return edges.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of ``edges`` (a, b): label is its component's smallest node.

    Each partition's edges are contracted first; then large-star and small-star alternate
    until a turn changes no edge. Each turn is written to the shared checkpoint folder.
    """
    edges, n = counted(edges.select("a", "b").filter("a <> b"), EDGES_A_TASK)
    edges, n = counted(_contracted(edges), EDGES_A_TASK)
    while n:
        both = _both(edges, ("a", "b"), ("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("m", "u").alias("b"), (F.col("m") < F.col("u")).alias("moved"))
        large = large.groupBy("a", "b").agg(F.max("moved").alias("moved"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").withColumn("moved", F.col("moved") | (F.col("m") < F.col("b")))
        made = small.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y"), "moved"), F.struct(F.col("a").alias("x"), F.col("m").alias("y"), "moved"))).alias("p"))
        made = made.select(F.col("p.x").alias("a"), F.col("p.y").alias("b"), "p.moved").filter("a <> b").groupBy("a", "b").agg(F.max("moved").alias("moved"))
        made, n, moved = counted(made, EDGES_A_TASK, F.max("moved"))
        edges = made.select("a", "b")
        if not moved:
            break
    return _both(edges, ("a", "b"), ("b", "b")).toDF("node", "label").distinct()


def _both(df: DataFrame, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    """Two pairs of columns as rows; unlike a union it keeps a small table in its one partition, without shuffles."""
    return df.select(F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (one, two)))).alias("p")).select("p.x", "p.y")


def _compared(a: Column, b: Column, differences: Column) -> Column:
    """Struct: size of the intersection of two sets (bytes of sorted 64-bit values); if asked for, what b lacks of a and adds to it."""

    @F.pandas_udf("both long, lacks array<long>, adds array<long>")
    def run(x: pd.Series, y: pd.Series, asked: pd.Series) -> pd.DataFrame:
        made = []
        for p, q, wanted in zip(x, y, asked):
            p, q = np.frombuffer(p, dtype=np.int64), np.frombuffer(q, dtype=np.int64)
            if wanted:
                lacks = np.setdiff1d(p, q, True)
                made.append((len(p) - len(lacks), lacks, np.setdiff1d(q, p, True)))
            else:
                made.append((len(np.intersect1d(p, q, True)), None, None))
        return pd.DataFrame(made, columns=["both", "lacks", "adds"])

    return run(a, b, differences)


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, large, ...) with n_a, n_b, both, lacks and adds from the full sets."""
    pairs, n = counted(pairs)
    one = sets.select(F.col("node").alias("b"), F.col("values").alias("y")).join(if_small(pairs, n), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("values").alias("x")), "a")
    made = two.select(*pairs.columns, (F.length("x") / 8).cast("long").alias("n_a"), (F.length("y") / 8).cast("long").alias("n_b"), _compared(F.col("x"), F.col("y"), F.col("large")).alias("_m"))
    return made.select(*pairs.columns, "n_a", "n_b", "_m.both", "_m.lacks", "_m.adds")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many shingles of a node no other node of ``sets`` has; nodes without are left out."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, values in zip(batch["node"], batch["values"]):
                yield pd.DataFrame({"node": node, "s": np.frombuffer(values, dtype=np.int64)})

    each = sets.select("node", "values").mapInPandas(explode, "node long, s long")
    alone = each.groupBy("s").agg(F.count("*").alias("k"), F.min("node").alias("node")).filter("k = 1")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def _reaches(both: Column, n: Column, m: Column, percent: int) -> Column:
    return both * 100 >= (n + m - both) * percent


def _near(n: Column, m: Column, bits: list[tuple[Column, Column]], percent: int) -> Column:
    """Whether sizes and signatures allow a link."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in bits), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ <= BANDS * ROWS - least_agreement(percent / 100))


def _first_round(members: DataFrame, own: DataFrame, n_own: int, percent: int) -> DataFrame:
    """Members of buckets with their bucket's pivot, and whether the two may be linked; members without room for any link are left out."""
    facts = members.join(if_small(own, n_own), "node", "left").withColumn("own", F.when(F.col("members") > LARGE, F.coalesce("own", F.lit(0))).otherwise(F.lit(0)))
    pivots = facts.groupBy("bucket").agg(F.min(F.struct("own", "node", "n", "bits_1", "bits_2")).alias("p"))
    both = facts.join(if_small(*counted(pivots)), "bucket")  # a table of its own, so that a large bucket can be split
    room = (F.col("n") - F.col("own")) * 100 >= (F.col("n") + F.col("p.own")) * percent
    near = _near(F.col("n"), F.col("p.n"), [(F.col("bits_1"), F.col("p.bits_1")), (F.col("bits_2"), F.col("p.bits_2"))], percent)
    both = both.filter(room & (F.col("node") != F.col("p.node")))
    return both.select("bucket", (F.col("members") > LARGE).alias("large"), "node", "n", "bits_1", "bits_2", F.col("p.node").alias("pivot"), near.alias("near"))


def _small_pairs(side: DataFrame, percent: int) -> DataFrame:
    """Pairs of a small bucket in two components that sizes and signatures allow."""
    side = side.select("bucket", "node", "n", "bits_1", "bits_2", "label")
    other = side.select("bucket", *(F.col(c).alias(f"{c}_a") for c in side.columns if c != "bucket"))
    near = _near(F.col("n"), F.col("n_a"), [(F.col("bits_1"), F.col("bits_1_a")), (F.col("bits_2"), F.col("bits_2_a"))], percent)
    met = other.join(side, "bucket").filter((F.col("node_a") < F.col("node")) & (F.col("label_a") != F.col("label")) & near)
    return met.select(F.col("node_a").alias("a"), F.col("node").alias("b"), F.lit(False).alias("large"), "label_a", "label").distinct()


def _large_links(side: DataFrame, differences: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (label_a, label) between members of large buckets in two components, by their differences from the pivot they share.

    x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles, D being a set's difference from the
    pivot, and are linked if that is at most c (n + m), c = (100 - percent) / (100 + percent).
    Pairs that need no common difference all meet in one member, the one of least |D| - c n.
    The others share one of their rarest differences (prefix filter): a member that is not
    in the pivot's component has |D| > c (n + base), which bounds from below what is shared,
    so that members meet on few and rare ones only; they are then verified on all of D.
    """
    r, q = 100 - percent, 100 + percent
    main = labels.select(F.col("node").alias("pivot"), F.col("label").alias("main"))
    rows = side.select("pivot", "node", "n", "label").distinct().join(differences, ["pivot", "node"]).join(main, "pivot", "left")
    rows = rows.select("pivot", "node", "n", "label", F.coalesce("main", "pivot").alias("main"), "base", F.concat("lacks", "adds").alias("diff")).withColumn("d", F.size("diff").cast("long"))
    rows = durable(rows)
    d, n = F.col("d"), F.col("n")

    spare = q * d - r * n
    stars = rows.groupBy("pivot").agg(F.min(F.struct(spare.alias("spare"), "label")).alias("own"), F.min(F.struct((-r * F.col("base")).alias("spare"), F.col("main").alias("label"))).alias("at"))
    stars = stars.select("pivot", F.least("own", "at").alias("star"))
    near = rows.join(if_small(*counted(stars)), "pivot").filter((F.col("star.spare") + spare <= 0) & (F.col("star.label") != F.col("label"))).select(F.col("star.label").alias("label_a"), "label")

    each = rows.select("pivot", "node", "n", "label", "main", "base", "d", F.explode("diff").alias("e"))
    shared = each.groupBy("pivot", "e").agg(F.count("*").alias("k")).filter("k > 1")
    alone = F.ceil(d - r * n / percent)  # what is shared at least, whatever the other one
    with_other = F.ceil((q * d + r * (F.col("base") - n)) / (2 * q))  # ... if the other one is not in the pivot's component
    own = Window.partitionBy("pivot", "node")
    ranked = each.join(shared, ["pivot", "e"])
    ranked = ranked.withColumn("place", F.row_number().over(own.orderBy("k", "e")) + d - F.count("*").over(own))  # after those that none shares
    ranked = durable(ranked.filter(F.col("place") <= d - F.greatest(F.lit(1), alone) + 1))
    probes = ranked.filter("label <> main").select("pivot", "e", F.col("node").alias("node_a"), *(F.col(c).alias(f"{c}_a") for c in ("label", "n", "d", "place")))
    held = ranked.filter(F.col("place") <= d - F.greatest(F.lit(1), alone, with_other) + 1).select("pivot", "e", "node", "label", "n", "d", "place")
    # at the first difference that two share, no more can follow than either has left; later ones may fall to this, the first does not
    most = 1 + F.least(d - F.col("place"), F.col("d_a") - F.col("place_a"))
    room = (F.least(n, F.col("n_a")) * 100 >= F.greatest(n, F.col("n_a")) * percent) & (2 * q * most >= q * (d + F.col("d_a")) - r * (n + F.col("n_a")))
    met = probes.join(held, ["pivot", "e"]).filter((F.col("label_a") != F.col("label")) & room).select("pivot", "node_a", "node").distinct()
    other = rows.select("pivot", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "label", "d", "diff")))
    both = met.join(other, ["pivot", "node_a"]).join(rows.select("pivot", "node", "n", "label", "d", "diff"), ["pivot", "node"])
    linked = both.filter(2 * q * F.size(F.array_intersect("diff", "diff_a")) >= q * (d + F.col("d_a")) - r * (n + F.col("n_a"))).select("label_a", "label")
    return near.union(linked).distinct()


def _identity(key: Column, text: Column) -> list[Column]:
    """128 bits of a row's key and text."""
    return [F.xxhash64(F.lit(i), key.isNull(), key, text.isNull(), text).alias(f"t{i}") for i in (1, 2)]


def _classes(df: DataFrame, key: Column, text: Column, width: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (key, t1, t2, n, node) and classes (node, least key, identity of one row, n, bands, bits) with their number."""
    for salt in range(8):
        rows = df.select(key.alias("key"), *_identity(key, text), sketches(text, width, salt).alias("s")).select("key", "t1", "t2", "s.*")
        rows = durable(rows)
        same = {c: F.first(c).alias(c) for c in ("n", "bands", "bits_1", "bits_2")}
        made = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
            F.min("key").alias("least"), F.min(F.struct("t1", "t2")).alias("at"), *same.values(), (F.min("other") != F.max("other")).alias("clash"))
        classes, n, clash = counted(made, 50_000, F.max("clash"))
        if not clash:
            return rows, classes, n
    raise RuntimeError("classes could not be named")


def _labels(df: DataFrame, text: Column, key: Column, classes: DataFrame, width: int, percent: int) -> tuple[DataFrame, int]:
    """(node, label) of the classes that are linked, and their number."""
    # buckets of two classes or more
    banded = classes.select("node", "n", "bits_1", "bits_2", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members, left = counted(banded.join(if_small(*counted(shared)), "bucket"))
    if not left:
        return members.select("node", F.col("node").alias("label")), 0
    nodes, n = counted(classes.select("node", "at").join(members.groupBy("node").agg(F.max("members").alias("most")), "node").select("node", "most", "at.t1", "at.t2"))

    # full sets of the classes in buckets, from their texts
    @F.pandas_udf("binary")
    def set_bytes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, width).tobytes())

    texts = df.select(*_identity(key, text), text.alias("text")).join(if_small(nodes, n), ["t1", "t2"]).dropDuplicates(["node"])
    sets = counted(texts.select("node", "most", set_bytes("text").alias("values")), 2000)[0]
    own, n = counted(_own_shingles(sets.filter(F.col("most") > LARGE)))

    side = durable(_first_round(members, own, n, percent))
    pairs = side.filter("large OR near").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max("large").alias("large"))
    met = durable(_met(pairs, sets))
    linked = components(met.filter(_reaches(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))
    labels, n = counted(linked)

    # a second round for buckets whose members are not in one component
    side = side.join(if_small(labels, n), "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = side.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("bucket")
    side, left = counted(side.join(if_small(*counted(apart)), "bucket", "left_semi"))
    if left:
        found = _met(_small_pairs(side.filter(~F.col("large")), percent), sets)
        found = found.filter(_reaches(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("label_a", "label")
        differences = met.filter("large").select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("n_a").alias("base"), "lacks", "adds")
        found = found.union(_large_links(side.filter("large"), differences, labels, percent))
        merged, k = counted(components(found.toDF("a", "b")).toDF("label", "new"))
        if k:  # classes that only the second round linked are labels of their own
            old = labels.join(if_small(merged, k), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
            alone = merged.select(F.col("label").alias("node"), F.col("new").alias("label"))
            labels, n = counted(old.union(alone).distinct())
    return labels, n


def _components_of_rows(df: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(key, t1, t2, node, n_shingles, component_id, kept) of each row."""
    bounded_batches(df.sparkSession)
    id_, content = F.col(key), F.col(text).cast("string")
    rows, classes, n_classes = _classes(df, id_, content, width)
    labels, n = _labels(df, content, id_, classes, width, percent)
    # the smallest key of each component, and each row's
    known = classes.select("node", "least")
    linked = known.join(if_small(labels, n), "node")
    least = linked.groupBy("label").agg(F.min("least").alias("lowest"))
    linked = linked.join(if_small(least, n), "label").select("node", "lowest")
    named = known.join(if_small(linked, n), "node", "left").select("node", F.when(F.col("lowest").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("lowest"))
    named = durable(named)  # a table of its own, so that the rows of a large class can be split
    made = rows.select("key", "t1", "t2", "n", "node").join(if_small(named, n_classes), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("lowest"))
    return made.select("key", "t1", "t2", "node", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """A row for each row of ``df``: key, n_shingles, component_id, kept; linked: 100 * intersection >= percent * union."""
    made = _components_of_rows(df, key, text, width, percent)
    return made.select(F.col("key").alias(key), "n_shingles", "component_id", "kept")


def drop_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each component; a row with an empty set or the only one of its component stays.

    Rows with a null key stay if no row with a key is in their component, as far as
    their texts differ. What goes is anti-joined by its identity, so that the texts
    move at most once.
    """
    made = _components_of_rows(df, key, text, width, percent)
    stays = F.col("kept") | F.col("component_id").isNull() | F.col("node").isNull()
    each = made.withColumn("stays", stays).groupBy("t1", "t2").agg(F.max("stays").alias("stays"), F.count("node").alias("copies"))
    gone, n, repeated = counted(each.filter(~F.col("stays") | (F.col("copies") > 1)), 50_000, F.count(F.when(F.col("stays"), 1)))
    t1, t2 = free_names(df, 2)
    rows = df.withColumns(dict(zip((t1, t2), _identity(F.col(key), F.col(text).cast("string")))))
    gone = gone.select(F.col("t1").alias(t1), F.col("t2").alias(t2), "stays")
    kept = rows.join(if_small(gone.drop("stays"), n), [t1, t2], "left_anti")
    if repeated:  # of rows that are repeated whole, one
        again = rows.join(if_small(gone.filter("stays").drop("stays"), repeated), [t1, t2], "left_semi")
        kept = kept.unionByName(again.dropDuplicates([t1, t2]))
    return kept.select(*df.columns)


#: DuckDB SQL of ``duplicate_classes`` with its defaults: all pairs of distinct texts that share a shingle, and all that links reach.
CLASSES_SQL = r"""
WITH RECURSIVE t AS (
  SELECT text, row_number() OVER () AS t, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
), s AS (
  SELECT text, t, list_distinct(CASE WHEN len(w) < 3 THEN list_filter([array_to_string(w, ' ')], lambda x: len(w) > 0)
                                     ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS set FROM t
), e AS (SELECT t, len(set) AS n, unnest(set) AS x FROM s),
p AS (SELECT a.t AS a, b.t AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.t < b.t GROUP BY a.t, b.t),
l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (n + m - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT t, t FROM s UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
d AS (SELECT doc_id, t, coalesce(len(set), 0) AS n FROM documents LEFT JOIN s USING (text)),
c AS (SELECT r.a AS t, min(d.doc_id) AS component_id FROM r JOIN d ON d.t = r.b GROUP BY r.a)
SELECT doc_id, n::bigint AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE c.component_id END AS component_id, coalesce(doc_id = CASE WHEN n = 0 THEN doc_id ELSE c.component_id END, false) AS kept
FROM d LEFT JOIN c USING (t)
"""
