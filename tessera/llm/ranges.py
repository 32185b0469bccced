"""Sampled splitters: an even division of rows into ranges of a key, with DataFrame functions only."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys for each range asked for.
SAMPLES_A_RANGE = 24
#: Ranges at most, so that the boundaries stay a few MB; beyond, ranges grow with the data.
MOST_RANGES = 1 << 15
#: A range is overfull above so many times the even share.
OVERFULL = 2.0
#: Rounds of subdivision of overfull ranges.
ROUNDS = 5


@dataclass(frozen=True)
class Splitters:
    """Ascending boundaries; range i holds the keys from boundary i-1 (included) up to boundary i."""

    bounds: list[tuple]
    types: list[str]

    def index(self, key: list[Column]) -> Column:
        """The range of a key: binary search over the boundaries."""
        n = len(self.bounds)
        if not n:
            return F.lit(0)
        own = F.struct(*(k.cast(t).alias(f"k{i}") for i, (k, t) in enumerate(zip(key, self.types))))
        fields = ",".join(f"k{i}:{t}" for i, t in enumerate(self.types))
        rows = [{f"k{i}": v for i, v in enumerate(b)} for b in self.bounds]
        all_bounds = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")  # folded to one literal
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))

        def step(at: Column, by: Column) -> Column:
            to = at + by
            return F.when((to <= n) & (F.element_at(all_bounds, F.least(to, F.lit(n))) <= own), to).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)


def longs(values: list[int]) -> Column:
    """An array literal of any length."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _chance(key: list[Column], seed: int) -> Column:
    """A value in (0, 1) that the key decides."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 1).cast("double") / float((1 << 52) + 2)


def _drawn(rows: DataFrame, key: list[str], most: Column, seed: int) -> DataFrame:
    """Distinct keys drawn with a chance that grows with the weight: those whose exponential draw is at most ``most``."""
    draw = -F.log(_chance([F.col(c) for c in key], seed)) / F.greatest(F.col("w"), F.lit(1e-9))
    return rows.filter(draw <= most)


def splitters(df: DataFrame, key: list[str], weight: Column, n_ranges: int, seed: int = 7) -> Splitters:
    """Boundaries that divide the total ``weight`` of ``df`` into about ``n_ranges`` even ranges of ``key``.

    Keys are sampled with a chance that grows with their weight (exponential draws by
    weight below a threshold that the total sets), and every SAMPLES_A_RANGE-th of the
    ordered sample is a boundary. The exact weight of each range is then counted; ranges
    above OVERFULL times the even share are sampled again and subdivided, until none is
    overfull but for a single key. The driver gets about n_ranges * SAMPLES_A_RANGE keys a
    round, however many rows and partitions there are. ``df`` is read several times and
    should be a written table of the key alone. Nulls come first in a key part.
    """
    n_ranges = max(1, min(n_ranges, MOST_RANGES))
    rows = df.select(*key, weight.cast("double").alias("w"))
    types = [t for c in key for n, t in rows.dtypes if n == c]
    total = rows.agg(F.sum("w")).first()[0] if n_ranges > 1 else 0
    if not total:
        return Splitters([], types)
    even = total / n_ranges
    order = lambda k: tuple((x is not None, x) for x in k)
    sample = sorted((tuple(r) for r in _drawn(rows, key, F.lit(SAMPLES_A_RANGE / even), seed).select(*key).distinct().collect()), key=order)
    made = Splitters(sample[SAMPLES_A_RANGE::SAMPLES_A_RANGE], types)
    for turn in range(ROUNDS):
        own = F.struct(*key)
        ranged = rows.withColumn("r", made.index([F.col(c) for c in key]))
        over = ranged.groupBy("r").agg(F.sum("w").alias("w"), (F.min(own) == F.max(own)).alias("one")).filter(~F.col("one") & (F.col("w") > OVERFULL * even))
        over = {r["r"]: r["w"] for r in over.collect()}  # at most n_ranges / OVERFULL
        if not over:
            break
        again = ranged.filter(F.col("r").isin(list(over)))
        by_range: dict[int, list[tuple]] = {}
        for r in _drawn(again, key, F.lit(SAMPLES_A_RANGE / even), seed + 1 + turn).select("r", *key).distinct().collect():
            by_range.setdefault(r["r"], []).append(tuple(r)[1:])
        new = set()
        for r, keys in by_range.items():
            keys.sort(key=order)
            new |= set(keys[:: max(1, int(len(keys) * even / over[r]))])
        # keys that alone outweigh an even share get a range of their own: a boundary at them
        # and one at the next; there are fewer than n_ranges of them
        heavy = again.groupBy("r", *key).agg(F.sum("w").alias("w")).filter(F.col("w") > even).select("r", own.alias("heavy"))
        after = again.select("r", own.alias("k")).join(F.broadcast(heavy), "r").filter(F.col("k") > F.col("heavy"))
        for r in heavy.select("heavy").union(after.groupBy("r", "heavy").agg(F.min("k").alias("k")).select("k")).collect():
            new.add(tuple(r[0]))
        if new <= set(made.bounds):
            break
        made = Splitters(sorted({*made.bounds, *new}, key=order), types)
    return made
