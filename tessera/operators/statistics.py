"""Rank statistics, tests and densities as plans over counts.

Ranks are taken over distinct values with their counts, by a scan over ranges of values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import free_names, on_keys, settled
from tessera.operators.scan import numbered, scan


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, ties, rank): the mean rank of each distinct value, by a scan over the distinct values."""
    by = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    (before,) = free_names(by, 1, "rank")
    return scan(by, [F.col(value)], before={before: F.col("ties")}).select(value, "ties", (F.col(before) + (F.col("ties") + 1) / 2).alias("rank"))


def percentiles(df: DataFrame, value: str, points: list[float], group: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated percentiles q0, q1, ... of each group (or of all rows); nulls are left out.

    A mergeable sketch (one partial aggregation) brackets each wanted rank to within its error;
    one more pass counts what lies below a bracket and orders the distinct values inside it,
    which are some 4 / ``accuracy`` of the group, or all of a group of under 2 * ``accuracy`` rows.
    """
    keys = group or []
    names = [f"g{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    near, m = 2.0 / accuracy, len(points)
    sides = [max(q - near, 0.0) for q in points] + [min(q + near, 1.0) for q in points]
    sketch = rows.groupBy(*names).agg(F.count("*").alias("n"), F.percentile_approx("v", sides, accuracy).alias("s")).filter("n > 0")
    wanted = settled(sketch)
    met, few = on_keys(rows, wanted, names), F.col("n") <= 2 * accuracy
    inside = lambda i: (F.col("v") >= F.col("s")[i]) & (F.col("v") <= F.col("s")[m + i])
    below = met.filter(~few).groupBy(*names).agg(*(F.count_if(F.col("v") < F.col("s")[i]).alias(f"b{i}") for i in range(m)))
    some = few
    for i in range(m):
        some = some | inside(i)
    brackets = F.when(few, F.array(F.lit(-1))).otherwise(F.array_compact(F.array(*(F.when(inside(i), F.lit(i)) for i in range(m)))))  # -1: the whole group
    held = met.filter(some).select(*names, "n", "v", F.explode(brackets).alias("i")).groupBy(*names, "n", "i", "v").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*names, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = on_keys(held.withColumn("before", before), below, names, "left") if names else held.withColumn("before", before).crossJoin(F.broadcast(below))  # without groups: one row

    def value(i: int, q: float, up: Callable) -> Column:
        first = F.col("before") + F.when(F.col("i") < 0, F.lit(0)).otherwise(F.col(f"b{i}"))
        rank = up(F.lit(q) * (F.col("n") - 1))
        return F.max(F.when(F.col("i").isin(i, -1) & (rank >= first) & (rank < first + F.col("k")), F.col("v")))

    made = at.groupBy(*names, "n").agg(*(f.alias(f"{k}{i}") for i, q in enumerate(points) for k, f in (("d", value(i, q, F.floor)), ("u", value(i, q, F.ceil)))))
    rest = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    made = made.select(*names, *((F.col(f"d{i}") + (F.col(f"u{i}") - F.col(f"d{i}")) * rest(q)).alias(f"q{i}") for i, q in enumerate(points)))
    return made.withColumnsRenamed(dict(zip(names, keys)))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a normal deviate: complementary error function by its Chebyshev fit (error below 1.2e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the fit, from the constant term up.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    total = F.lit(0.0)
    for c in reversed(fit):
        total = total * t + c
    return t * F.exp(-x * x + total)


def chi_square_tail(x: Column, df: Column) -> Column:
    """Upper tail of a chi-square value, by the finite sums for even and odd degrees of freedom."""
    half, odd = x / 2, df % 2 == 1
    terms = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(df / 2).cast("int")))
    # term i over term i - 1 is half / (i - 1) if even, half / (i - 1/2) if odd
    first = F.when(odd, F.sqrt(half) / (3.141592653589793**0.5 / 2)).otherwise(F.lit(1.0))
    step = lambda acc, i: F.struct((acc["t"] * F.when(i == 1, 1.0).otherwise(half / F.when(odd, i - 0.5).otherwise(i - 1))).alias("t"), (acc["s"] + acc["t"] * F.when(i == 1, 1.0).otherwise(half / F.when(odd, i - 0.5).otherwise(i - 1))).alias("s"))
    total = F.aggregate(terms, F.struct(first.cast("double").alias("t"), F.lit(0.0).alias("s")), step, lambda acc: acc["s"])
    head = F.when(odd, normal_tail(F.sqrt(x))).otherwise(0.0)
    return head + F.when(df == 1, 0.0).otherwise(F.exp(-half) * total)


def mann_whitney(df: DataFrame, value: str, group: str, one: object) -> DataFrame:
    """One row: sizes, U of group ``one``, rank-biserial r, z with tie correction, two-sided normal p."""
    ranks = average_ranks(df, value)
    rows = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == one).alias("k1"), F.count_if(F.col(group) != one).alias("k2"))
    made = rows.join(ranks, value).agg(
        F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.sum(F.col("rank") * F.col("k1")).alias("r1"),
        F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    made = made.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("t") / (n * (n - 1))))
    made = made.withColumn("z", (F.col("u") - n1 * n2 / 2.0) / sd).withColumn("effect", 2 * F.col("u") / (n1 * n2) - 1)
    return made.select("n1", "n2", "u", "effect", "z", normal_tail(F.col("z")).alias("p"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, H with tie correction and its chi-square p. A row may be in several groups (given as several rows)."""
    ranks = average_ranks(df, value)
    cells = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k")).join(ranks, value)
    sums = cells.groupBy(group).agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("k")).alias("r"))
    h = sums.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    ties = ranks.agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    made = h.crossJoin(ties).select("groups", "n", (raw / (1 - F.col("t") / (n * n * n - n))).alias("h"))  # one row each
    return made.withColumn("p", chi_square_tail(F.col("h"), F.col("groups") - 1))


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t: the regularised incomplete beta function by its continued fraction (200 terms)."""
    a, x = df / 2.0, df / (df + t * t)
    b, tiny = F.lit(0.5), 1e-300
    flip = x >= (a + 1) / (a + b + 2)  # beyond it the fraction of the complement converges faster
    p, q, z = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1 - x).otherwise(x)
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def turn(s: Column, m: Column) -> Column:
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1 / safe(1 + even * s["d"])
        c = safe(1 + even / s["c"])
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d2 = 1 / safe(1 + odd * d)
        c2 = safe(1 + odd / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d * c * d2 * c2).alias("h"))

    d0 = 1 / safe(1 - (p + q) * z / (p + 1))
    h = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda m: m.cast("double")), F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h")), turn)["h"]
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(z) + q * F.log(1 - z)) / p
    part = front * h
    return F.when(x >= 1, 1.0).when(x <= 0, 0.0).otherwise(F.when(flip, 1 - part).otherwise(part))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1/2: Stirling's series, moved up by eight."""
    up = x
    product = F.lit(1.0)
    for _ in range(8):
        product, up = product * up, up + 1
    series = (up - 0.5) * F.log(up) - up + 0.9189385332046727 + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up)
    return series - F.log(product)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, the correlation of average ranks, and its two-sided p by Student's t with n - 2 degrees of freedom."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.join(average_ranks(rows, x).select(x, F.col("rank").alias("rx")), x).join(average_ranks(rows, y).select(y, F.col("rank").alias("ry")), y)
    made = rows.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))
    free = (F.col("n") - 2).cast("double")
    t = F.col("rho") * F.sqrt(free / (1 - F.col("rho") * F.col("rho")))
    return made.withColumn("p", F.when(F.abs("rho") >= 1, 0.0).when(free > 0, student_tail(t, free)))


def fisher_tail(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Two-sided exact p of a 2 x 2 table and its logarithm to base 10: the sum over all tables that are no more likely.

    On each side of the mode the nearest such table is found by bisection, and terms follow
    from one another outward until they no longer count, so that nothing is held.
    """
    ab, ac, da, n = a + b, a + c, d - a, a + b + c + d
    low, high = max(0, -da), min(ab, ac)
    head = sum(math.lgamma(k + 1) for k in (ab, ac, n - ab, n - ac)) - math.lgamma(n + 1)
    log_p = lambda x: head - sum(math.lgamma(k + 1) for k in (x, ab - x, ac - x, da + x))
    limit = log_p(a) + 1e-7
    mode = min(high, max(low, (ab + 1) * (ac + 1) // (n + 2)))

    def side(begin: int, end: int, step: int) -> tuple[float, float]:
        """Logarithm of the first term at or beyond ``begin`` within the limit, and the sum in its units."""
        if (end - begin) * step < 0 or log_p(end) > limit:
            return -math.inf, 0.0
        near, far = begin, end  # log_p falls from begin to end
        while (far - near) * step > 0:
            half = (near + far) // 2 if step > 0 else -((-near - far) // 2)
            near, far = (near, half) if log_p(half) <= limit else (half + step, far)
        x, term, total = near, 1.0, 0.0
        while term > total * 1e-17:
            total += term
            if x == end:
                break
            up, down = ((ab - x) * (ac - x), (x + 1) * (da + x + 1)) if step > 0 else (x * (da + x), (ab - x + 1) * (ac - x + 1))
            term, x = term * (up / down), x + step
        return log_p(near), total

    parts = [s for s in (side(mode, low, -1), side(mode + 1, high, 1)) if s[1]]
    top = max(s[0] for s in parts)
    log = top + math.log(sum(math.exp(first - top) * total for first, total in parts))
    return min(1.0, math.exp(log)), min(0.0, log / math.log(10))


def fisher(df: DataFrame) -> DataFrame:
    """Rows with counts a, b, c, d (2 x 2): odds ratio, phi, the two-sided exact p and log10_p."""
    a, b, c, d = (F.col(k).cast("long") for k in "abcd")

    @F.pandas_udf("p double, log10_p double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        found = [fisher_tail(*map(int, t)) if not any(map(pd.isna, t)) else (None, None) for t in zip(a, b, c, d)]
        return pd.DataFrame(found, columns=["p", "log10_p"], dtype="float64")

    (name,) = free_names(df, 1, "odds", "phi", "p", "log10_p")
    x = {k: F.col(k).cast("double") for k in "abcd"}
    den = F.sqrt((x["a"] + x["b"]) * (x["c"] + x["d"]) * (x["a"] + x["c"]) * (x["b"] + x["d"]))
    made = {"odds": F.when((b > 0) & (c > 0), x["a"] * x["d"] / (x["b"] * x["c"])), "phi": F.when(den > 0, (x["a"] * x["d"] - x["b"] * x["c"]) / den)}
    return df.withColumn(name, tail(a, b, c, d)).withColumns(made | {"p": F.col(f"{name}.p"), "log10_p": F.col(f"{name}.log10_p")}).drop(name)


def bh_adjust(df: DataFrame, p: str, key: str) -> DataFrame:
    """``df`` with q: Benjamini-Hochberg, ties by key; a scan upward for the ranks and one downward for the running minimum."""
    rank, every, low = free_names(df, 3, "q")
    own = numbered(df, [F.col(p), F.col(key)], rank)
    own = on_keys(own, df.agg(F.count("*").alias(every)), [])
    own = scan(own, [-F.col(rank)], least={low: F.col(p) * F.col(every) / (F.col(rank) + 1)})
    return own.withColumn("q", F.least(F.lit(1.0), F.col(low))).drop(rank, every, low)


def kde(df: DataFrame, value: str, low: float, high: float, steps: int, width: float) -> DataFrame:
    """Gaussian density of the values on a grid; values are first counted, the grid is a literal."""
    by = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    rows = by.select("v", "k", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn("x", low + F.col("i") * ((high - low) / steps))
    kernel = F.exp(-F.pow((F.col("x") - F.col("v")) / width, F.lit(2)) / 2) / (width * (2 * 3.141592653589793) ** 0.5)
    return rows.groupBy("i", "x").agg((F.sum(kernel * F.col("k")) / F.sum("k")).alias("density"))


def scott_width(df: DataFrame, value: str) -> float | None:
    """Scott's width: the sample deviation times n to the power of -1/5; None where there is no spread."""
    n, sd = df.agg(F.count(value), F.stddev_samp(F.col(value).cast("double"))).first()
    return sd * n**-0.2 if n > 1 and sd else None


def binned_density(df: DataFrame, value: str, low: float, high: float, steps: int, width: float | None = None, fine: int = 64, reach: float = 8.0) -> DataFrame:
    """(i, x, density) on a grid: Gaussian kernels by linear binning and a truncated convolution; width by Scott's rule if None.

    Each value is shared between the two nearest of bins a ``fine``-th of the width apart, so
    the kernels are of bins, however many values there are; a kernel ends ``reach`` widths out.
    Only bins that reach the grid count, but the density is one of all values.
    """
    width = width or scott_width(df, value)
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"), (low + F.col("id") * ((high - low) / steps)).alias("x"))
    if width is None:
        return grid.withColumn("density", F.lit(None).cast("double"))
    bin_width, step = width / fine, (high - low) / steps
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    place = (F.col("v") - low) / bin_width
    near = rows.filter(F.col("v").between(low - (reach + 1) * width, high + (reach + 1) * width)).select(F.floor(place).alias("b"), (place - F.floor(place)).alias("w"))
    shares = near.select(F.explode(F.array(F.struct(F.col("b"), (1 - F.col("w")).alias("w")), F.struct((F.col("b") + 1).alias("b"), "w"))).alias("s"))
    bins = shares.groupBy("s.b").agg(F.sum("s.w").alias("w"))
    at = F.col("b") * bin_width  # from low
    first, last = F.greatest(F.lit(0), F.ceil((at - reach * width) / step)), F.least(F.lit(steps), F.floor((at + reach * width) / step))
    spread = bins.filter(first <= last).select("b", "w", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("i"))
    kernel = F.exp(-F.pow((F.col("i") * step - at) / width, F.lit(2)) / 2) / (width * (2 * math.pi) ** 0.5)
    sums = spread.groupBy("i").agg(F.sum(kernel * F.col("w")).alias("s"))
    made = on_keys(grid, rows.agg(F.count("*").alias("n")), []).join(sums, "i", "left")
    return made.select("i", "x", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("density"))


def weight_robustness(kinds: DataFrame, weight: Column, moves: Column, least: float, times: int, reach: float = 0.2, seed: int = 42) -> DataFrame:
    """One row: rank correlation (mean, smallest) with the unmoved scores, and counts at ``least`` or more (mean, smallest, largest, unmoved).

    kinds: kind and k, its number of members, all of one score ``weight``; in each of
    ``times`` draws the weights of kinds that ``moves`` move by up to ``reach``, evenly,
    by a digest. Kinds are few, whatever the members.
    """
    rows = kinds.select("kind", "k", weight.alias("own"), moves.alias("moves"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("draw"))
    digest = F.md5(F.concat_ws(":", "kind", F.col("draw").cast("string"), F.lit(str(seed))))
    even = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("score", F.when(F.col("moves"), F.col("own") * (1 - reach + 2 * reach * even)).otherwise(F.col("own")))

    def rank(c: str) -> Column:
        upto = Window.partitionBy("draw").orderBy(c).rangeBetween(Window.unboundedPreceding, 0)
        ties = F.sum("k").over(Window.partitionBy("draw", c))
        return F.sum("k").over(upto) - ties + (ties + 1) / 2

    rows = rows.withColumns({"x": rank("own"), "y": rank("score")})
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    by = rows.groupBy("draw").agg(
        F.sum(k).alias("n"), F.sum(k * x).alias("sx"), F.sum(k * y).alias("sy"), F.sum(k * x * y).alias("sxy"), F.sum(k * x * x).alias("sxx"), F.sum(k * y * y).alias("syy"),
        F.sum(F.when(F.col("score") >= least, k).otherwise(0)).alias("count"), F.sum(F.when(F.col("own") >= least, k).otherwise(0)).alias("unmoved"),
    )
    c = lambda a, b, s: F.col("n") * F.col(s) - F.col(a) * F.col(b)
    rho = c("sx", "sy", "sxy") / F.sqrt(c("sx", "sx", "sxx") * c("sy", "sy", "syy"))
    by = by.withColumn("rho", F.when((c("sx", "sx", "sxx") > 0) & (c("sy", "sy", "syy") > 0), rho))
    return by.agg(F.avg("rho").alias("rho_mean"), F.min("rho").alias("rho_least"), F.avg("count").alias("count_mean"), F.min("count").alias("count_least"), F.max("count").alias("count_most"), F.max("unmoved").alias("unmoved"), F.count("*").alias("draws"))


def threshold_sweep(pairs: DataFrame, similarities: list[int], deltas: list[float]) -> DataFrame:
    """Counts of pairs for each similarity (in hundredths) and difference; one pass over the pairs."""
    reach = lambda s: F.col("inter") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("inter")) * s
    grid = [(s, d) for s in similarities for d in deltas]
    counts = pairs.agg(F.count("*").alias("all"), *(F.count_if(reach(s) & (F.col("delta") >= d)).alias(f"n{i}") for i, (s, d) in enumerate(grid)))  # one row
    cells = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(d).alias("d"), F.col(f"n{i}").alias("n")) for i, (s, d) in enumerate(grid)))
    return counts.filter(F.col("all") > 0).select(F.explode(cells).alias("t")).select("t.*")
