"""Mixing sources to target weights (operator 11): Pareto order sampling.

Each source gets a share of the words of the mix, at most ``most`` times its own words, the
excess going to the others by weight (a water level). Within a source the share is dealt to
preference classes in the same way, so that every document has an expected number of copies.
The whole part of it is certain; for the fraction documents are ranked by random odds divided
by inclusion odds, and those that rank first are taken until the words of the source are
reached. The place to cut is found by selection on the ranks' bits, from sums of words by
bucket, so that a source of any size is cut without ordering its documents in one task. One
closing document per source, the one whose size is nearest to what is missing, ends the mix.

Defined results: a null text has no words; null sources are a source of their own, last in
order; documents without words are taken zero times; ``target`` is that of the source. The
random number comes from MD5 of the keys, so reruns agree, and rows with equal keys (repeated
rows) share their fate. Null keys count as empty. An empty table gives no rows. Columns of the
caller are carried as they are, whatever their names; made names win over carried ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, counted, durable, if_small, in_tasks
from tessera.llm.ranges import splitters

#: Bits of a rank, in the steps of the selection.
BITS = (12, 18, 18)
#: Rows of sources that one task numbers.
SOURCES_A_TASK = 100_000
#: Rows in a written file.
TASK_ROWS = 500_000
#: Steps of a preference: eighths of a power of two, from 2^-10 to 2^10.
STEPS, MOST_STEPS = 8, 80


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, n: int, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` (n rows) with the sums over all rows before each one, in ``order`` (unique); ranges of rows are summed on their own."""
    keys = [f"__k{i}" for i in range(len(order))]
    df = df.withColumns({k: c for k, c in zip(keys, order)} | {f"__v{k}": v for k, v in sums.items()})
    split = splitters(df, keys, F.lit(1), n // SOURCES_A_TASK + 1)
    df = df.withColumn("__part", split.index([F.col(k) for k in keys]))
    before = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"__in{k}": F.coalesce(F.sum(f"__v{k}").over(before), F.lit(0)) for k in sums})
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    parts = df.groupBy("__part").agg(*(F.sum(f"__v{k}").alias(f"__s{k}") for k in sums))
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__s{k}").over(ahead), F.lit(0)).alias(f"__a{k}") for k in sums))
    df = df.join(F.broadcast(parts), "__part")
    made = {k: F.col(f"__in{k}") + F.col(f"__a{k}") for k in sums}
    return df.withColumns(made).drop("__part", *keys, *(f"__{x}{k}" for k in sums for x in ("v", "in", "a")))


def source_targets(sources: DataFrame, n: int, words: int, share: float, cycle: tuple[int, ...], most: int) -> DataFrame:
    """``sources`` (n rows: no_source, source, source_size) with the target of each: ``share`` of all words by weight, none above ``most`` times its size."""
    total = share * words
    out = _running(sources, n, [F.col("no_source"), F.col("source")], {"place": F.lit(1)})
    out = out.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in cycle)), (F.col("place") % len(cycle) + 1).cast("int")))
    out = out.withColumn("cap", most * F.col("source_size"))
    all_weights = out.agg(F.sum("weight")).first()[0] or 0
    order = [F.col("cap") / F.col("weight"), F.col("no_source"), F.col("source")]
    out = _running(out, n, order, {"caps": F.col("cap"), "weights": F.col("weight")})
    level = (F.lit(total) - F.col("caps")) / (F.lit(all_weights) - F.col("weights"))  # if all before are at their cap
    out = out.withColumn("level", level)
    found = out.filter(F.col("level") < F.col("cap") / F.col("weight")).agg(F.min_by("level", F.struct(*order))).first()[0]
    dealt = F.col("weight") * F.lit(found) if found is not None else F.col("cap").cast("double")
    return out.select("no_source", "source", "source_size", F.least(dealt, F.col("cap").cast("double")).alias("target"))


def expected_copies(classes: DataFrame, most: int) -> DataFrame:
    """``classes`` (source, class, class_size, source_size, target) with whole copies and the fraction that remains.

    The target of the source is dealt by preference times size, no class above ``most`` copies;
    a source has at most 2 * MOST_STEPS + 1 classes, ordered by preference.
    """
    own = ("no_source", "source")
    weight = F.pow(F.lit(2.0), F.col("class") / float(STEPS)) * F.col("class_size")
    before = Window.partitionBy(*own).orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    here_on = Window.partitionBy(*own).orderBy(F.desc("class")).rowsBetween(0, Window.unboundedFollowing)
    rows = classes.withColumns({"w": weight, "cap": (most * F.col("class_size")).cast("double")})
    rows = rows.withColumn("level", F.try_divide(F.col("target") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("w").over(here_on)))
    free = F.when((F.col("w") > 0) & (F.col("level") * F.col("w") < F.col("cap")), F.struct(-F.col("class"), "level"))
    rows = rows.withColumn("level", F.min(free).over(Window.partitionBy(*own))["level"])
    copies = F.when(F.col("w") > 0, F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")) / F.col("class_size"))
    rows = rows.withColumn("copies", F.coalesce(copies, F.lit(0.0)))
    return rows.select(*own, "class", "class_size", "source_size", "target", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("fraction"))


def _cut(ranked: DataFrame, wanted: DataFrame, n_sources: int) -> DataFrame:
    """For each source of ``wanted`` (words): cut, the first rank that no longer fits, and missing, the words that the ranks before it leave.

    The bits of the ranks are settled from the highest: words are summed by bucket, and the
    bucket in which the sum passes the wanted words is divided again.
    """
    own = ["no_source", "source"]
    left, width = sum(BITS), []
    for b in BITS:
        left -= b
        width.append(left)
    cuts = wanted.select(*own, F.col("words").alias("missing"), F.lit(0).cast("long").alias("bucket"))
    for i, low in enumerate(width):
        rows = ranked.select(*own, "rank", "size")
        if i:
            rows = rows.withColumn("bucket", F.shiftright("rank", width[i - 1])).join(if_small(cuts.select(*own, "bucket"), n_sources), [*own, "bucket"])
        sums = rows.groupBy(*own, F.shiftright("rank", low).alias("next")).agg(F.sum("size").alias("words"))
        until = Window.partitionBy(*own).orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("until", F.sum("words").over(until)).join(if_small(cuts.drop("bucket"), n_sources), own)
        fits = F.col("until") <= F.col("missing")
        found = sums.groupBy(*own).agg(F.min(F.when(~fits, F.col("next"))).alias("found"), F.coalesce(F.max(F.when(fits, F.col("until"))), F.lit(0)).alias("fit"))
        # a source all of whose ranks fit has no bucket to divide; its cut is beyond all ranks
        cuts = cuts.drop("bucket").join(if_small(found, n_sources), own, "left")
        end = F.lit((1 << (sum(BITS) - low)) + 1).cast("long")
        cuts = durable(cuts.select(*own, (F.col("missing") - F.coalesce(F.col("fit"), F.lit(0))).alias("missing"), F.coalesce("found", end).alias("bucket")))
    return cuts.withColumnRenamed("bucket", "cut")


def mix(
    docs: DataFrame, carry: list[str] | None = None, source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id",), share: float = 1.5,
    cycle: tuple[int, ...] = (3, 1, 2), most: int = 2, preference=None, seed: int = 42,
) -> DataFrame:
    """Columns of ``carry`` (default: all but the text) with size, source_size, target and taken.

    ``share``: words of the mix as a part of all words, at most ``most``; ``cycle``: weights of
    the sources in order of code points, repeating; ``preference``: a function of the size
    column that gives a document's preference within its source (default: all alike), rounded
    to an eighth of a power of two.
    """
    made = ("size", "source_size", "target", "taken")
    columns = [c for c in (carry if carry is not None else [c for c in docs.columns if c != text]) if c not in made]
    own = F.struct(F.lit(True), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("own")
    of = F.col(source).cast("string")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    rows = docs.select(own, of.isNull().alias("no_source"), F.coalesce(of, F.lit("")).alias("source"), n_words(F.col(text)).alias("size"), draw.alias("draw"))
    steps = F.lit(0) if preference is None else F.greatest(F.lit(-MOST_STEPS), F.least(F.lit(MOST_STEPS), F.round(STEPS * F.log2(preference(F.col("size"))))))
    rows, n, words = counted(rows.withColumn("class", steps.cast("int")), TASK_ROWS, F.sum("size"))
    words = words or 0
    ids = ["no_source", "source"]

    classes, n_classes = counted(rows.groupBy(*ids, "class").agg(F.sum("size").alias("class_size")))
    sources, n_sources = counted(classes.groupBy(*ids).agg(F.sum("class_size").alias("source_size")))
    targets = source_targets(sources, n_sources, words, min(share, most), cycle, most)
    shares = durable(expected_copies(classes.join(targets, ids), most))
    fraction = F.col("fraction")
    wanted = shares.groupBy(*ids).agg((F.first("target") - F.sum(F.col("whole") * F.col("class_size"))).alias("words"))

    per_class = shares.drop("class_size")
    u = (F.col("draw") + 0.5) / float(1 << 52)
    ratio = (u / (1 - u)) / (fraction / (1 - fraction))
    rank = F.floor(ratio / (1 + ratio) * float(1 << sum(BITS))).cast("long")
    ranked = rows.join(if_small(per_class, n_classes), [*ids, "class"])
    ranked = durable(in_tasks(ranked.withColumn("rank", F.when((fraction > 0) & (F.col("size") > 0), F.least(rank, F.lit((1 << sum(BITS)) - 1)))).drop("draw", "class", "fraction"), n / TASK_ROWS))
    chosen = ranked.filter(F.col("rank").isNotNull())
    cuts = _cut(chosen, wanted, n_sources)

    small = if_small(cuts, n_sources)
    miss = F.abs(F.col("size") - F.col("missing"))
    last = chosen.join(small, ids).filter((F.col("rank") >= F.col("cut")) & (miss < F.col("missing"))).groupBy(*ids).agg(F.min(F.struct(miss.alias("miss"), "rank", "size")).alias("closing"))
    ends = cuts.join(last, ids, "left").select(*ids, "cut", F.col("closing.rank").alias("closing_rank"), F.col("closing.size").alias("closing_size"))
    done = ranked.join(if_small(ends, n_sources), ids)
    more = (F.col("rank") < F.col("cut")) | ((F.col("rank") == F.col("closing_rank")) & (F.col("size") == F.col("closing_size")))
    taken = F.col("size") * (F.col("whole") + F.when(more, 1).otherwise(0))
    return done.select(*(F.col(f"own.c{i}").alias(c) for i, c in enumerate(columns)), "size", "source_size", "target", taken.cast("long").alias("taken"))


#: DuckDB SQL of the query: levels by sorting, the cut by a running sum over each source's ranks. 42: seed; 20 words: fragments, at half preference.
MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\x09-\\x0D]+')), 0)::bigint AS size,
         ('0x' || md5('42:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')))[1:13])::bigint AS draw FROM documents
), c AS (SELECT *, CASE WHEN size < 20 THEN 0.5::double ELSE 1.0::double END AS v FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(i - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, (1.5::double * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap::double / weight, i) - cap)) / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY cap::double / weight, i) - weight)) AS level FROM w),
l AS (SELECT arg_min(level, (cap::double / weight, i)) AS level FROM o WHERE level < cap::double / weight),
t AS (SELECT source, source_size, least(coalesce(weight * l.level, cap::double), cap::double) AS target FROM w, l),
k AS (SELECT source, v, sum(size)::bigint AS class_size FROM c GROUP BY source, v),
e AS (SELECT k.*, target, source_size, v * class_size AS cw, (target - (sum(2.0::double * class_size) OVER a - 2.0::double * class_size)) / (sum(v * class_size) OVER b) AS own_level
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
      WINDOW a AS (PARTITION BY k.source ORDER BY v DESC ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY k.source ORDER BY v DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, arg_max(own_level, v) FILTER (WHERE cw > 0 AND own_level * cw < 2.0::double * class_size) OVER (PARTITION BY source) AS level FROM e),
g AS (SELECT *, CASE WHEN cw > 0 THEN least(coalesce(level * cw, 2.0::double * class_size), 2.0::double * class_size) / class_size ELSE 0.0::double END AS copies FROM f),
h AS (SELECT source, any_value(target) - sum(floor(copies) * class_size) AS wanted FROM g GROUP BY source),
r AS (SELECT c.*, g.source_size, g.target, floor(copies)::bigint AS whole, copies - floor(copies) AS p, wanted, (draw + 0.5::double) / 4503599627370496.0::double AS u
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source AND c.v = g.v JOIN h ON c.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS ratio FROM r),
n AS (SELECT *, floor(ratio / (1 + ratio) * 281474976710656.0::double)::bigint AS rank FROM q),
m AS (SELECT *, sum(size) FILTER (WHERE rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST) AS until FROM n),
x AS (SELECT *, rank IS NOT NULL AND until <= wanted AS fits FROM m),
y AS (SELECT *, wanted - coalesce(sum(size) FILTER (WHERE fits) OVER (PARTITION BY source), 0) AS missing FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN rank IS NOT NULL AND NOT fits AND abs(size - missing) < missing THEN abs(size - missing) END NULLS LAST, rank, size) = 1
        AND rank IS NOT NULL AND NOT fits AND abs(size - missing) < missing AS closing FROM y)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN fits OR closing THEN 1 ELSE 0 END))::bigint AS taken FROM z
"""
