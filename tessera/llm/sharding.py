"""Sharding (operator 1): sampled splitters, range partition and even shards by bytes.

Records are ordered by the MD5 of their text and then by key, so that equal texts
stand together. Size-weighted samples of these keys give splitters; the range
partition by them is exact about sizes, since each range's total is counted and
overfull ranges are subdivided. Each range is a task's, and no task holds more.

Groups of equal texts above LIGHT of a shard (and above the largest record) are placed
first, the heaviest first, each as a whole in the lightest shard where it fits; one that
fits nowhere is divided like records of their own. All other records fill what
room is left in the shards, in order, a light group by where it begins. So a shard's size is
off the even share by less than a light group or the largest record at each end.

Defined results: keys are of any type with an order that JSON can hold, nulls first; a
null text has no bytes (its size is the overhead) and the MD5 of nothing; repeated rows
are records of their own; an empty table gives no rows; columns of the result's names
are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, in_tasks
from tessera.llm.ranges import longs, splitters

#: Bytes of a record besides its text.
OVERHEAD = 16
#: Groups of equal texts above this share of a shard are placed one by one; there are at most n_shards / LIGHT of them.
LIGHT = 1 / 64
#: Bytes of text of the records in a range; there is at least one range for each core.
RANGE_BYTES = 64 << 20
#: Rows and bytes of text of a task that writes the working table.
TASK_ROWS, TASK_BYTES = 500_000, 256 << 20


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def place_groups(groups: list[tuple[str, int]], n_shards: int, most: int) -> tuple[dict[str, int], list[int]]:
    """Shard of each group (digest, bytes) that fits, heaviest first into the lightest shard, and the shards' loads."""
    loads, placed = [0] * n_shards, {}
    for digest, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        lightest = loads.index(min(loads))
        if loads[lightest] + size <= most:
            placed[digest] = lightest
            loads[lightest] += size
    return placed, loads


def shard(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with size (long), shard (int, from 0) and slot (long, gapless from 0 within a shard).

    ``df`` is read twice: for its total, and to write its columns (or those of ``carry``) to the
    shared checkpoint folder; all other passes work on that table.
    """
    made = ("size", "shard", "slot")
    columns = [c for c in (carry if carry is not None else df.columns) if c not in made]
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    own = F.struct(F.lit(True), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("own")
    rows = df.select(own, size_of(F.col(text).cast("string")).alias("size"), digest.alias("digest"), F.col(key).alias("key"))
    n, total, largest = rows.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    rows = durable(in_tasks(rows, max(n / TASK_ROWS, (total or 0) / TASK_BYTES if text in columns else 0)))
    result = [F.col(f"own.c{i}").alias(c) for i, c in enumerate(columns)]
    if not n:
        return rows.select(*result, "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    # heavy groups: as many as n_shards / LIGHT
    heavy = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter(F.col("bytes") > max(largest, total / n_shards * LIGHT)).collect()
    placed, loads = place_groups([(r["digest"], r["bytes"]) for r in heavy], n_shards, total // n_shards)
    groups, before_group, in_shard = [], 0, [0] * n_shards
    for r in sorted(heavy, key=lambda r: r["digest"]):
        at = placed.get(r["digest"])
        groups.append((r["digest"], at, before_group, in_shard[at] if at is not None else 0))
        if at is not None:
            before_group += r["n"]
            in_shard[at] += r["n"]
    names = ("digest", "at", "before_group", "in_shard")
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, g)) for g in groups])), "array<struct<digest:string,at:int,before_group:long,in_shard:long>>")
    groups = df.sparkSession.range(1).select(F.inline(listed))
    rows = rows.join(F.broadcast(groups.withColumn("heavy", F.lit(True))), "digest", "left")

    # ranges of the order; a light group has one key, so that it is never divided
    rows = rows.withColumns({"a": F.when(F.col("heavy"), F.col("key")), "b": F.when(F.col("heavy"), F.col("row")).otherwise(F.lit(0))})
    parts = ["digest", "a", "b"]
    split = splitters(rows, parts, F.col("size"), max(df.sparkSession.sparkContext.defaultParallelism, total // RANGE_BYTES))
    rows = rows.withColumn("range", split.index([F.col(c) for c in parts]))
    rest = F.col("at").isNull()
    counts = {"bytes": F.when(rest, F.col("size")), "rest": F.when(rest, F.lit(1)), "whole": F.when(~rest, F.lit(1))}
    counts = {k: F.coalesce(v, F.lit(0)).cast("long") for k, v in counts.items()}
    totals = {r["range"]: r for r in rows.groupBy("range").agg(*(F.sum(v).alias(k) for k, v in counts.items())).collect()}  # as many as ranges
    offsets = {k: [0] for k in counts}
    for r in range(len(split.bounds) + 1):
        for k, sums in offsets.items():
            sums.append(sums[-1] + (totals[r][k] if r in totals else 0))

    rows = rows.repartitionById(len(split.bounds) + 1, "range")
    upto = Window.partitionBy("range").orderBy("digest", "key", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{k}_before": F.sum(v).over(upto) - v + F.element_at(longs(offsets[k]), F.col("range") + 1) for k, v in counts.items()})
    first = F.min("bytes_before").over(Window.partitionBy("range", "digest"))
    rows = rows.withColumn("begin", F.when(F.col("heavy"), F.col("bytes_before")).otherwise(first))
    ends = [0]
    for s in range(n_shards):
        ends.append(ends[-1] + total * (s + 1) // n_shards - total * s // n_shards - loads[s])
    after = F.size(F.filter(longs(ends[1:]), lambda end: end <= F.col("begin")))
    rows = rows.withColumn("shard", F.coalesce("at", F.least(after, F.lit(n_shards - 1))).cast("int"))
    firsts = {r["shard"]: r for r in rows.filter(rest).groupBy("shard").agg(F.min("rest_before").alias("first"), F.count("*").alias("n")).collect()}  # as many as shards

    def of_shard(k: str) -> Column:
        return F.element_at(longs([firsts[s][k] if s in firsts else 0 for s in range(n_shards)]), F.col("shard") + 1)

    slot = F.when(rest, F.col("rest_before") - of_shard("first")).otherwise(F.col("whole_before") - F.col("before_group") + F.col("in_shard") + of_shard("n"))
    return rows.select(*result, "size", "shard", slot.alias("slot"))


#: DuckDB SQL of the query: the same shards from one ordered pass, heavy groups placed one by one; CRC-32 by its table, made by the rule.
SHARDING_SQL = """
WITH RECURSIVE k(n, i, c) AS (
  SELECT n, 0, n::bigint FROM range(256) r(n)
  UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::bigint, c >> 1) ELSE c >> 1 END FROM k WHERE i < 8
), t AS (SELECT list(c ORDER BY n) AS t FROM k WHERE i = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS h, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, h, (len(x) // 2 + 16)::bigint AS size, list_reduce(list_concat([4294967295::bigint], list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint)), lambda a, v: xor(t[(xor(a, v) & 255) + 1], a >> 8)) AS c FROM d, t),
a AS (SELECT sum(size)::bigint AS total, max(size) AS largest FROM b),
g AS (SELECT h, sum(size)::bigint AS w FROM b GROUP BY h),
v AS (SELECT h, w, row_number() OVER (ORDER BY w DESC, h) AS i FROM g, a WHERE w > greatest(largest, total / 40 / 64)),
l(i, loads, h, put) AS (
  SELECT 0::bigint, list_transform(range(40), lambda s: 0::bigint), NULL::varchar, NULL::integer
  UNION ALL
  SELECT v.i, CASE WHEN list_min(loads) + w <= total // 40 THEN list_transform(range(40), lambda s: loads[s + 1] + CASE WHEN s + 1 = list_position(loads, list_min(loads)) THEN w ELSE 0 END) ELSE loads END,
         v.h, CASE WHEN list_min(loads) + w <= total // 40 THEN (list_position(loads, list_min(loads)) - 1)::integer END
  FROM l JOIN v ON v.i = l.i + 1, a
), f AS (SELECT arg_max(loads, i) AS loads FROM l),
e AS (SELECT s, sum(total * (s + 1) // 40 - total * s // 40 - loads[s + 1]) OVER (ORDER BY s) AS until FROM range(40) r(s), f, a),
u AS (SELECT list(until ORDER BY s) AS ends FROM e),
o AS (SELECT b.*, l.h IS NOT NULL AS heavy, put, sum(CASE WHEN put IS NULL THEN size ELSE 0 END) OVER (ORDER BY b.h, doc_id ROWS UNBOUNDED PRECEDING) - CASE WHEN put IS NULL THEN size ELSE 0 END AS before
      FROM b LEFT JOIN l ON b.h = l.h),
p AS (SELECT *, CASE WHEN heavy THEN before ELSE min(before) OVER (PARTITION BY h) END AS begin FROM o),
s AS (SELECT *, coalesce(put, least(39, len(list_filter(ends, lambda x: x <= begin))))::integer AS shard FROM p, u)
SELECT doc_id, size, xor(c, 4294967295::bigint) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY put IS NOT NULL, h, doc_id) - 1 AS slot, NULL::integer AS grown_shard
FROM s
"""
