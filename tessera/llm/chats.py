"""Chat formatting (operator 4): collapse of cumulative snapshots, then rendering.

A logged conversation that is a prefix of a longer one, turn by turn, is dropped, and
of equal conversations the one with the smallest id stays. Each turn gets its place
and a rolling hash of all turns up to it: the running sum of place-dependent hashes,
which can be summed in parts: sampled splitters divide the order of all turns (conversation,
number, digest) into even parts, so that a conversation of any length, and any number of
turns of one number or none, spreads over many tasks. A conversation's last state is
anti-joined with the states before a turn.

Defined results: turns are ordered by number (nulls last), ties by the digest of role
and text; repeated rows of a conversation count once; null roles and texts count as
empty; ids are of any type with an order, and rows with a null id are a conversation of
their own, whose id is the smallest. Long conversations are rendered in segments of
``segment_turns`` turns, in order the whole; with None each is one row, however long. An
empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import counted, durable
from tessera.llm.ranges import splitters

#: Turns in a part that one task orders.
PART_TURNS = 50_000
#: Turns in a rendered segment.
SEGMENT = 512


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", "digest").cast("decimal(20,0)")


def turn_states(turns: DataFrame) -> DataFrame:
    """Turns with their place (from 1) and the state after them (s1, s2) and before them (b1, b2)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text")))
    rows = rows.groupBy("conv", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    within = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_last(), "digest")
    upto = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def parts_before(df: DataFrame, **sums: Column) -> DataFrame:
        parts = df.groupBy("conv", "part").agg(*(v.alias(k) for k, v in sums.items()))
        return parts.select("conv", "part", *(F.coalesce(F.sum(k).over(upto), F.lit(0)).alias(f"{k}_before") for k in sums))

    rows = durable(rows)
    order = [F.col("conv.conv_id").alias("a"), F.col("turn").isNull().alias("b"), F.col("turn").alias("c"), F.col("digest").alias("d")]
    short, n = counted(rows.select(*order))
    split = splitters(short, ["a", "b", "c", "d"], F.lit(1), n // PART_TURNS + 1)
    rows = rows.withColumn("part", split.index(order))
    numbers = parts_before(rows, n=F.count("*"))
    rows = rows.withColumn("place", F.row_number().over(within)).join(numbers, ["conv", "part"])
    rows = rows.withColumn("place", F.col("place") + F.col("n_before")).drop("n_before")
    rows = rows.withColumns({"h1": _hash(1), "h2": _hash(2)})
    summed = parts_before(rows, s1=F.sum("h1"), s2=F.sum("h2"))
    running = Window.partitionBy("conv", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"s1": F.sum("h1").over(running), "s2": F.sum("h2").over(running)}).join(summed, ["conv", "part"])
    state = {k: (F.col(k) + F.col(f"{k}_before")).cast("decimal(38,0)") for k in ("s1", "s2")}
    rows = rows.withColumns(state)
    return rows.select("conv", "place", "role", "text", "s1", "s2", *((F.col(f"s{i}") - F.col(f"h{i}")).cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)))


def collapse(turns: DataFrame, segment_turns: int | None = SEGMENT) -> DataFrame:
    """Maximal conversations, rendered: conv_id, segment (from 0), n_turns, copies, text."""
    rows = durable(turn_states(turns))
    last = rows.groupBy("conv").agg(F.max(F.struct("place", "s1", "s2")).alias("s")).select("conv", "s.*")
    last = last.groupBy("place", "s1", "s2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    before = rows.filter("place > 1").select((F.col("place") - 1).alias("place"), F.col("b1").alias("s1"), F.col("b2").alias("s2")).distinct()
    kept = last.join(before, ["place", "s1", "s2"], "left_anti").select("conv", "copies", F.col("place").alias("n_turns"))
    segment = lambda place: F.floor((place - 1) / segment_turns).cast("int") if segment_turns else F.lit(0)
    made = rows.select("conv", "place", render(F.col("role"), F.col("text")).alias("line")).withColumn("segment", segment(F.col("place")))
    # a row for each segment of a kept conversation, so that turns meet by segment and never by conversation
    kept = kept.select("*", F.explode(F.sequence(F.lit(0), segment(F.col("n_turns")))).alias("segment"))
    made = made.join(kept, ["conv", "segment"]).groupBy("conv", "segment", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    text = F.array_join(F.col("lines.line"), "")
    return made.select("conv.conv_id", "segment", F.col("n_turns").cast("long").alias("n_turns"), "copies", text.alias("text"))


#: DuckDB SQL of ``collapse`` for conversations of one segment, with the text's MD5.
COLLAPSE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), o AS (
  SELECT *, md5(length(role)::varchar || ':' || role || ':' || text) AS d FROM t
), c AS (
  SELECT conv_id, list(d ORDER BY turn NULLS LAST, d) AS ds,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, d) AS r
  FROM o GROUP BY conv_id
), u AS (
  SELECT ds, min(conv_id) AS conv_id, count(*) AS copies, min(r) AS r FROM c GROUP BY ds
)
SELECT conv_id, 0::integer AS segment, len(ds)::bigint AS n_turns, copies::bigint AS copies, md5(r) AS text_md5 FROM u
WHERE NOT EXISTS (SELECT 1 FROM u v WHERE len(v.ds) > len(u.ds) AND list_slice(v.ds, 1, len(u.ds)) = u.ds)
"""
