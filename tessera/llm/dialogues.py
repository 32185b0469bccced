"""Conversation structure repair (operator 13): error-correcting Earley parsing.

The roles of a conversation are parsed by a weighted grammar: each turn may be kept, given
another role or deleted, and turns may be inserted, at a price each; a chart item holds the
cheapest (cost, audit) by which it is reached, the audit being the initials of the edits in
order, ties to the least. The completed chart yields the repair.

Turns are placed in order by sampled splitters, which spread one long conversation over many
tasks, and cut into segments of bounded rows and bytes. Only a segment's symbols (role initial
and fault of each turn) go to the parser. A conversation of one segment, which is nearly
every one, is parsed at once; of others each segment is parsed from every state of the grammar
to every other, and the segments' results are composed in order. The grammar is left-linear:
each item begins where the segment does, so that a completed nonterminal is such a state.

Defined results: null roles and texts count as one space; turns are ordered by number, nulls
first, ties by role, then by digest; repeated rows count as duplicates; null ids are a conversation of
their own. A conversation without rows has zeros, no audit and the digest of an empty text.
What one conversation yields in one piece (its audit, the digest of its text) goes through one
row or stream: audits hold a character for each turn; texts are hashed segment by segment
and never held together. Only conv_id, turn, role and text are used.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, counted, durable
from tessera.llm.ranges import splitters

#: Turns in a part that one task orders.
PART_TURNS = 50_000
#: Turns and bytes in a segment.
SEGMENT_TURNS, SEGMENT_BYTES = 1_000, 4 << 20
#: Prices of the edits; an undeleted truncated turn pays CUT besides.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Productions by nonterminal; terminals are the initials of roles. NONE: nothing yet; LEAD: after a system turn; OPEN: after a user turn; PAIRS: after an answer.
GRAMMAR = {"NONE": [()], "LEAD": [("NONE", "s")], "OPEN": [("NONE", "u"), ("LEAD", "u"), ("PAIRS", "u")], "PAIRS": [("OPEN", "a")]}
#: Nonterminals that may end a conversation, and those by which a segment may begin and end.
ACCEPTED, STATES = ("NONE", "PAIRS"), ("NONE", "LEAD", "OPEN", "PAIRS")
#: Terminals that a turn may be given or inserted as.
FREE = ("u", "a")
#: Results of a worker that are kept for equal symbols.
MEMORY = 20_000

#: A step: k keep, d delete, u and a new role, U and A inserted turn; and its initial in the audit.
AUDIT = str.maketrans("kduaUA", "KDRRII")
PLACED = "kdua"


def symbol(role: Column, blank_or_repeated: Column, truncated: Column) -> Column:
    """A turn's symbol: x must be deleted; else its role's initial (o: another one), upper case if truncated."""
    initial = F.substring(role, 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(blank_or_repeated, "x").when(truncated, F.upper(own)).otherwise(own)


def parse(symbols: str, begin: str = "NONE", grammar: dict = GRAMMAR) -> dict[str, tuple[int, str, str]]:
    """By nonterminal that the symbols can be parsed as, after ``begin``: cost, audit and steps of the cheapest way.

    Items are (head, body, dot, origin). A column's items are worked off until none gets
    cheaper; scanning leads to the next column (keep, new role, delete) or stays (insert).
    """
    column: dict[tuple, tuple] = {}
    ahead: dict[tuple, tuple] = {}
    done: list[dict[str, dict[int, tuple]]] = []
    waiting: list[dict[str, set[tuple]]] = []
    agenda: list[tuple] = []

    def put(items: dict, item: tuple, value: tuple) -> None:
        if item not in items or value < items[item]:
            items[item] = value
            if items is column:
                agenda.append(item)

    def step(value: tuple, cost: int, own: str) -> tuple:
        return value[0] + cost, value[1] + own.translate(AUDIT), value[2] + own

    def complete(name: str, origin: int, value: tuple) -> None:
        known = done[at][name]
        if origin in known and known[origin] <= value:
            return
        known[origin] = value
        for parent in tuple(waiting[origin][name]):
            before = column[parent] if origin == at else charts[origin][parent]
            put(column, (parent[0], parent[1], parent[2] + 1, parent[3]), (before[0] + value[0], before[1] + value[1], before[2] + value[2]))

    charts: list[dict] = []
    for at in range(len(symbols) + 1):
        column, ahead = ahead, {}
        charts.append(column)
        done.append({n: {} for n in grammar})
        waiting.append({n: set() for n in grammar})
        agenda = list(column)
        if at == 0:
            for name, bodies in grammar.items():
                for body in bodies:
                    if body:
                        put(column, (name, body, 0, 0), (0, "", ""))
            put(column, (begin, (), 0, 0), (0, "", ""))
        mark = symbols[at : at + 1]
        own, extra = mark.lower(), CUT if mark.isupper() else 0
        while agenda:
            item = agenda.pop()
            name, body, dot, origin = item
            value = column[item]
            if dot == len(body):
                complete(name, origin, value)
                if mark:  # a deleted turn after the last one that belongs to the item
                    put(ahead, item, step(value, DELETE, "d"))
                continue
            nxt = body[dot]
            if nxt in grammar:
                waiting[at][nxt].add(item)
                if at and nxt not in (n for n, _, d, o in column if d == 0 and o == at):
                    for b in grammar[nxt]:
                        put(column, (nxt, b, 0, at), (0, "", ""))
                for o, v in tuple(done[at][nxt].items()):
                    if o == at:
                        put(column, (name, body, dot + 1, origin), (value[0] + v[0], value[1] + v[1], value[2] + v[2]))
                continue
            moved = (name, body, dot + 1, origin)
            if nxt in FREE:
                put(column, moved, step(value, INSERT, nxt.upper()))
            if mark:
                put(ahead, item, step(value, DELETE, "d"))
                if own == nxt:
                    put(ahead, moved, step(value, extra, "k"))
                elif nxt in FREE and own != "x":
                    put(ahead, moved, step(value, REROLE + extra, nxt))
    return {n: v[0] for n, v in done[-1].items() if 0 in v}


def _turns(steps: str) -> list[str]:
    """Steps turn by turn: those before a turn go with it, those after the last with the last."""
    own = re.findall(f"[^{PLACED}]*[{PLACED}]", steps)
    rest = steps[sum(map(len, own)) :]
    return [*own[:-1], own[-1] + rest] if own else []


ENTRY = "struct<begin:string,end:string,cost:long,steps:array<string>>"


def _parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple[str, bool], list[dict]] = {}

    def entries(symbols: str, whole: bool) -> list[dict]:
        made = []
        for begin in STATES[: 1 if whole else None]:
            found = parse(symbols, begin)
            ends = [min((n for n in ACCEPTED if n in found), key=lambda n: found[n])] if whole else found
            made += [{"begin": begin, "end": n, "cost": found[n][0], "steps": _turns(found[n][2])} for n in ends]
        return made

    for symbols, whole in batches:
        out = []
        for s, w in zip(symbols, whole):
            key = (s, bool(w))
            if key not in known:
                if len(known) >= MEMORY:
                    known.clear()
                known[key] = entries(*key)
            out.append(known[key])
        yield pd.Series(out)


def _composed(entries: pd.Series) -> pd.Series:
    """For each conversation the begin and end of each segment on the cheapest way; entries: in order of segments, part, sub, begin, end, cost, audit."""
    out = []
    for of in entries:
        best = {"NONE": (0, "", None)}
        for _, own in itertools.groupby(of, key=lambda e: (e["part"], e["sub"])):
            reached: dict[str, tuple] = {}
            for e in own:
                if e["begin"] in best:
                    cost, audit, way = best[e["begin"]]
                    value = (cost + e["cost"], audit + e["audit"])
                    if e["end"] not in reached or value < reached[e["end"]][:2]:
                        reached[e["end"]] = (*value, ((e["begin"], e["end"]), way))
            best = reached
        way, steps = min(best[n] for n in ACCEPTED if n in best)[2], []
        while way:
            steps.append({"begin": way[0][0], "end": way[0][1]})
            way = way[1]
        out.append(steps[::-1])
    return pd.Series(out)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order of conversation and segment; a digest for each conversation, its pieces joined by line breaks."""
    at = at_id = sha = None

    def made() -> pd.DataFrame:
        return pd.DataFrame({"hot": [at], "sha": [sha.hexdigest()]})

    for batch in batches:
        for hot, piece in zip(batch["hot"], batch["piece"]):
            if sha is None or hot != at:
                if sha is not None:
                    yield made()
                at, sha, at_id = hot, hashlib.sha256(), False
            if at_id:
                sha.update(b"\n")
            sha.update(piece.encode())
            at_id = True
    if sha is not None:
        yield made()


def place_turns(turns: DataFrame) -> DataFrame:
    """Turns with conv, segment, place (within the segment, from 1), flags of their fault, and the last turn and role before them in their part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({
        "digest": F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text")),
        "bytes": F.octet_length("text").cast("long"),
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "open": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
    })
    rows = durable(rows)
    order = [F.col("conv.conv_id").alias("a"), F.col("turn").alias("b"), F.substring("role", 1, 64).alias("c"), F.col("digest").alias("d")]
    short, n = counted(rows.select(*order))
    split = splitters(short, ["a", "b", "c", "d"], F.lit(1), n // PART_TURNS + 1)
    rows = rows.withColumn("part", split.index(order))
    part = Window.partitionBy("conv", "part")
    by = part.orderBy(F.asc_nulls_first("turn"), F.substring("role", 1, 64), "digest")
    weight = 1.0 / SEGMENT_TURNS + F.col("bytes") / float(SEGMENT_BYTES)
    rows = rows.withColumns({
        "row": F.row_number().over(by),
        "sub": F.floor(F.sum(weight).over(by.rowsBetween(Window.unboundedPreceding, 0))),
        "before": F.lag(F.struct("turn", F.substring("role", 1, 1).alias("initial"))).over(by),
    })
    again = F.row_number().over(Window.partitionBy("conv", "part", "digest").orderBy("row")) > 1
    rows = rows.withColumn("again", again)
    if split.bounds:  # a text may also have been seen in an earlier part of its conversation; at most as many conversations as boundaries have several
        parts = rows.groupBy("conv").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last").select("conv")
        seen = rows.join(F.broadcast(parts), "conv").groupBy("conv", "digest").agg(F.min("part").alias("first_part"), F.max("part").alias("last_part"))
        seen = seen.filter("first_part < last_part").select("conv", "digest", "first_part")
        rows = rows.join(seen, ["conv", "digest"], "left").withColumn("again", F.col("again") | F.coalesce(F.col("part") > F.col("first_part"), F.lit(False))).drop("first_part")
    return rows.withColumns({
        "place": F.row_number().over(Window.partitionBy("conv", "part", "sub").orderBy("row")),
        "again": F.col("again") & ~F.col("blank"),
        "open": F.col("open") & ~F.col("blank") & ~F.col("again"),
    })


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = turns.sparkSession
    bounded_batches(spark)
    segment = ["conv", "part", "sub"]
    rows = place_turns(turns)
    initial = F.substring("role", 1, 1)
    legal = F.concat(F.col("before.initial"), initial).isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before.turn"))
    ends = F.struct("part", "row", "turn", initial.alias("initial"))
    count = {"blank": F.col("blank"), "duplicate": F.col("again"), "truncated": F.col("open"), "illegal": F.col("before").isNotNull() & ~legal, "turns": new_turn}
    segments = rows.groupBy(*segment).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", symbol(F.col("role"), F.col("blank") | F.col("again"), F.col("open")).alias("s")))), lambda x: x["s"]), "").alias("symbols"),
        F.min(ends).alias("head"), F.max(ends).alias("tail"), F.min("turn").alias("least"), F.max("turn").alias("most"),
        *(F.count_if(c).alias(k) for k, c in count.items()),
    )
    of = Window.partitionBy("conv")
    segments = segments.withColumns({"whole": F.count("*").over(of) == 1, "prior": F.lag("tail").over(of.orderBy("part", "sub"))})
    # the first row of a part has no row before it in its part, but may have one in the part before
    joins = F.col("prior").isNotNull() & (F.col("prior.part") < F.col("head.part"))
    bad = joins & ~F.concat(F.col("prior.initial"), F.col("head.initial")).isin("su", "ua", "au")
    same = joins & (F.col("prior.turn") == F.col("head.turn"))
    segments = segments.withColumns({"illegal": F.col("illegal") + F.when(bad, 1).otherwise(0), "turns": F.col("turns") - F.when(same, 1).otherwise(0)})
    parsed = F.pandas_udf(f"array<{ENTRY}>")(_parsed)
    segments = durable(segments.drop("head", "tail", "prior").withColumn("entries", parsed("symbols", "whole")).drop("symbols"))

    def audit(steps: Column) -> Column:
        return F.translate(F.array_join(steps, ""), "kduaUA", "KDRRII")

    several = segments.filter(~F.col("whole"))
    brief = F.transform("entries", lambda e: F.struct(F.col("part"), F.col("sub"), e["begin"].alias("begin"), e["end"].alias("end"), e["cost"].alias("cost"), audit(e["steps"]).alias("audit")))
    several = several.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "sub", brief.alias("entries")))).alias("all"))
    composed = F.pandas_udf("array<struct<begin:string,end:string>>")(_composed)
    ways = several.withColumn("way", composed(F.flatten("all.entries"))).select("conv", F.explode(F.arrays_zip("all.part", "all.sub", "way.begin", "way.end")).alias("w"))
    ways = ways.select("conv", "w.*")
    chosen = F.filter("entries", lambda e: F.col("whole") | ((e["begin"] == F.col("begin")) & (e["end"] == F.col("end"))))
    edits = segments.join(ways, segment, "left").withColumn("entry", F.get(chosen, F.lit(0))).drop("entries", "begin", "end")
    edits = durable(edits.select(*segment, "whole", "least", "most", *count, "entry.cost", "entry.steps"))

    sums = ("blank", "duplicate", "truncated", "illegal", "cost")
    result = edits.groupBy("conv").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in sums),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "sub", audit(F.col("steps")).alias("a")))), lambda x: x["a"]), "").alias("audit"),
    )

    line = F.concat(F.col("role"), F.lit(":"), F.col("text"))
    given = {"k": line, "u": F.concat(F.lit("user:"), F.col("text")), "a": F.concat(F.lit("assistant:"), F.col("text")), "U": F.lit("user:"), "A": F.lit("assistant:")}

    def written(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, v in given.items():
            out = F.when(c == k, v).otherwise(out)
        return out

    lines = rows.select(*segment, "place", "role", "text").join(edits.select(*segment, "whole", "steps"), segment)
    lines = lines.withColumn("lines", F.transform(F.split(F.element_at("steps", F.col("place")), ""), written))
    lines = lines.select(*segment, "whole", "place", F.filter("lines", lambda x: x.isNotNull()).alias("lines")).filter(F.size("lines") > 0)
    pieces = lines.groupBy(*segment, "whole").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "lines"))), lambda x: x["lines"])), "\n").alias("piece"))
    short = pieces.filter("whole").select("conv", F.sha2("piece", 256).alias("sha"))
    # conversations of several segments are numbered by the row of their first segment, for a key of a plain type
    named = edits.filter(~F.col("whole")).groupBy("conv").agg(F.min(F.struct("part", "sub")).alias("f"))
    named = durable(named.select("conv", F.monotonically_increasing_id().alias("hot")))
    streamed = pieces.filter(~F.col("whole")).join(named, "conv").select("hot", "part", "sub", "piece")
    streamed = streamed.repartition("hot").sortWithinPartitions("hot", "part", "sub").select("hot", "piece").mapInPandas(_digests, "hot long, sha string")
    digests = short.unionByName(streamed.join(named, "hot").select("conv", "sha"))
    result = result.join(digests, "conv", "left").withColumn("repaired_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    return result.select("conv.conv_id", "gaps", *sums[:4], "cost", "audit", "repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """Turns as the query damages them, by the checksum of ``conv_id:turn``: dropped, emptied, cut, repeated or given the role user."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("d"))
    rows = rows.filter("d <> 0").withColumns({
        "text": F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("d") == 4, "user").otherwise(F.col("role")),
    })
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged turns, with a row for every conversation of ``turns``."""
    every = turns.select(F.struct("conv_id").alias("conv")).distinct()
    found = repair(damage(turns))
    made = found.columns[1:]
    found = found.select(F.struct("conv_id").alias("conv"), *made)
    none = {c: F.lit(0).cast("long") for c in made} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.join(found, "conv", "left").select("conv.conv_id", *(F.coalesce(F.col(c).cast("long") if c not in ("audit", "repaired_sha256") else F.col(c), none[c]).alias(c) for c in made))


#: DuckDB SQL of the query: the best way to each state of the role automaton, turn by turn; CRC-32 by its table, made by the rule.
REPAIR_SQL = """
WITH RECURSIVE k(n, i, c) AS (
  SELECT n, 0, n::bigint FROM range(256) r(n)
  UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::bigint, c >> 1) ELSE c >> 1 END FROM k WHERE i < 8
), t AS (SELECT list(c ORDER BY n) AS t FROM k WHERE i = 8),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) AS x FROM conversations),
h AS (SELECT b.*, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint)), lambda a, v: xor(t[(xor(a, v) & 255) + 1], a >> 8))) % 20 AS d FROM b, t),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h, range(2) c(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role)::varchar || ':' || role || ':' || text)) AS i FROM g),
f AS (SELECT *, NOT regexp_matches(text, '[^ \\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
             NOT regexp_matches(text, '[.!?][ \\x09-\\x0D]*$') AS cut, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
m AS (SELECT conv_id, i, turn, role, text, blank, seen AND NOT blank AS duplicate, cut AND NOT seen AND NOT blank AS truncated, pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') AS illegal FROM f),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
             count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n FROM m GROUP BY conv_id),
v AS (SELECT conv_id, i, role, text, blank OR duplicate AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS extra, role[1] AS r FROM m),
-- a way: cost in ten digits and the audit, so that text order is the order of ways; and its lines
w(conv_id, i, e, l, u, p) AS (
  SELECT conv_id, 0::bigint, {'a': '0000000000', 't': []::varchar[]}, NULL::struct(a varchar, t varchar[]), {'a': '0000000005I', 't': ['user:']}, {'a': '0000000010II', 't': ['user:', 'assistant:']} FROM q
  UNION ALL
  SELECT conv_id, i, e, l, u2, list_min([p1, y(u2, 5, 'I', ['assistant:'])]) FROM (
    SELECT *, list_min([u1, y(e, 5, 'I', ['user:']), y(l, 5, 'I', ['user:']), y(p1, 5, 'I', ['user:'])]) AS u2 FROM (
      SELECT w.conv_id, v.i, y(w.e, 2, 'D', []) AS e,
             list_min([y(w.l, 2, 'D', []), CASE WHEN NOT gone AND r = 's' THEN y(w.e, extra, 'K', [role || ':' || text]) END]) AS l,
             list_min([y(w.u, 2, 'D', []), CASE WHEN NOT gone AND r = 'u' THEN y(list_min([w.e, w.l, w.p]), extra, 'K', [role || ':' || text])
                                                WHEN NOT gone THEN y(list_min([w.e, w.l, w.p]), extra + 1, 'R', ['user:' || text]) END]) AS u1,
             list_min([y(w.p, 2, 'D', []), CASE WHEN NOT gone AND r = 'a' THEN y(w.u, extra, 'K', [role || ':' || text])
                                                WHEN NOT gone THEN y(w.u, extra + 1, 'R', ['assistant:' || text]) END]) AS p1
      FROM w JOIN v ON v.i = w.i + 1 AND v.conv_id IS NOT DISTINCT FROM w.conv_id))
), z AS (SELECT w.conv_id, list_min([e, p]) AS best FROM w JOIN q ON w.i = q.n AND w.conv_id IS NOT DISTINCT FROM q.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.a[1:10]::bigint, 0) AS cost, coalesce(best.a[11:], '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN q ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""


def _sql_steps(sql: str) -> str:
    """``y(way, price, initial, lines)`` written out: DuckDB has no functions in a single statement."""
    while (at := sql.find("y(")) >= 0 and sql[at - 1] in " [(":
        depth, cuts, i = 0, [], at + 2
        while depth >= 0:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 0:
                cuts.append(i)
            i += 1
        way, price, own, lines = (sql[a + 1 : b].strip() for a, b in zip([at + 1, *cuts], [*cuts, i - 1]))
        made = f"CASE WHEN ({way}) IS NOT NULL THEN {{'a': lpad((({way}).a[1:10]::bigint + {price})::varchar, 10, '0') || ({way}).a[11:] || '{own[1:-1]}', 't': list_concat(({way}).t, {lines}::varchar[])}} END"
        sql = sql[:at] + made + sql[i:]
    return sql


REPAIR_SQL = _sql_steps(REPAIR_SQL)
