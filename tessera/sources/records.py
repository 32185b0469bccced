"""Records of delimited files that span lines, read from splittable line scans."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The inside of a quoted field, and fields that end on their line; a quote counts at the start of a field only.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_CLOSED = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'


def _ends_inside(value: Column, inside: bool) -> Column:
    """Whether a line ends within a quoted field, if it begins ``inside`` one or not."""
    if inside:
        return value.rlike(rf'^{_INSIDE}(?:"[^,]*+(?:,{_CLOSED}(?=,))*+,"{_INSIDE})?$')
    return value.rlike(rf'^(?:{_CLOSED},)*+"{_INSIDE}$')


def _states(out: np.ndarray, within: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line ends within a quoted field, if the first one begins ``inside`` one; ``out``, ``within``: the same for a line that begins outside and inside."""
    turns = np.cumsum(out & ~within)
    last = np.maximum.accumulate(np.where(out == within, np.arange(len(out)), -1))  # the last line that sets the state
    since = np.where(last >= 0, turns[last], 0)
    return np.where(last >= 0, out[last], inside) ^ ((turns - since) % 2 > 0)


def _block_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block the states it leaves behind if it begins outside and inside a quoted field, the line that ends the record it begins inside of, and for both the line at which the record that is open at its end begins (-1: none)."""
    columns = ["_path", "_block", "_outside", "_inside", "_closed", "_open_out", "_open_in"]
    at, states, closed, opened = None, [False, True], -1, [-1, -1]
    for rows in batches:
        made = []
        path, block, line, out, within = (rows[c].to_numpy() for c in ("_path", "_block", "_line", "_out", "_in"))
        new = np.flatnonzero((block[1:] != block[:-1]) | (path[1:] != path[:-1])) + 1
        for low, high in itertools.pairwise([0, *new, len(rows)] if len(rows) else []):
            if (path[low], block[low]) != at:
                if at:
                    made.append((*at, *states, closed, *opened))
                at, states, closed, opened = (path[low], block[low]), [False, True], -1, [-1, -1]
            for k in (0, 1):
                after = _states(out[low:high], within[low:high], states[k])
                begins = np.flatnonzero(~np.concatenate([[states[k]], after[:-1]]))
                if k and closed < 0 and not after.all():
                    closed = line[low + after.argmin()]
                if not after[-1]:
                    opened[k] = -1
                elif len(begins):
                    opened[k] = line[low + begins[-1]]
                states[k] = bool(after[-1])
        yield pd.DataFrame(made, columns=columns)
    if at:
        yield pd.DataFrame([(*at, *states, closed, *opened)], columns=columns)


def _block_begins(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one file with their numbers, the number of the block in which the record began that a block begins inside of, the last line of that record here and the first one of the record that is open at the end."""
    made, inside, since, most = [], False, -1, np.iinfo(np.int64).max
    for n, (path, block, out, within, closed, open_out, open_in) in enumerate(blocks.sort_values("_block").itertuples(index=False, name=None)):
        opened = open_in if inside else open_out
        made.append((path, block, n, since, (closed if closed >= 0 else most) if inside else -1, opened if opened >= 0 else most))
        since = n if opened >= 0 else since
        inside = within if inside else out
    return pd.DataFrame(made, columns=["_path", "_block", "_number", "_since", "_head", "_tail"])


def join_broken_lines(lines: DataFrame, joint: str = "") -> DataFrame:
    """``lines`` with the lines of one record joined, at the first of them.

    lines: _path, _block (a number for each stretch of a file that one task reads), _line
    (a number that orders a stretch's lines), value; other columns are those of the first
    line. Lines come in the order in which they were read, as no shuffle lies between. A line
    takes the state (within a quoted field or not) to another one: it keeps it, turns it or
    sets it. Each block is read once for the state it leaves behind for both states it may
    begin with; these are composed over the blocks of a file. Then each task joins the lines of records within a
    block, so that lines stay where they are; only the lines of records that go on in another block
    meet. Files without a line that may open a field take no part.
    """
    marked = lines.withColumn("_out", _ends_inside(F.col("value"), False))
    paths = [(r["_path"], r["_any"]) for r in marked.groupBy("_path").agg(F.bool_or("_out").alias("_any")).collect()]  # a row for each file
    broken = [(path,) for path, any_ in paths if any_]
    if not broken:
        return lines
    listed = F.broadcast(lines.sparkSession.createDataFrame(broken, "_path string"))
    rows = marked.join(listed, "_path", "left_semi").withColumn("_in", _ends_inside(F.col("value"), True))
    blocks = rows.select("_path", "_block", "_line", "_out", "_in").mapInPandas(_block_ends, "_path string, _block long, _outside boolean, _inside boolean, _closed long, _open_out long, _open_in long")
    blocks = blocks.groupBy("_path").applyInPandas(_block_begins, "_path string, _block long, _number int, _since int, _head long, _tail long").collect()  # a row for each block of a file
    known = F.broadcast(lines.sparkSession.createDataFrame(blocks, "_path string, _block long, _number int, _since int, _head long, _tail long"))
    head, tail = F.col("_line") <= F.col("_head"), F.col("_line") >= F.col("_tail")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the lines of a record that goes on in the next batch
        for batch in batches:
            own = batch if held is None else pd.concat([held, batch])
            if not len(own):
                continue
            after = _states(own["_out"].to_numpy(dtype=bool), own["_in"].to_numpy(dtype=bool), False)
            before = np.concatenate([[False], after[:-1]])
            begins = np.flatnonzero(~before)
            end = begins[-1] if after[-1] else len(own)
            own, held, begins = own.iloc[:end], own.iloc[end:] if after[-1] else None, begins[begins < end]
            if len(begins):
                value = own["value"].to_numpy(dtype=object, copy=True)
                value[before[:end]] = joint + value[before[:end]]
                yield own.iloc[begins].drop(columns=["_out", "_in"]).assign(value=np.add.reduceat(value, begins))

    placed = rows.join(known, ["_path", "_block"])
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in lines.dtypes)
    whole = placed.filter(~head & ~tail).select(*lines.columns, "_out", "_in").mapInPandas(join, kinds)
    names = ["_block", "_line", *(c for c in lines.columns if c not in ("_path", "_block", "_line"))]
    pieces = placed.filter(head | tail).groupBy("_path", F.when(head, F.col("_since")).otherwise(F.col("_number")).alias("_of")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("p"))
    value = F.array_join(F.transform("p", lambda x: x["value"]), joint).alias("value")
    pieces = pieces.select(*(F.col(c) if c == "_path" else value if c == "value" else F.col("p")[0][c].alias(c) for c in lines.columns))
    made = whole.unionByName(pieces)
    return made if len(broken) == len(paths) else made.unionByName(lines.join(listed, "_path", "left_anti"))
