"""Permutation nulls over edges: values dealt anew by a keyed bijection.

A draw is arithmetic: node i of n gets the value of node p(i), where p is a Feistel network
on a grid of a x b >= n places, walked on until it falls below n. So nothing is sorted or
shuffled for a draw; edges stay where they are, each task counts for all draws and only the
counts meet. The values are a table of n numbers that every task holds, up to a bound;
beyond it positions are joined with the values.

Counts take up to HELD edges of a task at a time, so that draws are dealt once for all of
them; a node's values in the draws of a step lie side by side, and an edge compares two such rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scan import numbered, scan

#: Rounds of the network (that many for permutations of a few nodes too), and the modulus and multipliers of its rounds (products stay below 2^63).
ROUNDS, PRIME, M_PLACE, M_DRAW, M_ROUND, M_OFFSET, M_ONE, M_TWO = 12, 2147483647, 1103515245, 69069, 1597334677, 40503, 48271, 69621
#: Values that every task may hold (8 bytes each).
MOST_VALUES = 1 << 20
#: Numbers of one step in a task; edges that a task holds at most.
STEP, HELD = 1 << 20, 1 << 23
#: Places of a side of a tile (a multiple of 64), tiles of a side of a group that deals its values once; edges of a tile below which it is no table of bits; different values and tasks at most.
SIDE, GROUP, LEAST_EDGES, MOST_KINDS, MOST_TASKS = 4096, 6, 20_000, 64, 4096
#: Standard deviations around the expected cut among the lots within which edges are put in order.
SPREAD = 8


def bijection(i: np.ndarray, n: np.ndarray, offset: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """Place of ``i`` (from 0, below ``n``) in the permutation that ``draw``, ``offset`` and ``seed`` name; arrays of one shape, or broadcast."""
    i, n, offset, draw = (np.asarray(x, dtype=np.int64) for x in (i, n, offset, draw))
    if n.size and (n == n.flat[0]).all():
        n = n.ravel()[0]  # one number divides faster than as many as places
    wide = np.ceil(np.sqrt(n.astype(np.float64))).astype(np.int64)
    tall = -(-n // wide)
    key = draw % PRIME * M_DRAW + offset % PRIME * M_OFFSET + seed

    def rest(x, of):
        """x % of; the division is faster than the remainder."""
        return x - x // of * of

    def once(x, wide, tall, key):
        left, right = rest(x, wide), x // wide
        for r in range(1, ROUNDS + 1):
            y = rest(right * M_PLACE + (key + r * M_ROUND), PRIME)
            y = rest(y * (y + M_ONE), PRIME)
            y = rest(y * (y + M_TWO), PRIME)
            left, right = right, rest(left + y, wide if r % 2 else tall)
        return wide * right + left

    shape = np.broadcast_shapes(i.shape, n.shape, key.shape)
    at = np.array(np.broadcast_to(once(i, wide, tall, key), shape))
    while (out := at >= n).any():
        one = n.ndim == 0
        wides, talls = (wide, tall) if one else (np.broadcast_to(x, shape)[out] for x in (wide, tall))
        at[out] = once(at[out], wides, talls, np.broadcast_to(key, shape)[out])
    return at


def placed(nodes: DataFrame, group: str | None = None, seed: int = 42) -> DataFrame:
    """nodes (id, value, group) with i, their number within the group by id, n, the group's size, and offset, the nodes in groups before it."""
    own = nodes.select("id", "value", (F.col(group) if group else F.lit(0)).alias("g"))
    sizes = scan(own.groupBy("g").agg(F.count("*").alias("n")), [F.col("g")], before={"offset": F.col("n")})
    rows = numbered(own, [F.col("id")], "i", group=["g"])
    return rows.join(sizes, rows["g"].eqNullSafe(sizes["g"])).select("id", "value", "i", "n", "offset")


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one, two = (nodes.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("value", "i", "n", "offset"))) for k in "ab")
    return edges.select("a", "b").join(one, "a").join(two, "b")


def _batches(batches: Iterator[pd.DataFrame], times: int, seed: int, wanted: np.ndarray | None = None) -> Iterator[tuple[pd.DataFrame, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """Edges, draws and the places of both ends in each draw (draws x edges); draw 0 leaves all in place."""
    for edges in batches:
        if not len(edges):
            continue
        both = {c: np.concatenate([edges[f"{c}_a"], edges[f"{c}_b"]]).astype(np.int64) for c in ("i", "n", "offset")}
        place, back = np.unique(both["i"] + both["offset"], return_inverse=True)
        first = np.unique(back, return_index=True)[1]
        i, n, offset = (both[c][first] for c in ("i", "n", "offset"))
        step = max(1, STEP // max(len(place), len(edges)))
        every = np.arange(times + 1) if wanted is None else np.nonzero(wanted)[0]
        for low in range(0, len(every), step):
            draws = every[low : low + step]
            at = bijection(i, n, offset, draws[:, None], seed) + offset
            at[draws == 0] = place
            yield edges, draws, (at[:, back[: len(edges)]], at[:, back[len(edges) :]])


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches put together to HELD rows or a little more."""
    parts, n = [], 0
    for part in batches:
        parts.append(part)
        n += len(part)
        if n >= HELD:
            yield pd.concat(parts)
            parts, n = [], 0
    if n:
        yield pd.concat(parts)


def _held_ends(edges: pd.DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The places that edges end at, their i, n and offset, and both ends of each edge as numbers of these places."""
    both = {c: np.concatenate([edges[f"{c}_a"], edges[f"{c}_b"]]).astype(np.int64) for c in ("i", "n", "offset")}
    place, first, back = np.unique(both["i"] + both["offset"], return_index=True, return_inverse=True)
    return place, tuple(both[c][first] for c in ("i", "n", "offset")), back[: len(edges)], back[len(edges) :]


def _coded(values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray | None, float | np.int8]:
    """``values`` and ``least`` in a form that compares fast: whole numbers within a byte, whose null values are told by a mask, or as they are."""
    known = np.unique(values[~np.isnan(values)])
    whole = len(known) > 0 and least > 0 and (known == np.round(known)).all() and known[-1] - known[0] < 127
    coded = np.where(np.isnan(values), 0, values - known[0]).astype(np.int8) if whole else values
    return coded, np.isnan(values) if np.isnan(values).any() else None, np.int8(min(127, np.ceil(least))) if whole else least


def far_counts(edges: pd.DataFrame, values: np.ndarray, least: float, times: int, seed: int) -> np.ndarray:
    """For each draw from 0 to ``times`` the number of ``edges`` whose ends differ by ``least`` or more. ``values``: by place.

    Where few different values lie close enough together to be told by their numbers, numbers
    of a byte stand for them; others are compared as they are.
    """
    place, ends, one, two = _held_ends(edges)
    i, n, offset = (c[:, None] for c in ends)
    one, two = one.astype(np.int32), two.astype(np.int32)
    order = np.lexsort((two, one))  # near rows together
    one, two = one[order], two[order]
    coded, nulls, least = _coded(values, least)
    counts, step = np.zeros(times + 1, dtype=np.int64), int(max(1, min(512, STEP * 8 // max(1, len(place)))))
    for low in range(0, times + 1, step):
        draws = np.arange(low, min(low + step, times + 1))
        at = np.empty((len(place), len(draws)), dtype=np.int64)
        for p in range(0, len(place), lines := max(1, STEP // (8 * len(draws)))):
            own = slice(p, p + lines)
            at[own] = bijection(i[own], n[own], offset[own], draws[None, :], seed) + offset[own]
        if low == 0:
            at[:, 0] = place
        dealt, none = coded[at], None if nulls is None else nulls[at]
        for e in range(0, len(one), 255):  # as many as a byte counts
            a, b = one[e : e + 255], two[e : e + 255]
            far = np.abs(dealt[a] - dealt[b]) >= least
            if none is not None:
                far &= ~(none[a] | none[b])
            counts[draws] += far.sum(axis=0, dtype=np.uint8)
    return counts


def _values(nodes: DataFrame):
    """Values by place and the place of each among all ids, broadcast; None if they are more than MOST_VALUES."""
    if nodes.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        return None
    rows = nodes.select("id", (F.col("i") + F.col("offset")).alias("at"), F.col("value").cast("double").alias("value")).toPandas()
    table, rank = np.full(len(rows), np.nan), np.empty(len(rows), dtype=np.int64)
    table[rows["at"].to_numpy()] = rows["value"].to_numpy()
    rank[rows.sort_values("id", kind="stable")["at"].to_numpy()] = np.arange(len(rows))
    return nodes.sparkSession.sparkContext.broadcast((table, rank))


def _dealt(nodes: DataFrame, met: DataFrame, times: int, seed: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(rep, a, b, at_a, at_b, delta) by joining places with values, for tables of any size."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for edges, draws, (one, two) in _batches(batches, times, seed, wanted):
            yield pd.DataFrame({"rep": np.repeat(draws, len(edges)), "a": np.tile(edges["a"], len(draws)), "b": np.tile(edges["b"], len(draws)), "pa": one.ravel(), "pb": two.ravel(), **{f"at_{k}": np.tile(edges[f"i_{k}"] + edges[f"offset_{k}"], len(draws)) for k in "ab"}})

    kinds = dict(met.dtypes)
    rows = met.mapInPandas(places, f"rep int, a {kinds['a']}, b {kinds['b']}, pa long, pb long, at_a long, at_b long")
    one, two = (nodes.select((F.col("i") + F.col("offset")).alias(f"p{k}"), F.col("value").alias(f"v_{k}")) for k in "ab")
    return rows.join(one, "pa").join(two, "pb").select("rep", "a", "b", "at_a", "at_b", F.abs(F.col("v_a") - F.col("v_b")).alias("delta"))


def permutation_null(nodes: DataFrame, edges: DataFrame, least: float, times: int, group: str | None = None, seed: int = 42) -> DataFrame:
    """(rep, n): edges whose ends differ by ``least`` or more after the values were dealt anew; replicate 0 is the observed one.

    nodes: id, value and, for a constrained null, the group within which values stay; edges:
    a, b. A difference with a null value is none.
    """
    nodes = placed(nodes, group, seed)
    return _null(nodes, _ends(nodes, edges), _values(nodes), least, times, seed)


def _tiles(met: DataFrame, size: int, side: int, group: int) -> DataFrame:
    """Edges as tiles of a symmetric table of bits: gx, gy (the tiles' group), x, y, bits (a row of ``side`` bits for each place of block x; none if there are few edges), rest (edges beyond, as pairs of places within the blocks)."""
    blocks = -(-size // side)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, rest = {}, {}
        for edges in batches:
            low, high = edges["low"].to_numpy(), edges["high"].to_numpy()
            tile = low // side * blocks + high // side
            for t in np.unique(tile):
                own = tile == t
                keys, k = np.unique(low[own] % side * side + high[own] % side, return_counts=True)
                seen = tables.setdefault(t, np.zeros(side * side, dtype=bool))
                again = np.repeat(keys, k - 1 + seen[keys])  # edges that occur several times
                seen[keys] = True
                rest.setdefault(t, []).append(again)
        for t in list(tables):
            seen, more = tables.pop(t), rest.pop(t)
            few = (n := np.flatnonzero(seen)).size < LEAST_EDGES
            bits = None if few else np.packbits(seen, bitorder="little").tobytes()
            x, y = divmod(int(t), blocks)
            yield pd.DataFrame([(x // group, y // group, x, y, bits, np.concatenate([n if few else n[:0], *more]).astype(np.int32).tobytes())], columns=["gx", "gy", "x", "y", "bits", "rest"])

    one, two = (F.col(f"i_{k}") + F.col(f"offset_{k}") for k in "ab")
    edges = met.select(F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    tile = F.floor(F.col("low") / side) * blocks + F.floor(F.col("high") / side)
    return edges.repartition(min(blocks * (blocks + 1) // 2, MOST_TASKS), tile).mapInPandas(build, "gx int, gy int, x int, y int, bits binary, rest binary")


def tile_counts(tiles: pd.DataFrame, codes: np.ndarray, far: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, draws: np.ndarray, seed: int, side: int) -> np.ndarray:
    """For each of ``draws`` the number of edges of ``tiles`` whose ends are far apart.

    codes: the value's number by place; far: whether two numbers are far apart; sizes, offsets: of the group of each place. A row of a
    tile is met with the bits of all places of the other block that are far from the row's value.
    """
    counts, lanes = np.zeros(len(draws), dtype=np.int64), np.uint64(0x00FF00FF00FF00FF)
    none, words, lines = len(far) - 1, side // 64, min(side, 1024)
    met, ones = np.empty((lines, words), dtype=np.uint64), np.empty((lines, words), dtype=np.uint8)
    tables = [None if b is None else np.frombuffer(b, dtype=np.uint64).reshape(side, words) for b in tiles["bits"]]
    rests = [np.divmod(np.frombuffer(b, dtype=np.int32), side) for b in tiles["rest"]]
    blocks = sorted({*tiles["x"], *tiles["y"]})
    columns = sorted({y for y, t in zip(tiles["y"], tables) if t is not None})
    step = max(1, STEP * 4 // (len(blocks) * side))
    for first in range(0, len(draws), step):
        own = draws[first : first + step]
        dealt = {}
        for b in blocks:
            place = np.arange(b * side, min((b + 1) * side, len(codes)))
            made = np.full((len(own), side), none, dtype=np.uint8)
            for low in range(0, len(place), several := max(1, STEP // 32 // len(own))):
                p = place[low : low + several, None]
                at = bijection(p - offsets[p], sizes[p], offsets[p], own[None, :], seed) + offsets[p]
                at[:, own == 0] = p
                made[:, low : low + len(p)] = codes[at].T
            dealt[b] = made
        for k in range(len(own)):
            n, masks = 0, {}
            for y in columns:
                masks[y] = np.packbits(np.take(far, dealt[y][k], axis=1), axis=1, bitorder="little").view(np.uint64)
            for x, y, bits, (a, b) in zip(tiles["x"], tiles["y"], tables, rests):
                row = dealt[x][k]
                if bits is not None:
                    for low in range(0, side, lines):
                        np.take(masks[y], row[low : low + lines], axis=0, out=met[: side - low], mode="clip")
                        np.bitwise_and(met, bits[low : low + lines], out=met)
                        np.bitwise_count(met, out=ones)
                        # eight counts of up to 64 lie in a word; pairs of them are summed by lane, over 128 words at most
                        eight = ones.ravel().view(np.uint64)
                        n += int(np.add.reduceat((eight & lanes) + ((eight >> np.uint64(8)) & lanes), np.arange(0, len(eight), 128)).view(np.uint16).sum(dtype=np.int64))
                if len(a):
                    n += int(np.count_nonzero(far[row[a], dealt[y][k][b]]))
            counts[first + k] = n
    return counts


def _kinds(values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """The number of each value, and which two numbers are far apart (the last one is of null and far from none); None if there are too many."""
    known = np.unique(values[~np.isnan(values)])
    if not 0 < len(known) <= MOST_KINDS:
        return None
    far = np.zeros((len(known) + 1, len(known) + 1), dtype=bool)
    far[:-1, :-1] = np.abs(known[:, None] - known[None, :]) >= least
    return np.where(np.isnan(values), len(known), np.searchsorted(known, values)).astype(np.uint8), far


def _tiled_null(nodes: DataFrame, met: DataFrame, kinds, least: float, times: int, seed: int) -> DataFrame:
    """(rep, n) from tiles: a task takes one group of tiles and one part of the draws, so that values are dealt once for the whole group."""
    spark, side, group = nodes.sparkSession, SIDE, GROUP
    places = nodes.select((F.col("i") + F.col("offset")).alias("at"), "n", "offset").toPandas().sort_values("at")
    held = spark.sparkContext.broadcast((*kinds, places["n"].to_numpy().astype(np.int64), places["offset"].to_numpy().astype(np.int64)))
    blocks = -(-len(places) // side)
    groups = (-(-blocks // group)) * (-(-blocks // group) + 1) // 2
    parts = max(1, -(-spark.sparkContext.defaultParallelism * 5 // groups))

    def count(key: tuple, tiles: pd.DataFrame) -> pd.DataFrame:
        draws = np.arange(key[2], times + 1, parts)
        codes, far, sizes, offsets = held.value
        return pd.DataFrame({"rep": draws, "n": tile_counts(tiles, codes, far, sizes, offsets, draws, seed, side)})

    tiles = _tiles(met, len(places), side, group).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # one task for each group and part
    at = (F.col("gy") * (F.col("gy") + 1) / 2 + F.col("gx")).cast("int") * parts + F.col("part")
    return tiles.repartitionById(groups * parts, at).groupBy("gx", "gy", "part").applyInPandas(count, "rep int, n long")


def _null(nodes: DataFrame, met: DataFrame, table, least: float, times: int, seed: int) -> DataFrame:
    if table is None:
        return _dealt(nodes, met, times, seed).groupBy("rep").agg(F.count_if(F.col("delta") >= least).alias("n"))
    every = nodes.sparkSession.range(times + 1).select(F.col("id").cast("int").alias("rep"), F.lit(0).cast("long").alias("n"))
    if (kinds := _kinds(table.value[0], least)) is not None:
        return _tiled_null(nodes, met, kinds, least, times, seed).unionByName(every).groupBy("rep").agg(F.sum("n").alias("n"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(times + 1, dtype=np.int64)
        for edges in _held(batches):
            own += far_counts(edges, table.value[0], least, times, seed)
        yield pd.DataFrame({"rep": np.arange(times + 1), "n": own})

    counts = _gathered(met).mapInPandas(count, "rep int, n long")
    return counts.unionByName(every).groupBy("rep").agg(F.sum("n").alias("n"))


def _gathered(met: DataFrame) -> DataFrame:
    """Edges without their ids, in as many tasks as run at once."""
    return met.select(*(f"{c}_{k}" for k in "ab" for c in ("i", "n", "offset"))).coalesce(met.sparkSession.sparkContext.defaultParallelism)


def _lots(rep, one, two, seed: int):
    """A lot by which chance orders the edges of a draw, from the places of their ends; for numbers and columns."""
    y = (one * M_PLACE + two * M_DRAW + rep * M_ROUND + seed) % PRIME
    y = (y * y + M_ONE * y) % PRIME
    return (y * y + M_TWO * y) % PRIME


def _far_edges(nodes: DataFrame, met: DataFrame, table, least: float, times: int, seed: int, only: list[int]) -> DataFrame:
    """(rep, a, b, lot): edges that differ by ``least`` or more in each of the replicates ``only``, with a lot that orders them by chance (0 in the observed one)."""
    wanted = np.isin(np.arange(times + 1), only)
    if table is None:
        rows = _dealt(nodes, met, times, seed, wanted).filter(F.col("delta") >= least)
        mark = _lots(F.col("rep").cast("long"), F.col("at_a"), F.col("at_b"), seed)
        return rows.select("rep", "a", "b", F.when(F.col("rep") > 0, mark).otherwise(0).alias("lot"))

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for edges, draws, (one, two) in _batches(batches, times, seed, wanted):
            values = table.value[0]
            rep, k = np.nonzero(np.abs(values[one] - values[two]) >= least)
            own = edges.iloc[k]
            rep = draws[rep]
            lot = np.where(rep > 0, _lots(rep, (own["i_a"] + own["offset_a"]).to_numpy(), (own["i_b"] + own["offset_b"]).to_numpy(), seed), 0)
            yield pd.DataFrame({"rep": rep, "a": own["a"].to_numpy(), "b": own["b"].to_numpy(), "lot": lot})

    kinds = dict(met.dtypes)
    return met.select("a", "b", *(f"{c}_{k}" for k in "ab" for c in ("i", "n", "offset"))).mapInPandas(far, f"rep int, a {kinds['a']}, b {kinds['b']}, lot long")


def lot_bounds(n: int, wanted: int, spread: float) -> tuple[int, int]:
    """Lots below the first number are most likely among the ``wanted`` smallest of ``n``, those from the second on most likely not."""
    if n == wanted:
        return PRIME, PRIME
    share = wanted / n
    wide = (spread * np.sqrt(n * share * (1 - share)) + spread) * PRIME / n
    return max(0, int(share * PRIME - wide)), min(PRIME, int(share * PRIME + wide) + 1)


def hub_rows(edges: pd.DataFrame, values: np.ndarray, least: float, counts: np.ndarray, seed: int, spread: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each draw with ``counts[0]`` differing edges or more: the draw, how many of ``edges`` are surely taken, their ends by place, and (lot, place, place) of those that may be.

    ``counts``: the differing edges of all in each draw.
    """
    place, (i, n, offset), one, two = _held_ends(edges)
    coded, nulls, least = _coded(values, least)
    base = (place[one] * M_PLACE + place[two] * M_DRAW + seed) % PRIME
    draws, step = np.nonzero(counts >= counts[0])[0], int(max(1, STEP // len(place)))
    for first in range(0, len(draws), step):
        own = draws[first : first + step]
        at = bijection(i[None, :], n[None, :], offset[None, :], own[:, None], seed) + offset
        at[own == 0] = place
        for rep, dealt in zip(own, at):
            v = coded[dealt]
            far = np.abs(v[one] - v[two]) >= least
            if nulls is not None:
                none = nulls[dealt]
                far &= ~(none[one] | none[two])
            k = np.flatnonzero(far)
            low, high = lot_bounds(counts[rep], counts[0], spread)
            open_ = np.empty((3, 0), dtype=np.int64)
            if low < PRIME:
                lot = base[k] + rep * M_ROUND
                for m in (M_ONE, M_TWO):
                    lot -= lot // PRIME * PRIME
                    lot *= lot + m
                lot -= lot // PRIME * PRIME
                near = np.flatnonzero((lot >= low) & (lot < high))
                open_ = np.stack([lot[near], place[one[k[near]]], place[two[k[near]]]])
                k = k[lot < low]
            degrees = np.zeros(len(values), dtype=np.int64)
            degrees[place] = np.bincount(one[k], minlength=len(place)) + np.bincount(two[k], minlength=len(place))
            yield int(rep), len(k), degrees, open_


def _hub_shares(met: DataFrame, table, least: float, counts: np.ndarray, hubs: int, seed: int, spread: float) -> DataFrame:
    """(rep, n) of ``hub_null`` for draws with enough differing edges; n is null where the bounds of the lots did not hold the cut.

    A task counts the ends of the edges that are surely taken; a draw's counts (one for each
    node, at most MOST_VALUES) and the few edges near the cut come together. Edges that meet a hub
    are its ends, less those between two hubs, which are looked up.
    """
    wanted = int(counts[0])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for edges in _held(batches):
            for rep, sure, degrees, open_ in hub_rows(edges, table.value[0], least, counts, seed, spread):
                rows.append((rep, sure, degrees.astype(np.min_scalar_type(degrees.max(initial=0))).tobytes(), open_.tobytes()))
                held += len(rows[-1][2]) + len(rows[-1][3])
                if held > STEP * 8:
                    yield pd.DataFrame(rows, columns=["rep", "sure", "degrees", "open"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["rep", "sure", "degrees", "open"])

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        values, rank = table.value
        rep, degrees = int(rows["rep"].iloc[0]), np.zeros(len(values), dtype=np.int64)
        for own in rows["degrees"]:
            degrees += np.frombuffer(own, dtype=f"u{len(own) // len(values)}")
        lot, one, two = np.concatenate([np.frombuffer(own, dtype=np.int64).reshape(3, -1) for own in rows["open"]], axis=1)
        more = wanted - int(rows["sure"].sum())
        if not 0 <= more <= len(lot):
            return pd.DataFrame([(rep, None, -1, -1, -1, 0, [], [])], columns=names)  # sought by rows
        taken = np.lexsort((rank[two], rank[one], lot))[:more]
        np.add.at(degrees, np.concatenate([one[taken], two[taken]]), 1)
        cut = (lot_bounds(counts[rep], wanted, spread)[0], -1, -1, 0)
        if more:  # the last one taken and how many like it are (edges that occur several times)
            keys = np.stack([lot[taken], rank[one[taken]], rank[two[taken]]])
            cut = (*keys[:, -1].tolist(), int((keys == keys[:, -1:]).all(axis=0).sum()))
        top = np.lexsort((rank, -degrees))[:hubs]
        top = np.sort(top[degrees[top] > 0])
        low, high = (top[x] for x in np.triu_indices(len(top)))
        return pd.DataFrame([(rep, int(degrees[top].sum()), *cut, low.tolist(), high.tolist())], columns=names)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, rank = table.value
        for rows in batches:
            rep = rows["rep"].to_numpy().astype(np.int64)
            places = [(rows[f"i_{k}"] + rows[f"offset_{k}"]).to_numpy() for k in "ab"]
            dealt = [np.where(rep > 0, bijection(*(rows[f"{c}_{k}"].to_numpy() for c in ("i", "n", "offset")), rep, seed) + rows[f"offset_{k}"].to_numpy(), p) for k, p in zip("ab", places)]
            lot = np.where(rep > 0, _lots(rep, *places, seed), 0)
            one, two = (rank[p] for p in places)
            c, x, y = (rows[k].to_numpy() for k in ("cut", "cut_a", "cut_b"))
            last = (lot == c) & (one == x) & (two == y)
            own = last | (lot < c) | ((lot == c) & ((one < x) | ((one == x) & (two < y))))
            own &= np.abs(values[dealt[0]] - values[dealt[1]]) >= least
            yield pd.DataFrame({"rep": rep[own], "last": last[own]})

    names = ["rep", "ends", "cut", "cut_a", "cut_b", "cut_n", "low", "high"]
    made = _gathered(met).mapInPandas(count, "rep int, sure long, degrees binary, open binary")
    made = made.groupBy("rep").applyInPandas(pick, "rep int, ends long, cut long, cut_a long, cut_b long, cut_n long, low array<long>, high array<long>")
    picked = met.sparkSession.createDataFrame(made.toArrow())  # a row for each replicate
    pairs = picked.select("rep", "cut", "cut_a", "cut_b", F.explode(F.arrays_zip("low", "high")).alias("p")).select("rep", "cut", "cut_a", "cut_b", "p.*")
    one, two = (F.col(f"i_{k}") + F.col(f"offset_{k}") for k in "ab")
    inner = met.withColumns({"low": F.least(one, two), "high": F.greatest(one, two)}).join(F.broadcast(pairs), ["low", "high"])
    inner = inner.select("rep", "cut", "cut_a", "cut_b", *(f"{c}_{k}" for k in "ab" for c in ("i", "n", "offset"))).mapInPandas(taken, "rep int, last boolean")
    inner = inner.groupBy("rep").agg(F.count_if(~F.col("last")).alias("before"), F.count_if("last").alias("last"))
    between = F.coalesce(F.col("before") + F.least("last", "cut_n"), F.lit(0))
    return picked.join(inner, "rep", "left").select("rep", ((F.col("ends") - between) / F.lit(wanted)).alias("n"))


def _hub_shares_by_rows(far: DataFrame, wanted: int, hubs: int) -> DataFrame:
    order = Window.partitionBy("rep").orderBy("lot", "a", "b")
    far = far.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= wanted).select("rep", "a", "b")
    ends = far.select("rep", F.explode(F.array("a", "b")).alias("node")).groupBy("rep", "node").agg(F.count("*").alias("k"))
    top = ends.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("k"), "node"))).filter(F.col("i") <= hubs)
    top = top.groupBy("rep").agg(F.collect_list("node").alias("hubs"))  # a few nodes each
    hit = F.array_contains("hubs", F.col("a")) | F.array_contains("hubs", F.col("b"))
    return far.join(top, "rep").groupBy("rep").agg((F.count_if(hit) / F.count("*")).alias("n"))


def hub_null(nodes: DataFrame, edges: DataFrame, least: float, times: int, hubs: int = 4, group: str | None = None, seed: int = 42, spread: float = SPREAD) -> DataFrame:
    """(rep, n): share of edges that differ by ``least`` or more and meet one of the ``hubs`` nodes of highest degree among them (ties: smallest id).

    Each replicate has as many such edges as the observed one, drawn by lot; those with fewer are left out.
    """
    nodes = placed(nodes, group, seed)
    met, table = _ends(nodes, edges), _values(nodes)
    counts = np.zeros(times + 1, dtype=np.int64)
    for r in _null(nodes, met, table, least, times, seed).collect():  # a number for each replicate
        counts[r["rep"]] = r["n"]
    wanted, only = int(counts[0]), np.nonzero(counts >= counts[0])[0].tolist()
    by_rows = lambda only: _hub_shares_by_rows(_far_edges(nodes, met, table, least, times, seed, only), wanted, hubs)
    if table is None or not wanted:
        return by_rows(only)
    rows = _hub_shares(met, table, least, counts, hubs, seed, spread).collect()  # a number for each replicate
    missed = [r["rep"] for r in rows if r["n"] is None]
    made = nodes.sparkSession.createDataFrame([(r["rep"], r["n"]) for r in rows if r["n"] is not None], "rep int, n double")
    return made.unionByName(by_rows(missed)) if missed else made


def empirical(null: DataFrame, smooth: bool = True) -> DataFrame:
    """One row of a null (rep, n): observed, mean, sd (population), z, fold, and the share of draws at or above (p) and at or below (p_low) the observed, with or without the +1."""
    drawn = F.col("rep") > 0
    one = 1 if smooth else 0
    seen = F.max(F.when(~drawn, F.col("n"))).over(Window.partitionBy(F.lit(0)))  # a row for each replicate
    made = null.withColumn("observed", seen).filter(drawn).agg(
        F.max("observed").alias("observed"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count("*").alias("times"),
        F.count_if(F.col("n") >= F.col("observed")).alias("above"), F.count_if(F.col("n") <= F.col("observed")).alias("below"),
    )
    share = lambda k: (F.col(k) + one) / (F.col("times") + one)
    return made.select("observed", "mean", "sd", "times", F.when(F.col("sd") > 0, (F.col("observed") - F.col("mean")) / F.col("sd")).alias("z"), F.when(F.col("mean") > 0, F.col("observed") / F.col("mean")).alias("fold"), share("above").alias("p"), share("below").alias("p_low"))
