"""Small labelled graphs as tables: environment fingerprints, ring systems with linkers, common parts.

nodes: graph, node, label; edges: graph, a, b, label (undirected, each once). All steps are
joins and aggregates keyed by graph and node, so any number of graphs of any size will do; a
step along the edges is one exchange of messages.

Graphs of up to ROW_SIZE nodes are rows of arrays (``packed``) where all of a graph is
wanted, so that no step moves them; larger ones go by the rounds over tables.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.sources.files import scratch

#: Nodes of a graph that is one row at most; edges are each once, so they are under half its square.
ROW_SIZE = 32


def directed(edges: DataFrame) -> DataFrame:
    """(graph, node, other, bond): a row for each end of each edge."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    return edges.select("graph", F.col("label").alias("bond"), F.explode(ends).alias("e")).select("graph", "e.node", "e.other", "bond")


def by_size(nodes: DataFrame, edges: DataFrame) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Nodes and edges of the graphs that are rows, and of those that are too large for it (None: there are none).

    The sizes are counted first, so that no large graph is put together.
    """
    large = nodes.groupBy("graph").count().filter(F.col("count") > ROW_SIZE).select("graph")
    if large.isEmpty():
        return (nodes, edges), None
    folder = scratch(nodes.sparkSession, "large")
    large.write.parquet(folder)
    large = nodes.sparkSession.read.schema(large.schema).parquet(folder)
    small, rest = (tuple(df.join(large, "graph", how) for df in (nodes, edges)) for how in ("left_anti", "left_semi"))
    return small, rest


def packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, label, a, b, bond): a row for each graph, its nodes in order and its edges as arrays."""
    own = nodes.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("v"))
    bonds = edges.groupBy("graph").agg(F.collect_list(F.struct("a", "b", F.col("label").alias("bond"))).alias("e"))
    rows = own.join(bonds.hint("merge"), "graph", "left")  # both lie by graph; no broadcast by the size of the items' file
    return rows.select("graph", "v.node", "v.label", *(F.coalesce(f"e.{c}", F.array()).alias(c) for c in ("a", "b", "bond")))


def each_row(made: Callable, kind: str) -> Column:
    """Struct ``kind`` of what ``made`` gives for a graph's lists node, label, a, b and bond."""

    @F.pandas_udf(kind)
    def rows(node: pd.Series, label: pd.Series, a: pd.Series, b: pd.Series, bond: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([made(*(x.tolist() for x in g)) for g in zip(node, label, a, b, bond)], columns=[c.split()[0] for c in kind.split(", ")])

    return rows("node", "label", "a", "b", "bond")


@lru_cache(1 << 16)
def _md5(text: str | None) -> str | None:
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


def row_ends(node: list, a: list, b: list, bond: list) -> list[list[tuple]]:
    """For each node its bonds: (bond, place of the other end; -1: not among the nodes)."""
    place, ends = {v: i for i, v in enumerate(node)}, [[] for _ in node]
    for x, y, label in zip(a, b, bond):
        i, j = place.get(x, -1), place.get(y, -1)
        for at, to in ((i, j), (j, i)):
            if at >= 0:
                ends[at].append((label, to))
    return ends


def row_codes(label: list, ends: list, radius: int) -> list[list]:
    """The codes of ``environments`` for a row: a list for each radius from 0."""
    every = [[_md5(x) for x in label]]
    for _ in range(radius):
        last = every[-1]
        heard = ("|".join(sorted(f"{x}:{last[j]}" for x, j in own if j >= 0 and x is not None and last[j] is not None)) for own in ends)
        every.append([None if c is None else _md5(f"{c}({h})") for c, h in zip(last, heard)])
    return every


def row_key(codes: list) -> str:
    return _md5("|".join(sorted(c for c in codes if c is not None)))


def row_core(a: list, b: list) -> list[int]:
    """Places of the edges that the two-core keeps."""
    left = list(range(len(a)))
    while True:
        degree = Counter(v for i in left for v in (a[i], b[i]))
        kept = [i for i in left if degree[a[i]] > 1 and degree[b[i]] > 1]
        if len(kept) == len(left):
            return left
        left = kept


def row_least(ends: list) -> list[int]:
    """For each node the first place that it hangs together with."""
    least = [-1] * len(ends)
    for i in range(len(ends)):
        todo = [i] if least[i] < 0 else []
        while todo:
            v = todo.pop()
            if least[v] < 0:
                least[v] = i
                todo += [j for _, j in ends[v] if j >= 0 and least[j] < 0]
    return least


def environments(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """(graph, node, code0, ..., code<radius>): a digest of what lies around a node within each radius.

    Each round joins a node's code with the sorted bonds and codes of its neighbours
    (Weisfeiler-Lehman), so that equal surroundings have equal codes in every graph.
    """
    ends = directed(edges)
    codes = nodes.select("graph", "node", F.md5("label").alias("code0"))
    for r in range(1, radius + 1):
        last = f"code{r - 1}"
        told = ends.join(codes.select("graph", F.col("node").alias("other"), last), ["graph", "other"])
        heard = told.groupBy("graph", "node").agg(F.array_join(F.sort_array(F.collect_list(F.concat("bond", F.lit(":"), last))), "|").alias("heard"))
        codes = codes.join(heard, ["graph", "node"], "left")
        codes = codes.withColumn(f"code{r}", F.md5(F.concat(last, F.lit("("), F.coalesce("heard", F.lit("")), F.lit(")")))).drop("heard")
    return codes


def fingerprints(codes: DataFrame, radius: int) -> DataFrame:
    """(graph, features): the distinct codes of a graph at all radii, for ``set_pairs`` and digests."""
    every = codes.select("graph", F.explode(F.array(*(f"code{r}" for r in range(radius + 1)))).alias("code"))
    return every.groupBy("graph").agg(F.collect_set("code").alias("features"))


def graph_features(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """As ``fingerprints`` of ``environments``."""
    (nodes, edges), rest = by_size(nodes, edges)
    kept = each_row(lambda node, label, a, b, bond: (sorted({c for codes in row_codes(label, row_ends(node, a, b, bond), radius) for c in codes if c is not None}),), "features array<string>")
    made = packed(nodes, edges).select("graph", kept["features"].alias("features"))
    return made if rest is None else made.unionByName(fingerprints(environments(*rest, radius), radius))


def ring_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, t): the nodes of each graph in order, as node, label and ring, whether it is in the two-core."""
    (nodes, edges), rest = by_size(nodes, edges)

    def rings(node, label, a, b, bond):
        held = {v for i in row_core(a, b) for v in (a[i], b[i])}
        return ([v in held for v in node],)

    made = packed(nodes, edges).withColumn("ring", each_row(rings, "ring array<boolean>")["ring"])
    made = made.select("graph", F.arrays_zip("node", "label", "ring").alias("t"))
    if rest is None:
        return made
    core = directed(_core_rounds(rest[1])).select("graph", "node", F.lit(True).alias("ring")).distinct()
    marked = rest[0].join(core, ["graph", "node"], "left").withColumn("ring", F.coalesce("ring", F.lit(False)))
    return made.unionByName(marked.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("node", "label", "ring"))).alias("t")))


def graph_key(codes: DataFrame, last: str) -> DataFrame:
    """(graph, key): a digest of the codes of all nodes; isomorphic graphs have the same."""
    return codes.groupBy("graph").agg(F.md5(F.array_join(F.sort_array(F.collect_list(last)), "|")).alias("key"))


def two_core(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes of one edge are taken away until there are none: rings and what links them.

    A round takes all leaves at once, so there are as many rounds as the longest chain is
    long; each round's edges are a written table, its losses are observed while writing.
    Graphs of up to ROW_SIZE nodes lose theirs in their rows.
    """
    ends = directed(edges).select("graph", "node").distinct()
    (ends, edges), rest = by_size(ends, edges)
    rows = packed(ends.withColumn("label", F.lit(None).cast("string")), edges)
    kept = each_row(lambda node, label, a, b, bond: (row_core(a, b),), "kept array<int>")["kept"]
    core = rows.select("graph", F.arrays_zip("a", "b", F.col("bond").alias("label")).alias("e"), F.explode(kept).alias("i"))
    core = core.select("graph", F.get("e", "i").alias("e")).select("graph", "e.*")
    return core if rest is None else core.unionByName(_core_rounds(rest[1]))


def _core_rounds(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    folder, left, k = scratch(spark, "two-core"), edges, 0
    while True:
        degree = directed(left).groupBy("graph", "node").agg(F.count("*").alias("n"))
        leaves = degree.filter("n = 1").select("graph", "node", F.lit(True).alias("leaf"))
        out = left
        for end in "ab":
            out = out.join(leaves.select("graph", F.col("node").alias(end), F.col("leaf").alias(f"leaf_{end}")), ["graph", end], "left")
        seen = Observation()
        out = out.observe(seen, F.count_if(F.col("leaf_a").isNotNull() | F.col("leaf_b").isNotNull()).alias("lost"))
        out = out.filter("leaf_a IS NULL AND leaf_b IS NULL").select("graph", "a", "b", "label")
        out.write.parquet(f"{folder}/{k}")
        left, k = spark.read.schema(out.schema).parquet(f"{folder}/{k}"), k + 1
        if not seen.get["lost"]:
            return left


def scaffolds(nodes: DataFrame, edges: DataFrame, radius: int = 3) -> DataFrame:
    """(graph, key, generic): digests of the two-core, with labels and without; graphs of chains only have none and no row."""
    (nodes, edges), rest = by_size(nodes, edges)

    def keys(node, label, a, b, bond):
        kept = row_core(a, b)
        a, b, bond = ([x[i] for i in kept] for x in (a, b, bond))
        held = {*a, *b}
        own = [(v, x) for v, x in zip(node, label) if v in held]
        ends = row_ends([v for v, _ in own], a, b, bond)
        plain = [[("*", j) for _, j in e] for e in ends]
        return tuple(row_key(row_codes(x, e, radius)[-1]) if own else None for x, e in (([x for _, x in own], ends), (["*"] * len(own), plain)))

    made = packed(nodes, edges).select("graph", each_row(keys, "key string, generic string").alias("k")).select("graph", "k.*").filter("generic IS NOT NULL")
    return made if rest is None else made.unionByName(_scaffold_rounds(*rest, radius))


def _scaffold_rounds(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    core = _core_rounds(edges)
    held = directed(core).select("graph", "node").distinct()
    own = nodes.join(held, ["graph", "node"])
    plain = own.withColumn("label", F.lit("*"))
    exact = graph_key(environments(own, core, radius), f"code{radius}")
    generic = graph_key(environments(plain, core.withColumn("label", F.lit("*")), radius), f"code{radius}")
    return exact.join(generic.withColumnRenamed("key", "generic"), "graph")


def longest_common(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """Places (from 0) of a longest common subsequence in ``a`` and in ``b``.

    Rows of the table are bits (a place is unset where the length grows), one addition a
    row; of several ways the one that drops the last of ``a`` first.
    """
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for y in b:
        v = rows[-1]
        u = v & masks.get(y, 0)
        rows.append((v + u | v - u) & full)
    length = lambda i, j: i - (rows[j] & (1 << i) - 1).bit_count()
    i, j, one, two = len(a), len(b), [], []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            one.append(i)
            two.append(j)
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return one[::-1], two[::-1]


def common_part(a: Column, b: Column) -> Column:
    """Struct n, only_a, only_b of two token lists: the length of their longest common subsequence and the places (from 0) outside it; null lists are empty."""

    @F.pandas_udf("n int, only_a array<int>, only_b array<int>")
    def part(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        made = []
        for x, y in zip(a, b):
            x, y = ([] if t is None else list(t) for t in (x, y))
            one, two = longest_common(x, y)
            held, kept = set(one), set(two)
            made.append((len(one), [i for i in range(len(x)) if i not in held], [j for j in range(len(y)) if j not in kept]))
        return pd.DataFrame(made, columns=["n", "only_a", "only_b"])

    return part(a, b)


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, least): the smallest node that each of ``nodes`` (graph, node) hangs together with, by edges among them.

    The smallest node spreads along the edges until nothing changes, so there are as many
    rounds as the longest shortest way; each is a written table. Graphs of up to ROW_SIZE nodes
    are labelled in their rows.
    """
    nodes = nodes.select("graph", "node").distinct()
    (nodes, edges), rest = by_size(nodes, edges)
    rows = packed(nodes.withColumn("label", F.lit(None).cast("string")), edges)
    at = each_row(lambda node, label, a, b, bond: (row_least(row_ends(node, a, b, bond)),), "at array<int>")["at"]
    made = rows.select("graph", "node", at.alias("at")).select("graph", F.explode(F.arrays_zip("node", "at")).alias("x"), F.col("node").alias("all"))
    made = made.select("graph", F.col("x.node").alias("node"), F.get("all", F.col("x.at")).alias("least"))
    return made if rest is None else made.unionByName(_label_rounds(*rest))


def _label_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    spark, nodes = nodes.sparkSession, nodes.select("graph", "node").distinct()
    folder, k = scratch(spark, "connected"), 0
    ends = directed(edges).select("graph", "node", "other")
    ends = ends.join(nodes, ["graph", "node"], "left_semi").join(nodes.select("graph", F.col("node").alias("other")), ["graph", "other"], "left_semi")
    labels = nodes.withColumn("least", F.col("node"))
    while True:
        told = ends.join(labels.select("graph", F.col("node").alias("other"), "least"), ["graph", "other"]).groupBy("graph", "node").agg(F.min("least").alias("told"))
        seen = Observation()
        made = labels.join(told, ["graph", "node"], "left").withColumn("told", F.least("least", "told"))
        made = made.observe(seen, F.count_if(F.col("told") < F.col("least")).alias("moved")).select("graph", "node", F.col("told").alias("least"))
        made.write.parquet(f"{folder}/{k}")
        labels, k = spark.read.schema(made.schema).parquet(f"{folder}/{k}"), k + 1
        if not seen.get["moved"]:
            return labels


def connected_subset(subset: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, n_nodes, connected): whether the nodes of ``subset`` (graph, node) hang together by edges among themselves."""
    return component_labels(subset, edges).groupBy("graph").agg(F.count("*").alias("n_nodes"), (F.min("least") == F.max("least")).alias("connected"))


def holding(nodes: DataFrame, edges: DataFrame, labels: list[str | None], bonds: list[tuple[int, int, str | None]]) -> DataFrame:
    """(graph): graphs that hold a pattern of nodes ``labels`` (None: any) and ``bonds`` (i, j, label or None), each on a node of its own.

    Bonds are joined in turn; each must have an end among the nodes that are placed before it.
    """
    ends = directed(edges)
    own = nodes.select("graph", F.col("node").alias("v0"), F.col("label").alias("l0"))
    rows, placed = (own.filter(F.col("l0") == labels[0]) if labels[0] else own).drop("l0"), {0}
    for i, j, bond in bonds:
        i, j = (i, j) if i in placed else (j, i)
        step = ends.filter(F.col("bond") == bond) if bond else ends
        step = step.select("graph", F.col("node").alias(f"v{i}"), F.col("other").alias(f"v{j}"))
        if j in placed:
            rows = rows.join(step, ["graph", f"v{i}", f"v{j}"], "left_semi")
            continue
        rows = rows.join(step, ["graph", f"v{i}"])
        for k in placed - {i}:
            rows = rows.filter(F.col(f"v{k}") != F.col(f"v{j}"))
        if labels[j]:
            rows = rows.join(nodes.filter(F.col("label") == labels[j]).select("graph", F.col("node").alias(f"v{j}")), ["graph", f"v{j}"], "left_semi")
        placed.add(j)
    return rows.select("graph").distinct()


def first_held(nodes: DataFrame, edges: DataFrame, patterns: list[tuple[str, list, list]], otherwise: str = "other") -> DataFrame:
    """(graph, pattern): the name of the first pattern (name, labels, bonds) that a graph holds."""
    every = nodes.select("graph").distinct().withColumns({"rank": F.lit(len(patterns)), "pattern": F.lit(otherwise)})
    for i, (name, labels, bonds) in enumerate(patterns):
        every = every.unionByName(holding(nodes, edges, labels, bonds).withColumns({"rank": F.lit(i), "pattern": F.lit(name)}))
    return every.groupBy("graph").agg(F.min_by("pattern", "rank").alias("pattern"))


def single_cuts(nodes: DataFrame, edges: DataFrame, radius: int = 2) -> DataFrame:
    """(graph, a, b, core, rest, n_core, n_rest): both parts of a graph for each edge that holds it together.

    The core is the part with more nodes (ties: the one of the smallest node); ``core`` and
    ``rest`` are digests of the parts, with the place of the cut marked. Each edge's cut is a
    copy of its graph without it, so this is for small graphs; those of up to ROW_SIZE nodes
    are copied within their rows, once for each edge that is found to hold them together.
    """
    (nodes, edges), rest = by_size(nodes, edges)
    fields = {"at": "int", "core": "string", "rest": "string", "n_core": "long", "n_rest": "long"}

    def cuts(node, label, a, b, bond):
        made, place = [], {v: i for i, v in enumerate(node)}
        for k, cut in enumerate(zip(a, b)):
            one, two = (place.get(v, -1) for v in cut)
            left = [i for i in range(len(a)) if (a[i], b[i]) != cut]
            ends = row_ends(node, *([x[i] for i in left] for x in (a, b, bond)))
            least = row_least(ends)
            if one < 0 or two < 0 or least[one] == least[two]:
                continue
            codes = row_codes([None if x is None else x + "*" * (v in cut) for v, x in zip(node, label)], ends, radius)[-1]
            sides = sorted((-least.count(p), p, row_key([c for c, q in zip(codes, least) if p == q])) for p in (least[one], least[two]))
            made.append((k, sides[0][2], sides[1][2], -sides[0][0], -sides[1][0]))
        return tuple(zip(*made)) or ((),) * len(fields)

    found = each_row(cuts, ", ".join(f"{c} array<{t}>" for c, t in fields.items()))
    rows = packed(nodes, edges).select("graph", "a", "b", found.alias("f")).select("graph", "a", "b", F.explode(F.arrays_zip(*(f"f.{c}" for c in fields))).alias("c"))
    made = rows.select("graph", *(F.get(k, F.col("c.at")).alias(k) for k in "ab"), *(f"c.{c}" for c in list(fields)[1:]))
    return made if rest is None else made.unionByName(_cut_rounds(*rest, radius))


def _cut_rounds(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    cuts = edges.select("graph", "a", "b").withColumn("cut", F.struct("graph", "a", "b"))
    of = cuts.select("graph", "cut")
    left = of.join(edges, "graph").filter((F.col("a") != F.col("cut.a")) | (F.col("b") != F.col("cut.b"))).select(F.col("cut").alias("graph"), "a", "b", "label")
    own = of.join(nodes, "graph").select(F.col("cut").alias("graph"), "node", F.concat("label", F.when(F.col("node").isin(F.col("cut.a"), F.col("cut.b")), "*").otherwise("")).alias("label"))
    parts = _label_rounds(own, left).select(F.col("graph").alias("cut"), "node", "least")
    # of the component that had the edge, the part of each end
    ends = parts.filter(F.col("node").isin(F.col("cut.a"), F.col("cut.b"))).groupBy("cut").agg(F.min("least").alias("one"), F.max("least").alias("two")).filter("one < two")
    held = parts.join(ends, "cut").filter(F.col("least").isin(F.col("one"), F.col("two")))
    sizes = held.groupBy("cut", "least").agg(F.count("*").alias("n"))
    codes = environments(own, left, radius).select(F.col("graph").alias("cut"), "node", f"code{radius}")
    keys = held.join(codes, ["cut", "node"]).groupBy("cut", "least").agg(F.md5(F.array_join(F.sort_array(F.collect_list(f"code{radius}")), "|")).alias("key"))
    made = sizes.join(keys, ["cut", "least"]).groupBy("cut").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "least", "key"))).alias("p"))
    return made.select("cut.*", F.col("p")[0]["key"].alias("core"), F.col("p")[1]["key"].alias("rest"), (-F.col("p")[0]["less"]).alias("n_core"), (-F.col("p")[1]["less"]).alias("n_rest"))


def descriptors(nodes: DataFrame, edges: DataFrame, masses: dict[str, float], hetero: list[str]) -> DataFrame:
    """(graph, mass, n_nodes, n_bonds, parts, rings, core_nodes, hetero, ends, plain_share): numbers of each graph.

    rings: bonds - nodes + parts; core_nodes: those in rings or between them; ends: nodes of
    one bond or none; plain_share: of the carbon nodes those with bonds "-" only.
    """
    (nodes, edges), rest = by_size(nodes, edges)

    def numbers(node, label, a, b, bond):
        ends, core = row_ends(node, a, b, bond), row_core(a, b)
        held = {v for i in core for v in (a[i], b[i])}
        carbon = [all(x in ("-", None) for x, _ in own) for v, own in zip(label, ends) if v == "C"]
        return (
            sum((masses.get(x, 0.0) for x in label), 0.0), len(node), sum(map(len, ends)) // 2, len(set(row_least(ends))), sum(v in held for v in node),
            sum(x in hetero for x in label), sum(len(own) < 2 for own in ends), sum(carbon) / len(carbon) if carbon else None,
        )

    kind = "mass double, n_nodes long, n_bonds long, parts long, core_nodes long, hetero long, ends long, plain_share double"
    made = packed(nodes, edges).select("graph", each_row(numbers, kind).alias("n")).select("graph", "n.*").withColumn("rings", F.col("n_bonds") - F.col("n_nodes") + F.col("parts"))
    return made if rest is None else made.unionByName(_descriptor_rounds(*rest, masses, hetero))


def _descriptor_rounds(nodes: DataFrame, edges: DataFrame, masses: dict[str, float], hetero: list[str]) -> DataFrame:
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in masses.items() for x in pair)), F.col("label")), F.lit(0.0))
    bonds = directed(edges).groupBy("graph", "node").agg(F.count("*").alias("k"), F.bool_and(F.col("bond") == "-").alias("plain"))
    core = directed(_core_rounds(edges)).select("graph", "node", F.lit(1).alias("core")).distinct()
    rows = nodes.join(bonds, ["graph", "node"], "left").join(core, ["graph", "node"], "left").join(_label_rounds(nodes, edges), ["graph", "node"])
    carbon, plain = F.col("label") == "C", F.coalesce("plain", F.lit(True))
    made = rows.groupBy("graph").agg(
        F.sum(weight).alias("mass"), F.count("*").alias("n_nodes"), (F.coalesce(F.sum("k"), F.lit(0)) / 2).cast("long").alias("n_bonds"), F.count_if(F.col("node") == F.col("least")).alias("parts"),
        F.count("core").alias("core_nodes"), F.count_if(F.col("label").isin(*hetero)).alias("hetero"), F.count_if(F.coalesce("k", F.lit(0)) < 2).alias("ends"),
        F.try_divide(F.count_if(carbon & plain), F.count_if(carbon)).alias("plain_share"),
    )
    return made.withColumn("rings", F.col("n_bonds") - F.col("n_nodes") + F.col("parts"))
