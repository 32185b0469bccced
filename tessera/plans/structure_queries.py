"""Queries of small graphs, with their SQL.

The graphs are those of the orders: a node for each line number, labelled by its supplier,
bonded to the next number and to lines of the same return flag.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import classify
from tessera.operators import graphs as G
from tessera.operators import similarity as S
from tessera.plans.bindings import rounded, table

QUERIES: dict = {}
ORACLE: dict = {}
ELEMENTS = ("C", "C", "N", "O", "Cl")
RADIUS = 2


def order_graphs(spark, d):
    element = F.element_at(F.array(*map(F.lit, ELEMENTS)), (F.min("l_suppkey") % len(ELEMENTS) + 1).cast("int"))
    # a graph's lines come together once; the steps by graph and node that follow move nothing
    nodes = table(spark, d, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node")).agg(element.alias("label"), F.min("l_returnflag").alias("flag"))
    one, two = nodes.select("graph", F.col("node").alias("a"), F.col("flag").alias("fa")), nodes.select("graph", F.col("node").alias("b"), F.col("flag").alias("fb"))
    near = F.col("b") == F.col("a") + 1
    edges = one.join(two, "graph").filter((F.col("a") < F.col("b")) & (near | (F.col("fa") == F.col("fb"))))
    return nodes.select("graph", "node", "label"), edges.select("graph", "a", "b", F.when(near, "-").otherwise("=").alias("label"))


def graph_fingerprints(spark, d):
    nodes, edges = order_graphs(spark, d)
    found = G.fingerprints(G.environments(nodes, edges, RADIUS), RADIUS)
    return found.select("graph", F.size("features").alias("n"), F.md5(F.array_join(F.sort_array("features"), "|")).alias("digest"))


def graph_similarity(spark, d):
    """Pairs of order graphs by shared environments; those of under 12 are too plain to tell apart."""
    nodes, edges = order_graphs(spark, d)
    found = G.graph_features(nodes, edges, RADIUS)
    pairs = S.set_pairs(found.withColumnRenamed("graph", "id").filter(F.size("features") >= 12), 1, 2)
    return rounded(pairs.groupBy("inter", "size_a", "size_b").agg(F.count("*").alias("n"), F.avg(F.col("b") - F.col("a")).alias("apart")), "apart")


def graph_scaffolds(spark, d):
    nodes, edges = order_graphs(spark, d)
    found = nodes.select("graph").distinct().join(G.scaffolds(nodes, edges, RADIUS), "graph", "left")
    return found.groupBy("key", "generic").agg(F.count("*").alias("n"), F.min("graph").alias("first"))


def _differences(spark, d):
    """Each order and the next one by key: the common part of their labels in line order, and what lies outside."""
    nodes, edges = order_graphs(spark, d)
    lists = G.ring_lists(nodes, edges)
    pairs = lists.select(F.col("graph").alias("a"), F.col("t").alias("ta")).join(lists.select((F.col("graph") - 1).alias("a"), F.col("graph").alias("b"), F.col("t").alias("tb")), "a")
    made = pairs.withColumn("part", G.common_part(F.col("ta.label"), F.col("tb.label")))
    out = F.concat(F.transform("part.only_a", lambda i: F.get("ta", i)), F.transform("part.only_b", lambda i: F.get("tb", i)))
    return made.withColumn("out", out)


def common_parts(spark, d):
    return _differences(spark, d).select("a", "b", "part.n", F.size("part.only_a").alias("only_a"), F.size("part.only_b").alias("only_b"), F.size("out").alias("n_out"))


def graph_differences(spark, d):
    """Tags of what differs: by the labels outside the common part, and whether they lie in a ring (as nitrogen: aromatic)."""
    made = _differences(spark, d)
    symbols, ring = F.col("out.label"), F.exists("out", lambda x: x["ring"])
    aromatic = F.exists("out", lambda x: x["ring"] & (x["label"] == "N"))
    return made.select(F.explode(classify.difference_tags(symbols, aromatic, ring)).alias("tag"), F.size("out").alias("n_out")).groupBy("tag").agg(F.count("*").alias("n"), F.sum("n_out").alias("total"))


#: The first that an order's graph holds.
PATTERNS = [
    ("chloro_amine", ["Cl", "N"], [(0, 1, "=")]),
    ("ring_of_three", ["C", None, None], [(0, 1, None), (1, 2, None), (0, 2, None)]),
    ("dioxy", ["O", "C", "O"], [(0, 1, "-"), (1, 2, "-")]),
    ("branched", ["C", None, None, None], [(0, 1, None), (0, 2, None), (0, 3, None)]),
]
MASSES = {"C": 12.011, "N": 14.007, "O": 15.999, "Cl": 35.45}


def graph_patterns(spark, d):
    nodes, edges = order_graphs(spark, d)
    return G.first_held(nodes, edges, PATTERNS).groupBy("pattern").agg(F.count("*").alias("n"), F.min("graph").alias("first"))


def graph_cuts(spark, d):
    """Cores that orders share after one cut, with how many different rests they carry."""
    nodes, edges = order_graphs(spark, d)
    made = G.single_cuts(nodes, edges, RADIUS)
    # a graph counts with one of its cuts to a core, so that distinct graphs need no shuffle of their own
    own = made.groupBy("graph", "core").agg(F.collect_list("rest").alias("rests"), F.max("n_core").alias("n_core"))
    each = own.select("core", "n_core", F.posexplode("rests").alias("i", "rest"))
    pairs = each.groupBy("core", "rest").agg(F.count("*").alias("n"), F.count_if(F.col("i") == 0).alias("graphs"), F.max("n_core").alias("n_core"))
    return pairs.groupBy("core").agg(F.sum("n").alias("n"), F.sum("graphs").alias("graphs"), F.count("rest").alias("rests"), F.max("n_core").alias("n_core"))


def graph_descriptors(spark, d):
    nodes, edges = order_graphs(spark, d)
    return rounded(G.descriptors(nodes, edges, MASSES, ["N", "O"]), "mass", "plain_share")


for _f in (graph_fingerprints, graph_similarity, graph_scaffolds, common_parts, graph_differences, graph_patterns, graph_cuts, graph_descriptors):
    QUERIES[_f.__name__] = _f

_GRAPHS = f"""gn AS (SELECT l_orderkey AS graph, l_linenumber AS node, {list(ELEMENTS)}[min(l_suppkey) % {len(ELEMENTS)} + 1] AS label, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
ge AS (SELECT x.graph, x.node AS a, y.node AS b, CASE WHEN y.node = x.node + 1 THEN '-' ELSE '=' END AS label FROM gn x JOIN gn y ON x.graph = y.graph AND x.node < y.node AND (y.node = x.node + 1 OR x.flag = y.flag))"""


def _rounds(nodes: str, edges: str, name: str, radius: int = RADIUS) -> str:
    """Code tables <name>0, <name>1, ... of the environments."""
    sql = f"{name}e AS (SELECT graph, a AS node, b AS other, label AS bond FROM {edges} UNION ALL SELECT graph, b, a, label FROM {edges}),\n{name}0 AS (SELECT graph, node, md5(label) AS code FROM {nodes})"
    for r in range(1, radius + 1):
        told = f"SELECT e.graph, e.node, string_agg(bond || ':' || code, '|' ORDER BY bond || ':' || code) AS heard FROM {name}e e JOIN {name}{r - 1} c ON c.graph = e.graph AND c.node = e.other GROUP BY ALL"
        sql += f",\n{name}{r} AS (SELECT c.graph, c.node, md5(code || '(' || coalesce(heard, '') || ')') AS code FROM {name}{r - 1} c LEFT JOIN ({told}) h ON h.graph = c.graph AND h.node = c.node)"
    return sql


_CODES = "fs AS (SELECT DISTINCT graph, code FROM (" + " UNION ALL ".join(f"SELECT * FROM c{r}" for r in range(RADIUS + 1)) + "))"
#: The two-core of each graph, its edges as a list that loses its leaves until none is left.
_CORE = """cr(graph, es, k, last) AS (
  SELECT graph, list({'a': a, 'b': b, 'label': label}), 0, -1 FROM ge GROUP BY graph
  UNION ALL
  SELECT graph, list_filter(es, lambda e: len(list_filter(es, lambda f: f.a = e.a OR f.b = e.a)) > 1 AND len(list_filter(es, lambda f: f.a = e.b OR f.b = e.b)) > 1), k + 1, len(es) FROM cr WHERE len(es) <> last
), co AS (SELECT graph, unnest(arg_max(es, k), recursive := true) FROM cr GROUP BY graph),
cn AS (SELECT DISTINCT graph, node FROM (SELECT graph, a AS node FROM co UNION ALL SELECT graph, b FROM co))"""
#: Cell by cell: the length of the longest common subsequence of the first i and j labels, and the places it takes.
_COMMON = """li AS (SELECT gn.graph, list({'label': label, 'ring': cn.node IS NOT NULL} ORDER BY gn.node) AS t FROM gn LEFT JOIN cn ON cn.graph = gn.graph AND cn.node = gn.node GROUP BY gn.graph),
pr AS (SELECT x.graph AS a, y.graph AS b, x.t AS ta, y.t AS tb, len(x.t) AS n, len(y.t) AS m FROM li x JOIN li y ON y.graph = x.graph + 1),
ls(a, s, cells) AS (
  SELECT a, 0, []::struct(n integer, i integer[], j integer[])[] FROM pr
  UNION ALL
  SELECT ls.a, s + 1, list_append(cells, CASE
      WHEN ta[s // m + 1].label = tb[s % m + 1].label THEN {'n': coalesce(d.n, 0) + 1, 'i': list_append(coalesce(d.i, []), s // m + 1), 'j': list_append(coalesce(d.j, []), s % m + 1)}
      WHEN coalesce(u.n, 0) >= coalesce(l.n, 0) THEN {'n': coalesce(u.n, 0), 'i': coalesce(u.i, []), 'j': coalesce(u.j, [])} ELSE l END)
  FROM (SELECT ls.*, ta, tb, n, m, CASE WHEN s >= m AND s % m > 0 THEN cells[s - m] END AS d, CASE WHEN s >= m THEN cells[s - m + 1] END AS u, CASE WHEN s % m > 0 THEN cells[s] END AS l FROM ls JOIN pr USING (a) WHERE s < n * m) ls
), df AS (SELECT pr.*, cells[n * m] AS c FROM pr JOIN ls ON ls.a = pr.a AND s = n * m),
dt AS (SELECT a, b, c.n AS n_common, n - c.n AS only_a, m - c.n AS only_b, list_concat(list_filter(ta, lambda x, k: NOT list_contains(c.i, k)), list_filter(tb, lambda x, k: NOT list_contains(c.j, k))) AS out FROM df)"""
ORACLE |= {
    "graph_fingerprints": f"WITH {_GRAPHS}, {_rounds('gn', 'ge', 'c')}, {_CODES} SELECT graph, count(*)::integer AS n, md5(string_agg(code, '|' ORDER BY code)) AS digest FROM fs GROUP BY graph",
    "graph_similarity": f"""WITH {_GRAPHS}, {_rounds('gn', 'ge', 'c')}, {_CODES}, z AS (SELECT graph, count(*)::integer AS n FROM fs GROUP BY graph HAVING count(*) >= 12),
f AS (SELECT graph, code, n FROM fs JOIN z USING (graph)), p AS (SELECT x.graph AS a, y.graph AS b, count(*)::integer AS "inter", any_value(x.n) AS size_a, any_value(y.n) AS size_b FROM f x JOIN f y ON x.code = y.code AND x.graph < y.graph GROUP BY ALL)
SELECT "inter", size_a, size_b, count(*) AS n, round(avg(b - a), 6) AS apart FROM p WHERE "inter" * 2 >= size_a + size_b - "inter" GROUP BY ALL""",
    "graph_scaffolds": f"""WITH RECURSIVE {_GRAPHS}, {_CORE}, kn AS (SELECT gn.* FROM gn JOIN cn ON cn.graph = gn.graph AND cn.node = gn.node), pn AS (SELECT graph, node, '*' AS label FROM kn), pb AS (SELECT graph, a, b, '*' AS label FROM co),
{_rounds('kn', 'co', 'k')}, {_rounds('pn', 'pb', 'p')},
x AS (SELECT graph, md5(string_agg(code, '|' ORDER BY code)) AS key FROM k{RADIUS} GROUP BY graph), y AS (SELECT graph, md5(string_agg(code, '|' ORDER BY code)) AS generic FROM p{RADIUS} GROUP BY graph)
SELECT key, generic, count(*) AS n, min(g.graph) AS first FROM (SELECT DISTINCT graph FROM gn) g LEFT JOIN x ON x.graph = g.graph LEFT JOIN y ON y.graph = g.graph GROUP BY key, generic""",
    "common_parts": f"WITH RECURSIVE {_GRAPHS}, {_CORE}, {_COMMON} SELECT a, b, n_common AS n, only_a::integer AS only_a, only_b::integer AS only_b, len(out)::integer AS n_out FROM dt",
    "graph_differences": f"""WITH RECURSIVE {_GRAPHS}, {_CORE}, {_COMMON}, y AS (SELECT out, list_transform(out, lambda x: x.label) AS s, len(list_filter(out, lambda x: x.ring)) > 0 AS ring, len(list_filter(out, lambda x: x.ring AND x.label = 'N')) > 0 AS aromatic FROM dt),
t AS (SELECT len(out) AS n_out, unnest([CASE WHEN list_has_any(s, ['F', 'Cl', 'Br', 'I']) THEN 'halogen_change' END, CASE WHEN list_has_any(s, ['N', 'O', 'S']) THEN 'heteroatom_change' END, CASE WHEN aromatic THEN 'aromatic_change' END,
  CASE WHEN ring THEN 'ring_modification' END, CASE WHEN len(s) <= 1 THEN 'single_atom' WHEN len(s) <= 4 THEN 'small_substituent' WHEN len(s) <= 8 THEN 'medium_substituent' ELSE 'large_substituent' END, CASE WHEN len(s) > 0 AND len(list_filter(s, lambda x: x <> 'C')) = 0 THEN 'carbon_only' END]) AS tag FROM y)
SELECT tag, count(*) AS n, sum(n_out)::bigint AS total FROM t WHERE tag IS NOT NULL GROUP BY tag""",
    "graph_patterns": f"""WITH {_GRAPHS}, e AS (SELECT graph, a AS x, b AS y, label FROM ge UNION ALL SELECT graph, b, a, label FROM ge), w AS (SELECT e.*, x.label AS lx, y.label AS ly FROM e JOIN gn x ON x.graph = e.graph AND x.node = e.x JOIN gn y ON y.graph = e.graph AND y.node = e.y),
h AS (SELECT graph, 0 AS k FROM w WHERE lx = 'Cl' AND ly = 'N' AND label = '='
  UNION ALL SELECT p.graph, 1 FROM w p JOIN w q ON q.graph = p.graph AND q.x = p.y JOIN w r ON r.graph = p.graph AND r.x = q.y AND r.y = p.x WHERE p.lx = 'C'
  UNION ALL SELECT p.graph, 2 FROM w p JOIN w q ON q.graph = p.graph AND q.x = p.y WHERE p.lx = 'O' AND p.ly = 'C' AND q.ly = 'O' AND p.label = '-' AND q.label = '-' AND q.y <> p.x
  UNION ALL SELECT graph, 3 FROM w WHERE lx = 'C' GROUP BY graph, x HAVING count(*) >= 3
  UNION ALL SELECT graph, 4 FROM gn), f AS (SELECT graph, min(k) AS k FROM h GROUP BY graph)
SELECT ['chloro_amine', 'ring_of_three', 'dioxy', 'branched', 'other'][k + 1] AS pattern, count(*) AS n, min(graph) AS first FROM f GROUP BY k""",
    "graph_cuts": f"""WITH RECURSIVE {_GRAPHS}, c AS (SELECT row_number() OVER (ORDER BY graph, a, b) AS id, graph AS g, a, b FROM ge),
l AS (SELECT c.id AS graph, e.a, e.b, e.label FROM c JOIN ge e ON e.graph = c.g WHERE e.a <> c.a OR e.b <> c.b), w AS (SELECT graph, a AS x, b AS y FROM l UNION ALL SELECT graph, b, a FROM l),
r AS (SELECT id AS graph, 0 AS side, a AS node FROM c UNION SELECT id, 1, b FROM c UNION SELECT r.graph, r.side, w.y FROM r JOIN w ON w.graph = r.graph AND w.x = r.node),
k AS (SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.graph = id AND side = 0 AND r.node = c.b)),
o AS (SELECT r.graph, r.node, n.label || CASE WHEN r.node IN (c.a, c.b) THEN '*' ELSE '' END AS label, r.side FROM r JOIN k ON k.id = r.graph JOIN c ON c.id = r.graph JOIN gn n ON n.graph = c.g AND n.node = r.node),
lk AS (SELECT l.* FROM l JOIN k ON k.id = l.graph WHERE EXISTS (SELECT 1 FROM o WHERE o.graph = l.graph AND o.node = l.a)), {_rounds('o', 'lk', 'u')},
p AS (SELECT o.graph, side, count(*) AS n, min(o.node) AS least, md5(string_agg(code, '|' ORDER BY code)) AS key FROM o JOIN u{RADIUS} u ON u.graph = o.graph AND u.node = o.node GROUP BY ALL),
s AS (SELECT graph, arg_min(key, (-n, least)) AS core, arg_max(key, (-n, least)) AS rest, max(n) AS n_core FROM p GROUP BY graph)
SELECT core, count(*) AS n, count(DISTINCT g) AS graphs, count(DISTINCT rest) AS rests, max(n_core) AS n_core FROM s JOIN c ON c.id = s.graph GROUP BY core""",
    "graph_descriptors": f"""WITH RECURSIVE {_GRAPHS}, {_CORE}, w AS (SELECT graph, a AS x, b AS y, label FROM ge UNION ALL SELECT graph, b, a, label FROM ge), r AS (SELECT graph, node, node AS least FROM gn UNION SELECT w.graph, w.y, r.least FROM r JOIN w ON w.graph = r.graph AND w.x = r.node),
m AS (SELECT graph, node, min(least) AS least FROM r GROUP BY ALL), b AS (SELECT graph, x AS node, count(*) AS k, bool_and(label = '-') AS plain FROM w GROUP BY ALL),
d AS (SELECT gn.*, coalesce(k, 0) AS k, coalesce(plain, true) AS plain, m.least, cn.node IS NOT NULL AS core FROM gn JOIN m USING (graph, node) LEFT JOIN b USING (graph, node) LEFT JOIN cn ON cn.graph = gn.graph AND cn.node = gn.node)
SELECT graph, round(sum(CASE label WHEN 'C' THEN 12.011 WHEN 'N' THEN 14.007 WHEN 'O' THEN 15.999 ELSE 35.45 END::double), 6) AS mass, count(*) AS n_nodes, (sum(k) // 2)::bigint AS n_bonds, count(*) FILTER (WHERE node = least) AS parts,
  ((sum(k) // 2) - count(*) + count(*) FILTER (WHERE node = least))::bigint AS rings, count(*) FILTER (WHERE core) AS core_nodes, count(*) FILTER (WHERE label IN ('N', 'O')) AS hetero, count(*) FILTER (WHERE k < 2) AS ends,
  round(count(*) FILTER (WHERE label = 'C' AND plain) / nullif(count(*) FILTER (WHERE label = 'C'), 0), 6) AS plain_share FROM d GROUP BY graph""",
}
