"""Queries of record and layout handling, file checks, digests, versions, gates and large tables of counts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import structures as Z
from tessera.functions import values as V
from tessera.operators import activities, checks, digests
from tessera.operators import graphs as G
from tessera.operators import statistics as T
from tessera.plans.bindings import rounded, table
from tessera.plans.structure_queries import _GRAPHS, order_graphs
from tessera.sources import files
from tessera.sources.versions import Conflict, VersionedTable

QUERIES: dict = {}
ORACLE: dict = {}


# records and layouts

def quoted_line_breaks(spark, d):
    """Orders in files by status: comments with breaks, commas and doubled quotes in quoted fields, and inch marks in plain ones."""
    base, o = files.scratch(spark, "broken"), table(spark, d, "orders")
    text = F.concat(F.lit('"made\n'), "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.lit(', ""x""\n\nend"')).otherwise('"'))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat((F.col("o_custkey") % 50).cast("string"), F.lit('" wide')), text, F.round("o_totalprice", 0).cast("long").cast("string"))
    for status in ("F", "O", "P"):
        files.write_lines(o.filter(F.col("o_orderstatus") == status).select(line), ["notes", "PUBCHEM_SID,SIZE,COMMENT,IC50"], f"{base}/AID_{ord(status)}_datatable_all.csv")
    rows = files.preamble_csv(spark, [f"{base}/AID_{ord(s)}_datatable_all.csv" for s in ("F", "O", "P")], in_parts=True)
    return rows.groupBy(files.file_id(F.col("_path")).alias("aid"), "COMMENT").agg(F.count("*").alias("n"), F.sum(F.col("PUBCHEM_SID").cast("long")).alias("sids"), F.sum(F.col("IC50").cast("long")).alias("ic50"), F.max("SIZE").alias("size"))


#: Strategy -> columns of its tables; cells are made by ``_cells``.
STRATEGIES = {
    "standard": ("Standard Type", "Standard Value", "Standard Units", "Standard Relation"),
    "ic50": ("IC50", "IC50 Qualifier"),
    "pubchem": ("PubChem Standard Value", "Standard Type", "Standard Relation"),
    "average": ("Average IC50", "Qualifier"),
    "pic50": ("pIC50_min", "pIC50_max"),
    "inhibition": ("Inhibition at 10 uM",),
    "outcome": ("PUBCHEM_ACTIVITY_OUTCOME", "Standard Type"),
}


def layout_strategies(spark, d):
    """Every layout over all orders, with cells that have a sign, a relation column, no value, a sign only, or no number."""
    k, v = F.col("o_orderkey") % 7, F.round("o_totalprice", 0).cast("long").cast("string")
    cell = F.when(k == 0, "").when(k == 1, "n/d").when(k == 2, F.concat(F.lit("> "), v)).when(k == 3, ">").when(k == 4, F.concat(F.lit("<="), v)).otherwise(v)
    relation = F.when(F.col("o_orderkey") % 5 == 0, "'<'").when(F.col("o_orderkey") % 5 == 1, "'='").otherwise(F.lit(None).cast("string"))
    unit = F.element_at(F.array(*map(F.lit, ("nM", "uM", " mM", "%", "counts"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("IC50", "ki", "% inhibition", "Zeta"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    power = F.when(k == 0, "").when(k == 1, "n/d").otherwise(F.format_string("%.1f", F.col("o_orderkey") % 40 / 10 + 4))
    cells = {"Standard Type": kind, "Standard Value": cell, "Standard Units": unit, "Standard Relation": relation, "IC50": cell, "IC50 Qualifier": relation, "PubChem Standard Value": cell, "Average IC50": cell, "Qualifier": relation, "pIC50_min": F.when(F.col("o_orderkey") % 2 == 0, power).otherwise(""), "pIC50_max": power, "Inhibition at 10 uM": cell, "PUBCHEM_ACTIVITY_OUTCOME": F.lit("Active")}
    made = None
    for name, columns in STRATEGIES.items():
        rows = table(spark, d, "orders").select(F.lit(name).alias("strategy"), F.when(F.col("o_custkey") % 3 == 0, "HTS").otherwise("A").alias("layer"), *(cells[c].alias(c) for c in columns))
        own = activities.extract(rows).select("strategy", "endpoint", "source_column", "qualifier", "unit", "status", "value_nm", "potency", "usable")
        made = own if made is None else made.unionByName(own)
    made = made.groupBy("strategy", "endpoint", "source_column", "qualifier", "unit", "status").agg(F.count("*").alias("n"), F.count_if("usable").alias("n_usable"), F.sum(F.log10(F.when(F.col("value_nm") > 0, F.col("value_nm")))).alias("log_nm"), F.sum("potency").alias("potency"))
    return rounded(made, "log_nm", "potency", digits=4)


# file checks decided by rows

def _nation_files(spark, d) -> str:
    base = files.scratch(spark, "nations")
    rows = table(spark, d, "customer").select(F.concat(F.lit("AID_"), F.col("c_nationkey").cast("string"), F.lit("_datatable_all")).alias("file"), "c_custkey")
    rows.repartition("file").write.partitionBy("file").csv(base)
    return base


def orphan_files(spark, d):
    """Files of the customers' nations; registered: nations whose customers hold more than the mean; excluded: those with a large supplier."""
    found = files.inventory(spark, _nation_files(spark, d), "part-*").select("aid").distinct()
    by = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"))
    mean = by.agg(F.avg("s").alias("mean"))
    known = by.crossJoin(F.broadcast(mean)).filter("s > mean").select(F.col("c_nationkey").cast("string").alias("aid"))  # one row
    out = table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").cast("string").alias("aid")).distinct()
    return files.unregistered(found, known, out).select("aid", "status")


def required_columns(spark, d):
    """A table of part sizes by brand, as wide as brands with many parts, against all brands as required columns."""
    p = table(spark, d, "part")
    brands = sorted(r[0] for r in p.select("p_brand").distinct().collect())  # a schema, some dozens of names
    wide = [r[0] for r in p.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_size").alias("s")).filter("s > 25").select("p_brand").collect()]
    table_ = p.filter(F.col("p_brand").isin(wide)).groupBy("p_type").pivot("p_brand", sorted(wide)).agg(F.sum("p_size"))
    made = files.check_columns(spark, {"sizes": (table_, brands)})
    return made.select("name", F.array_join("missing", "|").alias("missing"), "status")


def file_places(spark, d):
    """Files of one id in two folders: the source label of each folder, whether the date is one, and what the inventory says."""
    base, o = files.scratch(spark, "places"), table(spark, d, "orders")
    for folder, status, aid in (("Data Set", "F", 11), ("Late%20Data", "O", 11), ("Data Set", "P", 12)):
        o.filter(F.col("o_orderstatus") == status).select("o_orderkey").coalesce(1).write.mode("append").csv(f"{base}/{folder}/AID_{aid}_datatable_all.csv")
    found = files.inventory(spark, base, "part-*")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    found = found.withColumns({"label": files.folder_label(folder), "dated": (F.datediff(F.current_date(), F.to_date("modified", "yyyy-MM-dd")) <= 1)})
    known = spark.createDataFrame([("11",), ("12",)], "aid string")
    said = files.check_inventory(found, known, 1).select("aid", "files", "status")
    return found.groupBy("aid", "label").agg(F.bool_and("dated").alias("dated"), F.max(F.col("length") > 0).alias("filled")).join(said, "aid")


# values

def first_filled(spark, d):
    """The first of three cells that is not blank, cut at the bar."""
    p = table(spark, d, "part")
    one = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" |note | more"))).when(F.col("p_partkey") % 3 == 1, F.lit("  "))
    two = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit("|x")))
    return p.groupBy(V.cut_at_bar(V.nonempty(one, two, F.col("p_name"))).alias("value")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def stop_gate(spark, d):
    """The gate's refusal over claims about each segment's balance: passed, and the first ten that failed."""
    by = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("n"))
    said = by.select("c_mktsegment", checks.claim("balance", F.lit(4500.0), F.col("mean"), 100.0).alias("c"))
    checked = said.select(F.concat("c.metric", F.lit(" of "), "c_mktsegment").alias("metric"), "c.status").orderBy("metric")
    try:
        checks.gate(checked)
        failed = ""
    except AssertionError as e:
        failed = str(e)
    return by.agg(F.sum("n").alias("rows")).select("rows", F.lit(not failed).alias("passed"), F.lit(failed).alias("said"))


def property_rules(spark, d):
    """Violations of the rule of five, of the two limits on turns and area, and the class of a change in size, on the parts' own numbers."""
    p = table(spark, d, "part")
    mass, logp, donors, acceptors, turns, area = F.col("p_retailprice") / 3, F.col("p_size") / 6.0, F.col("p_partkey") % 9, F.col("p_partkey") % 13, F.col("p_size") % 15, F.col("p_retailprice") / 8
    rows = p.select(Z.rule_of_five(mass, logp, donors, acceptors).alias("violations"), Z.veber(area, turns).alias("veber"), Z.size_class(F.col("p_size") % 12).alias("size_class"))
    return rows.groupBy("violations", "veber", "size_class").agg(F.count("*").alias("n"))


def connected_parts(spark, d):
    """For each order's graph whether its carbon nodes hang together."""
    nodes, edges = order_graphs(spark, d)
    made = G.connected_subset(nodes.filter("label = 'C'").select("graph", "node"), edges)
    return made.groupBy("n_nodes", "connected").agg(F.count("*").alias("n"), F.min("graph").alias("first"))


# large counts, densities, digests, versions

def fisher_large(spark, d):
    """Price units (some ten million) of even and odd line numbers by return flag against the others."""
    unit = F.floor(F.col("l_extendedprice") / 100).cast("long")
    even = (F.col("l_linenumber") % 2 == 0) & (F.col("l_orderkey") % 2 == 0)
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.when(even, unit).otherwise(0)).alias("a"), F.sum(F.when(even, 0).otherwise(unit)).alias("b"))
    total = rows.agg(F.sum("a").alias("h"), F.sum("b").alias("m"))
    rows = rows.crossJoin(F.broadcast(total)).select("l_returnflag", "a", "b", (F.col("h") - F.col("a")).alias("c"), (F.col("m") - F.col("b")).alias("d"))  # one row
    return rounded(T.fisher(rows).select("l_returnflag", "a", "b", "c", "d", "odds", "log10_p"), "odds", "log10_p", digits=3)


def density_scott(spark, d):
    rows = table(spark, d, "documents").select(F.log10("n_chars").alias("v"))
    return rounded(T.binned_density(rows, "v", 0.0, 6.0, 60), "x", "density", digits=5)


def density_fixed(spark, d):
    return rounded(T.binned_density(table(spark, d, "orders"), "o_totalprice", 0.0, 600000.0, 120, 9000.0), "x", "density", digits=10)


def lineitem_digest(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", F.round(F.col("l_quantity") * 100, 0).cast("long").alias("q"))
    return digests.table_digest(rows)


def versioned_table(spark, d):
    """Three versions of the suppliers, a reader pinned to the second, and a writer that comes too late."""
    t = VersionedTable(spark, files.scratch(spark, "versions"))
    t.replace(lambda _: table(spark, d, "supplier").select("s_suppkey", "s_acctbal"))
    t.replace(lambda s: s.filter("s_acctbal > 0"))
    pinned = t.read()
    late = t.stage(table(spark, d, "supplier").limit(0).select("s_suppkey", "s_acctbal"))
    t.replace(lambda s: s.filter("s_acctbal > 5000"))
    try:
        t.publish(late, 3)
        conflict = False
    except Conflict:
        conflict = True
    of = lambda name, s: s.agg(F.lit(name).alias("version"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"), F.lit(conflict).alias("conflict"))
    return of("newest", t.read()).unionByName(of("pinned", pinned)).unionByName(of("first", t.read(1)))


for _f in (quoted_line_breaks, layout_strategies, orphan_files, required_columns, file_places, first_filled, stop_gate, property_rules, connected_parts, fisher_large, density_scott, density_fixed, lineitem_digest, versioned_table):
    QUERIES[_f.__name__] = _f

_DENSITY = """n AS (SELECT count(v) AS n, {width} AS w FROM x), t AS (SELECT v, (v - {low}) / (w / 64) AS t, w, n FROM x, n WHERE v IS NOT NULL),
b AS (SELECT floor(t)::bigint + s AS b, sum(CASE WHEN s = 0 THEN 1 - (t - floor(t)) ELSE t - floor(t) END) AS k, any_value(w) AS w, any_value(n) AS n FROM t, range(2) r(s) GROUP BY 1),
g AS (SELECT i::integer AS i, {low} + i * (({high} - {low}) / {steps}::double) AS x FROM range(0, {steps} + 1) r(i))
SELECT i, round(x, {digits}) AS x, round(coalesce(sum(k * exp(-pow((i * (({high} - {low}) / {steps}::double) - b * (w / 64)) / w, 2) / 2) / (w * sqrt(2 * pi()))) FILTER (WHERE abs(i * (({high} - {low}) / {steps}::double) - b * (w / 64)) <= 8 * w), 0.0::double) / any_value(n), {digits}) AS density FROM g, b GROUP BY i, x"""
_CELL = """o AS (SELECT o_orderkey AS ok, o_custkey AS ck, o_orderkey % 7 AS k, round(o_totalprice)::bigint::double AS v, CASE o_orderkey % 5 WHEN 0 THEN '<' WHEN 1 THEN '=' ELSE '' END AS rel,
  ['nM', 'uM', 'mM', '%', 'counts'][o_custkey % 5 + 1] AS u, ['IC50', 'Ki', 'Pct_inh', 'Zeta'][o_custkey % 4 + 1] AS e, CASE WHEN o_custkey % 3 = 0 THEN 'HTS' ELSE 'A' END AS layer FROM orders),
c AS (SELECT *, CASE k WHEN 2 THEN '>' WHEN 3 THEN '>' WHEN 4 THEN '<' ELSE '' END AS sign, CASE k WHEN 0 THEN 'NO_VALUE' WHEN 1 THEN 'PARSE_ERROR' WHEN 3 THEN 'QUALIFIER_ONLY' ELSE 'OK' END AS st,
  CASE u WHEN 'nM' THEN 1.0::double WHEN 'uM' THEN 1000.0::double WHEN 'mM' THEN 1000000.0::double END AS f, round(4 + (ok % 40) / 10.0::double, 1) AS p FROM o),
s AS (
  SELECT 'standard' AS strategy, e AS endpoint, 'Standard Value' AS source_column, CASE WHEN st = 'NO_VALUE' THEN rel WHEN rel NOT IN ('', '=') THEN rel ELSE sign END AS qualifier, CASE u WHEN 'mM' THEN 'mM' ELSE u END AS unit,
         CASE WHEN st <> 'OK' THEN st WHEN e = 'Pct_inh' OR u = '%' THEN 'OK' WHEN f IS NULL THEN 'UNCONVERTIBLE_UNITS' ELSE 'OK' END AS status, CASE WHEN st = 'OK' AND e <> 'Pct_inh' AND u <> '%' THEN v * f END AS nm, NULL::double AS direct, layer FROM c
  UNION ALL SELECT t.s, coalesce(t.e, c.e), t.c, CASE WHEN st = 'NO_VALUE' THEN rel WHEN rel <> '' THEN rel ELSE sign END, t.u, CASE WHEN st = 'QUALIFIER_ONLY' THEN 'NO_VALUE' ELSE st END, CASE WHEN st = 'OK' THEN v * t.f END, NULL, layer
  FROM c, (VALUES ('ic50', 'IC50', 'IC50', 'nM', 1.0::double), ('pubchem', NULL, 'PubChem Standard Value', 'uM', 1000.0::double), ('average', 'IC50', 'Average IC50', 'uM', 1000.0::double)) t(s, e, c, u, f)
  UNION ALL SELECT 'pic50', 'IC50', 'pIC50_min', CASE WHEN k > 1 THEN '=' ELSE '' END, 'nM', CASE k WHEN 0 THEN 'NO_VALUE' WHEN 1 THEN 'PARSE_ERROR' ELSE 'OK' END, CASE WHEN k > 1 THEN pow(10.0::double, 9 - p) END, CASE WHEN k > 1 THEN p END, layer FROM c
  UNION ALL SELECT 'inhibition', 'Pct_inh', 'Inhibition at 10 uM', sign, '%', CASE WHEN k = 0 THEN 'NO_VALUE' ELSE 'OK' END, NULL, NULL, layer FROM c
  UNION ALL SELECT 'outcome', e, 'PUBCHEM_ACTIVITY_OUTCOME', '', '', 'NO_VALUE', NULL, NULL, layer FROM c
)"""
ORACLE |= {
    "quoted_line_breaks": """WITH o AS (SELECT ascii(o_orderstatus)::varchar AS aid, 'made' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ', "x"end' ELSE '' END AS comment, o_orderkey, o_totalprice, (o_custkey % 50)::varchar || '" wide' AS size FROM orders)
SELECT aid, comment AS "COMMENT", count(*) AS n, sum(o_orderkey)::bigint AS sids, sum(round(o_totalprice))::bigint AS ic50, max(size) AS size FROM o GROUP BY aid, comment""",
    "layout_strategies": f"WITH {_CELL} SELECT strategy, endpoint, source_column, qualifier, unit, status, count(*) AS n, count(*) FILTER (WHERE endpoint = 'IC50' AND nm > 0 AND layer <> 'HTS') AS n_usable, round(sum(CASE WHEN nm > 0 THEN log10(nm) END), 4) AS log_nm, round(sum(CASE WHEN endpoint <> 'Pct_inh' THEN coalesce(direct, CASE WHEN endpoint = 'IC50' AND nm > 0 THEN 9 - log10(nm) END) END), 4) AS potency FROM s GROUP BY ALL",
    "orphan_files": """WITH f AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT c_nationkey AS k, sum(c_acctbal) AS s FROM customer GROUP BY 1), r AS (SELECT k FROM s WHERE s > (SELECT avg(s) FROM s)), x AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000)
SELECT k::varchar AS aid, CASE WHEN k IN (SELECT k FROM x) THEN 'EXCLUDED' ELSE 'ORPHAN' END AS status FROM f WHERE k IN (SELECT k FROM x) OR k NOT IN (SELECT k FROM r)""",
    "required_columns": "WITH b AS (SELECT p_brand, avg(p_size) AS s FROM part GROUP BY 1), m AS (SELECT string_agg(p_brand, '|' ORDER BY p_brand) FILTER (WHERE s <= 25) AS missing FROM b) SELECT 'sizes' AS name, coalesce(missing, '') AS missing, CASE WHEN missing IS NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM m",
    "file_places": """WITH f AS (SELECT * FROM (VALUES ('11', 'pubchem_data_set', 'F'), ('11', 'pubchem_late_data', 'O'), ('12', 'pubchem_data_set', 'P')) t(aid, label, s)), n AS (SELECT aid, label, count(o_orderkey) AS n FROM f LEFT JOIN orders ON o_orderstatus = s GROUP BY ALL)
SELECT aid, label, true AS dated, n > 0 AS filled, count(*) OVER (PARTITION BY aid) AS files, CASE WHEN count(*) OVER (PARTITION BY aid) > 1 THEN 'FAIL' WHEN n = 0 THEN 'WARN' ELSE 'PASS' END AS status FROM n""",
    "first_filled": """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN p_type || '|x' ELSE p_name END AS v FROM part) SELECT trim(v) AS value, count(*) AS n, min(p_partkey) AS first FROM v GROUP BY 1""",
    "stop_gate": """WITH b AS (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT sum(n)::bigint AS rows, string_agg('balance of ' || c_mktsegment, ', ' ORDER BY c_mktsegment) FILTER (WHERE abs(4500 - m) > 100) AS failed FROM b)
SELECT rows, failed IS NULL AS passed, coalesce('checks failed: ' || failed, '') AS said FROM f""",
    "property_rules": """SELECT ((p_retailprice / 3 > 500)::integer + (p_size / 6.0::double > 5)::integer + (p_partkey % 9 > 5)::integer + (p_partkey % 13 > 10)::integer) AS violations, p_size % 15 <= 10 AND p_retailprice / 8 <= 140 AS veber,
CASE WHEN p_size % 12 <= 1 THEN 'single' WHEN p_size % 12 <= 3 THEN 'small' WHEN p_size % 12 <= 8 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM part GROUP BY ALL""",
    "connected_parts": f"""WITH RECURSIVE {_GRAPHS}, c AS (SELECT graph, node FROM gn WHERE label = 'C'), e AS (SELECT ge.graph, a, b FROM ge JOIN c x ON x.graph = ge.graph AND x.node = a JOIN c y ON y.graph = ge.graph AND y.node = b),
w AS (SELECT graph, a AS node, b AS other FROM e UNION ALL SELECT graph, b, a FROM e), r AS (SELECT graph, min(node) AS node FROM c GROUP BY graph UNION SELECT w.graph, w.other FROM r JOIN w ON w.graph = r.graph AND w.node = r.node),
n AS (SELECT graph, count(*) AS n FROM c GROUP BY graph), m AS (SELECT graph, count(*) AS m FROM r GROUP BY graph) SELECT n AS n_nodes, n = m AS connected, count(*) AS n, min(n.graph) AS first FROM n JOIN m USING (graph) GROUP BY 1, 2""",
    "fisher_large": """WITH y AS (SELECT l_returnflag, coalesce(sum(floor(l_extendedprice / 100)) FILTER (WHERE l_linenumber % 2 = 0 AND l_orderkey % 2 = 0), 0)::bigint AS a, coalesce(sum(floor(l_extendedprice / 100)) FILTER (WHERE NOT (l_linenumber % 2 = 0 AND l_orderkey % 2 = 0)), 0)::bigint AS b FROM lineitem GROUP BY 1),
q AS (SELECT l_returnflag, a, b, (sum(a) OVER () - a)::bigint AS c, (sum(b) OVER () - b)::bigint AS d FROM y), h AS (SELECT *, a + b AS ab, a + c AS ac, d - a AS da, lgamma(a + b + 1.0) + lgamma(c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) - lgamma(a + b + c + d + 1.0) AS k FROM q),
o AS (SELECT *, k - lgamma(a + 1.0) - lgamma(b + 1.0) - lgamma(c + 1.0) - lgamma(d + 1.0) AS own FROM h),
x AS (SELECT o.*, x, k - lgamma(x + 1.0) - lgamma(ab - x + 1.0) - lgamma(ac - x + 1.0) - lgamma(da + x + 1.0) AS l FROM o, LATERAL (SELECT unnest(range(greatest(0, -da), least(ab, ac) + 1)) AS x) t),
t AS (SELECT l_returnflag, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, max(l) AS top FROM x WHERE l <= own + 1e-7 GROUP BY l_returnflag),
s AS (SELECT x.l_returnflag, sum(exp(l - top)) AS s FROM x JOIN t USING (l_returnflag) WHERE l <= own + 1e-7 AND l > top - 60 GROUP BY 1)
SELECT l_returnflag, a, b, c, d, round(a::double * d / (b::double * c), 3) AS odds, round(least(0, (top + ln(s)) / ln(10)), 3) AS log10_p FROM t JOIN s USING (l_returnflag)""",
    "density_scott": "WITH x AS (SELECT log10(n_chars) AS v FROM documents), " + _DENSITY.format(width="stddev_samp(v) * pow(count(v), -0.2::double)", low="0.0::double", high="6.0::double", steps=60, digits=5),
    "density_fixed": "WITH x AS (SELECT o_totalprice AS v FROM orders), " + _DENSITY.format(width="9000.0::double", low="0.0::double", high="600000.0::double", steps=120, digits=10),
    "lineitem_digest": """WITH c AS (SELECT unnest([l_orderkey::varchar, l_partkey::varchar, l_linenumber::varchar, l_returnflag, round(l_quantity * 100)::bigint::varchar]) AS v, unnest([1, 2, 3, 4, 5]) AS i, row_number() OVER () AS r FROM lineitem),
h AS (SELECT r, sha256(string_agg(coalesce(length(v) || ':' || v || ';', '~;'), '' ORDER BY i)) AS h FROM c GROUP BY r), k AS (SELECT h, count(*) AS k FROM h GROUP BY h),
l6 AS (SELECT h[1:6] AS p, sha256(string_agg(h || 'x' || k, ',' ORDER BY h)) AS d, sum(k) AS k FROM k GROUP BY 1), l3 AS (SELECT p[1:3] AS p, sha256(string_agg(d, ',' ORDER BY l6.p)) AS d, sum(k) AS k FROM l6 GROUP BY 1)
SELECT sum(k)::bigint AS n, sha256(string_agg(d, ',' ORDER BY p)) AS root FROM l3""",
    "versioned_table": "SELECT version, count(*) FILTER (WHERE s_acctbal > least_) AS n, round(sum(s_acctbal) FILTER (WHERE s_acctbal > least_), 2) AS balance, true AS conflict FROM supplier, (VALUES ('newest', 5000), ('pinned', 0), ('first', -1000000)) t(version, least_) GROUP BY version",
}
