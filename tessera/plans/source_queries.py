"""Queries that write files from the tables to the shared folder and read them back through the sources, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators import activities
from tessera.plans.bindings import rounded, table
from tessera.sources import files

QUERIES: dict = {}
ORACLE: dict = {}

#: aid, status of its orders, source, layer; 104 is not registered.
REGISTRY = (("101", "F", "lab", "A"), ("102", "O", "screen", "HTS"), ("103", "P", "lab", "D"), ("105", "X", "none", "E"))
LAYOUTS = (("101", "F", "IC50"), ("102", "O", "Inhibition"), ("103", "P", "PubChem Standard Value"), ("104", "F", "IC50"))


def _registry(spark):
    return spark.createDataFrame([(a, s, layer) for a, _, s, layer in REGISTRY], "aid string, source string, layer string")


def _assay_files(spark, d) -> list[str]:
    """A file (in parts) for each layout: two lines of notes, the header, a line of types, and the orders of its status."""
    base, o = files.scratch(spark, "assays"), table(spark, d, "orders")
    made = []
    for aid, status, column in LAYOUTS:
        head = ["exported table", "notes, with commas", f"PUBCHEM_SID,{column},COMMENT", "RESULT_TYPE,FLOAT,STRING"]
        value = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.round("o_totalprice", 0).cast("long").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""x"""')))
        path = f"{base}/Data Set/AID_{aid}_datatable_all.csv"
        files.write_lines(o.filter(F.col("o_orderstatus") == status).select(value), head, path)
        made.append(path)
    return made


def preamble_csv_scan(spark, d):
    rows = files.preamble_csv(spark, _assay_files(spark, d), in_parts=True)
    return rows.groupBy(files.file_id(F.col("_path")).alias("aid")).agg(
        F.count("*").alias("n"), F.sum(F.col("PUBCHEM_SID").cast("long")).alias("sids"), F.sum(F.col("IC50").cast("long")).alias("ic50"),
        F.sum(F.col("Inhibition").cast("long")).alias("inhibition"), F.max("COMMENT").alias("comment"),
    )


def registry_union(spark, d):
    rows = files.with_registry(files.preamble_csv(spark, _assay_files(spark, d), in_parts=True), _registry(spark))
    return rows.groupBy("source", "layer").agg(F.count("*").alias("n"), F.count_distinct("aid").alias("files"))


def layout_extraction(spark, d):
    """Each layout's rows through its own strategy, then together."""
    made = None
    for path in _assay_files(spark, d):
        rows = files.with_registry(files.preamble_csv(spark, path, in_parts=True), _registry(spark))
        own = activities.extract(rows).select("aid", "endpoint", "unit", "status", "value_nm", "potency", "usable")
        made = own if made is None else made.unionByName(own)
    made = made.groupBy("aid", "endpoint", "unit", "status").agg(F.count("*").alias("n"), F.count_if("usable").alias("n_usable"), F.sum("value_nm").alias("nm"), F.avg("potency").alias("potency"))
    return rounded(made, "potency")


def file_inventory(spark, d):
    paths = _assay_files(spark, d)
    found = files.whole_files(files.inventory(spark, paths[0].rsplit("/", 2)[0], "part-*"))
    rows = files.preamble_csv(spark, paths, in_parts=True)
    checked = files.check_files(rows, found, ["PUBCHEM_SID", "IC50"], 200)
    checked = checked.select(files.file_id(F.col("path")).alias("aid"), F.col("rows"), F.array_join("missing", "|").alias("missing"), F.col("status").alias("content"))
    listed = files.check_inventory(found, _registry(spark), 10).select("aid", "files", "status")
    return listed.join(checked, "aid", "left")


def unregistered_files(spark, d):
    found = files.whole_files(files.inventory(spark, _assay_files(spark, d)[0].rsplit("/", 2)[0], "part-*"))
    excluded = spark.createDataFrame([("102",), ("999",)], "aid string")
    return files.unregistered(found, _registry(spark), excluded).select("aid", "status")


def delimited_scan(spark, d):
    """A table written with semicolons and with tabs, read by types and columns."""
    base, c = files.scratch(spark, "delimited"), table(spark, d, "customer")
    c.write.option("header", True).option("sep", ";").csv(f"{base}/one.csv")
    c.write.option("header", True).option("sep", "\t").csv(f"{base}/two.tsv")
    types = {"c_acctbal": "double", "c_custkey": "long", "c_name": "int"}
    one = files.delimited(spark, f"{base}/one.csv", ";", types, ["c_mktsegment", "c_acctbal", "c_name"]).groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("balance"), F.count("c_name").alias("n_numbers"))
    two = files.delimited(spark, f"{base}/two.tsv", types=types, columns=["c_custkey", "c_mktsegment"]).groupBy("c_mktsegment").agg(F.sum("c_custkey").alias("keys"))
    return rounded(one.join(two, "c_mktsegment"), "balance", digits=2)


def sinks_round_trip(spark, d):
    base, p = files.scratch(spark, "sinks"), table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    files.write_table(p, f"{base}/table")
    files.write_csv(p, f"{base}/csv", ["p_retailprice", "p_partkey"])
    files.write_json(p, f"{base}/json")
    counted = lambda df, name: df.agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.sum(F.col("p_partkey").cast("long")).alias("keys"), F.round(F.sum(F.col("p_retailprice").cast("double")), 2).alias("price"))
    text = spark.read.text(f"{base}/json").select(F.from_json("value", "p_partkey long, p_retailprice double").alias("r")).select("r.*")
    csv = files.delimited(spark, f"{base}/csv")
    assert csv.columns == ["p_retailprice", "p_partkey"]
    return counted(spark.read.parquet(f"{base}/table"), "table").unionByName(counted(csv, "csv")).unionByName(counted(text, "json"))


def replaced_table(spark, d):
    path = files.scratch(spark, "replaced")
    files.write_table(table(spark, d, "supplier"), path)
    made = files.replace_table(spark, path, lambda t: t.filter("s_acctbal > 0").withColumn("grade", F.when(F.col("s_acctbal") > 5000, "high").otherwise("low")))
    return made.groupBy("grade").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


def materialised_table(spark, d):
    """The second call reads what the first has written; its own plan is never run."""
    path = files.scratch(spark, "materialised")
    files.materialised(spark, path, lambda: table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return files.materialised(spark, path, lambda: spark.range(0).select(F.lit(0).alias("n_regionkey"), "id"))


def export_package(spark, d):
    names = ("nation", "region", "supplier")
    at = files.export_package({n: table(spark, d, n) for n in names}, files.scratch(spark, "package"), {"supplier": ["s_suppkey", "s_nationkey"]})
    made = None
    for name, path in at.items():
        rows = files.delimited(spark, path)
        own = rows.agg(F.lit(name).alias("name"), F.lit(len(rows.columns)).alias("columns"), F.count("*").alias("n"))
        made = own if made is None else made.unionByName(own)
    return made


def external_columns(spark, d):
    made = files.check_columns(spark, {"part": (table(spark, d, "part"), ["p_partkey", "p_shape", "p_colour"]), "nation": (table(spark, d, "nation"), ["n_name"])})
    return made.select("name", F.array_join("missing", "|").alias("missing"), "status")


def endpoints_long(spark, d):
    """Wide to long through the library: filled cells with qualifiers parsed."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 > 0, F.concat(F.lit(">"), F.col("l_quantity").cast("long").cast("string"))).alias("Ki (nM)"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_suppkey").cast("string")).alias("IC50 (nM)"), F.when(F.col("l_linenumber") > 4, F.lit(" ")).otherwise(F.lit("n/d")).alias("Kd (nM)"))
    long = activities.endpoints_long(rows, {"Ki (nM)": "Ki", "IC50 (nM)": "IC50", "Kd (nM)": "Kd"})
    return long.groupBy("endpoint", "source_column", "qualifier", "status").agg(F.count("*").alias("n"), F.sum("value_nm").alias("total"))


for _f in (preamble_csv_scan, registry_union, layout_extraction, file_inventory, unregistered_files, delimited_scan, sinks_round_trip, replaced_table, materialised_table, export_package, external_columns, endpoints_long):
    QUERIES[_f.__name__] = _f

_FILES = "a AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{s}', '{c}')" for a, s, c in LAYOUTS) + ") t(aid, status, layout)), g AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{s}', '{layer}')" for a, _, s, layer in REGISTRY) + ") t(aid, source, layer)), f AS (SELECT a.*, o_orderkey AS sid, round(o_totalprice)::bigint AS v, o_orderpriority AS p FROM a JOIN orders ON o_orderstatus = status)"
ORACLE |= {
    "preamble_csv_scan": f"WITH {_FILES} SELECT aid, count(*) AS n, sum(sid)::bigint AS sids, sum(v) FILTER (WHERE layout = 'IC50')::bigint AS ic50, sum(v) FILTER (WHERE layout = 'Inhibition')::bigint AS inhibition, max(p || ', \"x\"') AS comment FROM f GROUP BY aid",
    "registry_union": f"WITH {_FILES} SELECT source, layer, count(*) AS n, count(DISTINCT aid) AS files FROM f JOIN g USING (aid) GROUP BY source, layer",
    "layout_extraction": f"WITH {_FILES}, x AS (SELECT f.*, g.layer, CASE layout WHEN 'Inhibition' THEN 'Pct_inh' WHEN 'IC50' THEN 'IC50' ELSE '' END AS endpoint, CASE layout WHEN 'Inhibition' THEN '%' WHEN 'IC50' THEN 'nM' ELSE 'uM' END AS unit, CASE layout WHEN 'IC50' THEN v::double WHEN 'PubChem Standard Value' THEN v * 1000.0::double END AS nm FROM f JOIN g USING (aid)) SELECT aid, endpoint, unit, 'OK' AS status, count(*) AS n, count(*) FILTER (WHERE endpoint = 'IC50' AND nm > 0 AND layer NOT IN ('HTS', 'D', 'E')) AS n_usable, sum(nm) AS nm, round(avg(CASE WHEN endpoint = 'IC50' THEN 9 - log10(nm) END), 6) AS potency FROM x GROUP BY aid, endpoint, unit",
    "file_inventory": f"WITH {_FILES}, n AS (SELECT aid, layout, count(f.sid) AS n FROM a LEFT JOIN f USING (aid, layout) GROUP BY ALL) SELECT coalesce(g.aid, n.aid) AS aid, count(n.aid) OVER (PARTITION BY coalesce(g.aid, n.aid)) AS files, CASE WHEN g.aid IS NULL THEN 'ORPHAN' WHEN n.aid IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, n AS rows, CASE WHEN n.aid IS NULL THEN NULL WHEN layout <> 'IC50' THEN 'IC50' ELSE '' END AS missing, CASE WHEN n.aid IS NULL THEN NULL WHEN n = 0 OR layout <> 'IC50' THEN 'FAIL' WHEN n < 200 THEN 'WARN' ELSE 'PASS' END AS content FROM g FULL JOIN n ON g.aid = n.aid",
    "unregistered_files": "SELECT '102' AS aid, 'EXCLUDED' AS status UNION ALL SELECT '104', 'ORPHAN'",
    "delimited_scan": "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS balance, 0::bigint AS n_numbers, sum(c_custkey)::bigint AS keys FROM customer GROUP BY 1",
    "sinks_round_trip": "SELECT s.sink, count(*) AS n, sum(p_partkey)::bigint AS keys, round(sum(p_retailprice), 2) AS price FROM part, (VALUES ('table'), ('csv'), ('json')) s(sink) GROUP BY 1",
    "replaced_table": "SELECT CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END AS grade, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier WHERE s_acctbal > 0 GROUP BY 1",
    "materialised_table": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1",
    "export_package": "SELECT 'nation' AS name, 3 AS columns, count(*) AS n FROM nation UNION ALL SELECT 'region', 2, count(*) FROM region UNION ALL SELECT 'supplier', 2, count(*) FROM supplier",
    "external_columns": "SELECT 'part' AS name, 'p_shape|p_colour' AS missing, 'FAIL' AS status UNION ALL SELECT 'nation', '', 'PASS'",
    "endpoints_long": "WITH u AS (SELECT 'Ki' AS endpoint, 'Ki (nM)' AS source_column, '>' AS qualifier, 'OK' AS status, floor(l_quantity) AS v FROM lineitem WHERE l_linenumber % 2 > 0 UNION ALL SELECT 'IC50', 'IC50 (nM)', '', 'OK', l_suppkey FROM lineitem WHERE l_linenumber % 3 > 0 UNION ALL SELECT 'Kd', 'Kd (nM)', '', 'PARSE_ERROR', NULL FROM lineitem WHERE l_linenumber <= 4) SELECT endpoint, source_column, qualifier, status, count(*) AS n, sum(v)::double AS total FROM u GROUP BY ALL",
}
