"""Hand-computed cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import structures as X
from tessera.functions import values as V
from tessera.operators import activities, checks, consensus, landscape, lookup, similarity, statistics
from tessera.sources import files
from tessera.streaming.replicates import windowed_replicates


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,expected",
    [("", ("", None, "NO_VALUE")), (None, ("", None, "NO_VALUE")), (">50", (">", 50.0, "OK")), ("<= 3.5", ("<", 3.5, "OK")), ("=7", ("", 7.0, "OK")), (">", (">", None, "QUALIFIER_ONLY")), ("abc", ("", None, "PARSE_ERROR"))],
)
def test_parse_value(spark, text, expected):
    assert tuple(one(spark, V.parse_value(F.lit(text).cast("string")))) == expected


@pytest.mark.parametrize("value,unit,expected", [(2.0, "uM", (2000.0, "OK")), (2.0, " Micro Molar", (2000.0, "OK")), (2.0, "ug/mL", (None, "UNCONVERTIBLE_UNITS")), (None, "nM", (None, "NO_VALUE"))])
def test_units(spark, value, unit, expected):
    assert tuple(one(spark, V.convert_units(F.lit(value).cast("double"), F.lit(unit)))) == expected


def test_small_functions(spark):
    assert one(spark, V.endpoint_name(F.lit(" % Inhibition"))) == "Pct_inh"
    assert one(spark, V.endpoint_name(F.lit(" odd "))) == "odd"
    assert one(spark, V.cut_at_bar(F.lit("a b |c"))) == "a b"
    assert one(spark, V.nonempty(F.lit(" "), F.lit(" x "))) == "x"
    assert one(spark, V.pair_label(F.lit("b"), F.lit("a"))) == "a|b"
    assert one(spark, V.sali(F.lit(1.0), F.lit(1.0))) is None
    assert one(spark, V.p_text(F.lit(0.0004))) == "< 0.001" and one(spark, V.p_text(F.lit(0.25))) == "0.250"
    scores = {"bindingdb|chembl|pubchem_confirmatory": 0.3, "bindingdb|chembl": 0.6}
    got = [one(spark, V.overlap_score(F.lit(s), scores, 0.7)) for s in ("bindingdb|chembl|pubchem_confirmatory", "chembl", "chembl|pubchem_confirmatory", "chembl|bindingdb")]
    assert got == [0.3, 1.0, 0.7, 0.6]
    tiers = [one(spark, V.tier(F.lit(c), F.lit(d))) for c, d in ((True, 2.0), (True, 1.5), (True, 1.0), (False, 3.0))]
    assert tiers == ["severe", "moderate", "broad", "non_cliff"]
    assert one(spark, V.differs(F.lit(None).cast("double"), F.lit(1.0), 0.1)) is False


def test_consensus_keeps_its_grains(spark):
    rows = [("E", s, a, "IC50", v, q, "OK", True) for s, a, v, q in (("S1", "a1", 100.0, ""), ("S1", "a1", 1000.0, "<="), ("S1", "a2", 10.0, ">"), ("S2", "b1", 1000.0, ""))] + [(None, "S1", "a1", "IC50", 5.0, "", "OK", True)]
    df = spark.createDataFrame(rows, "entity string, source string, assay string, endpoint string, value double, qualifier string, status string, usable boolean")
    rep = consensus.replicates(df)
    src = {r["source"]: r for r in consensus.by_source(rep).collect()}
    assert src["S1"]["potency_source"] == pytest.approx(7.25) and src["S1"]["assay_spread"] == pytest.approx(1.5) and src["S1"]["high_variance"]
    assert {r["assay"]: r["any_qualifier"] for r in rep.collect()} == {"a1": "<", "a2": ">", "b1": ""}
    (e,) = consensus.by_entity(consensus.by_source(rep)).collect()
    assert e["consensus"] == pytest.approx(6.625) and e["spread"] == pytest.approx(1.25)
    assert e["discordant"] and not e["concordant"] and not e["high_confidence"] and e["source_list"] == "S1|S2"


def test_worst_status(spark):
    rows = [("e", "s", "a", "p", 1.0, "", s, True) for s in ("OK", "QUALIFIER_ONLY", "NO_VALUE")]
    df = spark.createDataFrame(rows, "entity string, source string, assay string, endpoint string, value double, qualifier string, status string, usable boolean")
    assert consensus.replicates(df).first()["worst_status"] == "QUALIFIER_ONLY"


def test_set_pairs_are_exact(spark):
    import random

    rnd = random.Random(5)
    sets = [(i, sorted(rnd.sample(range(30), rnd.randint(1, 12)))) for i in range(120)] + [(500, list(range(10))), (501, list(range(3, 13)))]
    df = spark.createDataFrame(sets, "id long, features array<long>")
    for num, den in ((7, 13), (6, 10), (1, 2)):
        expected = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) * den >= len(set(x) | set(y)) * num}
        assert {(r["a"], r["b"]) for r in similarity.set_pairs(df, num, den).collect()} == expected
    assert (500, 501) in {(r["a"], r["b"]) for r in similarity.set_pairs(df, 7, 13).collect()}


def test_graph_and_diversity(spark):
    edges = spark.createDataFrame([("h1", "x"), ("h1", "y"), ("h1", "h2"), ("z", "w")], "a string, b string")
    r = landscape.hub_share(edges, 1).first()
    assert (r["n_edges"], r["hub_degree"], r["degree_share"]) == (4, 3, 0.75)
    r = landscape.diversity(spark.createDataFrame([(1,), (1,), (2,)], "n long")).first()
    assert r["gini"] == pytest.approx(1 / 6) and r["groups"] == 3 and r["singleton_share"] == pytest.approx(2 / 3)


def test_bh(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r["k"]: round(r["q"], 9) for r in statistics.bh_adjust(df, "p", "k").collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}


def test_fisher_and_tail(spark):
    r = statistics.fisher(spark.createDataFrame([(3, 1, 1, 3)], "a long, b long, c long, d long")).first()
    assert r["p"] == pytest.approx(0.4857142857, rel=1e-6) and r["odds"] == 9.0
    assert one(spark, statistics.normal_tail(F.lit(1.959964))) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("x,df,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (18.307038, 10, 0.05), (24.724970, 11, 0.01)])
def test_chi_square_tail(spark, x, df, p):
    assert one(spark, statistics.chi_square_tail(F.lit(x), F.lit(df))) == pytest.approx(p, abs=2e-6)


def test_lookups(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, "b"), ("k", 3, "c")], "k string, o int, v string")
    assert lookup.first_wins(df, ["k"], "v", ["o"]).first()["v"] == "b"
    assert lookup.last_wins(df, ["k"], "v", ["o"]).first()["v"] == "c"
    assert lookup.pick(df, ["k"], [F.asc("o")]).first()["o"] == 1


def test_checks(spark):
    row = spark.createDataFrame([(3,)], "n int")
    made = checks.claims(row, checks.claim("good", F.lit(3), F.col("n")), checks.claim("off", F.lit(5), F.col("n"), 1.0))
    assert {r["metric"]: r["status"] for r in made.collect()} == {"good": "PASS", "off": "FAIL"}
    with pytest.raises(AssertionError, match="off"):
        checks.gate(made)


def test_preamble_csv_and_inventory(spark, tmp_path):
    one_, two = tmp_path / "Con A", tmp_path / "HTS"
    one_.mkdir(), two.mkdir()
    (one_ / "AID_11_datatable_all.csv").write_bytes(b'note\nPUBCHEM_SID,PUBCHEM_CID,IC50\nRESULT_TYPE,,FLOAT\n1,7,"1,5"\n-2,0,>3\nx,1,1\n\xff,1,1\n')
    (two / "AID_12_datatable_all.csv").write_text("PUBCHEM_SID,Inhibition\n5,40\n")
    rows = files.preamble_csv(spark, [str(one_), str(two)])
    registry = spark.createDataFrame([("11", "lab", "A"), ("12", "screen", "HTS"), ("13", "none", "D")], "aid string, source string, layer string")
    got = {r["PUBCHEM_SID"]: (r["IC50"], r["Inhibition"], r["layer"]) for r in files.with_registry(rows, registry).collect()}
    assert got == {"1": ("1,5", None, "A"), "-2": (">3", None, "A"), "5": (None, "40", "HTS")}
    assert {r["x"] for r in rows.select(files.folder_label(F.col("_path")).alias("x")).collect()} == {"pubchem_con_a", "pubchem_hts"}
    (tmp_path / "AID_99_x.csv").write_text("z")
    state = {r["aid"]: r["status"] for r in files.check_inventory(files.inventory(spark, str(tmp_path), "*.csv"), registry, 30).collect()}
    assert state == {"11": "PASS", "12": "WARN", "13": "FAIL", "99": "ORPHAN"}  # 27 bytes
    assert files.missing_columns(rows, ["PUBCHEM_SID", "nope"]) == ["nope"]
    assert files.cap_by_source(rows, "_path", ["_line"], 1).count() == 2


def test_delimited_and_sinks(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    df = files.delimited(spark, str(tmp_path / "a.tsv"))
    assert df.columns == ["x", "y"] and df.first()["y"] == "2"
    (tmp_path / "b.csv").write_text("x;y\n1;2\n")
    assert files.delimited(spark, str(tmp_path / "b.csv"), ";").first()["x"] == "1"
    at = str(tmp_path / "t")
    files.write_table(df, at)
    assert files.replace_table(spark, at, lambda t: t.withColumn("z", F.lit(1))).columns == ["x", "y", "z"]
    files.write_csv(df, str(tmp_path / "c"), ["y"])
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '{"x":"1","y":"2"}'


def test_activity_layouts(spark):
    def got(columns, row, layer="A"):
        df = spark.createDataFrame([(*row, layer)], ", ".join(f"`{c}` string" for c in [*columns, "layer"]))
        r = activities.extract(df).first()
        return r["endpoint"], r["qualifier"], r["value_nm"], r["status"], r["usable"]

    standard = ["Standard Type", "Standard Relation", "Standard Value", "Standard Units"]
    assert got(standard, ["IC50", "'>='", "2", "uM"]) == ("IC50", ">=", 2000.0, "OK", True)
    assert got(standard, ["IC50", "'='", "<2", "nM"], "HTS") == ("IC50", "<", 2.0, "OK", False)
    assert got(standard, ["Inhibition", "", "80", "%"]) == ("Pct_inh", "", None, "OK", False)
    assert got(standard, ["IC50", "", ">", "nM"])[3] == "QUALIFIER_ONLY"
    assert got(["IC50"], [">"])[3] == "NO_VALUE"
    assert got(["Average IC50"], ["3"]) == ("IC50", "", 3000.0, "OK", True)
    assert got(["pIC50_min"], ["6"])[2] == pytest.approx(1000.0)
    assert got(["Inhibition", "IC50"], ["9", ""])[3] == "NO_VALUE"  # the layout decides, not the cell
    assert got(["Inhibition at 10 uM"], ["abc"])[:4] == ("Pct_inh", "", None, "OK")
    assert got(["PUBCHEM_ACTIVITY_OUTCOME"], ["Active"])[0] == "Unknown"
    wide = spark.createDataFrame([("m", " 5", "", ">3", None)], "id string, `Ki (nM)` string, `IC50 (nM)` string, `Kd (nM)` string, e string")
    long = activities.endpoints_long(wide, {"Ki (nM)": "Ki", "IC50 (nM)": "IC50", "Kd (nM)": "Kd"})
    assert {(r["endpoint"], r["qualifier"], r["value_nm"]) for r in long.collect()} == {("Ki", "", 5.0), ("Kd", ">", 3.0)}


def test_structures_without_a_toolkit(spark):
    assert one(spark, X.tanimoto(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, X.rule_of_five(F.lit(600), F.lit(6), F.lit(1), F.lit(1))) == 2
    assert one(spark, X.size_class(F.lit(3))) == "small"
    edge = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    bonds = F.array(edge(1, 2), edge(2, 3), edge(4, 5))
    assert one(spark, X.connected(bonds, F.array(*(F.lit(x) for x in (1, 2, 3))))) is True
    assert one(spark, X.connected(bonds, F.array(*(F.lit(x) for x in (1, 2, 4))))) is False
    if not X.available():
        with pytest.raises(RuntimeError):
            X.descriptors(F.lit("C"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24), f"k{i % 2}", float(10 ** (1 + i % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    made = windowed_replicates(stream, "ts", ["k"], "value")
    q = made.writeStream.format("memory").queryName("replicates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"].day, r["k"]): (r["n_replicates"], r["potency"]) for r in spark.table("replicates").collect()}
    expected = df.groupBy(F.dayofmonth("ts").alias("d"), "k").agg(F.count("*").alias("n"), (9 - F.avg(F.log10("value"))).alias("p")).collect()
    assert got.keys() == {(r["d"], r["k"]) for r in expected}
    for r in expected:
        n, p = got[(r["d"], r["k"])]
        assert n == r["n"] and p == pytest.approx(r["p"])
