"""Scans, dense pairs, nulls, percentiles, tails, densities, graphs, records and versions against brute force."""

import csv
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import digests, graphs, nulls, scan, similarity, statistics
from tessera.sources import files, versions


@pytest.mark.parametrize("n", [0, 1, 500])
def test_scan_over_many_ranges(spark, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["a", "a", "b", None]), rnd.choice([None, rnd.random()]), rnd.randint(0, 9), 7) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, g string, x double, v int, __t0 int").repartition(5)
    order = lambda r: (r[2] is not None, r[2] or 0, r[0])
    for group in ([], ["g"]):
        got = scan.scan(df, [F.col("x"), F.col("id")], before={"s": F.col("v")}, least={"m": F.col("v")}, group=group, ranges=4).collect()
        assert len(got) == n and all(r["__t0"] == 7 for r in got)
        for r in got:
            own = sorted((x for x in rows if not group or x[1] == r["g"]), key=order)
            at = next(i for i, x in enumerate(own) if x[0] == r["id"])
            assert r["s"] == sum(x[3] for x in own[:at]) and r["m"] == min(x[3] for x in own[: at + 1])
    if n == 500:
        assert len(scan.boundaries(df, [F.col("x"), F.col("id")], 4)) >= 3
        plan = scan.numbered(df, [F.col("x"), F.col("id")], "k", ranges=4)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.replace("Window [sum(__t", "").split("BroadcastExchange")[0]


def test_adjusted_p_over_ranges_equals_one_pass(spark):
    rnd = random.Random(2)
    p = [round(rnd.random() ** 3, 2) for _ in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    got = {r["key"]: r["q"] for r in statistics.bh_adjust(spark.createDataFrame(list(enumerate(p)), "key int, p double"), "p", "key").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    order, least, expected = sorted(range(300), key=lambda i: (p[i], i)), 1.0, {}
    for k in range(299, -1, -1):
        least = min(least, p[order[k]] * 300 / (k + 1))
        expected[order[k]] = least
    assert got == pytest.approx(expected)


# dense pairs


@pytest.mark.parametrize("num,den", [(1, 2), (7, 10), (8, 10), (9, 10), (1, 1)])
def test_dense_pairs_equal_all_pairs(spark, num, den):
    rnd = random.Random(num * 31 + den)
    base = [rnd.getrandbits(64) for _ in range(40)]
    bits = [rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(200)] + [0, 0, 1, (1 << 64) - 1]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    got = {tuple(r) for r in similarity.bit_pairs(spark.createDataFrame(list(enumerate(signed)), "id int, bits long"), num, den).collect()}
    expected = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(bits), 2):
        inter, n, m = (a & b).bit_count(), a.bit_count(), b.bit_count()
        if inter * den >= (n + m - inter) * num:
            expected.add((i, j, inter, n, m))
    assert got == expected


def test_dense_pairs_compare_few(spark):
    """Near copies of random vectors: compared pairs grow far below the square of the rows."""
    compared = {}
    for n in (2000, 8000):
        rnd = random.Random(n)
        base = [rnd.getrandbits(64) for _ in range(n // 2)]
        bits = [b ^ flip for b in base for flip in (0, 1 << rnd.randrange(64))]
        rows = [(i, b - (1 << 64) if b >> 63 else b) for i, b in enumerate(bits)]
        seen = Observation()
        found = similarity.bit_pairs(spark.createDataFrame(rows, "id int, bits long"), 9, 10, compared=seen).count()
        compared[n] = seen.get["n"]
        assert found >= n // 2 and compared[n] < n * n / 500
    plans = [similarity.chunk_plan(64, {32: n}, 9, 10) for n in (10**4, 10**6, 10**8)]
    assert plans == sorted(plans, reverse=True) and plans[-1] < plans[0]  # fewer, longer chunks for more rows: the share of all pairs falls


# nulls


def test_bijection_deals_each_place_once_and_evenly():
    for n in (1, 2, 3, 7, 10, 64, 101):
        at = nulls.bijection(np.arange(n), n, 0, np.arange(300)[:, None], 42)
        assert (np.sort(at, axis=1) == np.arange(n)).all()
    at = nulls.bijection(np.arange(10), 10, 0, np.arange(1, 20001)[:, None], 42)
    cells = np.array([[(at[:, i] == p).sum() for p in range(10)] for i in range(10)])
    assert ((cells - 2000) ** 2 / 2000).sum() < 160  # 81 degrees of freedom
    both = np.array([((at[:, 0] == p) & (at[:, 1] == q)).sum() for p in range(10) for q in range(10) if p != q])
    assert ((both - 20000 / 90) ** 2 / (20000 / 90)).sum() < 160  # 89


@pytest.mark.parametrize("group", [None, "g"])
def test_null_counts_on_every_path(spark, monkeypatch, group):
    rnd = random.Random(4)
    nodes = [(i * 3, float(rnd.randint(0, 9)) if i else None, rnd.choice(["x", "y", None])) for i in range(40)]
    edges = [tuple(3 * k for k in sorted(rnd.sample(range(40), 2))) for _ in range(120)]
    n, e = spark.createDataFrame(nodes, "id int, value double, g string"), spark.createDataFrame(edges, "a int, b int").repartition(3)
    value = {i: v for i, v, _ in nodes}
    far = lambda v: sum(v[a] is not None and v[b] is not None and abs(v[a] - v[b]) >= 4 for a, b in edges)
    held = {r["rep"]: r["n"] for r in nulls.permutation_null(n, e, 4.0, 20, group).collect()}
    hubs = {r["rep"]: r["n"] for r in nulls.hub_null(n, e, 4.0, 20, group=group).collect()}
    assert held[0] == far(value) and set(held) == set(range(21))
    placed = sorted(nulls.placed(n, group).collect(), key=lambda r: r["i"] + r["offset"])
    for rep in range(1, 21):
        dealt = {r["id"]: placed[int(nulls.bijection(r["i"], r["n"], r["offset"], rep, 42)) + r["offset"]]["value"] for r in placed}
        assert held[rep] == far(dealt)
        if group:
            of = {i: g for i, _, g in nodes}
            for g in ("x", "y", None):
                own = lambda d: sorted((d[i] is not None, d[i] or 0) for i in d if of[i] == g)  # noqa: E731, B023
                assert own(dealt) == own(value)
    monkeypatch.setattr(nulls, "MOST_VALUES", 3)
    assert {r["rep"]: r["n"] for r in nulls.permutation_null(n, e, 4.0, 20, group).collect()} == held
    assert {r["rep"]: r["n"] for r in nulls.hub_null(n, e, 4.0, 20, group=group).collect()} == hubs


# statistics


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_percentiles_are_exact(spark, accuracy):
    rnd = random.Random(accuracy)
    rows = [(g, rnd.choice([round(rnd.gauss(0, 1), 1), rnd.random() * 100, 5.0])) for g in ("a", "b", None) for _ in range({"a": 3000, "b": 70}.get(g, 1))] + [("c", None)]
    df, points = spark.createDataFrame(rows, "n string, v double").repartition(7), [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["n"]: tuple(r)[1:] for r in statistics.percentiles(df, "v", points, ["n"], accuracy).collect()}
    expected = {g: tuple(np.quantile([v for k, v in rows if k == g and v is not None], points)) for g in ("a", "b", None)}
    assert {k: pytest.approx(v) for k, v in expected.items()} == got
    one = statistics.percentiles(df, "v", points, accuracy=accuracy).first()
    assert tuple(one) == pytest.approx(tuple(np.quantile([v for _, v in rows if v is not None], points)))


def test_fisher_tail_equals_the_sum_over_all_tables():
    rnd = random.Random(3)
    for _ in range(300):
        a, b, c, d = (rnd.choice((0, 1, rnd.randint(0, 12), rnd.randint(0, 60))) for _ in range(4))
        ways = lambda x: Fraction(math.comb(a + b, x) * math.comb(c + d, a + c - x))  # noqa: E731, B023
        xs = range(max(0, a - d), min(a + b, a + c) + 1)
        p = sum(w for x in xs if (w := ways(x)) <= ways(a) * Fraction(10000001, 10000000)) / sum(map(ways, xs))
        got = statistics.fisher_tail(a, b, c, d)
        assert got[0] == pytest.approx(float(p), rel=1e-9) and got[1] == pytest.approx(math.log10(p), abs=1e-8)
    p, log = statistics.fisher_tail(5_000_000, 5_000_000, 4_990_000, 5_010_000)
    assert 0 < p < 1e-3 and log == pytest.approx(math.log10(p))
    assert statistics.fisher_tail(9_000_000, 1_000_000, 1_000_000, 9_000_000)[1] < -1e6


def test_binned_density_is_near_the_exact_one(spark):
    rnd = random.Random(5)
    values = [rnd.gauss(2, 1) for _ in range(400)] + [50.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    for width in (0.3, None):
        w = width or float(np.std(known, ddof=1)) * len(known) ** -0.2
        got = {r["i"]: r["density"] for r in statistics.binned_density(df, "v", -1.0, 5.0, 30, width).collect()}
        exact = {i: sum(math.exp(-(((-1 + i * 0.2) - v) / w) ** 2 / 2) for v in known) / (len(known) * w * math.sqrt(2 * math.pi)) for i in range(31)}
        assert got == pytest.approx(exact, abs=2e-5)
    assert statistics.binned_density(df.filter("v > 49"), "v", 0.0, 1.0, 2).collect()[0]["density"] is None


# graphs


def random_graphs(rnd, n):
    nodes, edges = [], []
    for g in range(n):
        k = rnd.randint(1, 9)
        nodes += [(g, v, rnd.choice("CCNO")) for v in range(k)]
        edges += [(g, a, b, rnd.choice("-=")) for a, b in itertools.combinations(range(k), 2) if rnd.random() < 1.6 / k]
    return nodes, edges


def test_two_core_and_scaffolds(spark):
    nodes, edges = random_graphs(random.Random(6), 40)
    nodes += [(100, v, "C") for v in range(12)] + [(101, v, "C") for v in (5, 6, 7, 8)]
    edges += [(100, v, v + 1, "-") for v in range(11)] + [(101, 5, 6, "-"), (101, 6, 7, "-"), (101, 5, 7, "-"), (101, 7, 8, "-")]
    n, e = spark.createDataFrame(nodes, "graph int, node int, label string"), spark.createDataFrame(edges, "graph int, a int, b int, label string")
    left = set(edges)
    while True:
        degree = {}
        for g, a, b, _ in left:
            for v in (a, b):
                degree[g, v] = degree.get((g, v), 0) + 1
        kept = {x for x in left if degree[x[0], x[1]] > 1 and degree[x[0], x[2]] > 1}
        if kept == left:
            break
        left = kept
    assert {tuple(r) for r in graphs.two_core(e).collect()} == left
    found = {r["graph"]: r for r in graphs.scaffolds(n, e).collect()}
    assert set(found) == {x[0] for x in left} and 100 not in found and 101 in found


def test_environments_know_isomorphic_graphs(spark):
    rnd = random.Random(7)
    nodes, edges = random_graphs(rnd, 25)
    sizes = {g: 1 + max(v for h, v, _ in nodes if h == g) for g in range(25)}
    moved = {g: rnd.sample(range(k), k) for g, k in sizes.items()}
    nodes += [(g + 1000, moved[g][v], x) for g, v, x in nodes]
    edges += [(g + 1000, *sorted((moved[g][a], moved[g][b])), x) for g, a, b, x in edges]
    n, e = spark.createDataFrame(nodes, "graph int, node int, label string"), spark.createDataFrame(edges, "graph int, a int, b int, label string")
    codes = graphs.environments(n, e, 2)
    keys = {r["graph"]: r["key"] for r in graphs.graph_key(codes, "code2").collect()}
    features = {r["graph"]: set(r["features"]) for r in graphs.fingerprints(codes, 2).collect()}
    assert all(keys[g] == keys[g + 1000] and features[g] == features[g + 1000] for g in range(25))
    assert len(set(keys.values())) > 15
    near = graphs.graph_key(graphs.environments(n.filter("graph < 25").withColumn("label", F.when((F.col("graph") == 3) & (F.col("node") == 0), "S").otherwise(F.col("label"))), e, 2), "code2")
    changed = {r["graph"]: r["key"] for r in near.collect()}
    assert [g for g in range(25) if changed[g] != keys[g]] == [3]


def test_longest_common_equals_the_table(spark):
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 90))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        one, two = graphs.longest_common(a, b)
        assert len(one) == table[-1][-1] and [a[i] for i in one] == [b[j] for j in two]
        assert one == sorted(set(one)) and two == sorted(set(two))
    df = spark.createDataFrame([(["x", "y"], ["y", "z"]), (None, ["y"]), ([], [])], "a array<string>, b array<string>")
    got = [tuple(r["p"]) for r in df.select(graphs.common_part(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [(1, [0], [1]), (0, [], [0]), (0, [], [])]


def test_connected_subsets(spark):
    nodes, edges = random_graphs(random.Random(9), 30)
    subset = [(g, v) for g, v, x in nodes if x == "C"]
    got = {r["graph"]: (r["n_nodes"], r["connected"]) for r in graphs.connected_subset(spark.createDataFrame(subset, "graph int, node int"), spark.createDataFrame(edges, "graph int, a int, b int, label string")).collect()}
    for g in {s[0] for s in subset}:
        own = {v for h, v in subset if h == g}
        reached = {min(own)}
        while more := {y for h, a, b, _ in edges if h == g for x, y in ((a, b), (b, a)) if x in reached and y in own} - reached:
            reached |= more
        assert got[g] == (len(own), reached == own)


# records, digests, versions


def test_records_that_span_lines_and_blocks(spark, tmp_path):
    rnd = random.Random(10)
    cell = lambda: rnd.choice(["", "x", '5" wide', '"a,b"', '"one\ntwo"', '"he said ""no""\n\n,end"', '""', '"\n"', "plain text " * 9])
    paths = []
    for k in range(4):
        lines = ["note " + '"' * (k % 2), "PUBCHEM_SID,A,B"] + [f"{i},{cell() if k else 'x'},{cell() if k else 'y'}" for i in range(400)]
        path = f"{tmp_path}/AID_{k}_datatable_all.csv"
        with open(path, "w") as f:
            f.write("\n".join(lines) + ("\n" if k % 2 else ""))
        paths.append(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = files.preamble_csv(spark, paths)
        got = {(files_id(r["_path"]), int(r["PUBCHEM_SID"])): (r["A"], r["B"]) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = {}
    for k, path in enumerate(paths):
        with open(path, newline="") as f:
            for row in csv.DictReader(f.read().splitlines()[1:]):
                if row["PUBCHEM_SID"].strip().isdigit():
                    expected[k, int(row["PUBCHEM_SID"])] = (row["A"].strip(), row["B"].strip())
    assert set(got) == set(expected)
    assert {k: tuple(x or "" for x in v) for k, v in got.items()} == expected


def files_id(path):
    return int(path.rsplit("AID_", 1)[1].split("_")[0])


def test_table_digest_is_of_the_rows_alone(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 30), rnd.choice(["a", "", None, "1:b"])) for _ in range(300)]
    root = lambda r, parts: tuple(digests.table_digest(spark.createDataFrame(r, "i int, s string").repartition(parts), levels=(2, 1)).first())
    first = root(rows, 3)
    assert first[0] == 300 and root(rows[::-1], 7) == first and root(rows[:-1], 3) != first
    assert root(rows[:-1] + [(rows[-1][0], "other")], 3) != first
    assert root([(1, None)], 1) != root([(1, "~")], 1) and root([(1, "x")], 1) != root([(1, "x")] * 2, 1)
    assert root([], 1)[0] == 0


def test_versions_survive_a_writer_that_is_killed(spark, tmp_path):
    path = f"{tmp_path}/t"
    t = versions.VersionedTable(spark, path)
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.replace(lambda _: spark.range(3)) == 1
    pinned = t.read()

    class Killed(Exception):
        pass

    def dies(_):
        raise Killed

    with pytest.raises(Killed):  # while it makes the rows
        t.replace(dies)
    bad = lambda df: df.select(F.when(F.col("id") >= 0, F.raise_error("killed")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):  # while it writes them
        t.replace(bad)
    lost = t.stage(spark.range(9))  # after writing, before the pointer
    assert t.versions() == [1] and t.read().count() == 3
    assert t.replace(lambda df: df.filter("id > 0")) == 2
    with pytest.raises(versions.Conflict):
        t.publish(lost, 2)
    assert t.read().count() == 2 and t.read(1).count() == 3 and pinned.count() == 3
    gone = t.expire(keep=1)
    assert lost in gone and t.versions() == [2] and t.read().count() == 2
    assert versions.VersionedTable(spark, path).read().count() == 2


def test_names_of_the_caller_stay(spark):
    """Operators keep columns named like their own helpers."""
    from tessera.operators import lookup

    df = spark.createDataFrame([(1, 5, "x", 9), (1, 4, "y", 8), (2, 3, "z", 7)], "k int, v int, __t0 string, _n int")
    assert sorted(map(tuple, lookup.pick(df, ["k"], [F.col("v")]).collect())) == [(1, 4, "y", 8), (2, 3, "z", 7)]
    marked = lookup.mark(df, spark.createDataFrame([(2, "q")], "k int, _in string"), "k", "there")
    assert sorted((r["__t0"], r["there"]) for r in marked.collect()) == [("x", False), ("y", False), ("z", True)]
    made = lookup.first_found(df, ["k"], [("one", spark.createDataFrame([(1, 50)], "k int, w int"))], {"w": F.col("v")})
    assert sorted((r["__t0"], r["w"], r["found_in"]) for r in made.collect()) == [("x", 50, "one"), ("y", 50, "one"), ("z", 3, "computed")]
    assert files.cap_by_source(df, "k", ["v"], 1).columns == df.columns
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 1), (1, 2)], "a int, b int")
    items = spark.createDataFrame([(1, "i"), (1, "j"), (2, "j"), (3, "k"), (4, None)], "k int, i string")
    assert sorted(map(tuple, lookup.shares_any(pairs, items, "k", "i").collect())) == [(1, 2, True), (1, 2, True), (1, 3, False), (4, 1, False)]


def test_patterns_cuts_and_descriptors(spark):
    nodes, edges = random_graphs(random.Random(12), 35)
    n, e = spark.createDataFrame(nodes, "graph int, node int, label string"), spark.createDataFrame(edges, "graph int, a int, b int, label string")
    label = {(g, v): x for g, v, x in nodes}
    bond = {(g, *p): x for g, a, b, x in edges for p in ((a, b), (b, a))}
    size = {g: sum(1 for h, _, _ in nodes if h == g) for g in range(35)}
    for labels, bonds in ((["C", None, "N"], [(0, 1, "-"), (1, 2, None)]), ([None, "C", None], [(0, 1, None), (1, 2, None), (2, 0, "=")]), (["O"], []), (["C", "C", "C", None], [(1, 0, None), (2, 1, None), (1, 3, "=")])):
        expected = {
            g for g in range(35) for vs in itertools.permutations(range(size[g]), len(labels))
            if all(x is None or label[g, v] == x for x, v in zip(labels, vs)) and all((g, vs[i], vs[j]) in bond and x in (None, bond[g, vs[i], vs[j]]) for i, j, x in bonds)
        }
        assert {r["graph"] for r in graphs.holding(n, e, labels, bonds).collect()} == expected

    def part(g, begin, without):
        reached = {begin}
        while more := {y for (h, x, y) in bond if h == g and x in reached and {x, y} != without} - reached:
            reached |= more
        return reached

    cuts = {(r["graph"], r["a"], r["b"]): (r["n_core"], r["n_rest"]) for r in graphs.single_cuts(n, e).collect()}
    expected = {(g, a, b): (max(len(x), len(y)), min(len(x), len(y))) for g, a, b, _ in edges for x, y in [(part(g, a, {a, b}), part(g, b, {a, b}))] if b not in x}
    assert cuts == expected
    for r in graphs.descriptors(n, e, {"C": 2.0, "N": 3.0}, ["N"]).collect():
        g = r["graph"]
        parts = len({frozenset(part(g, v, set())) for v in range(size[g])})
        own = sum(1 for h, *_ in edges if h == g)
        assert (r["n_nodes"], r["n_bonds"], r["parts"], r["rings"]) == (size[g], own, parts, own - size[g] + parts)
        assert r["mass"] == sum({"C": 2.0, "N": 3.0}.get(label[g, v], 0.0) for v in range(size[g])) and r["hetero"] == sum(label[g, v] == "N" for v in range(size[g]))
