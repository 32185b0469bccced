"""Cases that reviewers found: odd values and sizes at which a step failed."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.operators import consensus, graphs, nulls, similarity
from tessera.plans import catalog
from tessera.sources import files, records


def test_unit_convert_of_zero_equals_sql(spark, tmp_path):
    rows = [(i, kind, v) for i, (kind, v) in enumerate((k, v) for k in ("view", "click", "signup", "error", "purchase") for v in (0.0, 12.5, None))]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLE["unit_convert"])
    got = catalog.QUERIES["unit_convert"](spark, str(tmp_path)).select(*rel.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


@pytest.mark.parametrize("num,den", [(45, 100), (9, 10)])
def test_dense_pairs_bring_the_columns_of_both_ends(spark, num, den):
    rnd = random.Random(num)
    base = [rnd.getrandbits(63) for _ in range(20)]
    rows = [(i, rnd.choice(base) ^ (1 << rnd.randrange(63)), float(i % 7), str(i % 3)) for i in range(150)] + [(150 + i, base[0], float(i), "x") for i in range(5)] + [(200, None, 1.0, "y")]
    df = spark.createDataFrame(rows, "id int, bits long, value double, group string")
    got = {tuple(r) for r in similarity.bit_pairs(df, num, den, keep=("value", "group")).collect()}
    expected = set()
    for a, x, v, g in rows[:-1]:
        for b, y, w, h in rows[:-1]:
            if a < b and (inter := (x & y).bit_count()) * den >= (x | y).bit_count() * num:
                expected.add((a, b, inter, x.bit_count(), y.bit_count(), v, w, g, h))
    assert got == expected


@pytest.mark.parametrize("name", ["neighborhood", "threshold_sweep", "cohort_contribution", "edge_labels", "node_degree"])
def test_dense_pairs_are_joined_once(spark, sf_dir, name):
    """Pairs of low thresholds are a share of all pairs: values come along with the rows, no join follows."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("scale", [1.0, 1.37, 1000.0])
def test_draws_are_dealt_once_for_all_edges_of_a_task(monkeypatch, scale):
    rng, deal, calls = np.random.default_rng(6), nulls.bijection, []
    sizes, n_edges = np.array([130, 70]), 40_000
    n, offset = np.repeat(sizes, sizes), np.repeat([0, 130], sizes)
    i = np.arange(200) - offset
    values = rng.integers(-3, 7, 200) * scale
    values[[5, 150]] = np.nan
    ends = {k: rng.integers(0, 200, n_edges) for k in "ab"}
    edges = pd.DataFrame({f"{c}_{k}": x[ends[k]] for k in "ab" for c, x in (("i", i), ("n", n), ("offset", offset))})
    monkeypatch.setattr(nulls, "bijection", lambda i, *rest: calls.append(i.size) or deal(i, *rest))
    batches = (edges[low : low + 1000] for low in range(0, n_edges, 1000))
    got = sum(nulls.far_counts(held, values, 4 * scale, 30, 42) for held in nulls._held(batches))
    assert sum(calls) == 200  # each place once, for all draws
    for rep in range(31):
        at = deal(i, n, offset, rep, 42) + offset if rep else np.arange(200)
        dealt = values[at]
        assert got[rep] == (np.abs(dealt[ends["a"]] - dealt[ends["b"]]) >= 4 * scale).sum()


@pytest.mark.parametrize("name", ["matched_pairs", "discontinuity"])
def test_cores_are_not_broadcast(spark, sf_dir, name):
    """Cores are many times as long as the items' file, by which a plan would choose a broadcast through the driver."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [core" in plan


def test_graphs_in_rows_equal_rounds_over_tables(spark, monkeypatch):
    """Graphs of up to six nodes as rows and the rest by rounds give what all as rows give."""
    rnd = random.Random(6)
    nodes = [(g, v, rnd.choice("CNO")) for g in range(12) for v in range(2 + g % 7)]
    edges = [(g, a, b, rnd.choice("-=")) for g in range(12) for a in range(2 + g % 7) for b in range(a + 1, 2 + g % 7) if rnd.random() < 0.4]
    n, e = spark.createDataFrame(nodes, "graph int, node int, label string"), spark.createDataFrame(edges, "graph int, a int, b int, label string")
    steps = {"cuts": lambda: graphs.single_cuts(n, e, 1), "descriptors": lambda: graphs.descriptors(n, e, {"C": 2.0}, ["N"]), "lists": lambda: graphs.ring_lists(n, e), "scaffolds": lambda: graphs.scaffolds(n, e, 1)}
    found = []
    for bound in (32, 6):
        monkeypatch.setattr(graphs, "ROW_SIZE", bound)
        found.append({name: sorted(map(repr, map(tuple, make().collect()))) for name, make in steps.items()})
    assert found[0] == found[1]


@pytest.mark.parametrize("name", ["graph_cuts", "graph_descriptors", "graph_scaffolds", "connected_parts"])
def test_graphs_move_once(spark, sf_dir, name):
    """Lines come together by graph; the steps within graphs do not shuffle them again (the last sums may, once)."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(graph") <= 1


def test_features_move_once_and_pairs_are_made_once(spark, sf_dir):
    """Features are counted where they meet, not joined with their counts; the summary is one pass over the pairs."""
    plan = catalog.QUERIES["cliff_summary"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(features") <= 2 and "Join Cross" not in plan


@pytest.mark.parametrize("spread", [8, 0])
def test_hub_shares_of_many_edges_equal_those_by_rows(spark, monkeypatch, spread):
    """Differing edges are not written out for each draw; where the lots' bounds miss the cut (spread 0), those draws go by rows."""
    rnd = random.Random(3)
    nodes = [(f"n{i:03d}", float(rnd.randint(0, 9)) if i % 17 else None, i % 3) for i in range(60)]
    edges = [(f"n{a:03d}", f"n{b:03d}") for a in range(60) for b in range(a + 1, 60) if rnd.random() < (0.9 if a < 5 else 0.3)]
    edges += edges[:40]
    n, e = spark.createDataFrame(nodes, "id string, value double, g int"), spark.createDataFrame(edges, "a string, b string").repartition(3)
    by_rows, seen = nulls._hub_shares_by_rows, []
    monkeypatch.setattr(nulls, "_hub_shares_by_rows", lambda far, *rest: seen.append(far) or by_rows(far, *rest))
    got = {r["rep"]: r["n"] for r in nulls.hub_null(n, e, 4.0, 30, group="g", spread=spread).collect()}
    assert bool(seen) == (spread == 0)
    monkeypatch.setattr(nulls, "MOST_VALUES", 3)
    assert {r["rep"]: r["n"] for r in nulls.hub_null(n, e, 4.0, 30, group="g").collect()} == got and len(got) > 5


@pytest.mark.parametrize("name", ["preamble_csv_scan", "registry_union", "layout_extraction", "file_inventory", "quoted_line_breaks"])
def test_lines_of_files_stay_in_the_tasks_that_read_them(spark, sf_dir, name, monkeypatch):
    """No line is shuffled by its file, to be joined or put in order there."""
    made, scan = [], files.preamble_csv
    monkeypatch.setattr(files, "preamble_csv", lambda *args, **more: made.append(scan(*args, **more)) or made[-1])
    catalog.QUERIES[name](spark, sf_dir)
    for rows in made:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Window" not in plan


def test_records_go_on_over_parts_and_batches(spark, tmp_path):
    """A file in parts whose records span lines, batches, blocks and parts, one of which lies wholly within a field."""
    lines = [line for i in range(300) for line in (f'{i},"a', "b" * (i % 5), f'c ""{i}"""' if i % 3 else 'c",x')]
    parts = [lines[:100], lines[100:101], lines[101:102], ['9000,"long'], ["inside"] * 50, ['end"'], lines[102:]]
    parts = parts[:3] + [lines[102:]] + parts[3:6]
    folder = tmp_path / "AID_7_datatable_all.csv"
    folder.mkdir()
    for k, part in enumerate(parts):
        (folder / f"part-{k:05d}-x.txt").write_text("\n".join(["note", "PUBCHEM_SID,A"] * (k == 0) + part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {int(r["PUBCHEM_SID"]): r["A"] for r in files.preamble_csv(spark, str(folder), in_parts=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {i: "a" + "b" * (i % 5) + (f'c "{i}"' if i % 3 else "c") for i in range(300)}
    assert got == expected | {9000: "long" + "inside" * 50 + "end"}


def test_states_of_lines_equal_a_walk_over_them():
    rnd = np.random.default_rng(5)
    for inside in (False, True):
        out, within = rnd.random(200) < 0.5, rnd.random(200) < 0.7
        state, walked = inside, []
        for o, w in zip(out, within):
            state = bool(w if state else o)
            walked.append(state)
        assert records._states(out, within, inside).tolist() == walked


def test_set_operations_read_the_keys_once(spark, sf_dir):
    plan = catalog.QUERIES["set_operations"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


SET_QUERIES = ("sim_pairs", "sim_landscape", "cliff_tiers", "cliff_summary", "tier_totals", "sas_quadrants", "sali_topk", "sali_bands")


@pytest.mark.parametrize("name", SET_QUERIES)
def test_pairs_of_copies_equal_sql(spark, tmp_path, name):
    """Copies, near copies of other lengths, repeated ids, null ids and null lengths."""
    rnd = random.Random(23)
    base = [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(30)) for _ in range(4)]
    texts = [base[i % 4] for i in range(40)] + [base[i % 4].replace(" ", "  " * (1 + i % 5), 9) for i in range(12)] + [base[i % 4] + " end" * (i % 3) + " so" for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", None if i % 17 == 3 else len(t) * (1 + i % 4)) for i, t in enumerate(texts)]
    rows += [(5, base[1], "en", "s1", 40), (5, base[2], "en", "s1", 70), (7, "two words", "en", "s0", 9), (None, base[0], "en", "s0", 20), (90, "one", "en", "s0", 3), (91, base[3], "en", None, 50), (91, base[3], "en", None, 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*rel.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


@pytest.mark.parametrize("name", ["tier_totals", "sas_quadrants", "sali_topk", "sali_bands"])
def test_copies_are_not_written_out(spark, tmp_path, name):
    """Ten times the copies leave the rows of every join as they are, but for those of the copies themselves."""
    rnd = random.Random(27)
    base = [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(30)) for _ in range(3)]
    rows = [(i, base[i % 3], "en", "s", 100 + i % 3) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in kind:
            todo.append(node.plan())
            continue
        if "Join" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert 0 <= most <= 600  # 59,700 pairs of copies


def test_independence_score_moves_rows_once(spark, sf_dir):
    """Sources of entities need none of the grains; the groups of a whole scanned stretch are never held in one task."""
    plan = catalog.QUERIES["independence_score"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "HashAggregate(keys=[entity" in plan and "assay" not in plan.split("Exchange ")[0]


def test_source_lists_equal_those_of_the_grains(spark):
    rnd = random.Random(41)
    rows = [(rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, "A", "N", "R"]), rnd.choice([None, "x", "y"]), rnd.choice([None, "F", "O"]), 1.0, "", "OK", rnd.choice([None, True, False, False])) for _ in range(60)]
    df = spark.createDataFrame(rows, "entity long, source string, assay string, endpoint string, value double, qualifier string, status string, usable boolean")
    grains = consensus.by_entity(consensus.by_source(consensus.replicates(df))).select("entity", "source_list")
    assert sorted(map(tuple, consensus.source_lists(df).collect())) == sorted(map(tuple, grains.collect()))


@pytest.mark.parametrize("confirmed", [[(1, 6000.0), (None, 7000.0), (2, 10.0)], [(1, 6000.0), (2, 10.0)], [(1, 10.0)]])
def test_screening_index_of_null_keys_equals_sql(spark, tmp_path, confirmed):
    rnd = random.Random(21)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "view", "click"]), rnd.choice([None, 10.0, 90.0, 500.0])) for _ in range(40)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame(confirmed, "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLE["screening_index"])
    got = catalog.QUERIES["screening_index"](spark, str(tmp_path)).select(*rel.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_a_mean_at_the_limit_is_not_above_it_in_any_order(spark):
    """Seven values of two digits with the exact mean 50, in an order in which their doubles sum to more."""
    rnd = random.Random(21)
    while True:
        cents = [rnd.randrange(1, 10_000) for _ in range(6)]
        cents.append(35_000 - sum(cents))
        values = [c / 100 for c in cents]
        total = 0.0
        for v in values:
            total += v
        if 0 < cents[-1] < 40_000 and total / 7 > 50:
            break
    df = spark.createDataFrame([(1, "view", v, "") for v in values], "entity long, assay string, value double, qualifier string").coalesce(1)
    (row,) = consensus.screening_index(df, spark.createDataFrame([(1,)], "entity long")).collect()
    assert row["activity_score"] == 0 and row["confirmed"]


def equals_sql(spark, at, name: str) -> bool:
    con = duckdb.connect()
    for path in at.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}/*.parquet'")
    rel = con.sql(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, str(at)).select(*rel.columns)
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_unit_convert_of_values_between_two_rounded_ones_equals_sql(spark, tmp_path):
    values = (1092.5, 1217.5, 1437.5, 364.5, 509.5, 628.5, -1.0, float("nan"), 1e306)
    rows = [(19 * i + 1, kind, v) for i, (kind, v) in enumerate((k, v) for k in ("view", "click", "signup", "error", "purchase") for v in values)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert equals_sql(spark, tmp_path, "unit_convert")


@pytest.mark.parametrize("name", ["series_summary", "cliff_tiers", "tier_totals"])
def test_documents_of_no_characters_equal_sql(spark, tmp_path, name):
    rows = [(i, "a b c d e", f"s{i // 3}", n) for i, n in enumerate((0, 1, 5, 0, 0, 7, 0, 0, 0, None, None, 0, 0))]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert equals_sql(spark, tmp_path, name)


@pytest.mark.parametrize("least_edges", [1, 10**6])
def test_draws_are_dealt_once_for_a_group_of_tiles(spark, monkeypatch, least_edges):
    """Edges are bits of tiles, draws are spread over tasks; edges that occur several times, null values and groups count as before."""
    for name, v in (("SIDE", 64), ("GROUP", 2), ("LEAST_EDGES", least_edges)):
        monkeypatch.setattr(nulls, name, v)
    rng = np.random.default_rng(8)
    size, n_edges = 300, 3000
    values = rng.integers(0, 10, size).astype(float)
    values[[3, 99, 250]] = np.nan
    half = np.sort(rng.integers(0, 3, size))
    a, b = np.sort(rng.integers(0, size, (2, n_edges)), axis=0)
    a, b = np.append(a[a < b], a[a < b][:500]), np.append(b[a < b], b[a < b][:500])
    nodes = spark.createDataFrame([(i, None if np.isnan(v) else float(v), int(g)) for i, (v, g) in enumerate(zip(values, half))], "id int, value double, half int")
    edges = spark.createDataFrame([(int(y), int(x)) if i % 3 else (int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "a int, b int").repartition(3)
    made = nulls.permutation_null(nodes, edges, 4.0, 20, "half")
    assert "FlatMapGroupsInPandas [gx" in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["rep"]: r["n"] for r in made.collect()}
    n, offset = np.bincount(half)[half], np.searchsorted(half, half)
    for rep in range(21):
        dealt = values[nulls.bijection(np.arange(size) - offset, n, offset, rep, 42) + offset if rep else np.arange(size)]
        assert got[rep] == (np.abs(dealt[a] - dealt[b]) >= 4).sum()


def test_reference_pairs_are_not_joined_with_themselves(spark, sf_dir):
    plan = catalog.QUERIES["reference_pair_semi"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("name", ["matched_pairs", "discontinuity"])
def test_matched_pairs_of_odd_tokens_equal_sql(spark, tmp_path, name):
    """Tokens with blanks, stars and nulls may share several cores, ids may occur twice; pairs of plain items are not grouped."""
    rnd = random.Random(4)
    rows = [(i % 110, rnd.choice(["A", "A B", "*", None, "C"]) if i % 3 == 0 else rnd.choice("AC"), rnd.choice(["x", "B x", "*"]) if i % 5 == 0 else "x", rnd.choice((1, 2, None)) if i % 4 == 0 else 1, " ".join(rnd.choices("pq*" if i % 7 == 0 else "pq", k=rnd.choice((1, 2, 2)))), float(rnd.randint(1, 9)) if i % 13 else None) for i in range(118)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_name string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    assert equals_sql(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["matched_pairs", "discontinuity"])
def test_pairs_of_plain_items_are_not_shuffled(spark, tmp_path, name):
    rows = [(i, "AC"[i % 2], "xyz"[i % 3], i % 4, "p q", float(i)) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_name string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    made = catalog.QUERIES[name](spark, str(tmp_path))
    made.collect()
    shuffled = made._jdf.queryExecution().executedPlan().toString()
    rows = sum(1 for line in shuffled.split("== Initial Plan ==")[0].splitlines() if "hashpartitioning(a" in line or "hashpartitioning(other" in line)
    assert rows == 0
