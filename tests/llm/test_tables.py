"""Operators over tables against brute force, with hot groups and edge cases."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chats, imatch, minhash, queries, ranges, sharding


def frame(spark, texts, ids=None):
    rows = [((ids[i] if ids else i), t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, extra string, shard long")


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))


# sharding


def check_shards(rows, n_shards, most):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(n_shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total = sum(r["size"] for r in rows)
    for s in range(n_shards):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / n_shards) <= 2 * most


def test_sharding_is_even_with_a_hot_text(spark):
    rnd = random.Random(1)
    texts = [prose(rnd, rnd.randint(1, 60)) for _ in range(400)] + ["hot text " * 5] * 200 + [None, "", "é☃"]
    rows = sharding.shard(frame(spark, texts), 7).collect()
    assert len(rows) == len(texts) and {r["extra"] for r in rows} == {"x"}
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    check_shards(rows, 7, max(r["size"] for r in rows))
    where = {}
    for r in rows:
        if r["text"]:
            where.setdefault(r["text"], set()).add(r["shard"])
    hot = where.pop("hot text " * 5)  # larger than a shard, so that it is divided
    assert len(hot) > 1 and all(len(s) == 1 for s in where.values())


def test_groups_that_fit_a_shard_stay_whole(spark):
    rnd = random.Random(11)
    groups = {f"group {g} " + "x" * rnd.randint(10, 400): rnd.randint(2, 60) for g in range(60)}
    texts = [t for t, n in groups.items() for _ in range(n)] + [prose(rnd, 20) for _ in range(300)] + ["too large for one " * 9] * 1500
    rnd.shuffle(texts)
    rows = sharding.shard(frame(spark, texts).repartition(5), 9).collect()
    check_shards(rows, 9, max(r["size"] for r in rows))
    where = collections.defaultdict(set)
    for r in rows:
        where[r["text"]].add(r["shard"])
    assert {t for t, s in where.items() if len(s) > 1} == {"too large for one " * 9}


def test_sharding_equals_sql_where_groups_are_placed(spark, tmp_path):
    rnd = random.Random(12)
    texts = [f"group {g} " + "x" * rnd.randint(10, 200) for g in range(30) for _ in range(g)] + ["hot"] * 900 + [prose(rnd, 9) for _ in range(300)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.sql(sharding.SHARDING_SQL)
    expected = sorted((dict(zip(rel.columns, r)) for r in rel.fetchall()), key=lambda r: r["doc_id"])
    got = sorted((r.asDict() for r in queries.op1_sharding(spark, str(tmp_path)).collect()), key=lambda r: r["doc_id"])
    assert got == expected


@pytest.mark.parametrize("texts,ids", [([], None), (["a"], None), (["same"] * 50, [3] * 50), ([None] * 9, [None] * 9)])
def test_sharding_edges(spark, texts, ids):
    rows = sharding.shard(frame(spark, texts, ids), 4).collect()
    assert len(rows) == len(texts)
    if rows:
        check_shards(rows, 4, max(r["size"] for r in rows))


def test_sharding_query(spark, sf_dir):
    rows = queries.op1_sharding(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["grown_shard"] is None for r in rows)
    check_shards(rows, 40, max(r["size"] for r in rows))


def test_splitters_subdivide_overfull_ranges(spark):
    df = spark.range(3000).select((F.col("id") * F.col("id") % 977).alias("k"), F.when(F.col("id") % 977 == 0, 5000).otherwise(1).alias("w"))
    split = ranges.splitters(df, ["k"], F.col("w"), 16)
    at = [r["r"] for r in df.select("k", split.index([F.col("k")]).alias("r")).distinct().orderBy("k").collect()]
    assert at == sorted(at) and at[-1] == len(split.bounds)
    sums = df.groupBy(split.index([F.col("k")]).alias("r")).agg(F.sum("w").alias("w"), F.count_distinct("k").alias("n")).collect()
    even = sum(r["w"] for r in sums) / 16
    assert all(r["w"] <= 2 * even or r["n"] == 1 for r in sums)


# chats


def test_chats_keep_maximal_conversations(spark):
    rnd, convs = random.Random(2), {}
    for c in range(60):
        kind = rnd.random()
        if convs and kind < 0.4:
            base = convs[rnd.choice(list(convs))]
            convs[c] = base[: rnd.randint(1, len(base))]
        else:
            convs[c] = [("user" if i % 2 == 0 else "assistant", rnd.choice("abc")) for i in range(rnd.randint(1, 6))]
    convs[100] = [("user", str(i)) for i in range(1300)]
    convs[101] = convs[100][:1100]
    rows = [(c, i * 3, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows += rows[:5]  # repeated rows count once
    rnd.shuffle(rows)
    got = chats.collapse(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    text = {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["segment"])):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["text"]
    keep = {}
    for c, turns in convs.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values()):
            keep.setdefault(tuple(turns), c)
    assert text == {c: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) for turns, c in keep.items()}
    assert {r["conv_id"]: r["n_turns"] for r in got}[100] == 1300 and len([r for r in got if r["conv_id"] == 100]) == 3


def test_long_conversations_are_ordered_in_parts(spark, monkeypatch):
    """One conversation with most turns, many of one number or none, over many parts."""
    monkeypatch.setattr(chats, "PART_TURNS", 40)
    rnd = random.Random(14)
    rows = [(1, i if i < 200 else 200 if i < 500 else None, "user", f"t{i}") for i in range(700)]
    rows += [(c, i, "user", f"t{i}") for c in (2, 3, 4) for i in range(c * 30)] + [(9, 0, "user", "other")]
    rnd.shuffle(rows)
    got = chats.collapse(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), None).collect()
    key = lambda t: (t[0] is None, t[0], hashlib.md5(f"4:user:{t[1]}".encode()).hexdigest())
    turns = sorted(((r[1], r[3]) for r in rows if r[0] == 1), key=lambda t: (key(t)[0], key(t)[1] or 0, key(t)[2]))
    assert {r["conv_id"]: r["text"] for r in got} == {1: "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for _, t in turns), 9: "<|im_start|>user\nother<|im_end|>\n"}


def test_a_long_conversation_meets_by_segment(spark):
    """No exchange of texts is by conversation alone, so that one of most turns spreads over its segments."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(2000)] + [(c, i, "user", f"{c} {i}") for c in range(2, 12) for i in range(2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = chats.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(conv#" in plan and all(", segment#" in part[:60] for part in plan.split("hashpartitioning(conv#")[1:] if "line#" in part.split("Exchange")[0])
        got = {(r["conv_id"], r["segment"]): r for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(k[1] for k in got if k[0] == 1) == [0, 1, 2, 3]
    text = "".join(got[1, s]["text"] for s in range(4))
    assert text == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in rows[:2000]) and len(got) == 14


def test_chats_edges(spark):
    schema = "conv_id long, turn int, role string, text string, place int"
    rows = [(None, 1, "user", "a", 0), (None, None, None, None, 0), (1, 1, "user", "a", 0), (2, 1, None, "a", 0), (3, 1, "", "a", 0)]
    got = {r["conv_id"]: (r["n_turns"], r["copies"]) for r in chats.collapse(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: (2, 1), 2: (1, 2)}
    named = [(f"c-{r[0]}" if r[0] else None, *r[1:]) for r in rows]
    got = {r["conv_id"]: (r["n_turns"], r["copies"]) for r in chats.collapse(spark.createDataFrame(named, schema.replace("conv_id long", "conv_id string"))).collect()}
    assert got == {None: (2, 1), "c-2": (1, 2)}
    same = spark.createDataFrame([(1, 7, "user", str(i), 0) for i in range(1500)] + [(2, None, "user", str(i), 0) for i in range(1500)], schema)  # one turn number, or none
    got = chats.collapse(same, segment_turns=None).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 1500 and got[0]["copies"] == 2 and got[0]["text"].count("<|im_start|>") == 1500
    assert chats.collapse(spark.createDataFrame([], schema)).count() == 0


# fingerprints


def edited(texts):
    """Of (id, text): the edited text of each, by place."""
    order = sorted(range(len(texts)), key=lambda i: -texts[i][0])
    made = {}
    for n, i in enumerate(order):
        own, after = texts[i][1] or "", texts[order[(n + 1) % len(order)]][1] or ""
        cut = len(own) // 3
        made[texts[i][0]] = own[: len(own) - cut] + after[:cut]
    return made


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def brute_fingerprints(texts, least, most):
    """(parts of each text, function from any text to its parts), with no Spark: XXH64 chained over sorted terms."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    terms = lambda t: sorted({signed(xx(w.encode())) for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())})
    count = collections.Counter(x for t in texts for x in terms(t))
    known = {x for x, n in count.items() if least * len(texts) <= n <= most * len(texts)}

    def digits(own):
        h = 42
        for x in own:
            h = xx(x.to_bytes(8, "little", signed=True), h)
        return f"{h:016x}"[:8]

    def parts(t):
        every = terms(t)
        of = lambda i, bits: [x for x in every if x in known and not (x % (1 << 64)) >> (i * 7 % (64 - bits)) & (1 << bits) - 1]
        return [digits(of(i, bits)) for i, bits in enumerate(imatch.SUBSET_BITS)] + [digits(every)]

    return parts


def brute_likeness(a, b):
    told = [(x, y) for x, y in zip(a, b) if (x, y) != (imatch.EMPTY, imatch.EMPTY)]
    return sum(x == y for x, y in told) / len(told) if told else 1.0


def check_fingerprints(rows, texts):
    parts = brute_fingerprints([t for _, t in texts], imatch.LEAST_SHARE, imatch.MOST_SHARE)
    new, order = edited(texts), sorted(texts, key=lambda x: -x[0])
    following = {i: order[(n + 1) % len(order)][1] for n, (i, _) in enumerate(order)}
    assert len(rows) == len(texts)
    for i, t in texts:
        r, own, other = rows[i], parts(t), parts(new[i])
        assert (r["n_chars"], r["edited"]) == (len(t or ""), new[i])
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(own), "".join(other))
        assert r["near_edited"] == pytest.approx(brute_likeness(own, other)) and r["near_next"] == pytest.approx(brute_likeness(own, parts(following[i])))


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    words = [prose(rnd, 1) for _ in range(300)]
    made = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts = [(i * 7 % 331, t) for i, t in enumerate([*made, None, "", "é☃日本 ΣΑΣ", "a", "--", "one two"] + ["copy of one text"] * 20)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in texts], "doc_id long, text string, near_next double")
    check_fingerprints({r["doc_id"]: r for r in imatch.compare_edited(df).collect()}, texts)
    monkeypatch.setattr(imatch, "RANGE_BYTES", 400)  # many ranges
    check_fingerprints({r["doc_id"]: r for r in imatch.compare_edited(df.repartition(7)).collect()}, texts)
    rows = imatch.compare_edited(df.withColumn("doc_id", F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))).collect()
    check_fingerprints({int(r["doc_id"][1:]): r for r in rows}, texts)


def test_fingerprint_paths_agree(spark, monkeypatch):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, prose(rnd, 50), "mine") for i in range(60)], "doc_id long, text string, __0 string")
    words = imatch.lexicon(df, "text", 0.01, 0.5)
    one = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint(df, words).collect()}
    monkeypatch.setattr(imatch, "PLAN_TERMS", 3)
    table = imatch.lexicon(df, "text", 0.01, 0.5)
    assert sorted(r["term"] for r in table.collect()) == words
    other = imatch.fingerprint(df, table).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in other} == one and {r["__0"] for r in other} == {"mine"}


@pytest.mark.parametrize("rows", [[], [(1, "alone here")], [(None, "a b c"), (None, None), (5, "a b c")], [(2, "x y z w")] * 12, [(None, None)] * 5])
def test_fingerprint_edges(spark, rows):
    made = imatch.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(made) == len(rows)
    if len(rows) in (1, 5, 12):
        assert all(r["near_next"] == 1.0 for r in made)


def test_fingerprints_of_few_terms(spark):
    """Texts without a lexicon term differ by their last part, so that unlike ones are not alike."""
    rows = [(i, f"word{i}") for i in range(40)] + [(40 + i, f"WORD{i}!") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint(df, imatch.lexicon(df, "text", 0.5, 0.6)).collect()}
    assert len(set(made.values())) == 40 and all(made[i] == made[40 + i] for i in range(40))


def test_fingerprint_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    new = edited(docs)
    rows = queries.op7_fingerprints(spark, sf_dir).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in rows} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in new.items()}
    parts = brute_fingerprints([t for _, t in docs], imatch.LEAST_SHARE, imatch.MOST_SHARE)
    assert all(r["fingerprint"] == "".join(parts(t)) for r in rows for t in [dict(docs)[r["doc_id"]]])


# near-duplicates


def brute(texts, width, percent):
    sets = {i: frozenset(minhash.shingles(t, width).tolist()) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(rnd, groups, size, words, edits):
    made = []
    for _ in range(groups):
        base = prose(rnd, words).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = prose(rnd, 1)
            made.append(" ".join(own))
    return made


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rnd = random.Random(5)
    # a large family whose members are linked over others only, small ones, exact copies, short and empty texts
    texts = families(rnd, 1, 260, 120, 9) + families(rnd, 12, 6, 60, 4) + [prose(rnd, 40) for _ in range(40)] + ["one", "one", "ONE two", "one\ttwo", "", None, " \n"] + ["exact copy of a text"] * 60
    rnd.shuffle(texts)
    pairs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in pairs], "doc_id long, text string, kept int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.duplicate_classes(df, width=width, percent=percent).collect()}
    expected = brute(pairs, width, percent)
    assert got == expected
    kept = minhash.drop_duplicates(df, width=width, percent=percent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)


def test_near_duplicate_edges(spark):
    schema = "doc_id long, text string"
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (2, "A b  c d"), (None, "q r s t"), (7, None), (7, None), (None, ""), (9, "x y")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in minhash.duplicate_classes(df).collect())
    assert got == sorted([(4, 2, 2, False), (4, 2, 2, False), (0, 2, 2, False), (2, 2, 2, True), (0, 2, 0, False), (7, 0, 7, True), (7, 0, 7, True), (0, 0, 0, False), (9, 1, 9, True)])
    kept = minhash.drop_duplicates(df, width=3, percent=85)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "q r s t"), (2, "A b  c d"), (7, ""), (7, ""), (9, "x y")]
    assert minhash.duplicate_classes(df.limit(0)).count() == 0 and minhash.drop_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, x) for x in range(501, 540)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_signatures_estimate_similarity():
    rnd = random.Random(7)
    base = prose(rnd, 400)
    other = base.split()
    other[100:150] = prose(rnd, 50).split()
    a, b = minhash.shingles(base, 3), minhash.shingles(" ".join(other), 3)
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((minhash.minima(a) == minhash.minima(b)).mean() - true) < 0.15


# pipeline


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= set(before)
        if k < 4:
            assert docs.columns == columns
        gone = set(before) - after
        if k == 0:
            clean = [i for i in gone if i in labels and labels[i]["quality"] == 1 and not labels[i]["toxic"]]
            assert not clean and len(gone) > 5
        if k == 2:
            expected = brute(list(before.items()), 5, 80)
            assert after == {i for i, (_, c) in expected.items() if i == c}
        if k == 3:
            assert gone >= {i for i, t in before.items() if any(b in t for b in bench)}
        before = {i: before[i] for i in after}
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns) and len(before) > 20
    ran = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"]: r["n_tokens"] for r in ran.collect()} == {r["doc_id"]: r["n_tokens"] for r in docs.collect()}


def boilerplate(n, rnd, words=750, common=600):
    """``n`` documents of mostly the same words, every second one a near copy of the one before."""
    shared, out = [f"c{i}" for i in range(common)], []
    while len(out) < n:
        own = [f"w{rnd.randrange(10**9)}" for _ in range(words - common)]
        out.append(" ".join(shared + own))
        for k in rnd.sample(range(words - common), 3):
            own[k] = f"v{rnd.randrange(10**9)}"
        out.append(" ".join(shared + own))
    return out[:n]


@pytest.mark.parametrize("percent", [80, 85])
def test_large_buckets_of_common_text_equal_brute_force(spark, monkeypatch, percent):
    """Shares of common text around the threshold, in buckets that count as large."""
    monkeypatch.setattr(minhash, "LARGE", 3)
    rnd = random.Random(percent)
    texts = []
    for common in (60, 85, 90, 93):
        shared = [f"c{i}" for i in range(common)]
        for _ in range(14):
            own = [f"w{rnd.randrange(10**9)}" for _ in range(100 - common)]
            texts.append(" ".join(shared + own + [f"t{rnd.randrange(6)}"] * rnd.randint(0, 9)))
            if rnd.random() < 0.4:
                cut = rnd.randint(0, 30)
                texts.append(" ".join((shared + own)[cut:]))
    rnd.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in minhash.duplicate_classes(frame(spark, texts).select("doc_id", "text"), width=3, percent=percent).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 100 >= (len(sets[i]) + len(sets[j]) - both) * percent:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == dict(enumerate(label))
