"""Operators on single texts against the libraries and brute force, with edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from tessera.llm import bpe, imatch, languages, license_rules, licenses, minhash, quality, queries, sharding, token_counts
from tessera.llm import decontamination as D

EDGE = [None, "", " ", "\n", "a", "The MIT License", "x" * 50_000, "é ☃ 日本語 <|endoftext|> <0x0A> \x00", "a b " * 5000, "a b " * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, license string, extra int"


def frame(spark, texts):
    rows = [(i if i % 4 else None, t, None if i % 3 else "en", None if i % 2 else "s", None, "kept", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def noise(rnd, pieces, n):
    return "".join(rnd.choice(pieces) for _ in range(n))


def test_license_rules_are_many_and_compile():
    assert len(license_rules.RULES) >= 200
    for rule in license_rules.RULES:
        licenses.compiled(rule)
    assert len({(r.label, r.pattern, r.tier) for r in license_rules.RULES}) == len(license_rules.RULES)


def test_license_base_places_equal_brute_force():
    rnd = random.Random(3)
    words = ["under", "the", "mit", "license", "Apache", "license,", "version", "2", "cc", "by", "nc", "é", "x9", "--"]
    for _ in range(300):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))
        low = text.translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for label, _, phrase in license_rules.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        got = licenses.scan(text)
        assert got[0] == len(w) and got[1] == len(at)
        assert (got[2], got[3]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert got[4] == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(got[5].split(","))


def test_license_containment_suppression():
    rules = license_rules.RULES
    text = "Licensed under the Apache License, Version 2.0."
    labels = licenses.scan(text)[5]
    assert labels == "apache-2"
    spans = licenses.scan("released under the terms of the gnu general public license version 3 license")[7]
    assert len(spans) == 1 and spans[0][0] == "gpl-3"
    outer, inner = next(i for i, r in enumerate(rules) if r.tier == 2), next(i for i, r in enumerate(rules) if r.tier == 4)
    assert licenses.resolve([(0, 10, outer), (2, 5, inner), (8, 12, inner)], rules) == [(0, 10, outer), (8, 12, inner)]
    assert licenses.resolve([(0, 10, inner), (2, 5, outer)], rules) == [(0, 10, inner), (2, 5, outer)]


def written(parsed):
    """All texts that a parsed regex matches; a repeat of any character is one character."""
    made = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            each = [chr(arg)]
        elif name == "IN":
            each = [chr(c) for kind, c in arg if str(kind) == "LITERAL"]
            assert len(each) == len(arg)
        elif name == "ANY":
            each = ["x"]
        elif name == "SUBPATTERN":
            each = written(arg[3])
        elif name == "BRANCH":
            each = [x for branch in arg[1] for x in written(branch)]
        else:
            least, most, inner = arg
            assert name == "MAX_REPEAT" and least in (0, 1) and (most == 1 or str(inner[0][0]) == "ANY")
            each = [""] * (least == 0) + written(inner)
        made = [a + b for a in made for b in each]
    return made


def test_license_keywords_are_in_all_a_rule_matches():
    for rule in license_rules.RULES:
        texts = written(re._parser.parse(rule.pattern))
        assert license_rules.compiled(rule).search(f" {texts[-1]} ")
        for text in texts:
            assert any(f" {k} " in f" {text} " for k in rule.keywords), (rule.label, text)


@pytest.mark.parametrize("text,label", [
    ("licensed under the GPLv3", "gpl-3"), ("Licensed under the GPLv2.", "gpl-2"), ("distributed under the LGPLv3", "lgpl-3"),
    ("released under the AGPLv3 license", "agpl-3"), ("available under the European Union Public Licence 1.2", "eupl-1.2"),
    ("licensed under the Common Development and Distribution License", "cddl-1"), ("Licensed under ASL 2.0", "apache-2"),
    ("under the Open Software License", "osl-3"), ("under the FreeBSD license", "bsd-2-clause"),
])
def test_license_names_without_the_first_keyword(text, label):
    found = licenses.scan(text)
    assert label in found[5].split(",") and found[6] > 0


def test_token_counts_equal_the_library():
    path = P.path("piece_bpe_32k.model")
    vocabulary = token_counts.vocabulary(path)
    lib = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace()
    own, rnd = token_counts.counter(path), random.Random(1)
    texts = [t for t in EDGE if t] + [noise(rnd, ["the", "a", " ", "\n", "☃", "é", "日", "<0x41>", "▁", "  ", "<unk>"], rnd.randint(1, 80)) for _ in range(300)]
    for t in texts:
        assert sum(own[w][0] for w in token_counts.words_of(t)) == len(lib.encode(t, add_special_tokens=False).ids), t[:50]


def test_token_counts_fuse_unknown_without_bytes():
    vocabulary = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("ab", -1.5), ("b", -1.0), ("▁a", -2.5)]
    lib = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace()
    own, rnd = token_counts.Counter(vocabulary), random.Random(2)
    for _ in range(400):
        t = noise(rnd, ["a", "b", "x", "y", " "], rnd.randint(1, 15))
        assert sum(own[w][0] for w in token_counts.words_of(t)) == len(lib.encode(t, add_special_tokens=False).ids), t


def test_bpe_equals_the_library():
    lib, rnd = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(4)
    own = bpe.Encoder(P.path("byte_bpe_50k.json"))
    pieces = ["a", " ", "\n", "!", "日", "'s", " the", "<|endoftext|>", "1", "　", "\x1c", "é", " word", "​", "\xa0", "<|endof", "text|>", "ſ", "İ"]
    texts = EDGE + [noise(rnd, pieces, rnd.randint(1, 3000)) for _ in range(150)] + [noise(rnd, [" alpha", " beta", ", gamma", "."], 2000)] * 3
    for t, (n, ids_sha, decoded_sha, ids) in zip(texts, own.encode(texts, True)):
        expected = lib.encode(t or "", add_special_tokens=False).ids
        assert list(ids) == expected and n == len(expected)
        assert ids_sha == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert decoded_sha == hashlib.sha256(lib.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    assert own.encoded < own.asked  # repeated passages are encoded once


def test_bpe_chunks_are_content_defined():
    rnd = random.Random(6)
    passage = noise(rnd, [" alpha", " beta", " gamma", ",", ".", " delta"], 3000).encode()
    one = set(bpe.stretches(b"begin" + passage + b" end"))
    two = set(bpe.stretches(noise(rnd, [" x", " yy"], 700).encode() + passage))
    assert len(one & two) > 0.8 * len(one)
    assert b"".join(bpe.stretches(passage)) == passage


def test_language_mixture():
    rnd = random.Random(8)
    a, b = ["the", "thing", "with", "whether"], ["und", "nicht", "zwischen", "kraft"]
    model = np.full((languages.CELLS, 2), 0.01)
    for i, words in enumerate((a, b)):
        for _ in range(4000):
            np.add.at(model[:, i], languages.trigrams(" ".join(rnd.choice(words) for _ in range(3))), 1)
    model /= model.sum(axis=0)
    assert languages.infer(" ".join(rnd.choice(a) for _ in range(80)), model)[0] == [0]
    found, share, fit = languages.infer(" ".join(rnd.choice(a) for _ in range(150)) + " " + " ".join(rnd.choice(b) for _ in range(50)), model)
    assert found == [0, 1] and 0.6 < share[0] < 0.85 and fit > 1
    long = " ".join(rnd.choice(b) for _ in range(5000))
    assert languages.infer(long, model)[:2] == ([1], [1.0]) and languages.infer(long, model)[2] > 1
    for t in (None, "", "12 34 !?"):
        assert languages.infer(t, model) == ([], [], 0.0)
    for noise in ("".join(rnd.choice("qxzjkvw") for _ in range(300)), "Η γλώσσα αυτή δεν είναι γνωστή στο μοντέλο", "これは学習されていない言語です"):
        assert languages.infer(noise, model)[2] < 0
    share, value = languages.em(model[languages.trigrams("the und the")], np.ones(9))
    grid = [np.log(model[languages.trigrams("the und the")] @ np.array([x, 1 - x])).sum() for x in np.linspace(0, 1, 2001)]
    assert value == pytest.approx(max(grid), abs=1e-3)


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = queries.op5_language_id(spark, sf_dir).filter("held_out").join(docs, "doc_id").filter("lang_pred <> 'und'")
    r = made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("x"), F.count("*").alias("n")).first()
    assert r["n"] > 20 and r["x"] > 0.97


def test_language_stage_keeps_texts_in_learned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = [(-1, "wqzxv kjqzx " * 30, "en"), (-2, "Η γλώσσα αυτή δεν είναι γνωστή", None), (-3, "12 34", "en"), (-4, None, "en")]
    rows = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("__0", F.lit("mine")).withColumn("_language", F.lit(1))
    kept = corpus_pipeline.language_stage(spark, rows, "")
    assert kept.columns == rows.columns
    kept = {r["doc_id"] for r in kept.collect()}
    assert not kept & {-1, -2, -3, -4}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_quality_of_rows_held_out(spark):
    """Learned from the even half of the labelled rows, measured on the odd half whose texts it has not seen."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = quality.learn(docs, labels.filter("doc_id % 2 = 0"))
    seen = docs.join(labels.filter("doc_id % 2 = 0"), "doc_id", "left_semi").select("text").distinct()
    unseen = docs.join(labels.filter("doc_id % 2 = 1"), "doc_id").join(seen, "text", "left_anti").select("doc_id", "quality", "toxic")
    made = quality.classify(docs, model, F.col("source"), F.col("lang")).select("doc_id", "kept").join(unseen, "doc_id")
    by = {r[0]: (r["k"], r["n"]) for r in made.groupBy((F.col("quality") == 1) & (F.col("toxic") == 0)).agg(F.avg(F.col("kept").cast("double")).alias("k"), F.count("*").alias("n")).collect()}
    assert by[True][1] > 500 and by[False][1] > 100 and by[True][0] > 0.99 and by[False][0] < 0.12


def brute_posteriors(rows, reject=0.5):
    """Of (host, path, evidence of low, of toxic): per row the host's and path's rates and the posteriors, by plain loops."""
    made = [{} for _ in rows]
    for k, head in enumerate(("low", "toxic")):
        mean = min(1 - 1e-6, max(1e-6, sum(r[2 + k] for r in rows) / len(rows)))

        def groups(of):
            by = {}
            for r in rows:
                by.setdefault(of(r), []).append(r[2 + k])
            return {g: (len(v), sum(v)) for g, v in by.items()}

        def strength(by):
            if len(by) < 2:
                return 1e4
            n = sum(c for c, _ in by.values())
            room = n - sum(c * c for c, _ in by.values()) / n
            between = (sum(c * (x / c - mean) ** 2 for c, x in by.values()) - (len(by) - 1) * mean * (1 - mean)) / room
            return min(1e6, max(2.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6

        hosts, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])
        m, s = strength(hosts), strength(paths)
        host = {h: (x + m * mean) / (c + m) for h, (c, x) in hosts.items()}
        path = {p: (x + s * host[p[0]]) / (c + s) for p, (c, x) in paths.items()}
        logit = lambda p: math.log(p / (1 - p))
        for r, out in zip(rows, made):
            z = logit(r[2 + k]) + logit(path[r[:2]]) - logit(mean)
            out |= {f"host_{head}": host[r[0]], f"path_{head}": path[r[:2]], f"p_{head}": 1 / (1 + math.exp(-z))}
    return [m | {"kept": m["p_low"] < reject and m["p_toxic"] < reject} for m in made]


def test_quality_equals_brute_force(spark):
    """Sites of all sizes, a hot one, null hosts and paths, ties and repeated rows; the evidence comes from single words."""
    rnd = random.Random(13)
    weights = {"bad": 3.0, "ugly": 1.5, "fine": -2.0, "mean": 2.5}
    model = {"low": {"prior": -0.5, "terms": {w: weights[w] for w in ("bad", "ugly", "fine")}}, "toxic": {"prior": -1.0, "terms": {"mean": 2.5}}}
    site = lambda: rnd.choice([("hot", "p"), ("hot", "p"), ("hot", None), (None, "p"), (f"h{rnd.randrange(12)}", f"p{rnd.randrange(3)}")])
    rows = [(*site(), " ".join(rnd.sample(list(weights), rnd.randint(1, 3)))) for _ in range(300)]
    rows += rows[:40]
    docs = spark.createDataFrame([(i, t, h, p, "mine", 1.5) for i, (h, p, t) in enumerate(rows)], "doc_id long, text string, source string, lang string, __0 string, p_low double")
    chance = lambda z: 1 / (1 + math.exp(-z))
    evidence = [tuple(chance(model[h]["prior"] + sum(model[h]["terms"].get(w, 0.0) for w in t.split())) for h in ("low", "toxic")) for _, _, t in rows]
    expected = brute_posteriors([(h, p, *e) for (h, p, _), e in zip(rows, evidence)])
    got = {r["doc_id"]: r for r in quality.classify(docs, model, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(rows) and {r["__0"] for r in got.values()} == {"mine"}
    for i, e in enumerate(expected):
        assert got[i]["kept"] == e["kept"] and all(got[i][k] == pytest.approx(v, abs=1e-9) for k, v in e.items() if k != "kept")
    assert 20 < sum(e["kept"] for e in expected) < 320


INTERNAL = ["_id", "_th", "_md5", "_row", "_range", "_nth", "_before", "_begin", "_host", "_path", "_own", "_passages", "_k", "_h", "_s", "__0", "__1", "__2", "own", "key", "row", "range", "digest", "a", "b", "t1", "t2", "node", "label", "at", "heavy", "next", "guard", "h1", "h2", "host", "path", "stays", "n", "found"]


def test_no_operator_touches_columns_of_the_caller(spark):
    """Columns with any name that an operator uses itself come back as they were; keys may be text."""
    texts = ["one two three four five six seven", "one two three four five six seven", None, "another text altogether here now", ""]
    df = spark.createDataFrame([(f"a-{i}", t, "src", "en", *(f"{c}{i}" for c in INTERNAL)) for i, t in enumerate(texts)], "doc_id string, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in INTERNAL))
    model = {h: {"prior": -1.0, "terms": {}} for h in quality.HEADS}
    bench = spark.createDataFrame([(1, "altogether here")], "item_id long, text string")
    made = {
        "shard": sharding.shard(df, 2), "quality": quality.classify(df, model, F.col("source"), F.col("lang")), "licenses": licenses.scan_licenses(df),
        "tokens": token_counts.count_tokens(df, P.path("piece_bpe_32k.model")), "bpe": bpe.encode_bpe(df, P.path("byte_bpe_50k.json")),
        "duplicates": minhash.drop_duplicates(df, width=3, percent=85), "leaks": D.drop_leaks(df, bench), "prints": imatch.fingerprint(df, imatch.lexicon(df)),
        "language": languages.identify(df, *languages.learn(df, "text", "lang", "doc_id")),
    }
    for name, result in made.items():
        rows = {r["doc_id"]: r for r in result.collect()}
        assert len(rows) == {"duplicates": 4, "leaks": 4}.get(name, 5), name
        for k, r in rows.items():
            assert all(r[c] == f"{c}{k[2:]}" for c in INTERNAL), name
    same = {r["doc_id"]: r["component_id"] for r in minhash.duplicate_classes(df).collect()}
    assert same["a-0"] == same["a-1"] == "a-0" and same["a-3"] == "a-3"
    assert {r["doc_id"] for r in imatch.compare_edited(df).collect()} == set(same)


def test_quality_shrinkage(spark):
    rows = [(i, "t", "big", f"p{i % 2}", 0.9) for i in range(200)] + [(i, "t", f"h{i}", "p", 0.1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p double")
    model = {h: {"prior": 0.0, "terms": {}} for h in quality.HEADS}
    r = quality.classify(docs, model, F.col("source"), F.col("lang")).first()
    assert r["host_low"] == pytest.approx(0.5) and r["p_low"] == pytest.approx(0.5)
    empty = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not empty["low"]["terms"]


def test_edge_texts_and_clashing_columns(spark):
    df = frame(spark, EDGE)
    found = licenses.scan_licenses(df).orderBy("extra").collect()
    assert [r["license"]["n_words"] for r in found[:4]] == [0] * 4 and found[5]["license"]["n_words"] == 3 and len(found) == len(EDGE)
    counted = token_counts.count_tokens(df, P.path("piece_bpe_32k.model"), out="extra2").orderBy("extra").collect()
    assert counted[0]["extra2"]["n_tokens"] == 0 and counted[-1]["extra2"] == counted[-2]["extra2"]
    coded = bpe.encode_bpe(df, P.path("byte_bpe_50k.json")).orderBy("extra").collect()
    assert coded[0]["bpe"]["ids"] == [] and coded[0]["bpe"]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    langs, model = languages.learn(df, "text", "lang", "doc_id")
    named = languages.identify(df, langs, model).orderBy("extra").collect()
    assert named[0]["language"]["lang_pred"] == "und" and named[4]["language"]["lang_pred"] in ("en", "und")
    none = languages.identify(df, *languages.learn(df.limit(0), "text", "lang", "doc_id"))
    assert {r["language"]["lang_pred"] for r in none.collect()} == {"und"}
    labels = spark.createDataFrame([(1, 0, None), (2, None, 1), (None, 1, 1), (5, 1, 0), (6, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.classify(df.withColumn("kept", F.lit(1)), quality.learn(df, labels), F.col("source"), F.col("lang"))
    rows = {r["extra"]: r["kept"] for r in scored.collect()}
    assert len(rows) == len(EDGE) and rows[0] is False and rows[1] is False
    for op in (licenses.scan_licenses(df.limit(0)), bpe.encode_bpe(df.limit(0), P.path("byte_bpe_50k.json"))):
        assert op.count() == 0
    assert quality.classify(df.limit(0), quality.learn(df.limit(0), labels), F.col("source"), F.col("lang")).count() == 0


def edits(passage, text):
    """Fewest edits of the whole passage at any place of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_finds_all_within_the_budget():
    rnd = random.Random(11)
    words = ["ther", "tion", "ing", "and", "the", "her", "re", "on", "wh", "ble", "of", "st"]
    make = lambda n: " ".join("".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    items = [(i, make(rnd.randint(8, 40))) for i in range(30)]
    index = D.Index(items)
    norm = {i: "".join(map(chr, D.normalise(t)[0].tolist())) for i, t in items}
    for turn in range(120):
        item, text = rnd.choice(items)
        chars = list(norm[item])
        for _ in range(rnd.randint(0, int(len(chars) * 0.14))):
            at, kind = rnd.randrange(len(chars)), rnd.random()
            chars[at : at + 1] = [rnd.choice("xyz")] if kind < 0.4 else [] if kind < 0.7 else [chars[at], "q"]
        doc = f"{make(rnd.randint(0, 60))} {''.join(chars)} {make(rnd.randint(0, 60))}"
        codes = "".join(map(chr, D.normalise(doc)[0].tolist()))
        k = {i: j for j, i in enumerate(index.ids)}[item]
        found = {x[0]: x for x in index.search(doc)}
        fewest = edits(norm[item], codes)
        assert (item in found) == (fewest <= int(index.edits[k])), (turn, fewest, int(index.edits[k]))
        if item in found:
            _, start, end, d = found[item]
            assert d == fewest and edits(norm[item], "".join(map(chr, D.normalise(doc[start:end])[0].tolist()))) == d
        clean = make(200)
        assert not index.search(clean)


def test_decontamination_of_repetitive_passages():
    """A run of neighbouring cells meets the bound; the match may lie anywhere along it."""
    rnd = random.Random(12)
    words = ["ther", "tion", "ing", "and", "the", "her", "re", "on", "wh", "ble", "of", "st"]
    make = lambda n: " ".join("".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    units = ["the cat sat on the mat", "1 2 3 4 5 6 7 8 9 0", "return none if x is none else", "abc", "row 12 of 340"]
    for turn in range(80):
        unit = units[turn % len(units)]
        passage = f"{make(rnd.randint(0, 3))} {' '.join([unit] * rnd.randint(3, 14))} {make(rnd.randint(0, 3))}".strip()
        index = D.Index([(1, passage)])
        if not index.ids or index.whole[0]:  # whole words, without edits
            continue
        norm = "".join(map(chr, index.codes[0].tolist()))
        chars = list(norm)
        for _ in range(rnd.choice([0, 0, int(len(chars) * 0.1), int(len(chars) * 0.14)])):
            at, kind = rnd.randrange(len(chars)), rnd.random()
            chars[at : at + 1] = [rnd.choice("xyz")] if kind < 0.4 else [] if kind < 0.7 else [chars[at], "q"]
        beside = " ".join([unit] * rnd.randint(0, 12))
        doc = f"{make(rnd.randint(0, 30))} {beside} {''.join(chars)} {make(rnd.randint(0, 2))} {beside} {make(rnd.randint(0, 30))}"
        doc = "".join(map(chr, D.normalise(doc)[0].tolist()))  # so that places are those of the compared characters
        fewest = edits(norm, doc)
        found = index.search(doc)
        assert bool(found) == (fewest <= int(index.edits[0])), (turn, fewest, int(index.edits[0]))
        if found:
            _, start, end, d = min(found, key=lambda x: x[3])
            assert d == fewest == edits(norm, doc[start:end])


@pytest.mark.parametrize("passage", ["Q", "4", "ab c", "What?", "Four. 4", "is 2 plus 2? Four", "What is 2 plus 2? Four.", "a" * 29, "b" * 30, "née d’Élan, 日本"])
def test_short_passages_are_found_as_words(passage):
    index = D.Index([(3, passage), (4, "--")])
    for doc in (passage, f"zz {passage.upper()}!", f"Before ({passage}) after", "filler words " * 30_000 + passage):
        found = index.search(doc)
        assert len(found) == 1 and found[0][0] == 3 and found[0][3] == 0, (passage, doc[-60:])
        assert D.normalise(doc[found[0][1] : found[0][2]])[0].tolist() == D.normalise(passage)[0].tolist()
    if len(D.normalise(passage)[0]) < D.LEAST_CHARS:
        assert not index.search(f"x{passage} y") and not index.search(f"y {passage.rstrip('.?')}x")
    assert not index.search("-- ??")


def test_each_place_of_a_passage_is_found():
    passage = "The quick brown fox jumped over the lazy dogs"
    gap = " and then something else was said at some length "
    found = D.Index([(1, passage), (2, "lazy dogs")]).search(gap.join([passage, passage.replace("quick", "quik"), passage]))
    assert [(i, d) for i, _, _, d in found] == [(1, 0), (1, 1), (1, 0), (2, 0), (2, 0), (2, 0)]


def test_decontamination_cases(spark):
    passage = "The quick brown fox, jumped over the lazy dogs & ran 42 miles home."
    long = "filler words here " * 40_000
    rows = [(1, passage), (2, f"xx {passage.upper()} yy {passage}"), (3, None), (4, ""), (5, long + passage), (6, long), (None, passage), (1, passage)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, passages string")
    bench = spark.createDataFrame([(7, passage), (8, None), (None, "x"), (9, "short"), (7, passage)], "item_id long, text string")
    made = D.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["edits"]) for r in D.leaks(docs.withColumn("doc_id", F.concat(F.lit("a-"), F.col("doc_id").cast("string"))), bench).collect()} == {("a-1", 0), ("a-2", 0), ("a-5", 0), (None, 0)}
    mine = D.drop_leaks(docs.withColumn("__0", F.lit("mine")).withColumn("_passages", F.lit("too")), bench).collect()
    assert {(r["__0"], r["_passages"]) for r in mine} == {("mine", "too")}
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in made if r["item_id"] == 7)[0] == (0, 7, 0)
    assert {r["doc_id"] for r in made} == {1, 2, 5, None}
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6]
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.leaks(docs.limit(0), bench).count() == 0


def test_license_scan_equals_all_rules_without_prefilter():
    """Labels, spans, tiers and score against every rule's regex on the whole text and a quadratic resolver."""
    rnd = random.Random(21)
    rules = license_rules.RULES
    plain = [r.pattern for r in rules if not re.search(r"[()\[\]?.{}|\\]", r.pattern)]
    names = ["apache license version 2 0", "gnu general public license version 3", "mit", "bsd 3 clause", "mozilla public license 2 0", "creative commons attribution 4 0", "isc", "eclipse public license"]
    frames = ["licensed under the terms of the {} license", "spdx license identifier mit", "see the {} license", "{} licensed", "released under {}", "under the {} licence"]
    assert len(plain) > 100
    for turn in range(250):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            part = rnd.choice([rnd.choice(plain), rnd.choice(frames).format(rnd.choice(names)), " ".join(rnd.choice(["the", "software", "code", "x9", "permission", "license"]) for _ in range(rnd.randint(1, 9)))])
            words = part.split()
            parts.append(" ".join(words[rnd.randint(0, 1) :] if rnd.random() < 0.3 else words))
        text = rnd.choice([" ", "\n", ", ", " -- "]).join(parts)
        joined = "".join(f" {w}" for w in text.lower().replace("\n", " ").replace(",", " ").replace("-", " ").split()) + " "
        spots = [(m.start(), m.end(), i) for i, r in enumerate(rules) for m in license_rules.compiled(r).finditer(joined)]
        kept = []
        for s, e, i in sorted(spots, key=lambda x: (rules[x[2]].tier, x[0], -x[1], x[2])):
            if not any(a <= s and e <= b for a, b, _ in kept):
                kept.append((s, e, i))
        got = licenses.scan(text)
        base = {rules[i].label for _, _, i in spots if rules[i].base}
        assert got[1] == sum(rules[i].base for _, _, i in spots) and got[4] == ",".join(sorted(base))
        assert got[5] == ",".join(sorted(base | {rules[i].label for _, _, i in kept}))
        assert got[6] == max((rules[i].confidence for _, _, i in kept), default=0.0)
        place = lambda p: joined[:p].count(" ") - 1  # noqa: E731, B023
        assert sorted(got[7]) == sorted((rules[i].label, place(s), place(e) + 1, rules[i].confidence, rules[i].tier) for s, e, i in kept)
