"""Mixing, filter audit and conversation repair against brute force, with hot groups and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import dialogues, filter_audit, mixing, queries

# mixing

DOCS = "doc_id long, text string, source string, size long, taken string, rank long"


def mix_rows(spark, sizes, **options):
    rows = [(i, None if n is None else " ".join(["w"] * n), s, -1, "mine", 7) for i, (s, n) in enumerate(sizes)]
    return mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5), carry=["doc_id", "source", "rank"], **options).collect()


def targets(sizes, share=1.5, cycle=(3, 1, 2), most=2):
    names = sorted({s for s, _ in sizes}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n or 0 for x, n in sizes if x == s) for s in names}
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, free, out = share * sum(own.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * own[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * own[s]
            left -= out[s]
        free -= over
    return out


def test_mixing_meets_targets_with_a_hot_source(spark):
    rnd = random.Random(5)
    sizes = [(s, rnd.randint(1, 200)) for s in ["hot"] * 500 + ["a", "b", "é", "z", "𝄞"] * 40 + [None, ""] * 25] + [("a", 4000), ("none", 0), ("none", None)]
    rnd.shuffle(sizes)
    rows = mix_rows(spark, sizes)
    expected = targets(sizes)
    assert len(rows) == len(sizes) and {r["rank"] for r in rows} == {7}
    got = collections.Counter()
    for r in rows:
        source, size = sizes[r["doc_id"]]
        assert (r["source"], r["size"]) == (source, size or 0) and r["source_size"] == sum(n or 0 for s, n in sizes if s == source)
        assert r["target"] == pytest.approx(expected[source])
        assert r["size"] == 0 or (r["taken"] % r["size"] == 0 and 0 <= r["taken"] <= 2 * r["size"])
        assert r["taken"] >= r["size"] * int(r["target"] / max(r["source_size"], 1))  # whole copies are certain where all are alike
        got[source] += r["taken"]
    for s, t in expected.items():
        assert abs(got[s] - t) <= 2, s  # the closing document leaves next to nothing
    again = {r["doc_id"]: r["taken"] for r in mix_rows(spark, sizes)}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixing_prefers_within_a_source_and_draws_by_odds(spark):
    sizes = [("a", 10 + i % 2) for i in range(4000)] + [("b", 10)] * 100
    rows = mix_rows(spark, sizes, cycle=(1, 1), share=0.5, preference=lambda n: F.when(n == 10, 0.25).otherwise(1.0))
    part = {n: sum(r["taken"] > 0 for r in rows if r["source"] == "a" and r["size"] == n) / 2000 for n in (10, 11)}
    assert part[10] == pytest.approx(part[11] / 4, abs=0.03)
    assert sum(r["taken"] for r in rows if r["source"] == "a") == pytest.approx(targets(sizes, 0.5, (1, 1))["a"], abs=11)


def test_mixing_of_nothing_and_of_repeated_rows(spark):
    assert mix_rows(spark, []) == []
    assert [r["taken"] for r in mix_rows(spark, [("a", None), ("b", 0)])] == [0, 0]
    same = spark.createDataFrame([(1, "x y", "a")] * 5 + [(None, None, None)] * 3, "doc_id long, text string, source string")
    rows = mixing.mix(same).collect()
    assert len(rows) == 8 and len({r["taken"] for r in rows if r["doc_id"] == 1}) == 1


def test_mixing_cut_is_that_of_an_ordered_pass(spark, monkeypatch):
    rnd = random.Random(8)
    sizes = [("a", rnd.randint(1, 50)) for _ in range(300)] + [("b", rnd.randint(1, 50)) for _ in range(200)] + [("c", 3)] * 10
    wide = {r["doc_id"]: r["taken"] for r in mix_rows(spark, sizes)}
    monkeypatch.setattr(mixing, "SOURCES_A_TASK", 1)
    monkeypatch.setattr(mixing, "if_small", lambda df, n: df)
    assert {r["doc_id"]: r["taken"] for r in mix_rows(spark, sizes)} == wide


# filter audit


def conditions(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text))]


def audited(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = [(s or "", [*conditions(t or ""), i is not None and i > least[t or ""]], labels.get(i, (0, 0)) if i is not None else (0, 0)) for i, t, s in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            at = ["ABCDE".index(x) for x in order]
            for k, f in enumerate(at):
                removed = [r for r in own if r[1][f] and not any(r[1][j] for j in at[:k])]
                out[part, "".join(order), k + 1] = [
                    sum(not any(r[1][j] for j in at[: k + 1]) for r in own), len(removed), sum(r[1][f] and any(r[1][j] for j in at[:k]) for r in own),
                    sum(r[1][f] and sum(r[1]) == 1 for r in own), sum(r[2][0] == 1 for r in removed), sum(r[2][1] == 1 for r in removed),
                ]
    totals = collections.Counter()
    for (part, order, step), v in out.items():
        totals[part, order[step - 1]] += v[1]
    return {k: tuple(v) + (totals[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    vocabulary = ["word%d" % i for i in range(70)] + ["ABC", "#tag", "é", "a\x0bb", "😀"]
    texts = [" ".join(rnd.choice(vocabulary[: rnd.choice((9, 75))]) for _ in range(rnd.randint(0, 120))) for _ in range(40)]
    docs = [(i, rnd.choice(texts), rnd.choice(["a", "a", "b", None, ""])) for i in range(150)]
    docs += [(500 + i, texts[0], "hot") for i in range(100)] + [(3, docs[3][1], docs[3][2])] + [(None, texts[0], "a"), (900, None, "a"), (901, "", "b"), (902, "x " * 100_000, "long")]
    rnd.shuffle(docs)
    labels = {i: (rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(0, 560, 2)}
    spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, source string, part string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    judged = [(i, q, t) for i, (q, t) in labels.items()] + [(4, 0, 0), (None, 1, 1), (6, None, None)]
    spark.createDataFrame(judged, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op12_filter_audit(spark, str(tmp_path)).collect()
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in rows} == audited(docs, labels) and len(rows) == 5 * 600


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = filter_audit.mask_cells(docs, labels, filter_audit.text_conditions(F.col("text")), F.col("source"))
    assert filter_audit.audit(cells, "ABCDE").count() == 0


# conversation repair

TURNS = "conv_id long, turn long, role string, text string, part int, place string"
NEXT = {("NONE", "s"): "LEAD", ("NONE", "u"): "OPEN", ("LEAD", "u"): "OPEN", ("PAIRS", "u"): "OPEN", ("OPEN", "a"): "PAIRS"}


def cheapest(symbols, begin="NONE"):
    """Best way to each state of the role automaton: (cost, audit, steps)."""

    def with_inserts(best):
        changed = True
        while changed:
            changed = False
            for state, (c, a, s) in list(best.items()):
                for x in "ua":
                    to = NEXT.get((state, x))
                    if to and (to not in best or (c + 5, a + "I") < best[to][:2]):
                        best[to], changed = (c + 5, a + "I", s + x.upper()), True
        return best

    best = with_inserts({begin: (0, "", "")})
    for mark in symbols:
        new, own, extra = {}, mark.lower(), 5 if mark.isupper() else 0

        def put(to, value):
            if to and (to not in new or value < new[to]):
                new[to] = value

        for state, (c, a, s) in best.items():
            put(state, (c + 2, a + "D", s + "d"))
            if own != "x":
                put(NEXT.get((state, own)), (c + extra, a + "K", s + "k"))
                for x in set("ua") - {own}:
                    put(NEXT.get((state, x)), (c + extra + 1, a + "R", s + x))
        best = with_inserts(new)
    return best


def repaired(turns):
    """Brute force of ``repair`` for the turns of one conversation: (turn, role, text)."""
    turns = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, marks, counts = set(), "", collections.Counter()
    for _, role, text in turns:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        own = role[:1] if role[:1] in ("s", "u", "a") else "o"
        marks += "x" if fault in ("blank", "duplicate") else own.upper() if fault else own
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    found = cheapest(marks)
    cost, audit, steps = min(found[n] for n in ("NONE", "PAIRS") if n in found)
    left, lines = list(turns), []
    for s in steps:
        if s in "UA":
            lines.append({"U": "user:", "A": "assistant:"}[s])
            continue
        _, role, text = left.pop(0)
        if s != "d":
            lines.append({"k": role, "u": "user", "a": "assistant"}[s] + ":" + text)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_turns(rnd, n):
    text = lambda: rnd.choice(["Yes.", "No!", "so", "", "\t\x0b", None, "a. b", "Ok? ", "é…", "word " * rnd.randint(1, 9) + "."])
    roles = ["system", "user", "assistant"] + [rnd.choice(("user", "assistant")) for _ in range(n)]
    return [(rnd.choice((k, k, k, k + 1, None)), rnd.choice((roles[min(k, 2)], *roles, "tool", "", None)), text() if rnd.random() < 0.5 else f"turn {k}.") for k in range(n)]


def test_parser_equals_the_automaton():
    rnd = random.Random(7)
    for _ in range(400):
        marks = "".join(rnd.choice("xsuaoSUAOuaua") for _ in range(rnd.randint(0, 12)))
        for begin in dialogues.STATES:
            assert dialogues.parse(marks, begin) == cheapest(marks, begin), (marks, begin)


def test_parser_takes_any_grammar():
    nested = {"ROOT": [("u", "ROOT", "a"), ("u", "a"), ("ROOT", "ROOT")], "NONE": [()]}
    assert dialogues.parse("uuaa", "NONE", nested)["ROOT"] == (0, "KKKK", "kkkk")
    assert dialogues.parse("uuaaa", "NONE", nested)["ROOT"][:2] == (2, "KKDKK")


@pytest.mark.parametrize("parts", [(50_000, 1000), (7, 1000), (50_000, 3), (5, 2)])
def test_repair_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(dialogues, "PART_TURNS", parts[0])
    monkeypatch.setattr(dialogues, "SEGMENT_TURNS", parts[1])
    rnd = random.Random(sum(parts))
    convs = {c: random_turns(rnd, rnd.randint(1, 9)) for c in (*range(40), None)} | {1000: random_turns(rnd, 60), 1001: [(5, "user", "again.")] * 30}
    rows = [(c, *t, 3, "x") for c, own in convs.items() for t in own]
    rnd.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in dialogues.repair(spark.createDataFrame(rows, TURNS).repartition(6)).collect()}
    assert got == {c: repaired(own) for c, own in convs.items()}


def test_repair_of_damaged_turns(spark):
    rnd = random.Random(9)
    convs = {c: [(k, *r[1:]) for k, r in enumerate(random_turns(rnd, rnd.randint(1, 6)))] for c in (*range(60), None)} | {29: [(0, "user", "Yes.")]}  # whose only turn is dropped
    rows = [(c, *t, 3, "x") for c, own in convs.items() for t in own]
    got = {r[0]: tuple(r)[1:] for r in dialogues.repair_damaged(spark.createDataFrame(rows, TURNS)).collect()}
    expected = {}
    for c, own in convs.items():
        left = []
        for turn, role, text in own:
            d = zlib.crc32(f"{' ' if c is None else c}:{turn}".encode()) % 20
            role, text = "user" if d == 4 else " " if role is None else role, " " if text is None else text
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            left += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        expected[c] = repaired(left) if left else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == expected
    assert any(not v[-2] for v in expected.values())


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert dialogues.repair(empty).count() == 0 and dialogues.repair_damaged(empty).count() == 0
