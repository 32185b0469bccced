"""License scan (operator 2).

Each whole text is reduced to its words, joined by single spaces. An Aho-Corasick
pass finds which rule keywords occur; only rules of which a keyword is there run
their regex, and each text a regex can match holds one. Detections are then resolved by priority: one that lies inside a kept
detection of the same or a higher priority is suppressed. Base phrases are
reported at all their places, whatever is suppressed.

Defined results: null and empty texts have no words and score 0; repeated rows are
scanned each; a column named like ``out`` is replaced, other columns stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches
from tessera.llm.license_rules import RULES, Rule, compiled

RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " detections array<struct<label:string,first_word:long,end_word:long,confidence:double,tier:int>>"
)

#: Bytes of a word stay, A-Z are lowered, all others become spaces.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


@lru_cache(maxsize=4)
def _matcher(rules: tuple[Rule, ...]):
    import ahocorasick

    by_word: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for keyword in rule.keywords:
            by_word.setdefault(f" {keyword} ", []).append(i)
    found = ahocorasick.Automaton()
    for word, which in by_word.items():
        found.add_word(word, which)
    found.make_automaton()
    return found, [compiled(r) for r in rules]


def resolve(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Of detections (start, end, rule), those that no kept one of their tier or above contains.

    Equal intervals of one tier: the earlier rule stays.
    """
    kept: list[tuple[int, int, int]] = []
    for tier in sorted({rules[r].tier for _, _, r in found}):
        kept.sort()
        starts, ends = [k[0] for k in kept], list(accumulate((k[1] for k in kept), max))
        far = -1
        for s, e, r in sorted((x for x in found if rules[x[2]].tier == tier), key=lambda x: (x[0], -x[1], x[2])):
            at = bisect_right(starts, s)
            if e <= far or at and ends[at - 1] >= e:
                continue
            far = e
            kept.append((s, e, r))
    return sorted(kept)


def scan(text: str | None, rules: tuple[Rule, ...] = RULES) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    joined = b" ".join((b"", *words, b"")).decode("utf-8", "surrogatepass")
    automaton, patterns = _matcher(rules)
    there = {i for _, which in automaton.iter(joined) for i in which}
    if not there:
        return len(words), 0, None, None, "", "", 0.0, []
    spots: list[tuple[int, int, int]] = []
    for i in sorted(there):
        spots += [(m.start(), m.end(), i) for m in patterns[i].finditer(joined)]
    edges = sorted({p for s, e, _ in spots for p in (s, e)})
    word_at, seen, last = {}, 0, 0
    for p in edges:  # a word's number is the count of spaces before it, less the first
        seen += joined.count(" ", last, p)
        word_at[p], last = seen - 1, p
    base = [(word_at[s], rules[i].label) for s, _, i in spots if rules[i].base]
    kept = resolve(spots, rules)
    base_labels = {label for _, label in base}
    labels = base_labels | {rules[i].label for _, _, i in kept}
    return (
        len(words), len(base), min((w for w, _ in base), default=None), max((w for w, _ in base), default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels)), max((rules[i].confidence for _, _, i in kept), default=0.0),
        [(rules[i].label, word_at[s], word_at[e] + 1, rules[i].confidence, rules[i].tier) for s, e, i in kept],
    )


def scan_licenses(df: DataFrame, text: str = "text", out: str = "license", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with a struct column ``out`` (RESULT) of what the scan found in ``text``."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for texts in batches:
            made = pd.DataFrame([scan(None if t is None else t, rules) for t in texts], columns=names)
            made["detections"] = [[dict(zip(("label", "first_word", "end_word", "confidence", "tier"), d)) for d in x] for x in made["detections"]]
            yield made.astype({"first_word": "Int64", "last_word": "Int64"})

    return df.withColumn(out, run(F.col(text)))
