"""Structure functions for token lists: what a chemical toolkit does for molecules, for any text of tokens, with DataFrame functions.

A text is standardised to its tokens; the core of a token list is what is left without
its variable tokens; a fingerprint is the set of hashed runs of tokens up to a radius; one
cut of a list gives a longer part (the core) and a shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens at most; a longer text has the status TOO_LONG.
MOST_TOKENS = 400


def standardise(text: Column) -> Column:
    """Struct tokens, key (a digest, null without tokens), n_tokens, status.

    What follows " |" is left out; letters are lowered, other signs divide tokens.
    Status: NO_TEXT (null or blank), PARSE_FAIL (no letter or digit), TOO_LONG, OK.
    """
    own = F.trim(F.split(F.coalesce(text, F.lit("")), r" \|")[0])
    tokens = F.array_remove(F.split(F.lower(own), r"[^\p{L}\p{N}]+"), "")
    status = F.when(own == "", "NO_TEXT").when(F.size(tokens) == 0, "PARSE_FAIL").when(F.size(tokens) > MOST_TOKENS, "TOO_LONG").otherwise("OK")
    ok = status == "OK"
    return F.struct(
        F.when(ok, tokens).alias("tokens"), F.when(ok, F.md5(F.array_join(tokens, " "))).alias("key"), F.when(ok, F.size(tokens)).alias("n_tokens"), status.alias("status"),
    )


def is_stable(text: Column) -> Column:
    """Whether standardising the standardised text changes nothing; null where there is none."""
    once = standardise(text)["tokens"]
    return F.when(once.isNotNull(), standardise(F.array_join(once, " "))["tokens"] == once)


def core(tokens: Column, generic: bool = False) -> Column:
    """The tokens without digits, in order; generic: each by its length only."""
    kept = F.filter(tokens, lambda t: ~t.rlike("[0-9]"))
    return F.array_join(F.transform(kept, lambda t: F.length(t).cast("string")) if generic else kept, " ")


def fingerprint(tokens: Column, radius: int = 2, bits: int = 2048) -> Column:
    """Sorted set bits: hashes of all runs of 1 to ``radius`` tokens."""
    def runs(r: int) -> Column:
        at = F.when(F.size(tokens) >= r, F.sequence(F.lit(1), F.size(tokens) - (r - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, r), " "))

    every = F.concat(*map(runs, range(1, radius + 1)))
    return F.array_sort(F.array_distinct(F.transform(every, lambda x: F.pmod(F.crc32(x), F.lit(bits)).cast("int"))))


def tanimoto(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def sensitivity(pairs: DataFrame, items: DataFrame, settings: list[tuple[int, int]], least: float) -> DataFrame:
    """Known pairs (a, b) with their similarity under each (radius, bits) as s0, s1, ..., and ``robust``: all reach ``least``."""
    for k in "ab":
        pairs = pairs.join(items.select(F.col("id").alias(k), F.col("tokens").alias(f"tokens_{k}")), k)
    made = {f"s{i}": tanimoto(fingerprint(F.col("tokens_a"), r, n), fingerprint(F.col("tokens_b"), r, n)) for i, (r, n) in enumerate(settings)}
    rows = pairs.select("a", "b", *(v.alias(k) for k, v in made.items()))
    return rows.withColumn("robust", F.least(*made) >= least) if len(made) > 1 else rows.withColumn("robust", F.col("s0") >= least)


def fragments(items: DataFrame) -> DataFrame:
    """(id, core, rest) for each single cut of a token list (id, tokens): the part with more characters and the other; on ties the first is the core."""
    cut = items.filter(F.size("tokens") > 1).select("id", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("i"))
    head, tail = F.array_join(F.slice("tokens", 1, F.col("i")), " "), F.array_join(F.slice("tokens", F.col("i") + 1, F.size("tokens")), " ")
    longer = F.length(head) >= F.length(tail)
    return cut.select("id", F.when(longer, head).otherwise(tail).alias("core"), F.when(longer, tail).otherwise(head).alias("rest")).distinct()


def first_pattern(text: Column, panel: list[tuple[str, str]], default: str = "none") -> Column:
    """Label of the first pattern of the panel that the text has."""
    made = F.lit(default)
    for label, pattern in reversed(panel):
        made = F.when(text.rlike(pattern), label).otherwise(made)
    return made


def descriptors(tokens: Column) -> Column:
    """Struct of counts: tokens, distinct, characters, digits, longest token, mean length."""
    lengths = F.transform(tokens, F.length)
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    return F.struct(
        F.size(tokens).alias("n"), F.size(F.array_distinct(tokens)).alias("distinct"), total.alias("chars"),
        F.length(F.regexp_replace(F.array_join(tokens, ""), "[^0-9]", "")).alias("digits"), F.array_max(lengths).alias("longest"), (total / F.size(tokens)).alias("mean"),
    )
