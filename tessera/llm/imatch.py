"""Document fingerprints (operator 7): I-Match with randomised lexicon subsets, DataFrame functions only.

A text's terms are its lower-cased runs of letters and digits. The lexicon holds the
terms whose share of all documents lies in a band (an inverse-document-frequency
band). A fingerprint has one part for each of several random subsets of the lexicon, the
hash of the document's sorted distinct terms in that subset, and a last part of all its
terms, in the lexicon or not, which tells documents apart that have few terms in it.
Likeness is the share of equal parts among those to which either document has a term.

Defined results: keys are of any type with an order that JSON can hold; null texts count
as empty; without any term all parts are EMPTY, and two such documents are alike (1.0).
Repeated rows are fingerprinted each; an empty table gives no rows; ``fingerprint``
replaces a column named like ``out`` and keeps the others, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import counted, durable, free_names, in_tasks, text_or_empty
from tessera.llm.ranges import splitters

#: The band: a lexicon term is in at least and at most such a share of the documents.
LEAST_SHARE, MOST_SHARE = 0.01, 0.25
#: Bits that decide membership in a subset: it keeps a term in 2**bits.
SUBSET_BITS = (4, 6, 7, 8) * 8
#: Above so many terms the lexicon is joined rather than put into the plan. A document
#: has d distinct terms in the mean, so that the band holds at most d / LEAST_SHARE.
PLAN_TERMS = 60_000
#: Bytes of text in a range of the document order, as long as ``ranges.MOST_RANGES`` suffice.
RANGE_BYTES = 16 << 20
#: Rows of a task that writes keys and sizes.
TASK_ROWS = 500_000
#: Hexadecimal digits of a part; those of the hash of no terms.
DIGITS, EMPTY = 8, "00000000"
PARTS = len(SUBSET_BITS) + 1


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the terms, sorted."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(df: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[int] | DataFrame:
    """Hashes of the terms in the band, counted over all documents: a list of up to PLAN_TERMS, or else a written table (column term)."""
    n = df.count()
    each = df.select(F.explode(terms(text_or_empty(F.col(text)))).alias("term"))
    kept = each.groupBy("term").count().filter(F.col("count").between(least * n, most * n)).select("term").persist()
    try:
        return sorted(r["term"] for r in kept.collect()) if kept.count() <= PLAN_TERMS else durable(kept)
    finally:
        kept.unpersist()


def in_lexicon(df: DataFrame, words: list[int] | DataFrame, column: str) -> DataFrame:
    """``df`` with the terms of the array ``column`` that are in the lexicon."""
    if isinstance(words, list):
        known = ",".join(map(str, words))
        return df.withColumn(column, F.expr(f"filter(`{column}`, t -> t IN ({known}))") if known else F.slice(column, 1, 0))
    at, kept = free_names(df, 2)
    rows = durable(df.withColumn(at, F.monotonically_increasing_id()))
    own = rows.select(at, F.explode(column).alias("term")).join(words, "term").groupBy(at).agg(F.array_sort(F.collect_list("term")).alias(kept))
    rows = rows.drop(column).join(own, at, "left").drop(at)
    return rows.withColumn(column, F.coalesce(kept, F.array().cast("array<bigint>"))).drop(kept)


def _member(at: int, bits: int):
    """Whether a term's hash has no bit set from ``at`` on, over ``bits`` bits."""
    return lambda t: F.shiftrightunsigned(t, at).bitwiseAND((1 << bits) - 1) == 0


def digits(words: Column) -> Column:
    """The first digits of the terms' hash; EMPTY for no terms, whose hash is the seed."""
    return F.lower(F.substring(F.lpad(F.hex(F.xxhash64(words)), 16, "0"), 1, DIGITS))


def parts(known: Column, every: Column) -> Column:
    """The fingerprint: digits for each subset of the lexicon terms, and those of all terms."""
    made = [digits(F.filter(known, _member(i * 7 % (64 - bits), bits))) for i, bits in enumerate(SUBSET_BITS)]
    return F.concat(*made, digits(every))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that are not empty in both; 1 if all are."""
    of = lambda c: F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substr(c, i * DIGITS + 1, F.lit(DIGITS)))
    state = F.zip_with(of(a), of(b), lambda x, y: F.when((x == EMPTY) & (y == EMPTY), None).otherwise(x == y))
    told = F.array_compact(state)
    return F.when(F.size(told) > 0, F.size(F.array_remove(told, False)) / F.size(told)).otherwise(F.lit(1.0))


def fingerprint(df: DataFrame, words: list[int] | DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with a string column ``out``: PARTS parts of DIGITS hexadecimal digits."""
    every, known = free_names(df, 2)
    rows = df.withColumn(every, terms(text_or_empty(F.col(text)))).withColumn(known, F.col(every))
    rows = in_lexicon(rows, words, known)
    return rows.withColumn(out, parts(F.col(known), F.col(every))).drop(every, known)


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (key, text) with their range of the order by key, the rows that close a range also as guards of the next, and the number of ranges.

    Order: key (nulls first), two hashes of the text, row. Rows that are equal in key and
    text may stand in any order, so that it does not matter if the row numbers of two
    reads differ. After the last range comes the first.
    """
    hashed = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(2), "text"), "row": F.monotonically_increasing_id()})
    order = ["key", "h1", "h2", "row"]
    short = in_tasks(hashed.select(*order, (F.octet_length("text") + 64).alias("size")), docs.count() / TASK_ROWS)
    short, _, total = counted(short, TASK_ROWS, F.sum("size"))
    split = splitters(short, order, F.col("size"), max(8, (total or 0) // RANGE_BYTES))
    index = split.index([F.col(c) for c in order]).alias("range")
    # one row for each range, of which there are at most a few times MOST_RANGES
    ends = short.groupBy(index).agg(F.max(F.struct("key", "h1", "h2")).alias("end"))
    following = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy()))
    ends = durable(ends.select(following.alias("range"), "end.*"))
    same = F.col("d.key").eqNullSafe(F.col("e.key")) & (F.col("d.h1") == F.col("e.h1")) & (F.col("d.h2") == F.col("e.h2"))
    guards = hashed.alias("d").join(F.broadcast(ends.alias("e")), same).select("d.*", "e.range").dropDuplicates(["range"])
    rows = hashed.withColumn("range", index).withColumn("guard", F.lit(False)).unionByName(guards.withColumn("guard", F.lit(True)))
    return rows, len(split.bounds) + 1


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last third (rounded down) replaced by as many first code
    points of the next document's text, in descending order of the key (nulls last); after
    the last document comes the first. Columns: key, n_chars, edited (text), fingerprint,
    edited_fingerprint, near_edited, near_next. Texts are moved once, each range of the
    order to a task of its own.
    """
    docs = df.select(F.col(key).alias("key"), text_or_empty(F.col(text)).alias("text"))
    words = lexicon(docs)
    rows, n_ranges = _ranges(docs)
    rows = fingerprint(rows, words).repartitionById(n_ranges, "range")
    # the guard, which closes the range before, comes first; a row's next one stands before it
    window = Window.partitionBy("range").orderBy(F.desc("guard"), "key", "h1", "h2", "row")
    rows = rows.withColumn("next", F.lag(F.struct("text", "fingerprint")).over(window)).filter(~F.col("guard"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("next.text", F.lit(1), cut)))
    rows = rows.select("key", "n_chars", "edited", "fingerprint", F.col("next.fingerprint").alias("next"))
    rows = fingerprint(rows, words, "edited", "edited_fingerprint")
    near = {f"near_{k}": likeness(F.col("fingerprint"), F.col(c)) for k, c in (("edited", "edited_fingerprint"), ("next", "next"))}
    return rows.withColumns(near).select(F.col("key").alias(key), "n_chars", "edited", "fingerprint", "edited_fingerprint", *near)
