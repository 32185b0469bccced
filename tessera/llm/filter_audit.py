"""Filter interaction audit (operator 12): what each filter removes in every order of the filters.

Documents are counted by part and by the set of filters that they fail (a mask), with the
good and the toxic among them; all that follows works on these cells. Each cell is unpivoted
against the steps of every order; a running bit-or over the steps tells which filters of the
mask came earlier; conditional sums over the cells of a part give the metrics of a step, and
the total over a filter's window (all orders, any step) is its Shapley count.

Defined results: a null text is empty and fails as the empty text does; a null part is the
empty string; labels of several rows of one document are joined (any 1 counts), and documents
without a label are neither good nor toxic. Rows that repeat a document, id and text, share
its fate; a document with a null id is no repeat and makes no other one a repeat. Without
documents there are no parts and so no rows. Only named columns are used, so that others may
have any name.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, text_or_empty

#: The limits of the conditions.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"


def text_conditions(text: Column) -> dict[str, Column]:
    """A: short; B: repetitive; C: capitals; D: symbols. Each is true if the text fails."""
    text = text_or_empty(text)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals.cast("long") > CAPITAL_PERCENT * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], part: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents by part and mask: n, n_good, n_toxic. Bit i of the mask is condition i; the bit after the last is that of a repeated text.

    Texts move as digests. Rows are counted by document and then by digest before the
    smallest id of each digest is sought, so that a large group of copies is a few rows by then.
    """
    bits = [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    repeat = 1 << len(bits)
    digest = F.unhex(F.sha2(text_or_empty(F.col(text)), 256))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    judged = labels.groupBy(F.col(key).alias("id")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(judged, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    kind = ["part", "mask", "good", "toxic"]
    rows = rows.groupBy("id", "digest", *kind).agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    rows = rows.groupBy("digest", *kind, known.alias("known")).agg(F.sum("n").alias("n"), F.min(F.when(known, F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    stays = F.when(F.col("known"), F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)).otherwise(F.col("n"))
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(repeat)).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    cells = rows.withColumn("stays", stays).select("part", "good", "toxic", split.alias("cell")).filter("cell.n > 0")
    counted = {"n": F.lit(True), "n_good": F.col("good"), "n_toxic": F.col("toxic")}
    return cells.groupBy("part", F.col("cell.mask").alias("mask")).agg(*(F.sum(F.when(c, F.col("cell.n")).otherwise(0)).alias(k) for k, c in counted.items()))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """Metrics of each step of every order of the filters ``letters`` (bit i of a mask: letter i), for each part.

    There are n! orders of n filters, so this is for up to about seven. The windows are of
    one cell and order (n rows) and of one filter of a part.
    """
    orders = F.from_json(F.lit(json.dumps(["".join(p) for p in itertools.permutations(letters)])), "array<string>")
    rows = cells.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    bit = F.element_at(F.array(*(F.lit(1 << i) for i in range(len(letters)))), F.instr(F.lit(letters), F.col("filter")))
    rows = rows.withColumns({"step": (F.col("place") + 1).cast("int"), "failed": F.col("mask").bitwiseAND(bit)})
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.bit_or("failed").over(earlier), F.lit(0)))
    fails, free = F.col("failed") != 0, F.col("before") == 0

    def total(when: Column, count: str = "n") -> Column:
        return F.sum(F.when(when, F.col(count)).otherwise(0))

    metrics = {
        "kept": total(~fails & free),
        "removed": total(fails & free),
        "redundant": total(fails & ~free),
        "unique_fails": total(fails & (F.col("mask") == F.col("failed"))),
        "good_lost": total(fails & free, "n_good"),
        "toxic_lost": total(fails & free, "n_toxic"),
    }
    steps = rows.groupBy("part", "filter_order", "step", "filter").agg(*(v.alias(k) for k, v in metrics.items()))
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


#: DuckDB SQL of the query: masks document by document, each order's first failure by comparing places.
AUDIT_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS f
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM d GROUP BY part, f),
p AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, 15 - a.i - b.i - c.i - d.i AS e FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i)
      WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
o AS (SELECT [a, b, c, d, e] AS fs, array_to_string(list_transform([a, b, c, d, e], lambda i: 'ABCDE'[i]), '') AS filter_order FROM p),
s AS (SELECT part, n, g, x, f, filter_order, k::integer AS step, fs[k] AS own, f[fs[k]] AS fails, list_bool_or(list_transform(range(1, k), lambda j: f[fs[j]])) AS before,
             len(list_filter(f, lambda v: v)) AS failures FROM c, o, range(1, 6) r(k)),
m AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT coalesce(before, false)), 0)::bigint AS kept,
             coalesce(sum(n) FILTER (WHERE fails AND NOT coalesce(before, false)), 0)::bigint AS removed, coalesce(sum(n) FILTER (WHERE fails AND before), 0)::bigint AS redundant,
             coalesce(sum(n) FILTER (WHERE fails AND failures = 1), 0)::bigint AS unique_fails,
             coalesce(sum(g) FILTER (WHERE fails AND NOT coalesce(before, false)), 0)::bigint AS good_lost,
             coalesce(sum(x) FILTER (WHERE fails AND NOT coalesce(before, false)), 0)::bigint AS toxic_lost
      FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM m
"""
