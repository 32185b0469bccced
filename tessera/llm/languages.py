"""Language identification (operator 5): mixtures of languages by expectation-maximisation.

A document is a bag of letter trigrams, one for each letter with its neighbours
(a non-letter counts as a boundary). Each trigram is drawn from one of the learned
languages. A document's proportions maximise the likelihood; a language joins the
set only if it raises the log-likelihood by more than PENALTY * log(trigrams). A
single language is proven best without iterations where no direction away from it
ascends (the likelihood is concave in the proportions). The fit is the mean log-likelihood of a trigram
above that of an even draw from all cells: below 0 the text is in none of the languages.

Defined results: null, empty and letterless texts are ``und`` with score 0, fit 0 and an
empty set; equal proportions fall to the language that sorts first; with no rows to
learn from, every text is ``und``; a column named like ``out`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

#: Trigrams are hashed to so many cells.
CELLS = 1 << 16
#: Learned from so many rows of a language, in the mean, drawn by a hash.
ROWS_A_LANGUAGE = 3000
#: Log-likelihood a further language must add, in units of log(trigrams).
PENALTY = 3.0
EM_STEPS, EM_TOLERANCE = 40, 1e-4
RESULT = "lang_pred string, score double, langs array<string>, shares array<double>, fit double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def trigrams(text: str | None) -> np.ndarray:
    """The cell of each letter's trigram."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _letters()
    letter = table[np.minimum(codes, 0xFFFF)]
    if (high := codes > 0xFFFF).any():
        letter[high] = [chr(c).isalpha() for c in codes[high]]
    c = np.zeros(len(codes) + 2, dtype=np.uint64)
    c[1:-1] = np.where(letter, codes, 0)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    return (h[letter] >> np.uint64(48)).astype(np.int64)


def em(p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p and the log-likelihood."""
    n = weight.sum()
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(EM_STEPS):
        mixed = p @ share
        new = share * ((weight / mixed) @ p) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < EM_TOLERANCE:
            break
    return share, float(weight @ np.log(p @ share))


def infer(text: str | None, model: np.ndarray) -> tuple[list[int], list[float], float]:
    """The set of languages (columns of the model), their proportions, largest first, and the fit."""
    cells = trigrams(text)
    if not len(cells) or not model.shape[1]:
        return [], [], 0.0
    if len(cells) > CELLS // 8:
        counted = np.bincount(cells, minlength=CELLS)
        cells = np.flatnonzero(counted)
        weight = counted[cells].astype(float)
    else:
        weight = np.ones(len(cells))
    p, n = model[cells], weight.sum()
    alone = weight @ np.log(p)
    best = int(alone.argmax())
    if ((weight / p[:, best]) @ p).max() <= n * (1 + 1e-9):
        return [best], [1.0], float(alone[best] / n + np.log(CELLS))
    share, _ = em(p, weight)
    order, reached, chosen = np.argsort(-share, kind="stable"), alone[best], ([best], [1.0])
    for k in range(2, len(order) + 1):
        some = order[:k]
        part, value = em(p[:, some], weight)
        if value - reached <= PENALTY * np.log(n):
            break
        by = np.argsort(-part, kind="stable")
        reached, chosen = value, ([int(x) for x in some[by]], [float(x) for x in part[by]])
    return *chosen, float(reached / n + np.log(CELLS))


def learn(rows: DataFrame, text: str, lang: str, key: str) -> tuple[list[str], np.ndarray]:
    """Languages and p(cell | language), learned from ``rows`` with a non-null ``lang``.

    About ROWS_A_LANGUAGE rows of each language are drawn by a hash of ``key``; their
    whole texts are counted on the executors and summed there. The driver gets at most
    CELLS counts for each language.
    """
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key)).alias("draw"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((CELLS, 0))
    langs = sorted(sizes)
    part = F.element_at(F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, ROWS_A_LANGUAGE / sizes[k])))), F.col("lang"))
    drawn = rows.filter(F.pmod("draw", F.lit(1 << 20)) < part * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch["text"], batch["lang"]):
                total.setdefault(k, np.zeros(CELLS, dtype=np.int64))
                total[k] += np.bincount(trigrams(t), minlength=CELLS)
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"lang": k, "cell": at, "n": v[at]})

    counted = drawn.mapInPandas(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    model = np.full((CELLS, len(langs)), 0.5)
    at = {k: i for i, k in enumerate(langs)}
    np.add.at(model, (counted["cell"].to_numpy(), counted["lang"].map(at).to_numpy(dtype=np.int64)), counted["n"].to_numpy())
    return langs, model / model.sum(axis=0)


def training_rows(key: Column) -> Column:
    """Rows to learn from: those whose crc32 of the key as text has not the remainder 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 != 2, F.lit(False))


def identify(df: DataFrame, langs: list[str], model: np.ndarray, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` with a struct column ``out`` (RESULT)."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((langs, model))

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table = shared.value
        for texts in batches:
            made = []
            for t in texts:
                found, parts, fit = infer(t, table)
                made.append((names[found[0]] if found else "und", min(1.0, parts[0]) if found else 0.0, [names[x] for x in found], parts, fit))
            yield pd.DataFrame(made, columns=["lang_pred", "score", "langs", "shares", "fit"])

    return df.withColumn(out, run(F.col(text)))
