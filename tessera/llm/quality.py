"""Quality classifier (operator 8): document evidence with hierarchical empirical Bayes.

Evidence: a logistic regression on those words and shape features of a text that
labelled rows show to be significant gives the probabilities that it is of low quality
and that it is toxic. Sites: the documents' probabilities are summed by path and by host; a
host's rate shrinks towards the global rate, a path's towards its host's, the more the
fewer documents it has (strength by the method of moments). A document's posterior
odds are its own times its path's rate odds over the global odds.

Defined results: null and empty texts are of low quality (probability 1) and are not
kept; null hosts or paths are sites of their own; without labelled rows the evidence
is the prior; repeated rows count each; columns of the result's names are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, counted, durable, free_names, if_small

#: Learned from so many labelled rows, in the mean, drawn by a hash.
LABELLED_ROWS = 20_000
#: Terms in a model at most, the most significant ones.
MODEL_TERMS = 5000
#: A term counts if so many labelled rows have it, so many standard errors from the mean rate.
LEAST_ROWS, LEAST_Z = 5, 5.0
#: Steps and ridge of the regression on the chosen terms.
FIT_STEPS, RIDGE = 300, 0.05
HEADS = ("low", "toxic")
WORD = re.compile(r"[^\W\d_]+")
#: Byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 sentence mark, 6 bar, 7 symbol.
CLASSES = np.array(
    [1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b" \t\n\r" else 5 if c in b".,;:'\"-?()" else 6 if c == 124 else 7 if 33 <= c <= 126 else 0 for c in range(256)],
    dtype=np.uint8,
)


def shape(text: str) -> list[str]:
    """Features of a text's form, each a share in 20 steps (finer near 0)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = np.bincount(CLASSES[raw], minlength=8)
    tokens, lines = text.split(), text.split("\n")
    letters = max(1, n[1] + n[2])
    shares = {
        "upper": n[2] / letters, "digit": n[3] / len(raw), "bar": n[6] / max(1, len(tokens)), "symbol": n[7] / len(raw), "other": n[0] / len(raw),
        "mark": n[5] / len(raw), "space": n[4] / len(raw), "again": 1 - len(set(tokens)) / max(1, len(tokens)),
        "pairs": 1 - len(set(zip(tokens, tokens[1:]))) / max(1, len(tokens) - 1), "lines": 1 - len(set(lines)) / len(lines),
    }
    made = [f"#{k}:{min(20, math.ceil(20 * math.sqrt(v)))}" for k, v in shares.items()]
    return [*made, f"#size:{int(math.log2(1 + len(tokens)))}"]


def terms(text: str) -> set[str]:
    return {*WORD.findall(text.lower()), *shape(text)}


def _logit(p):
    return np.log(p) - np.log1p(-p)


def fit_logistic(rows: list[np.ndarray], n_terms: int, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-regularised logistic regression on term presence."""
    sizes = np.array([len(r) for r in rows])
    term = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    w, b = np.zeros(n_terms), float(_logit((y.sum() + 0.5) / (len(y) + 1)))
    m, v = np.zeros(n_terms + 1), np.zeros(n_terms + 1)
    for step in range(1, FIT_STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[term], minlength=len(rows)) + b, -30, 30)))
        g = np.append(np.bincount(term, weights=(p - y)[row], minlength=n_terms) + RIDGE * w, (p - y).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (1 - step / (FIT_STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
    """The evidence model: intercept and term weights of each head.

    ``labels``: key, quality (0 is low) and toxic (1 is toxic); about LABELLED_ROWS of
    them are drawn by a hash of the key, one for each key. Terms are counted on the
    executors; the driver gets MODEL_TERMS rows for each head and the chosen terms of each drawn row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    labels = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    part = min(1.0, LABELLED_ROWS / max(1, labels.count()))
    drawn = labels.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < part * (1 << 20))
    drawn = drawn.groupBy(key).agg((F.min("quality") < 1).alias("low"), (F.max("toxic") > 0).alias("toxic"))
    rows = docs.select(key, F.col(text).alias("text")).filter(F.coalesce(F.col("text"), F.lit("")) != "")
    rows = rows.join(F.broadcast(drawn), key).select("text", "low", "toxic")  # LABELLED_ROWS bounds it
    rows = durable(rows.groupBy("text").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, low, toxic in zip(batch["text"], batch["low"], batch["toxic"]):
                yield pd.DataFrame({"term": list(terms(t)), "low": int(low), "toxic": int(toxic)})

    total = rows.agg(F.count("*").alias("n"), *(F.sum(F.col(h).cast("int")).alias(h) for h in HEADS)).first()
    n = total["n"]
    model = {h: {"prior": float(_logit((total[h] + 0.5) / (n + 1))) if n else 0.0, "terms": {}} for h in HEADS}
    if not n:
        return model
    counted = rows.mapInPandas(explode, "term string, low int, toxic int").groupBy("term")
    counted = durable(counted.agg(F.count("*").alias("n"), *(F.sum(h).alias(h) for h in HEADS)).filter(F.col("n") >= LEAST_ROWS))
    picked: dict[str, int] = {}
    for head in HEADS:
        rate = (total[head] + 0.5) / (n + 1)
        z = F.abs(F.col(head) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        best = counted.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MODEL_TERMS)
        for r in best.collect():
            picked.setdefault(r["term"], len(picked))

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [picked[x] for x in terms(t) & picked.keys()])

    fitted = rows.select(present("text").alias("at"), *HEADS).toPandas()
    for head in HEADS:
        y = fitted[head].to_numpy(dtype=float)
        if picked and 0 < y.sum() < len(y):
            weights, model[head]["prior"] = fit_logistic(list(fitted["at"]), len(picked), y)
            model[head]["terms"] = {t: float(weights[i]) for t, i in picked.items()}
    return model


def evidence_sums(text: Column, model: dict) -> Column:
    """Struct of each head's log-odds; null and empty texts: null."""
    weights: dict[str, tuple[float, float]] = {}
    for i, head in enumerate(HEADS):
        for term, w in model[head]["terms"].items():
            pair = list(weights.get(term, (0.0, 0.0)))
            pair[i] = w
            weights[term] = tuple(pair)
    prior = tuple(model[h]["prior"] for h in HEADS)

    @F.pandas_udf("low double, toxic double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = weights.keys()
        for texts in batches:
            made = []
            for t in texts:
                if not t:
                    made.append((None, None))
                    continue
                found = [weights[x] for x in terms(t) & known]
                made.append((prior[0] + sum(f[0] for f in found), prior[1] + sum(f[1] for f in found)))
            yield pd.DataFrame(made, columns=list(HEADS), dtype="float64")

    return run(text)


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), log_odds))))


def _odds(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _strength(by: DataFrame, head: str, mean: float) -> float:
    """Prior strength by the method of moments: mean (1 - mean) over the variance between groups, less one."""
    rate = F.col(head) / F.col("n")
    r = by.filter("n > 0").agg(F.sum(F.col("n") * F.pow(rate - mean, 2)).alias("ss"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["k"] or r["k"] < 2:
        return 1e4
    room = r["n"] - r["nn"] / r["n"]
    between = (r["ss"] - (r["k"] - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    return float(min(1e6, max(2.0, mean * (1 - mean) / between - 1))) if between > 0 else 1e6


def classify(df: DataFrame, model: dict, host: Column, path: Column, text: str = "text", reject: float = 0.5) -> DataFrame:
    """``df`` with p_low, p_toxic (posteriors), host_low, path_low, host_toxic, path_toxic (rates) and kept.

    A document is kept unless one of its posteriors is ``reject`` or more.
    """
    bounded_batches(df.sparkSession)
    made = ["p_low", "p_toxic", "host_low", "path_low", "host_toxic", "path_toxic", "kept"]
    at_host, at_path, evidence = free_names(df, 3)
    rows = df.withColumns({at_host: F.coalesce(host.cast("string"), F.lit("\0")), at_path: F.coalesce(path.cast("string"), F.lit("\0")), evidence: evidence_sums(F.col(text), model)})
    own = {}
    for head in HEADS:
        own[head] = F.coalesce(_chance(F.col(evidence)[head]), F.lit(1.0 - 1e-9 if head == "low" else 1e-9))
    rows = rows.drop(*made)
    keys = F.col(at_host).alias("host"), F.col(at_path).alias("path")
    paths, n_paths = counted(rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(own[h]).alias(h) for h in HEADS)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(h).alias(h) for h in HEADS))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(h).alias(h) for h in HEADS)).first()
    mean = {h: min(1 - 1e-6, max(1e-6, (total[h] or 0.0) / (total["n"] or 1))) for h in HEADS}
    shrink = {h: (_strength(hosts, h, mean[h]), _strength(paths, h, mean[h])) for h in HEADS}
    hosts = hosts.select("host", *(((F.col(h) + shrink[h][0] * mean[h]) / (F.col("n") + shrink[h][0])).alias(f"host_{h}") for h in HEADS))
    sites = paths.join(if_small(hosts, n_paths), "host")
    sites = sites.select(F.col("host").alias(at_host), F.col("path").alias(at_path), *(f"host_{h}" for h in HEADS), *(((F.col(h) + shrink[h][1] * F.col(f"host_{h}")) / (F.col("n") + shrink[h][1])).alias(f"path_{h}") for h in HEADS))
    rows = rows.join(if_small(durable(sites), n_paths), [at_host, at_path])
    posterior = {f"p_{h}": _chance(_odds(own[h]) + _odds(F.col(f"path_{h}")) - float(_logit(mean[h]))) for h in HEADS}
    rows = rows.withColumns(posterior).withColumn("kept", (F.col("p_low") < reject) & (F.col("p_toxic") < reject))
    return rows.select(*(c for c in df.columns if c not in made), *made)
