"""Queries of the consensus grains, overlaps and screening index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators import checks, consensus, statistics
from tessera.plans.bindings import CONSENSUS, M, measurements, rep_sql, rounded, table

# Scores of overlapping sources.
SCORES = {"A|N|R": 0.3, "A|R": 0.5, "A|N": 0.6}
QUERIES: dict = {}
ORACLE: dict = {}


def _entities(spark, d):
    return consensus.by_entity(consensus.by_source(consensus.replicates(measurements(spark, d))))


def replicate_aggregate(spark, d):
    keys = ["part", "assay", "source"]
    made = rounded(consensus.replicates(measurements(spark, d), keys), "potency", "log_mean", "log_std")
    return made.withColumn("screening", F.col("source") == "R")


def replicate_sources(spark, d):
    made = consensus.by_source(consensus.replicates(measurements(spark, d))).drop("usual_qualifier")
    return rounded(made, "potency_source", "potency_std", "assay_spread")


def entity_consensus(spark, d):
    return rounded(_entities(spark, d), "consensus", "spread")


def preferred_overlap(spark, d):
    rows = consensus.prefer_overlap(measurements(spark, d), "entity", "source", "N", "A")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


def qualifier_mode(spark, d):
    rows = consensus.keyed(measurements(spark, d), ["part"])
    return rows.groupBy("part").agg(F.mode("qualifier", True).alias("usual"), F.count("*").alias("n"))


def independence_score(spark, d):
    ent = consensus.source_lists(measurements(spark, d))
    made = ent.select("entity", "source_list", V.overlap_score(F.col("source_list"), SCORES, 0.7).alias("score"))
    return made.withColumn("independent", (F.col("score") >= 0.7) & F.col("source_list").contains("|"))


def source_combo_counts(spark, d):
    ent = _entities(spark, d)
    made = ent.groupBy("source_list").agg(F.count("*").alias("n"), F.avg("consensus").alias("mean"), F.count_if("concordant").alias("n_concordant"))
    return rounded(made, "mean")


def upset_counts(spark, d):
    has = lambda s: F.bool_or(F.col("source") == s)
    ent = measurements(spark, d).groupBy("entity").agg(has("A").alias("in_a"), has("N").alias("in_n"), has("R").alias("in_r"))
    return ent.groupBy("in_a", "in_n", "in_r").agg(F.count("*").alias("n"))


def cohort_groups(spark, d):
    """Groups wholly in a cohort, mixed or outside."""
    parts = table(spark, d, "part")
    made = parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("k"))
    return made.select("*", F.when(F.col("k") == F.col("n"), "only").when(F.col("k") > 0, "mixed").otherwise("none").alias("kind"))


def golden_set(spark, d):
    rows = measurements(spark, d).withColumn("potency", V.potency(F.col("value")))
    return rounded(consensus.golden_set(rows), "consensus", "max_delta")


def screening_index(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("assay"), "value", F.when(F.col("value") > 400, ">").otherwise("").alias("qualifier"))
    confirmed = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("entity"))
    return rounded(consensus.screening_index(events, confirmed), "confidence", "max_value")


def split_completeness(spark, d):
    return checks.completeness(measurements(spark, d), F.col("usable"))


def value_parse(spark, d):
    e = table(spark, d, "events")
    sign = F.when(F.col("event_type") == "view", ">").when(F.col("event_type") == "click", "<= ").when(F.col("event_type") == "signup", "=").when(F.col("event_type") == "error", "x").otherwise("")
    text = F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_id") % 13 == 0, "~").otherwise(F.concat(sign, F.col("value").cast("string")))
    made = e.select("event_id", V.parse_value(text).alias("p"))
    return made.select("event_id", "p.qualifier", "p.value", "p.status")


def unit_convert(spark, d):
    e = table(spark, d, "events")
    unit = F.when(F.col("event_type") == "view", "nM").when(F.col("event_type") == "click", " Micro Molar").when(F.col("event_type") == "signup", "mmol/L").when(F.col("event_type") == "error", "ug/mL").otherwise("pM")
    value = F.when(F.col("event_id") % 19 > 0, F.col("value"))
    made = e.select("event_id", V.convert_units(value, unit).alias("c"))
    made = made.withColumn("t", V.round_trip(F.col("c.value")))  # of no substance: beyond all bounds
    return made.select("event_id", F.round("c.value", 6).alias("nm"), "c.status", F.round("t.potency", 6).alias("potency"), V.rounded_double(F.col("t.back"), 3).alias("back"), V.differs(F.col("t.potency"), F.lit(7.0), 0.1).alias("differs"))


def endpoint_map(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", " IC50 ").when(F.col("o_orderpriority") == "2-HIGH", "Kinact/Ki").when(F.col("o_orderpriority") == "3-MEDIUM", "potency").when(F.col("o_orderpriority") == "5-LOW", "% Inhibition").otherwise(F.col("o_orderpriority"))
    return o.groupBy(V.endpoint_name(raw).alias("endpoint")).agg(F.count("*").alias("n"))


def mechanism_class(spark, d):
    """Ordered classes: ids first, then status, then keywords, then the default."""
    o, p = table(spark, d, "orders"), F.col("o_orderpriority")
    kind = F.when(F.col("o_custkey").isin(1, 2, 3, 5, 8), "override").when(F.col("o_orderstatus") == "P", "pending").when(p.contains("URGENT"), "fast").when(p.contains("HIGH") | p.contains("MEDIUM"), "usual").otherwise("slow")
    return o.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def qc_report(spark, d):
    rows = measurements(spark, d).withColumn("p", V.potency(F.col("value")))
    ok = F.col("status") == "OK"
    made = rows.groupBy("source", "endpoint").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(F.col("status") == "PARSE_ERROR").alias("n_error"), F.count_if("usable").alias("n_usable"),
        F.median("p").alias("median"), F.min("p").alias("least"), F.max("p").alias("most"),
    )
    return rounded(made.withColumn("pct_ok", V.share(F.col("n_ok"), F.col("n"), 100.0)), "median", "least", "most", "pct_ok")


def wide_to_long_endpoints(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.when(F.col("l_linenumber") % (i + 2) > 0, F.col(c)).cast("double").alias(n) for i, (n, c) in enumerate((("ki", "l_quantity"), ("ic50", "l_extendedprice"), ("kd", "l_discount"), ("ec50", "l_tax")))))
    long = rows.unpivot(["l_orderkey", "l_linenumber"], ["ki", "ic50", "kd", "ec50"], "endpoint", "value").filter("value IS NOT NULL")
    return rounded(long.groupBy("endpoint").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=2)


def coefficient_of_variation(spark, d):
    made = measurements(spark, d).groupBy("assay").agg(F.stddev_samp("value").alias("sd"), F.avg("value").alias("mean"))
    return rounded(made.select("assay", F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean")).alias("cv")), "cv")


def mean_comparison(spark, d):
    """Mean of values against the value of the mean logarithm, by group."""
    made = measurements(spark, d).groupBy("source").agg(F.avg("value").alias("arithmetic"), F.pow(F.lit(10.0), F.avg(F.log10("value"))).alias("geometric"))
    return rounded(made.withColumn("gap", F.col("arithmetic") - F.col("geometric")), "arithmetic", "geometric", "gap", digits=3)


for _f in (replicate_aggregate, replicate_sources, entity_consensus, preferred_overlap, qualifier_mode, independence_score, source_combo_counts, upset_counts, cohort_groups, golden_set, screening_index, split_completeness, value_parse, unit_convert, endpoint_map, mechanism_class, qc_report, wide_to_long_endpoints, coefficient_of_variation, mean_comparison):
    QUERIES[_f.__name__] = _f

_SCORE = "CASE WHEN source_list NOT LIKE '%|%' THEN 1.0 WHEN source_list = 'A|N|R' THEN 0.3 WHEN source_list = 'A|R' THEN 0.5 WHEN source_list = 'A|N' THEN 0.6 ELSE 0.7 END::double"
ORACLE |= {
    "replicate_aggregate": f"WITH {M}, {rep_sql('part, assay, source')} SELECT part, assay, source, n_replicates, round(potency, 6) AS potency, round(log_mean, 6) AS log_mean, round(log_std, 6) AS log_std, value_min, value_max, any_qualifier, worst_status, usable, source = 'R' AS screening FROM rep",
    "replicate_sources": CONSENSUS + " SELECT entity, source, endpoint, n_assays, n_measurements, round(potency_source, 6) AS potency_source, round(potency_std, 6) AS potency_std, round(assay_spread, 6) AS assay_spread, value_min, value_max, assay_list, usable, coalesce(assay_spread > 1.0, false) AS high_variance FROM src",
    "entity_consensus": CONSENSUS + " SELECT entity, n_sources, n_measurements, round(consensus, 6) AS consensus, round(spread, 6) AS spread, source_list, n_sources > 1 AS multi_source, coalesce(spread < 0.5, false) AS concordant, coalesce(spread >= 1.0, false) AS discordant, n_sources > 1 AND coalesce(spread < 0.5, false) AS high_confidence FROM ent",
    "preferred_overlap": f"WITH {M} SELECT source, count(*) AS n, count(DISTINCT entity) AS entities FROM m WHERE NOT (source = 'N' AND entity IN (SELECT entity FROM m WHERE source = 'A')) GROUP BY source",
    "qualifier_mode": f"WITH {M}, c AS (SELECT part, qualifier, count(*) AS k FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k DESC, qualifier) AS i, sum(k) OVER (PARTITION BY part) AS n FROM c) SELECT part, qualifier AS usual, n::bigint AS n FROM r WHERE i = 1",
    "independence_score": CONSENSUS + f" SELECT entity, source_list, {_SCORE} AS score, {_SCORE} >= 0.7 AND source_list LIKE '%|%' AS independent FROM ent",
    "source_combo_counts": CONSENSUS + " SELECT source_list, count(*) AS n, round(avg(consensus), 6) AS mean, count(*) FILTER (WHERE spread < 0.5) AS n_concordant FROM ent GROUP BY source_list",
    "upset_counts": f"WITH {M}, e AS (SELECT entity, bool_or(source = 'A') AS in_a, bool_or(source = 'N') AS in_n, bool_or(source = 'R') AS in_r FROM m GROUP BY entity) SELECT in_a, in_n, in_r, count(*) AS n FROM e GROUP BY ALL",
    "cohort_groups": "SELECT p_brand, p_type, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS k, CASE WHEN count(*) FILTER (WHERE p_size > 25) = count(*) THEN 'only' WHEN count(*) FILTER (WHERE p_size > 25) > 0 THEN 'mixed' ELSE 'none' END AS kind FROM part GROUP BY ALL",
    "golden_set": f"WITH {M}, c AS (SELECT entity, assay, median(9 - log10(value)) AS q FROM m GROUP BY ALL), e AS (SELECT entity, count(*) AS n_assays, max(q) - min(q) AS max_delta, median(q) AS consensus FROM c GROUP BY entity) SELECT entity, n_assays, round(max_delta, 6) AS max_delta, round(consensus, 6) AS consensus FROM e WHERE n_assays >= 2 AND max_delta <= 0.5",
    "screening_index": "WITH c AS (SELECT user_id AS entity, event_type, max(value) AS most, avg(value) FILTER (WHERE value <= 400) AS mean FROM events GROUP BY ALL), e AS (SELECT entity, count(*) AS n_assays, max(most) AS max_value, count(*) FILTER (WHERE mean > 50) AS activity_score FROM c GROUP BY entity) SELECT entity, n_assays, round(max_value, 6) AS max_value, activity_score, activity_score > 0 AS any_active, round(activity_score / n_assays, 6) AS confidence, CASE WHEN activity_score > 0 THEN 'Active' ELSE 'Inactive' END AS outcome, entity IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS confirmed FROM e",
    "split_completeness": f"WITH {M} SELECT count(*) FILTER (WHERE usable) AS n_in, count(*) FILTER (WHERE NOT usable) AS n_out, count(*) AS n_all, true AS complete FROM m",
    "value_parse": "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 13 = 0 THEN '~' WHEN event_type = 'view' THEN '>' WHEN event_type = 'click' THEN '<' ELSE '' END AS qualifier, CASE WHEN event_id % 17 = 0 OR event_id % 13 = 0 OR event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN event_id % 17 = 0 THEN 'NO_VALUE' WHEN event_id % 13 = 0 THEN 'QUALIFIER_ONLY' WHEN event_type = 'error' THEN 'PARSE_ERROR' ELSE 'OK' END AS status FROM events",
    "unit_convert": "WITH u AS (SELECT event_id, CASE WHEN event_id % 19 > 0 THEN value END AS v, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 1000.0 WHEN 'signup' THEN 1000000.0 WHEN 'error' THEN NULL ELSE 0.001 END::double AS f FROM events) SELECT event_id, round(v * f, 6) AS nm, CASE WHEN v IS NULL THEN 'NO_VALUE' WHEN f IS NULL THEN 'UNCONVERTIBLE_UNITS' ELSE 'OK' END AS status, round(9 - log10(v * f), 6) AS potency, round(pow(10.0, 9 - (9 - log10(v * f))), 3) AS back, coalesce(abs(9 - log10(v * f) - 7) > 0.1, false) AS differs FROM u",
    "endpoint_map": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'IC50' WHEN '2-HIGH' THEN 'Kinact_Ki' WHEN '3-MEDIUM' THEN 'IC50' WHEN '5-LOW' THEN 'Pct_inh' ELSE o_orderpriority END AS endpoint, count(*) AS n FROM orders GROUP BY 1",
    "mechanism_class": "SELECT CASE WHEN o_custkey IN (1, 2, 3, 5, 8) THEN 'override' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '%URGENT%' THEN 'fast' WHEN o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%MEDIUM%' THEN 'usual' ELSE 'slow' END AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "qc_report": f"WITH {M} SELECT source, endpoint, count(*) AS n, count(*) FILTER (WHERE status = 'OK') AS n_ok, count(*) FILTER (WHERE status = 'PARSE_ERROR') AS n_error, count(*) FILTER (WHERE usable) AS n_usable, round(median(9 - log10(value)), 6) AS median, round(min(9 - log10(value)), 6) AS least, round(max(9 - log10(value)), 6) AS most, round(count(*) FILTER (WHERE status = 'OK') / count(*) * 100, 6) AS pct_ok FROM m GROUP BY ALL",
    "wide_to_long_endpoints": "WITH w AS (SELECT CASE WHEN l_linenumber % 2 > 0 THEN l_quantity END AS ki, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice END AS ic50, CASE WHEN l_linenumber % 4 > 0 THEN l_discount END AS kd, CASE WHEN l_linenumber % 5 > 0 THEN l_tax END AS ec50 FROM lineitem), u AS (UNPIVOT w ON ki, ic50, kd, ec50 INTO NAME endpoint VALUE value) SELECT endpoint, count(*) AS n, round(sum(value), 2) AS total FROM u GROUP BY endpoint",
    "coefficient_of_variation": f"WITH {M} SELECT assay, round(stddev_samp(value) / abs(avg(value)), 6) AS cv FROM m GROUP BY assay",
    "mean_comparison": f"WITH {M} SELECT source, round(avg(value), 3) AS arithmetic, round(pow(10.0, avg(log10(value))), 3) AS geometric, round(avg(value) - pow(10.0, avg(log10(value))), 3) AS gap FROM m GROUP BY source",
}
