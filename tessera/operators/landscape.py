"""Pairs with a difference: tiers, summaries, cohorts, series, matched pairs and graph measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators.joins import on_keys
from tessera.operators.scan import numbered, scan
from tessera.operators.statistics import percentiles


def at_least(num: int, den: int) -> Column:
    """Whether a pair's similarity is num / den or more, in integers."""
    return F.col("inter") * den >= (F.col("size_a") + F.col("size_b") - F.col("inter")) * num


def similarity() -> Column:
    return F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter"))


def with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs with value_a, value_b, group_a, group_b, delta, similarity and tier; ``facts``: id, value, grp."""
    for k in "ab":
        pairs = pairs.join(facts.select(F.col("id").alias(k), F.col("value").alias(f"value_{k}"), F.col("grp").alias(f"group_{k}")), k)
    return compared(pairs)


def compared(pairs: DataFrame) -> DataFrame:
    """Pairs that have value_a and value_b with delta, similarity and tier."""
    pairs = pairs.withColumns({"delta": F.abs(F.col("value_a") - F.col("value_b")), "similarity": similarity(), "close": at_least(4, 5)})
    return pairs.withColumn("tier", V.tier(F.col("close"), F.col("delta"))).drop("close")


def class_cells(pairs: DataFrame, classes: DataFrame, facts: DataFrame) -> DataFrame:
    """All pairs of members as cells: value_a, value_b, inter, size_a, size_b, delta, similarity, tier and n, the number of pairs in it.

    pairs: of classes of equal sets; classes: id, cls, n; facts: id, value (an id may have several).
    Members of a class with one value are a cell; rows of one and the same id are no pair and count
    against their cell, so n is to be summed.
    """
    cells = classes.join(facts.select("id", "value"), "id").groupBy("cls", "n", "value").agg(F.count("*").alias("k"))
    of = lambda k: cells.select(F.col("cls").alias(k), F.col("n").alias("inter"), F.col("value").alias(f"value_{k}"), F.col("k").alias(f"k_{k}"))
    both, names = F.col("k_a") * F.col("k_b"), ("value_a", "value_b", "inter", "size_a", "size_b", "n")
    apart = pairs.join(of("a").drop("inter").hint("merge"), "a").join(of("b").drop("inter").hint("merge"), "b").withColumn("n", both)
    ends = [F.struct(f"value_{k}") for k in "ab"]  # nulls compare in structs
    within = of("a").withColumnRenamed("a", "cls").hint("merge").join(of("b").withColumnRenamed("b", "cls").drop("inter"), "cls").filter(ends[0] <= ends[1])
    within = within.withColumn("n", F.when(ends[0] == ends[1], F.expr("k_a * (k_a - 1) div 2")).otherwise(both))
    own = facts.filter("id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("value"))).alias("v")).filter("size(v) > 1").join(classes, "id").select(F.col("n").alias("inter"), F.posexplode("v").alias("i", "x"), "v")
    own = own.select("inter", F.col("x.value").alias("value_a"), F.explode(F.expr("slice(v, i + 2, size(v))")).alias("y"), F.lit(-1).cast("long").alias("n")).withColumn("value_b", F.col("y.value"))
    same = within.select("value_a", "value_b", "inter", "n").unionByName(own.select("value_a", "value_b", "inter", "n")).withColumns({"size_a": F.col("inter"), "size_b": F.col("inter")})
    return compared(apart.select(*names).unionByName(same.select(*names)))


def class_tops(pairs: DataFrame, classes: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """Pairs a < b of members of different classes, with value_a, value_b and compared: all that can be among the first ``k`` by (similarity, delta, a, b).

    Of members of one class and value only the ``k`` smallest ids can.
    """
    rows = classes.join(facts.select("id", "value"), "id")
    kept = rows.withColumn("i", F.row_number().over(Window.partitionBy("cls", "value").orderBy("id"))).filter(F.col("i") <= k)
    for c in "ab":
        pairs = pairs.join(kept.select(F.col("cls").alias(c), F.col("id").alias(f"id_{c}"), F.col("value").alias(f"value_{c}")).hint("merge"), c)
    made = compared(pairs)
    return made.withColumns({"a": F.least("id_a", "id_b"), "b": F.greatest("id_a", "id_b")})


def tier_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs by tier, members of cliffs, largest and mean differences."""
    cliff, severe = F.col("tier") != "non_cliff", F.col("tier") == "severe"
    ends = F.array(*(F.struct(F.col(k).alias("m"), F.lit(k == "a").alias("one")) for k in "ab"))
    # one pass: a pair counts with its first end, a member with what it is an end of
    own, names = F.col("one"), ("severe", "moderate", "broad")
    by = pairs.select(F.explode(ends).alias("e"), "tier", "delta").select("e.*", "tier", "delta").groupBy("m").agg(
        F.count_if(own).alias("n_pairs"), *(F.count_if(own & (F.col("tier") == t)).alias(f"n_{t}") for t in names),
        F.max("delta").alias("max_delta"), F.sum(F.when(own & severe, F.col("delta"))).alias("sum"), F.bool_or(cliff).alias("cliff"), F.bool_or(severe).alias("severe"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return by.agg(
        total("n_pairs"), *(total(f"n_{t}") for t in names), F.max("max_delta").alias("max_delta"), F.try_divide(F.sum("sum"), F.sum("n_severe")).alias("mean_severe_delta"),
        F.count_if("cliff").alias("n_in_cliffs"), F.count_if("severe").alias("n_in_severe"),
    )


def cohort_contribution(pairs: DataFrame, inside: Column) -> DataFrame:
    """Severe pairs with and without those that have a member ``inside`` the cohort, the share and a verdict."""
    severe = F.col("tier") == "severe"
    made = pairs.agg(F.count_if(severe).alias("n_all"), F.count_if(severe & ~inside).alias("n_without"))
    made = made.withColumn("delta", F.col("n_all") - F.col("n_without")).withColumn("pct", V.share(F.col("delta"), F.col("n_all"), 100.0))
    word = F.when(F.col("pct") >= 20, "strong").when(F.col("pct") >= 5, "moderate").otherwise("weak")
    return made.withColumn("verdict", F.concat(word, F.lit("_contribution")))


def series_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), (F.max(v) - F.min(v)).alias("range"))


def ruggedness(members: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """Each series: members, possible pairs, cliffs within it, density and its rank. ``members``: id, group; pairs: a, b, tier."""
    size = members.groupBy(group).agg(F.count("*").alias("n")).withColumn("possible", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    of = lambda k: members.select(F.col("id").alias(k), F.col(group).alias(f"g_{k}"))
    inside = pairs.filter("tier <> 'non_cliff'").join(of("a"), "a").join(of("b"), "b").filter("g_a = g_b")
    found = inside.groupBy(F.col("g_a").alias(group)).agg(F.count("*").alias("cliffs"))
    made = size.join(found, group, "left").withColumn("cliffs", F.coalesce("cliffs", F.lit(0)))
    made = made.withColumn("density", V.share(F.col("cliffs"), F.col("possible")))
    return numbered(made, [-F.col("density"), F.col(group)], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def series_ruggedness(members: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """Series of two members or more: size, severe cliffs, possible pairs, density, smoothness, statistics of the values, mean and largest SALI, rank by size.

    members: id, group, value; pairs: a, b, tier, delta, similarity and, if known, the ends' series g_a, g_b. SALI is over all pairs within the series.
    """
    v = F.col("value")
    size = members.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("spread"), F.stddev_samp(v).alias("sd"),
    ).filter("n >= 2").withColumn("possible", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    of = lambda k: members.select(F.col("id").alias(k), F.col(group).alias(f"g_{k}"))
    inside = (pairs if {"g_a", "g_b"} <= set(pairs.columns) else pairs.join(of("a"), "a").join(of("b"), "b")).filter("g_a = g_b")
    sali = V.sali(F.col("delta"), F.col("similarity"))
    found = inside.groupBy(F.col("g_a").alias(group)).agg(F.count_if(F.col("tier") == "severe").alias("severe"), F.avg(sali).alias("mean_sali"), F.max(sali).alias("max_sali"))
    middle = percentiles(members, "value", [0.5], [group]).withColumnRenamed("q0", "median")
    made = on_keys(size, middle, [group], "left").join(found, group, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("severe", "mean_sali", "max_sali")})
    made = made.withColumn("density", V.share(F.col("severe"), F.col("possible"))).withColumn("smoothness", 1 - F.col("density"))
    return numbered(made, [-F.col("n"), F.col(group)], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def series_coverage(sizes: DataFrame) -> DataFrame:
    """One row over group sizes (column n): groups of two or more, and the share of members in them."""
    n, large = F.col("n"), F.col("n") >= 2
    return sizes.agg(F.count_if(large).alias("series"), (F.sum(F.when(large, n).otherwise(0)) / F.sum(n)).alias("in_series"))


def explode_ends(edges: DataFrame, *keep: str) -> DataFrame:
    """A row (node, other, ...) for each end of each edge."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    return edges.select(F.explode(ends).alias("e"), *keep).select("e.node", "e.other", *keep)


def degrees(edges: DataFrame) -> DataFrame:
    return explode_ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def hub_share(edges: DataFrame, k: int) -> DataFrame:
    """One row: the share of edges by summed degree (a hub-hub edge counts twice) and by incidence (once)."""
    top = hubs(edges, k)
    n = edges.agg(F.count("*").alias("n_edges"))
    summed = top.agg(F.sum("degree").alias("hub_degree"))
    near = edges.join(top.select(F.col("node").alias("a"), F.lit(1).alias("x")), "a", "left").join(top.select(F.col("node").alias("b"), F.lit(1).alias("y")), "b", "left")
    met = near.agg(F.count_if(F.col("x").isNotNull() | F.col("y").isNotNull()).alias("incident"))
    made = n.crossJoin(summed).crossJoin(met)  # one row each
    return made.select("n_edges", F.coalesce("hub_degree", F.lit(0)).alias("hub_degree"), "incident", V.share(F.col("hub_degree"), F.col("n_edges")).alias("degree_share"), V.share(F.col("incident"), F.col("n_edges")).alias("incident_share"))


def edge_labels(edges: DataFrame) -> DataFrame:
    """Edges with group_a, group_b labelled by which end is in ``hub`` groups; same tells equal groups."""
    both = F.col("hub_a") & F.col("hub_b")
    label = F.when(both, "both").when(F.col("hub_a"), "a").when(F.col("hub_b"), "b").otherwise("none")
    return edges.withColumn("hub_label", label)


def neighbourhood(edges: DataFrame) -> DataFrame:
    """Each node: neighbours, mean difference, mean similarity, cliffs. ``edges``: a, b, delta, similarity, tier."""
    ends = explode_ends(edges, "delta", "similarity", "tier")
    return ends.groupBy("node").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.avg("similarity").alias("mean_similarity"), F.count_if(F.col("tier") != "non_cliff").alias("cliffs"))


def matched_pairs(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b of items (id, tokens) that are equal but for one token, with the number of shared cores and, for each column to ``keep``, <name>_a and <name>_b.

    Each item gives one core for each token left out, marked at its place; items meet on cores.
    Items whose text tells their tokens share one core at most, so that their pairs are done where they meet and not shuffled.
    """
    t = F.col("tokens")
    told = F.forall(t, lambda x: x.isNotNull() & (x != "*") & ~x.contains(" ")) & (F.count("*").over(Window.partitionBy("id")) == 1)
    items = items.filter(F.col("id").isNotNull())
    each = items.withColumn("told", told).filter(F.size(t) > 1).select("id", "told", *keep, F.posexplode(t).alias("at", "token"), t)
    gap = F.array_join(F.transform("tokens", lambda t, i: F.when(i == F.col("at"), "*").otherwise(t)), " ")
    core = each.select("id", "token", "told", *keep, gap.alias("core"))

    def met(rows: DataFrame, *own: str) -> DataFrame:
        left, right = (rows.select("core", *(F.col(c).alias(k if c == "id" else f"{c}_{k}") for c in ("id", "token", *own))) for k in "ab")
        # merged: a plan's estimate is of the items' file, cores are many times as long, so they might be sent to the driver for a broadcast
        return left.hint("merge").join(right, "core").filter((F.col("a") < F.col("b")) & (F.col("token_a") != F.col("token_b")))

    names = [f"{c}_{k}" for c in keep for k in "ab"]
    alone = met(core.filter("told"), *keep).select("a", "b", F.lit(1).cast("long").alias("n_cores"), "core", *names)
    odd = core.filter(~F.col("told"))
    near = core.filter("told").join(odd.select("core").distinct(), "core", "left_semi")
    more = met(odd.unionByName(near), "told").filter(~(F.col("told_a") & F.col("told_b")))
    more = more.groupBy("a", "b").agg(F.count("*").alias("n_cores"), F.min("core").alias("core"))
    for k in "ab" if keep else "":
        more = more.join(items.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in keep)), k)
    return alone.unionByName(more.select("a", "b", "n_cores", "core", *names))


def discontinuity(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each node (id, value): partners and the mean difference to them (null without). ``pairs``: a, b, value_a, value_b."""
    made = explode_ends(pairs, "value_a", "value_b").groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n_partners"), F.avg(F.abs(F.col("value_a") - F.col("value_b"))).alias("score"))
    return nodes.join(made, "id", "left").withColumn("n_partners", F.coalesce("n_partners", F.lit(0)))


def shared_assays(pairs: DataFrame, measured: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of assays both have and the largest difference within one (null without)."""
    one, two = (measured.select(F.col("entity").alias(k), "assay", F.col("value").alias(f"v_{k}")) for k in "ab")
    common = pairs.join(one, "a").join(two, ["b", "assay"]).groupBy("a", "b").agg(F.count("*").alias("n_common"), F.max(F.abs(F.col("v_a") - F.col("v_b"))).alias("max_delta"))
    return pairs.join(common, ["a", "b"], "left").withColumn("n_common", F.coalesce("n_common", F.lit(0)))


def diversity(sizes: DataFrame) -> DataFrame:
    """One row over group sizes (column n): ratio, singletons, top-ten coverage, Gini, Shannon entropy, evenness.

    Sizes are first counted by value, so that the ordered sums run over distinct sizes.
    """
    by = sizes.groupBy("n").agg(F.count("*").alias("k"))
    by = scan(by, [F.col("n")], before={"cum": F.col("n") * F.col("k"), "below": F.col("k")})
    by = on_keys(by, sizes.agg(F.count("*").alias("all")), [])
    by = by.withColumn("above", F.col("all") - F.col("below") - F.col("k"))
    k, n = F.col("k"), F.col("n")
    made = by.agg(
        F.sum(k).alias("groups"), F.sum(n * k).alias("members"), F.sum(F.when(n == 1, k).otherwise(0)).alias("singles"),
        F.sum(n * F.greatest(F.lit(0), F.least(k, 10 - F.col("above")))).alias("top10"),
        F.sum(F.col("cum") * k + n * k * (k + 1) / 2).alias("cum"), F.sum(n * k * F.log(n.cast("double"))).alias("nlogn"),
    )
    g, m = F.col("groups"), F.col("members")
    shannon = F.log(m.cast("double")) - F.col("nlogn") / m
    return made.select(
        "groups", "members", (g / m).alias("ratio"), (F.col("singles") / g).alias("singleton_share"), (F.col("top10") / m).alias("top10_coverage"),
        ((g + 1 - 2 * F.col("cum") / m) / g).alias("gini"), shannon.alias("shannon"), F.when(g > 1, shannon / F.log(g.cast("double"))).alias("evenness"),
    )


def lorenz(sizes: DataFrame) -> DataFrame:
    """Rank of each distinct size with the cumulative shares of groups and members up to it."""
    by = sizes.groupBy("n").agg(F.count("*").alias("k"))
    by = scan(by, [F.col("n")], before={"g": F.col("k"), "m": F.col("n") * F.col("k")})
    by = on_keys(by, sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("members")), [])
    return by.select("n", "k", ((F.col("g") + F.col("k")) / F.col("groups")).alias("group_share"), ((F.col("m") + F.col("n") * F.col("k")) / F.col("members")).alias("member_share"))
