"""Activity extraction from assay tables of differing layouts, and wide-to-long conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import values as V

# Columns that may hold an inhibition, in order.
INHIBITION = ("Inhibition", "Inhibition at 6.36 uM", "Inhibition at 10 uM", "Inhibition at 100 uM")


def _blank(name: str, have: set[str]) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in have else F.lit("")


def _quoted(name: str, have: set[str]) -> Column:
    return F.regexp_replace(_blank(name, have), "^'+|'+$", "")


def extract(df: DataFrame, layer: str = "layer") -> DataFrame:
    """``df`` with endpoint, source_column, value_raw, qualifier, value_nm, unit, status, potency, usable.

    The layout (which columns the table has) decides the strategy when the plan is made:
    the first that fits wins, even where its cell is blank. Tables of differing layouts
    are extracted each and then put together.
    """
    have = set(df.columns)
    kind, no = _blank("Standard Type", have), F.lit(None).cast("double")

    def numeric(column: str, endpoint: Column, relation: Column, unit: Column, keeps_sign_only: bool, equals_counts: bool) -> dict[str, Column]:
        raw = _blank(column, have)
        parsed = V.parse_value(raw)
        own = (relation != "") & (F.lit(equals_counts) | (relation != "="))
        qualifier = F.when(raw == "", relation).when(own, relation).otherwise(parsed["qualifier"])
        percent = ((endpoint == "Pct_inh") | (unit == "%")) if keeps_sign_only else F.lit(False)
        moved = V.convert_units(parsed["value"], unit)
        bad = parsed["status"].isin("PARSE_ERROR", "QUALIFIER_ONLY") if keeps_sign_only else parsed["status"] == "PARSE_ERROR"
        status = F.when(raw == "", "NO_VALUE").when(bad, parsed["status"]).when(percent, "OK").otherwise(moved["status"])
        value = F.when((raw != "") & ~bad & ~percent, moved["value"])
        return {"endpoint": endpoint, "source_column": F.lit(column), "value_raw": raw, "qualifier": qualifier, "value_nm": value, "unit": unit, "status": status, "_direct": no}

    relation = _quoted("Standard Relation", have)
    if {"Standard Value", "Standard Units"} <= have:
        made = numeric("Standard Value", V.endpoint_name(kind), relation, _blank("Standard Units", have), True, False)
    elif "IC50" in have:
        own = _quoted("IC50 Qualifier", have) if "IC50 Qualifier" in have else relation
        made = numeric("IC50", V.endpoint_name(F.when(kind == "", "IC50").otherwise(kind)), own, F.lit("nM"), False, True)
    elif "PubChem Standard Value" in have:
        made = numeric("PubChem Standard Value", V.endpoint_name(kind), relation, F.lit("uM"), False, True)
    elif "Average IC50" in have:
        made = numeric("Average IC50", F.lit("IC50"), _quoted("Qualifier", have), F.lit("uM"), False, True)
    elif {"pIC50_min", "pIC50_max"} & have:
        raw = F.coalesce(F.nullif(_blank("pIC50_min", have), F.lit("")), _blank("pIC50_max", have))
        p = V.number(raw)
        status = F.when(raw == "", "NO_VALUE").when(p.isNull(), "PARSE_ERROR").otherwise("OK")
        made = {"endpoint": F.lit("IC50"), "source_column": F.lit("pIC50_min" if "pIC50_min" in have else "pIC50_max"), "value_raw": raw, "qualifier": F.when(p.isNotNull(), "=").otherwise(""), "value_nm": V.from_potency(p), "unit": F.lit("nM"), "status": status, "_direct": p}
    elif found := [c for c in INHIBITION if c in have]:
        raw = _blank(found[0], have)
        made = {"endpoint": F.lit("Pct_inh"), "source_column": F.lit(found[0]), "value_raw": raw, "qualifier": V.parse_value(raw)["qualifier"], "value_nm": no, "unit": F.lit("%"), "status": F.when(raw == "", "NO_VALUE").otherwise("OK"), "_direct": no}
    else:
        name = V.endpoint_name(kind)
        made = {"endpoint": F.when(name == "", "Unknown").otherwise(name), "source_column": F.lit("PUBCHEM_ACTIVITY_OUTCOME"), "value_raw": _blank("PUBCHEM_ACTIVITY_OUTCOME", have), "qualifier": F.lit(""), "value_nm": no, "unit": F.lit(""), "status": F.lit("NO_VALUE"), "_direct": no}
    rows = df.withColumns(made)
    is_ic50, positive = F.col("endpoint") == "IC50", F.coalesce(F.col("value_nm") > 0, F.lit(False))
    potency = F.when(F.col("endpoint") == "Pct_inh", no).otherwise(F.coalesce(F.col("_direct"), F.when(is_ic50, V.potency(F.col("value_nm")))))
    outside = ~F.coalesce(F.col(layer), F.lit("")).isin("HTS", "D", "E")
    return rows.withColumn("potency", potency).withColumn("usable", is_ic50 & positive & outside).drop("_direct")


def endpoints_long(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A row for each filled value column; ``columns``: column -> endpoint label."""
    cells = F.array(*(F.struct(F.lit(label).alias("endpoint"), F.lit(c).alias("source_column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value_raw")) for c, label in columns.items()))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    rows = df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*").filter(F.coalesce(F.col("value_raw"), F.lit("")) != "")
    parsed = V.parse_value(F.col("value_raw"))
    return rows.withColumn("_p", parsed).select("*", "_p.qualifier", F.col("_p.value").alias("value_nm"), "_p.status").drop("_p")
