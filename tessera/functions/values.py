"""Scalar functions on measured values, labels and pairs; all are column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit factors to nanomolar, endpoint names, status ranks, overlap scores.
UNIT_FACTORS = {
    "nm": 1.0, "nanomolar": 1.0, "nmol/l": 1.0,
    "um": 1e3, "µm": 1e3, "micromolar": 1e3, "umol/l": 1e3,
    "mm": 1e6, "millimolar": 1e6, "mmol/l": 1e6,
    "pm": 1e-3, "picomolar": 1e-3, "pmol/l": 1e-3,
    "m": 1e9, "mol/l": 1e9,
}
ENDPOINTS = {
    "ic50": "IC50", "ic 50": "IC50", "pic50": "IC50", "ki": "Ki", "kd": "Kd", "ec50": "EC50", "ratio": "Kinact_Ki",
    "kinact/ki": "Kinact_Ki", "kinact_ki": "Kinact_Ki", "inhibition": "Pct_inh", "% inhibition": "Pct_inh",
    "pct_inh": "Pct_inh", "activity": "Pct_inh", "potency": "IC50",
}
STATUSES = ("OK", "NO_VALUE", "QUALIFIER_ONLY", "UNCONVERTIBLE_UNITS", "PARSE_ERROR")


def literal_map(items: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in items.items() for x in pair))


def number(col: Column) -> Column:
    """Text as double, null where it is not a number."""
    return col.try_cast("double")


def nonempty(*cols: Column) -> Column:
    """The first column that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols))


def cut_at_bar(col: Column) -> Column:
    """Text before the first " |", trimmed."""
    return F.trim(F.substring_index(col, " |", 1))


def parse_value(col: Column) -> Column:
    """Struct qualifier, value, status of a text such as ">= 12.5"; the equals sign is dropped."""
    text = F.trim(F.coalesce(col, F.lit("")))
    sign = F.regexp_extract(text, r"^([<>~=]{1,2})\s*", 1)
    rest = F.trim(F.regexp_replace(text, r"^[<>~=]{1,2}\s*", ""))
    value = number(rest)
    status = F.when(text == "", "NO_VALUE").when(rest == "", "QUALIFIER_ONLY").when(value.isNull(), "PARSE_ERROR").otherwise("OK")
    return F.struct(F.replace(sign, F.lit("="), F.lit("")).alias("qualifier"), value.alias("value"), status.alias("status"))


def convert_units(value: Column, unit: Column) -> Column:
    """Struct value (in nanomolar) and status."""
    key = F.replace(F.lower(F.trim(unit)), F.lit(" "), F.lit(""))
    factor = F.element_at(literal_map(UNIT_FACTORS), key)
    status = F.when(value.isNull(), "NO_VALUE").when(factor.isNull(), "UNCONVERTIBLE_UNITS").otherwise("OK")
    return F.struct((value * factor).alias("value"), status.alias("status"))


def endpoint_name(col: Column) -> Column:
    """Known codes in their one spelling, others trimmed."""
    return F.coalesce(F.element_at(literal_map(ENDPOINTS), F.lower(F.trim(col))), F.trim(col), F.lit(""))


def potency(value: Column) -> Column:
    """9 - log10(nanomolar), null unless positive."""
    return F.when(value > 0, 9 - F.log10(value))


def from_potency(p: Column) -> Column:
    return F.pow(F.lit(10.0), 9 - p)


@F.arrow_udf(T.StructType([T.StructField("potency", T.DoubleType()), T.StructField("back", T.DoubleType())]))
def round_trip(value: pa.Array) -> pa.Array:
    """Potency of a value (infinite of 0, no number below) and the value that follows from it, by the C library.

    Java's logarithm and power differ from it in the last digit, by which a value that lies between two rounded ones falls to either.
    """
    p = [None if v is None else math.nan if v < 0 else math.inf if v == 0 else 9 - math.log10(v) for v in value.to_pylist()]
    back = [None if x is None else math.inf if x < 9 - 308.25 else math.pow(10.0, 9 - x) for x in p]
    return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in (p, back)], ["potency", "back"])


def rounded_double(value: Column, digits: int) -> Column:
    """Rounded as a double times a power of ten, not by its decimal text: 0.5095 is a little below and goes down."""
    return F.when(F.abs(value) < 1e300, F.round(value * 10.0**digits) / 10.0**digits).otherwise(value)


def differs(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two values are further apart than the tolerance; false if either is null."""
    return F.coalesce(F.abs(a - b) > tolerance, F.lit(False))


def status_rank(col: Column) -> Column:
    return F.coalesce(F.element_at(literal_map({s: i for i, s in enumerate(STATUSES)}), col), F.lit(-1))


def overlap_score(sources: Column, scores: dict[str, float], otherwise: float) -> Column:
    """Score of a sorted, bar-joined set of sources: 1 for a single one, else the table's or the default."""
    key = F.array_join(F.array_sort(F.split(sources, r"\|")), "|")
    alone = F.size(F.split(sources, r"\|")) == 1
    return F.when(alone, 1.0).otherwise(F.coalesce(F.element_at(literal_map(scores), key), F.lit(otherwise)))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def sali(delta: Column, similarity: Column) -> Column:
    """Difference over dissimilarity, null for identical ones."""
    return F.when(similarity < 1, delta / (1 - similarity))


def share(part: Column, whole: Column, factor: float = 1.0) -> Column:
    """part / whole, 0 where the whole is."""
    return F.when(whole > 0, part / whole * factor).otherwise(F.lit(0.0))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "< 0.001").otherwise(F.format_string("%.3f", p))


def tier(similarity_10: Column, delta: Column) -> Column:
    """First matching of severe, moderate, broad; the first argument says that the similarity is 0.8 or more."""
    return F.when(similarity_10 & (delta >= 2.0), "severe").when(similarity_10 & (delta >= 1.5), "moderate").when(similarity_10 & (delta >= 1.0), "broad").otherwise("non_cliff")
