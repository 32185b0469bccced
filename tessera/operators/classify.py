"""Ordered classifications: ids first, then codes, then keywords, then a default; tags that may overlap."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes by endpoint, by layer and by keyword, in order of priority.
BY_ENDPOINT = (("Kinact_Ki", "covalent_irreversible"), ("Ki", "fp_binding"), ("Kd", "fp_binding"), ("EC50", "cellular"), ("Pct_inh", "screening_single_conc"))
BY_LAYER = (("HTS", "hts_screen"), ("E", "cellular"), ("D", "fp_binding"))
BY_KEYWORD = (
    (("RFMS",), "rfms_enzymatic"), (("FP", "FLUORESCENCE"), "fp_binding"), (("BAEE", "COLORIMETRIC"), "baee_colorimetric"), (("ABPP",), "fp_binding"),
    (("MALDI", "MASS"), "fp_binding"), (("CELLULAR", "WESTERN"), "cellular"), (("KINETICS",), "covalent_irreversible"),
)
USUAL = "baee_colorimetric"
GROUPS = (("covalent_irreversible", "covalent"), ("rfms_enzymatic", "enzymatic_confirmed"), ("baee_colorimetric", "enzymatic"), ("fp_binding", "fp_ic50"))
ORGANISMS = ((("homo sapiens", "human"), "homo_sapiens"), (("mus musculus", "mouse"), "mus_musculus"), (("rattus norvegicus", "rat"), "rattus_norvegicus"))
RECOMBINANT = ("escherichia", "ecoli", "recombinant")
SIZES = ((1, "single_atom"), (4, "small_substituent"), (8, "medium_substituent"))
HALOGENS, HETEROATOMS = ("F", "Cl", "Br", "I"), ("N", "O", "S")


def first_of(rules: Iterable[tuple[Column, str]], default: str | Column) -> Column:
    """The label of the first rule whose condition holds (null counts as no)."""
    rules = list(rules)
    made = F.when(rules[0][0], rules[0][1])
    for condition, label in rules[1:]:
        made = made.when(condition, label)
    return made.otherwise(default)


def _any_of(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def assay_mechanism(assay_id: Column, endpoint: Column, layer: Column, kind: Column, overrides: dict[str, Iterable[int]]) -> Column:
    """Class of an assay: id overrides, then endpoint, layer, keywords of ``kind`` (any case), then USUAL."""
    number, name, words = assay_id.try_cast("long"), F.trim(F.coalesce(endpoint, F.lit(""))), F.upper(F.coalesce(kind, F.lit("")))
    rules = [(number.isin(list(ids)), label) for label, ids in overrides.items()]
    rules += [(name == k, label) for k, label in BY_ENDPOINT] + [(layer == k, label) for k, label in BY_LAYER]
    return first_of([*rules, *((_any_of(words, k), label) for k, label in BY_KEYWORD)], USUAL)


def mechanism_group(classes: Column) -> Column:
    """Group of a delimited list of classes, by the first of GROUPS it holds."""
    return first_of(((classes.contains(k), label) for k, label in GROUPS), "unknown")


def id_class(assay_id: Column, sets: dict[str, Iterable[str]], default: str) -> Column:
    """Class of an id by the first set that holds it."""
    name = F.trim(assay_id.cast("string"))
    return first_of(((name.isin(list(ids)), label) for label, ids in sets.items()), default)


def organism(text: Column) -> Column:
    """Code of an organism's name; null, empty and nan are unknown."""
    name = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    rules = [(name.isin("", "nan"), "unknown"), *((name.isin(*names), code) for names, code in ORGANISMS), (_any_of(name, RECOMBINANT), "recombinant")]
    return first_of(rules, "non_human_other")


def token_difference(a: Column, b: Column) -> Column:
    """Struct only_a, only_b: tokens of one list that the other has not, distinct and sorted."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"))


def difference_tags(symbols: Column, aromatic: Column, ring: Column) -> Column:
    """Tags of the atoms by which two structures differ (element symbols; whether any is aromatic, or in a ring); several may hold."""
    n = F.size(symbols)
    held = lambda group: F.arrays_overlap(symbols, F.array(*map(F.lit, group)))
    size = first_of(((n <= most, label) for most, label in SIZES), "large_substituent")
    carbon = (n > 0) & F.forall(symbols, lambda s: s == "C")
    tags = [F.when(held(HALOGENS), "halogen_change"), F.when(held(HETEROATOMS), "heteroatom_change"), F.when(aromatic, "aromatic_change"), F.when(ring, "ring_modification"), size, F.when(carbon, "carbon_only")]
    return F.array_compact(F.array(*tags))
