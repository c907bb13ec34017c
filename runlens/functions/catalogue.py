"""Expressions over feature names and layer texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.constants import LAYER_PREFIXES, LAYER_TERMS

_QUANTILE = r"^(.+)-q_([0-9.]+)$"
_PROPORTION = r"^(.+)-r_(.+)$"


def parse_feature_name(name: Column) -> dict[str, Column]:
    """Split ``prefix-q_number`` / ``prefix-r_value`` into its parts."""
    quantile, proportion = name.rlike(_QUANTILE), name.rlike(_PROPORTION)
    return {
        "measurand_prefix": F.when(quantile, F.regexp_extract(name, _QUANTILE, 1))
        .when(proportion, F.regexp_extract(name, _PROPORTION, 1))
        .otherwise(name),
        "feature_type": F.when(quantile, "quantile")
        .when(proportion, "proportion")
        .otherwise("metadata"),
        "feature_value": F.when(quantile, F.regexp_extract(name, _QUANTILE, 2)).when(
            proportion, F.regexp_extract(name, _PROPORTION, 2)
        ),
    }


def _first_match(tests: list[tuple[Column, str]], otherwise: str) -> Column:
    head, *rest = tests
    chain = reduce(lambda acc, t: acc.when(*t), rest, F.when(*head))
    return chain.otherwise(otherwise)


def layer_of_text(layer: Column) -> Column:
    """Layer group of a catalogue row's layer text."""
    text = F.lower(layer)
    tests = [
        (reduce(lambda a, b: a | b, [text.contains(term) for term in terms]), group)
        for group, terms in LAYER_TERMS.items()
    ]
    blank = F.coalesce(layer, F.lit("")) == ""
    return _first_match([(blank, "Unknown"), *tests], "Other")


def layer_of_feature(name: Column) -> Column:
    """Layer group by the start of a feature's name."""
    text = F.lower(name)
    tests = [(text.startswith(prefix), layer) for prefix, layer in LAYER_PREFIXES.items()]
    return _first_match(tests, "Metadata/Other")


def squash(name: Column) -> Column:
    """Lower case without underscores, the form names are matched in."""
    return F.replace(F.lower(name), F.lit("_"), F.lit(""))
