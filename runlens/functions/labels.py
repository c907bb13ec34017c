"""Run labels: from folder names, from label tables, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.constants import OFF_PREFIX, OFF_WORDS, ON_PREFIX, ON_WORDS


def label_from_name(name: Column) -> Column:
    """Label that a run folder's name starts with, else null."""
    text = F.lower(name)
    return F.when(text.startswith(ON_PREFIX), "on").when(text.startswith(OFF_PREFIX), "off")


def name_mentions_label(name: Column) -> Column:
    """Label found anywhere in the name (the looser test of the run census)."""
    text = F.lower(name)
    return F.when(text.contains(ON_PREFIX), "on").when(text.contains(OFF_PREFIX), "off")


def normalize_label(raw: Column) -> Column:
    """Map the spellings of a label table to on / off, else null."""
    text = F.lower(F.trim(raw.cast("string")))
    return F.when(text.isin(*ON_WORDS), "on").when(text.isin(*OFF_WORDS), "off")


def resolve_label(from_name: Column, from_table: Column) -> dict[str, Column]:
    """The run's label, where it came from, and whether both sources disagree."""
    return {
        "cipher_state": F.coalesce(from_name, from_table, F.lit("unknown")),
        "cipher_source": F.when(from_name.isNotNull(), "folder")
        .when(from_table.isNotNull(), "db")
        .otherwise("none"),
        "label_mismatch": F.coalesce(from_name != from_table, F.lit(False)),
    }


def label_display(label: Column, anomalous: str = "off") -> Column:
    """Text shown for a label; which class counts as the misconfigured one is a parameter."""
    def text(state: str) -> str:
        note = "misconfigured" if state == anomalous else "normal"
        return f"Cipher {state.upper()} ({note})"

    return F.when(label == "on", text("on")).when(label == "off", text("off"))
