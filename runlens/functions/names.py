"""Names of columns, groups, runs and files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.constants import GROUP_TAG_LENGTH, GROUP_TAGS


def normalize_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def sanitize_name(name: str) -> str:
    return re.sub(r"[^a-z0-9_]", "_", normalize_name(name))


def _rename(df: DataFrame, names: list[str]) -> DataFrame:
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"column names collide: {repeated}")
    return df.toDF(*names)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip, lower-case, blank to underscore."""
    return _rename(df, [normalize_name(c) for c in df.columns])


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Only ``[a-z0-9_]``, one character for one."""
    return _rename(df, [sanitize_name(c) for c in df.columns])


def normalize_text(name: Column) -> Column:
    """``normalize_name`` for names that are data."""
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def group_tag(group: Column) -> Column:
    """Short column prefix of a measurement group."""
    known = F.create_map(*[F.lit(x) for pair in GROUP_TAGS.items() for x in pair])
    derived = F.substring(F.regexp_replace(F.lower(group), "[^a-z0-9_]", "_"), 1, GROUP_TAG_LENGTH)
    return F.coalesce(F.try_element_at(known, group), derived)


def group_name(stem: Column) -> Column:
    """Group part of ``date_time_GROUP``, else the whole stem."""
    return F.coalesce(F.try_element_at(F.split(stem, "_", 3), F.lit(3)), stem)


def measurement_ts(stem: Column) -> Column:
    """ISO text from the two six-character parts in front of a file stem, else null."""
    parts = F.split(stem, "_", 3)
    day, clock = F.get(parts, 0), F.get(parts, 1)

    def pairs(text: Column, separator: str) -> Column:
        return F.concat_ws(separator, *[F.substring(text, i, 2) for i in (1, 3, 5)])

    iso = F.concat(F.lit("20"), pairs(day, "-"), F.lit("T"), pairs(clock, ":"))
    return F.when((F.length(day) == 6) & (F.length(clock) == 6), iso)


def run_number(name: Column) -> Column:
    """Digits at the end of a run name, else -1."""
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint"))


def format_bytes(size: Column) -> Column:
    """Size as text. Halves of the last digit round up."""
    return (
        F.when(size >= 1e9, F.format_string("%.2f GB", size / 1e9))
        .when(size >= 1e6, F.format_string("%.1f MB", size / 1e6))
        .otherwise(F.format_string("%.1f KB", size / 1e3))
    )


def truncate_text(text: Column, length: int = 90) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)
