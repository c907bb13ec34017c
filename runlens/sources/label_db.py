"""Label tables kept in one small SQLite file per session."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.files import path_parts

NAME = "metadata.db"


def label_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (tranche, session, content) of the files right in a session folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", NAME)
        .load(root)
    )
    path = F.col("_metadata.file_path")
    parts = path_parts(path)
    return files.where(path.rlike(rf"/(?:session=)?Session_[^/]+/{re.escape(NAME)}$")).select(parts["tranche"].alias("tranche"), parts["session"].alias("session"), "content")


def _read(content: bytes) -> list[tuple]:
    with sqlite3.connect(":memory:") as con:
        con.deserialize(content)
        return con.execute("select rowid, name, eNB from configurations").fetchall()


def label_table(files: DataFrame) -> DataFrame:
    """Rows (tranche, session, name, enb): the first entry per name; unreadable files give none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tranche, session, content in zip(batch["tranche"], batch["session"], batch["content"]):
                try:
                    found = _read(bytes(content))
                except sqlite3.Error:
                    continue
                rows += [(tranche, session, pos, name, None if enb is None else str(enb))
                         for pos, name, enb in found]
            yield pd.DataFrame(rows, columns=["tranche", "session", "pos", "name", "enb"])

    entries = files.mapInPandas(
        parse, "tranche string, session string, pos bigint, name string, enb string"
    )
    return entries.groupBy("tranche", "session", "name").agg(F.min_by("enb", "pos").alias("enb"))
