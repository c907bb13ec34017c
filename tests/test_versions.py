"""Versioned tables: commits, readers, crashes, conflicts, and copy-on-write repair."""

import pytest
from pyspark.sql import functions as F

from runlens.sources import files, versions


def numbers(df):
    return sorted(r.v for r in df.collect())


def table_of(spark, *values):
    return spark.createDataFrame([(v, f"Tranche_{'AB'[v % 2]}") for v in values], "v long, tranche string")


def test_versions_and_pinned_readers(spark, tmp_path):
    path = str(tmp_path / "table one")
    assert versions.current(spark, path).number == 0
    assert versions.replace(table_of(spark, 1, 2), path, versions.partitioned("tranche")).number == 1
    pinned = versions.read(spark, path)
    assert versions.append(table_of(spark, 3), path, versions.partitioned("tranche")).number == 2
    assert versions.replace(versions.read(spark, path).withColumn("v", F.col("v") * 10), path, versions.partitioned("tranche")).number == 3
    assert numbers(pinned) == [1, 2]
    assert numbers(versions.read(spark, path, number=2)) == [1, 2, 3]
    now = versions.read(spark, path, table_of(spark, 1).schema)
    assert numbers(now) == [10, 20, 30] and now.columns == ["v", "tranche"]
    with pytest.raises(ValueError, match="no version 9"):
        versions.read(spark, path, number=9)


@pytest.mark.parametrize("dies", ["_stage", "_commit"])
def test_a_dead_writer_leaves_the_table(spark, tmp_path, monkeypatch, dies):
    path = str(tmp_path / "t")
    versions.replace(table_of(spark, 1), path)
    with monkeypatch.context() as patch:
        real = versions._stage

        def die(*args):
            if dies == "_stage":
                real(*args)
            raise KeyboardInterrupt

        patch.setattr(versions, dies, die)
        with pytest.raises(KeyboardInterrupt):
            versions.replace(table_of(spark, 2), path)
    assert numbers(versions.read(spark, path)) == [1]
    assert versions.replace(table_of(spark, 3), path).number == 2
    assert numbers(versions.read(spark, path)) == [3]
    assert versions.forget(spark, path) == 2
    assert numbers(versions.read(spark, path)) == [3] and versions.current(spark, path).number == 2


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.replace(table_of(spark, 1), path)
    real = versions._stage

    def slow(df, table, write):
        monkeypatch.setattr(versions, "_stage", real)
        versions.replace(table_of(spark, 2), path)
        return real(df, table, write)

    monkeypatch.setattr(versions, "_stage", slow)
    with pytest.raises(versions.Conflict):
        versions.append(table_of(spark, 3), path)
    assert numbers(versions.read(spark, path)) == [2]


def test_repair_rewrites_only_conflicting_files(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([("a", 1.5, "Tranche_A"), ("b", 2.0, "Tranche_B")], "run_id string, x double, tranche string")
    write = versions.partitioned("tranche", compression="snappy")
    versions.replace(good, path, write)
    versions.append(good.where("run_id = 'a'").withColumns({"x": F.col("x").cast("int"), "run_id": F.lit("c")}), path, write)
    before = {r.uri for r in versions.files(spark, path).collect()}
    odd = versions.conflicting(files.footer_columns(versions.files(spark, path)), ["x"])
    hit = {r.uri for r in odd.collect()}
    assert len(hit) == 1
    assert versions.rewrite(spark, path, odd, versions.cast_columns({"x": "double", "absent": "double"}), write).number == 3
    after = {r.uri for r in versions.files(spark, path).collect()}
    assert before - after == hit and len(after - before) == 1
    types = files.footer_columns(versions.files(spark, path)).where("column = 'x'").select("type").distinct().collect()
    assert [r.type for r in types] == ["double"]
    assert sorted((r.run_id, r.x) for r in versions.read(spark, path).collect()) == [("a", 1.5), ("b", 2.0), ("c", 1.0)]
    again = versions.conflicting(files.footer_columns(versions.files(spark, path)), ["x"])
    assert versions.rewrite(spark, path, again, versions.cast_columns({"x": "double"}), write).number == 3


def test_no_files(spark, tmp_path):
    path, schema = str(tmp_path / "t"), table_of(spark, 1).schema
    assert versions.read(spark, path, schema).collect() == []
    with pytest.raises(ValueError, match="no files"):
        versions.read(spark, path)
    versions.replace(table_of(spark, 1).where("false"), path, versions.partitioned("tranche"))
    assert versions.read(spark, path, schema).collect() == []
