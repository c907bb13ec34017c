"""Stored tables of many folders are listed by few tasks."""

from runlens.sources import tables, versions


def widest(spark, group, call):
    """The result of ``call``, and the most tasks of a stage that it ran."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        found, tracker = call(), spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, max((s.numTasks for s in stages if s), default=0)


def test_folders_are_listed_by_two_tasks_per_core(spark, tmp_path):
    rows = spark.range(60).selectExpr("'Tranche_A' as tranche", "concat('Session_', id) as session", "cast(id as string) as run_id", "id * 0.5e0 as x")
    few, name = 2 * spark.sparkContext.defaultParallelism, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    tables.write_bronze(rows, str(tmp_path / "bronze"))
    found, most = widest(spark, "bronze", lambda: tables.read_bronze(spark, str(tmp_path / "bronze"), rows.schema))
    assert 0 < most <= few < 60 and found.count() == 60
    versions.replace(tables.bronze_rows(rows), str(tmp_path / "table"), tables.bronze_writer())
    paths = versions.files(spark, str(tmp_path / "table"))
    found, most = widest(spark, "versions", lambda: versions._opened(spark, str(tmp_path / "table"), paths, rows.schema))
    assert 0 < most <= few and found.count() == 60
    assert spark.conf.get(name) == before
