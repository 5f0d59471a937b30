from gridloom.plans import programs, registry


def test_grids_to_validate_are_built_on_all_cores(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks, derived = [], programs.derived
    monkeypatch.setattr(programs, "derived", lambda part: tasks.append(part.rdd.getNumPartitions()) or derived(part))
    out = registry.QUERIES["program_validation"](spark, str(tmp_path))
    assert tasks and min(tasks) >= spark.sparkContext.defaultParallelism
    assert out.count() == 2000
