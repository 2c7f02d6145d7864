"""A task's share of the lines does not grow with the input."""

from orderlens.plans import stage_tables
from orderlens.sources import fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_tasks_follow_the_lines(spark, sf, monkeypatch):
    before = fixtures.fx_lines(spark, sf)
    n = before.count()
    most = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    monkeypatch.setattr(fixtures, "LINES_A_TASK", n // most, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = fixtures.fx_lines(spark, sf)
        tasks = many.rdd.getNumPartitions()
        assert most <= tasks <= 4 * most
        per_order = many.groupBy("order_id").count()
        assert per_order.rdd.getNumPartitions() == tasks and "hashpartitioning(order_id" not in plan(per_order)
        assert many.exceptAll(before).isEmpty() and many.count() == n
        assert fixtures.line_tasks(spark, sf) == tasks
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_meet_many_customers_in_as_many_tasks(spark, sf, monkeypatch):
    import re

    before = fixtures.fx_lines(spark, sf)
    n = before.count()
    monkeypatch.setattr(fixtures, "LINES_A_TASK", n // 64)
    monkeypatch.setattr(fixtures, "PARTS_A_TASK", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = fixtures.fx_lines(spark, sf)
        tasks = str(fixtures.line_tasks(spark, sf))
        for key in ("o_custkey", "c_custkey", "o_orderkey", "l_partkey"):
            assert set(re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", plan(many))) == {tasks}, key
        assert many.exceptAll(before).isEmpty() and many.count() == n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_follow_the_lines(spark, sf, tmp_path, monkeypatch):
    import shutil

    for t in fixtures.TABLES:
        shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 60, raising=False)
    table = stage_tables.feature_table(spark, str(tmp_path))
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("orderlens_features"))
    assert table.count() == fixtures.fx_lines(spark, sf).select("order_id").distinct().count()
    buckets = {int(r["data_type"]) for t in spark.catalog.listTables() if t.name.startswith("orderlens_features")
               for r in spark.sql(f"DESCRIBE TABLE EXTENDED {t.name}").where("col_name = 'Num Buckets'").collect()}
    assert name and max(buckets) >= 6000 // 60 // stage_tables.TASKS_A_BUCKET


def checkpoints(spark):
    """RDD folders among the session's checkpoints."""
    from orderlens.session import ensure_checkpoint_dir

    folder = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    below = [x.getPath() for x in files.listStatus(folder)]
    below += [x.getPath() for at in below for x in files.listStatus(at)]
    return {at.toString() for at in below if at.getName().startswith("rdd-")}


def test_features_are_staged_as_columns(spark, sf, tmp_path):
    import shutil

    for t in fixtures.TABLES:
        shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    before = checkpoints(spark)
    table = stage_tables.feature_table(spark, str(tmp_path))
    assert checkpoints(spark) == before
    assert table.count() == fixtures.fx_lines(spark, sf).select("order_id").distinct().count()


def test_scores_are_staged_as_columns(spark, sf):
    from orderlens.plans import jobs

    split = stage_tables.feature_table(spark, sf)
    before = checkpoints(spark)
    scores = jobs.model_comparison_run(spark, None, (), which=("baseline",), split=split)["scores"]
    assert checkpoints(spark) == before and "ExistingRDD" not in plan(scores)
    assert scores.columns[:4] == ["model", "order_id", "late_delivery_risk", "late_delivery_probability"]
    test = split.where("split = 'test'").select("order_id", "late_delivery_risk")
    assert scores.select("order_id", "late_delivery_risk").exceptAll(test).isEmpty() and scores.count() == test.count() > 0
