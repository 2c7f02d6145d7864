"""Plan shape: no cartesian or nested-loop joins anywhere, filters and
column pruning reach the scan, partial aggregation and no Expand where the
operator is designed without one."""

import pytest

from orderlens.operators import clean, features, line_kpi, orders
from orderlens.plans.queries import QUERIES
from orderlens.sources.fixtures import LINE_ORDER, fx_lines

MODEL = {"f19_logistic_scores", "f26_fitted_comparison", "g10_fitted_decision"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def static(spark):
    # plan as if every table were large: no runtime re-planning, no size-based broadcast
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL))
def test_no_cross_or_nested_loop_join(static, sf, name):
    p = plan(QUERIES[name](static, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_pruned(static, sf):
    p = plan(fx_lines(static, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint," in p
    assert "l_tax" not in p and "l_shipdate" not in p


def test_line_kpis_have_no_expand(static, sf):
    p = plan(line_kpi.line_kpis(clean.derive_line_columns(fx_lines(static, sf))))
    assert "Expand" not in p
    assert "partial_" in p


def test_order_build_reuses_join_partitioning(static, sf):
    lines = fx_lines(static, sf)
    p = plan(orders.build_orders(lines, LINE_ORDER, profit_rule="sum"))
    # the per-order aggregate, the distinct counts and their join all reuse the
    # join's partitioning by order key: no exchange on order_id, no Expand
    assert "Exchange hashpartitioning(order_id" not in p
    assert "Expand" not in p


def test_order_queries_are_lazy_and_pruned(static, sf):
    # no checkpointed order table in between: the plan reaches the scans, and
    # the timing counts read neither money nor quantities
    for name in ("d4_build_orders", "d9_timing_counts", "e7_order_kpis", "e8_order_breakdown"):
        assert "ExistingRDD" not in plan(QUERIES[name](static, sf)), name
    p = plan(QUERIES["d9_timing_counts"](static, sf))
    assert "lineitem" in p and "l_tax" not in p and "sum(" not in p


def test_order_grain_reads_lines_once(static, sf):
    # the distinct counts are flags inside the one per-order aggregate: the
    # line fixture (lineitem scan, its joins and shuffles) is planned once
    lines = fx_lines(static, sf)
    for df in (orders.build_orders(lines, LINE_ORDER, profit_rule="sum"),
               features.order_features(lines, LINE_ORDER, check_dates=False)):
        p = plan(df)
        assert p.count("lineitem") == 1
        assert "Exchange hashpartitioning(order_id" not in p and "Expand" not in p


def test_checks_ride_on_the_main_job(static, sf):
    # the date check of the features and all of the order profile: one scan of the lines
    for name in ("f2_order_features", "d10_orders_profile"):
        assert plan(QUERIES[name](static, sf)).count("lineitem") == 1, name


def test_profit_rule_starts_no_job(static, sf):
    sc = static.sparkContext
    lines = fx_lines(static, sf)
    sc.setJobGroup("rule", "plan only")
    try:
        built = orders.build_orders(lines, LINE_ORDER)
        assert not sc.statusTracker().getJobIdsForGroup("rule")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert "Subquery" in plan(built) and "Subquery" not in plan(built.select("order_id", "revenue"))


def scans(p):
    return [line for line in p.split("\n") if "FileScan" in line]


def test_stage_tables_are_read_pruned_and_join_without_exchange(static, sf):
    p = plan(QUERIES["h2_late_by_mode"](static, sf))
    # of the order table the key and the mode, of the scores the key, the label and the probability
    schemas = sorted(line.split("ReadSchema: ")[1].split(",", 9)[0:9] for line in scans(p))
    assert [s[:2] for s in schemas] == [["struct<order_id:bigint", "late_delivery_risk:int"], ["struct<order_id:bigint", "shipping_mode:string>"]]
    for name in ("g2_join_scores", "g10_decision_table", "h1_headline", "h2_late_by_mode", "h5_review_queue", "f29_final_predictions"):
        p = plan(QUERIES[name](static, sf))
        assert "ExistingRDD" not in p and "hashpartitioning(order_id" not in p, name
        assert "lineitem" not in p and "Bucketed: true" in p, name
    # one model's scores, one side of the split
    assert "PartitionFilters: [isnotnull(model" in plan(QUERIES["g2_join_scores"](static, sf))
    assert "split" in next(s for s in scans(plan(QUERIES["f15_baselines"](static, sf))) if "PartitionFilters: [isnotnull(split" in s)


def test_stage_tables_follow_their_input(spark, sf, tmp_path):
    import shutil

    from orderlens.plans import stage_tables
    from orderlens.sources.fixtures import TABLES

    for t in TABLES:
        shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    n = stage_tables.order_table(spark, str(tmp_path)).count()
    kept = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_orderkey % 2 = 0")
    expected = kept.select("l_orderkey").distinct().count()
    kept.write.parquet(str(tmp_path / "lineitem.new"))
    (tmp_path / "lineitem.parquet").unlink()
    shutil.copytree(tmp_path / "lineitem.new", tmp_path / "lineitem.parquet")
    assert stage_tables.order_table(spark, str(tmp_path)).count() == expected < n
    stage_tables.drop_stage_tables(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("orderlens_")]
    assert stage_tables.order_table(spark, sf).count() == n
