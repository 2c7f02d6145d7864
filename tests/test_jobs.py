"""End-to-end operations job on the dirty fixture: stage tables are written
and read back, and results equal the stand-alone operators."""

from pyspark.sql import functions as F

from orderlens.operators import clean, orders
from orderlens.plans import jobs
from orderlens.sources.fixtures import LINE_ORDER, fx_lines_raw


def test_operations_report(spark, sf, tmp_path):
    out = jobs.operations_report(spark, fx_lines_raw(spark, sf), str(tmp_path), LINE_ORDER)
    assert spark.read.parquet(str(tmp_path / "order_lines")).count() == 6000
    built = spark.read.parquet(str(tmp_path / "orders"))
    assert built.count() == out["orders"].count()
    # the profile of the written lines equals the one computed from a grouping of its own
    whole = clean.cleaning_profile(clean.type_lines(fx_lines_raw(spark, sf)))
    assert {(r.metric, r.value) for r in out["cleaning_profile"].collect()} == {(r.metric, r.value) for r in whole.collect()}
    k = {r.kpi: r.value for r in out["order_kpis"].collect()}
    assert k["Unique Orders"] == built.count()
    # missing dates of the dirty fixture stay missing, and the profile counts them
    miss = {r.column_name: r.missing_cells for r in out["missing_by_column"].collect()}
    assert miss["order_date"] > 0 and miss["category_name"] > 0
    expected = orders.build_orders(clean.clean_lines(fx_lines_raw(spark, sf)), LINE_ORDER)
    cols = sorted(built.columns)
    assert built.select(cols).exceptAll(expected.select(cols)).count() == 0
    assert (tmp_path / "order_breakdown").exists() and (tmp_path / "line_kpis").exists()
    top = out["worst_late_orders"].orderBy("rank").select("rank").collect()
    assert [r.rank for r in top] == list(range(1, len(top) + 1))
    assert out["timing_counts"].agg(F.sum("orders")).first()[0] == built.count()
