"""The tree models are fitted on all training rows, and their split points come from all of them."""

import pytest
from pyspark.sql import functions as F

from orderlens.operators import models

ROWS = 60_000


def prepared(spark, rows, label, numeric=(), categorical=(), **columns):
    """Both sides are the same made rows."""
    table = spark.range(rows).withColumnRenamed("id", "order_id")
    table = table.withColumns({n: F.expr(e) for n, e in columns.items()}).withColumn(models.LABEL, F.expr(label))
    return models.Prepared(table, table, list(numeric), list(categorical)).persist()


@pytest.fixture(scope="module")
def skewed(spark):
    """Rows that a hash of the order id would leave out of 50,000 are of a kind of their own: late, all others half."""
    left_out = "pmod(xxhash64(order_id), 1000003) >= int(1000003 * 50000L / 60000)"
    prep = prepared(spark, ROWS, f"int({left_out} or pmod(xxhash64(order_id, 7), 2) = 0)", ["size"], ["kind"],
                    size="double(order_id % 7)", kind=f"if({left_out}, 'rare', 'common')")
    yield prep
    prep.release()


def by_kind(fitted, prep):
    got = models.score(fitted, prep.test, ["kind"]).groupBy("kind").agg(
        F.min("late_delivery_probability").alias("low"), F.max("late_delivery_probability").alias("high")).collect()
    return {r["kind"]: (r["low"], r["high"]) for r in got}


def test_tree_models_take_all_rows(skewed):
    made = models.tree_input(skewed)
    assert made.rows == made.table.count() == ROWS


def test_forest_learns_from_every_row(skewed):
    found = by_kind(models.fit_forest(skewed, trees=20, depth=4), skewed)
    assert found["rare"][0] > 0.8 and found["common"][1] < 0.6


def test_boosting_learns_from_every_row(skewed):
    found = by_kind(models.fit_boosting(skewed, rounds=12), skewed)
    assert found["rare"][0] > 0.8 and found["common"][1] < 0.6


def test_forest_splits_between_rare_values(spark):
    """Eight values of fifteen rows each, late and on time in turn: a sample of 10,000 of the 120,000 rows misses some."""
    rare = "order_id % 1000 = 77"
    prep = prepared(spark, 120_000, f"int(if({rare}, order_id div 1000 % 2, pmod(xxhash64(order_id), 2)))", ["x"],
                    x=f"if({rare}, 1 + double(order_id div 1000 % 8), 0D)")
    scores = models.score(models.fit_forest(prep, trees=20, depth=15), prep.test.where(rare), ["x"]).collect()
    prep.release()
    assert len(scores) == 120
    assert {(r.x, r.late_delivery_probability > 0.5) for r in scores} == {(1.0 + k, k % 2 == 1) for k in range(8)}


@pytest.mark.parametrize("bins", [4, 32, 255])
def test_bin_edges_are_exact(spark, bins):
    """Against running counts of the sorted rows, with ties, heavy values and ranges of any size."""
    table = spark.range(5000).selectExpr(
        "double(pmod(xxhash64(id), 2000)) / 7 AS a", "if(id % 3 = 0, 5D, double(id % 600) - 90) AS b",
        "exp(double(pmod(xxhash64(id, 1), 900)) / 50) AS c", "double(id % 3) AS few")
    found = models.bin_edges(table, ["a", "b", "c", "few"], bins)
    rows = table.collect()
    want = {}
    for name in ("a", "b", "c", "few"):
        xs = sorted(r[name] for r in rows)
        if len(set(xs)) > bins:
            last = {x: k + 1 for k, x in enumerate(xs)}  # rows up to and with x
            first = {x: k for k, x in reversed([*enumerate(xs)])}  # rows before x
            want[name] = [x for x in sorted(last) if last[x] < 5000 and last[x] * bins // 5000 > first[x] * bins // 5000]
    assert found == want and {"a", "b", "c"} <= set(found) and "few" not in found
    assert all(len(x) < bins for x in found.values())


def test_few_rows_are_fitted_as_they_are(spark):
    """Where Spark itself looks at all rows, columns go into the vector as they are."""
    prep = prepared(spark, 9_000, "int(x > 50)", ["x"], x="double(order_id % 101)")
    made = models.tree_input(prep)
    vectors, most = models.tree_vectors(made, made.table, made.rows, models.FOREST_BINS)
    assert most == models.FOREST_BINS and max(r[models.VECTOR][0] for r in vectors(made.table).collect()) == 100.0
    prep.release()


def test_bins_of_values_on_an_edge(spark):
    """A value on an edge lies left of it, in fitting and in scoring, and unseen values lie in the end bins."""
    prep = prepared(spark, 20_000, "int(x > 4999)", ["x"], x="double(order_id % 10000)")
    made = models.tree_input(prep)
    vectors, most = models.tree_vectors(made, made.table, made.rows, 4)
    assert most ** 2 > made.rows and models.bin_edges(made.table, ["x"], 4) == {"x": [2499.0, 4999.0, 7499.0]}
    assert "nominal" not in str(vectors(made.table).schema[models.VECTOR].metadata)  # no categories
    odd = spark.createDataFrame([(x,) for x in (-1e9, 2499.0, 2499.5, 4999.0, 7499.0, 7500.0, 1e9)], "x double")
    assert [r[models.VECTOR][0] for r in vectors(odd).collect()] == [0, 0, 1, 1, 2, 3, 3]
    prep.release()


def test_bins_are_split_as_ranges(spark):
    """A tree of one split cannot tell alternating bins apart; one that took bins for categories could."""
    prep = prepared(spark, 20_000, "int(int(x) div 1250 % 2)", ["x"], x="double(order_id % 10000)")
    inner = prep.test.where("x >= 1250 and x < 8750")  # one split can tell the outer bins from all others
    scored = models.score(models.fit_forest(prep, trees=5, depth=1, bins=8), inner)
    assert scored.agg(F.max(F.abs(F.col("late_delivery_probability") - 0.5))).first()[0] < 0.2
    prep.release()


@pytest.mark.parametrize("rows, parallel, partitions", [
    (0, 8, 1), (2_501, 8, 2), (50_000, 64, 20), (5_000_000, 64, 20), (10_000_000, 8, 8), (10_000_000, 64, 40)])
def test_partitions_of_the_tree_table(rows, parallel, partitions):
    assert models.tree_partitions(rows, parallel) == partitions


def test_boosting_takes_split_points_from_all_rows(spark, monkeypatch):
    """Spark samples a table of more rows than the square of maxBins; no bound of the bins changes with it."""
    asked = []
    classifier = models.GBTClassifier
    monkeypatch.setattr(models, "GBTClassifier", lambda **kw: asked.append(kw["maxBins"]) or classifier(**kw))
    prep = prepared(spark, 75_000, "int(x + pmod(xxhash64(order_id), 40000) > 50000)", ["x"], x="double(order_id)")
    fitted = models.fit_boosting(prep, rounds=2)
    rest = models.tree_input(prep).table.where(~F.col(models.HELD_OUT)).count()
    assert 65_025 < rest < 75_000 and all(most ** 2 > rest for most in asked)
    found = fitted.transform(prep.test.where("order_id in (0, 74999)")).select("order_id", "late_delivery_probability").collect()
    assert {r[0]: r[1] > 0.5 for r in found} == {0: False, 74999: True}
    prep.release()
