"""Model operators at small size on sf0.001: shapes, ranges, determinism."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from orderlens.operators import evaluate, models
from orderlens.plans import jobs
from orderlens.sources.fixtures import LINE_ORDER, fx_lines


@pytest.fixture(scope="module")
def run(spark, sf):
    return jobs.model_comparison_run(spark, fx_lines(spark, sf), LINE_ORDER,
                                     which=("baseline", "logistic", "forest", "boosting"),
                                     forest_trees=10, boosting_rounds=5)


def test_scores_cover_test_side(run):
    n_test = {r.split: r.orders for r in run["split_profile"].collect()}["test"]
    assert n_test == 1473 - int(1473 * 0.8)
    per_model = {r.model: r.n for r in run["scores"].groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert per_model == {m: n_test for m in (models.BASELINE, models.LOGISTIC, models.FOREST, models.BOOSTING)}
    bad = run["scores"].filter((F.col("late_delivery_probability") < 0) |
                               (F.col("late_delivery_probability") > 1)).count()
    assert bad == 0


def test_comparison_and_selection(run):
    comp = {r.model: r for r in run["comparison"].collect()}
    assert comp[models.BASELINE].roc_auc == 0.5
    assert comp[models.LOGISTIC].roc_auc > 0.6
    assert set(run["fit_seconds"]) == set(comp)
    best = run["best"].first()
    assert best.model != models.BASELINE and best.threshold in (0.3, 0.4, 0.5, 0.6, 0.7)
    final = run["final_predictions"]
    n_test = {r.split: r.orders for r in run["split_profile"].collect()}["test"]
    assert final.count() == n_test
    assert {"risk_level", "prediction_correct", "order_value"} <= set(final.columns)


def test_same_seed_same_scores(spark, sf, run):
    again = jobs.model_comparison_run(spark, fx_lines(spark, sf), LINE_ORDER, which=("forest",),
                                      forest_trees=10)
    a = run["scores"].filter(F.col("model") == models.FOREST).select("order_id", "late_delivery_probability")
    b = again["scores"].select("order_id", "late_delivery_probability")
    assert a.exceptAll(b).count() == 0


def test_registered_queries_fit_all_four_models(spark, sf, monkeypatch):
    """The registered queries at a small forest and few rounds: every model has its rows."""
    full = jobs.model_comparison_run
    monkeypatch.setattr(jobs, "model_comparison_run", lambda s, lines, order, which=jobs.ALL_MODELS, split=None: full(
        s, lines, order, which=which, forest_trees=5, boosting_rounds=3, split=split))
    names = {r.model for r in E.queries()["f26_fitted_comparison"](spark, sf).collect()}
    assert names == {models.BASELINE, models.LOGISTIC, models.FOREST, models.BOOSTING}
    for query, model in (("f17_forest_scores", models.FOREST), ("f18_boosting_scores", models.BOOSTING)):
        scores = E.queries()[query](spark, sf)
        assert scores.count() == 1473 - int(1473 * 0.8) and {r.model for r in scores.select("model").distinct().collect()} == {model}


def test_boosting_stops_by_the_rule():
    falling = [1.0 - k / 100 for k in range(30)]
    assert models.stop_round(falling) is None and models.stop_round(falling[:5]) is None
    assert models.stop_round([*falling[:6], *[falling[5]] * 20]) == 16  # ten rounds without gain after the sixth
    assert models.stop_round([0.5] * 11) == 11
    assert models.stop_round([0.5] * 10 + [0.4] + [0.4] * 9) is None


def test_boosting_early_stop_and_bounded_rows(spark, sf, monkeypatch):
    from orderlens.operators import features
    from orderlens.plans.stage_tables import feature_table

    monkeypatch.setattr(models, "EARLY_STOP_ROWS", 500)
    train, test = features.split_frames(feature_table(spark, sf))
    prep = models.prepare(train, test, features.FEATURES)
    made = models.tree_input(prep, fit_rows=900)
    assert 800 < made.table.count() < 1000 and 0.05 < made.table.filter(models.HELD_OUT).count() / 900 < 0.15
    fitted = models.fit_boosting(prep, rounds=40)
    assert 1 <= fitted.rounds <= 40
    scored = models.score(fitted, prep.test)
    assert scored.count() == test.count() and evaluate.roc_auc(scored).first().roc_auc > 0.6
    prep.release()


def test_leakage_columns_are_refused(spark, sf):
    from orderlens.functions.contracts import ContractError
    from orderlens.operators import features
    from orderlens.plans.stage_tables import feature_table

    split = feature_table(spark, sf)
    assert not set(features.feature_frame(split).columns) & set(features.LEAKAGE_COLUMNS)
    with pytest.raises(ContractError, match="delivery_status"):
        features.feature_frame(split, (*features.FEATURES, "delivery_status"))
