"""End-to-end jobs: the reference's script chain as Spark jobs.

Stage outputs are written as tables (Parquet by default) under ``out_dir``,
a shared folder, and read back: that is the reference's file hand-over
between scripts, and it also cuts the lineage, so a lost executor
recomputes at most one stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import (
    clean, dashboard, decision, evaluate, features, line_kpi, models, order_kpi, orders,
)
from orderlens.sources.io import read_table, staged, write_table

ALL_MODELS = ("baseline", "logistic", "forest", "boosting")


def _stage(spark: SparkSession, df: DataFrame, out_dir: str, name: str, fmt: str,
           partition_by: Sequence[str] | None = None) -> DataFrame:
    path = write_table(df, f"{out_dir.rstrip('/')}/{name}", fmt, partition_by)
    return read_table(spark, path, fmt)


def operations_report(spark: SparkSession, raw_lines: DataFrame, out_dir: str,
                      line_order: Sequence[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Scripts 01-04: clean lines, line KPIs, orders, order KPIs."""
    # the distinct lines are written with their multiplicity: the profile needs no second grouping
    counted = _stage(spark, clean.counted_lines(raw_lines), out_dir, "order_lines", fmt)
    out = {"cleaning_profile": clean.profile_of(counted)}
    lines = counted.drop(clean.COPIES)
    out["missing_by_column"] = clean.missing_by_column(lines)
    out["line_kpis"] = line_kpi.line_kpis(lines)
    bd = line_kpi.line_breakdown(lines)
    out["line_breakdown"] = bd
    out["worst_late_lines"] = line_kpi.worst_late_lines(bd)
    out["worst_profit_lines"] = line_kpi.worst_profit_lines(bd)
    out["field_conflicts"] = orders.field_conflicts(lines)
    # both profits are written, and the rule follows from them (one pass over the lines)
    written = _stage(spark, orders.order_candidates(lines, line_order), out_dir, "order_candidates", fmt)
    built = _stage(spark, orders.finish_orders(written, orders.written_rule(written)), out_dir, "orders", fmt)
    out["orders"] = built
    out["orders_profile"] = orders.orders_profile(lines, line_order)
    out["timing_counts"] = orders.value_counts(built, "delivery_timing_group")
    out["order_kpis"] = order_kpi.order_kpis(built, unique_keys=True)
    obd = order_kpi.order_breakdown(built, unique_keys=True)
    out["order_breakdown"] = obd
    out["worst_late_orders"] = order_kpi.worst_late_orders(obd)
    out["worst_margin_orders"] = order_kpi.worst_margin_orders(obd)
    for name in ("line_kpis", "line_breakdown", "order_kpis", "order_breakdown"):
        write_table(out[name], f"{out_dir.rstrip('/')}/{name}", fmt)
    return out


def model_comparison_run(spark: SparkSession, model_lines: DataFrame | None, line_order: Sequence[str],
                         which: Sequence[str] = ALL_MODELS, forest_trees: int = models.FOREST_TREES,
                         boosting_rounds: int = models.BOOSTING_ROUNDS, split: DataFrame | None = None) -> dict:
    """Scripts 05-06: order features, exact time split, fits on the training
    side, long-form scores on the test side, comparison, grid, best pair
    and final predictions.

    ``split`` is a stored feature table with its split; without one the features of
    ``model_lines`` are staged in the session's shared checkpoint folder. Both
    sides are persisted (with spill to disk) while models are fitted; the scores are
    staged by model, and nothing stays persisted."""
    if split is None:
        split = features.time_split(staged(features.order_features(model_lines, line_order), "features"))
    train, test = features.split_frames(split)
    keep = [c for c in evaluate.PREDICTION_COLUMNS
            if c in test.columns and c not in ("order_id", "late_delivery_risk")]
    prep = models.prepare(train, test, features.FEATURES, keep).persist()
    fitters = {
        "baseline": models.fit_baseline,
        "logistic": models.fit_logistic,
        "forest": lambda p: models.fit_forest(p, trees=forest_trees),
        "boosting": lambda p: models.fit_boosting(p, rounds=boosting_rounds),
    }
    fitted = [fitters[m](prep) for m in which]
    scored = None
    for f in fitted:
        s = models.score(f, prep.test, keep)
        scored = s if scored is None else scored.unionByName(s)
    scored = staged(scored, "scores", ["model"])
    prep.release()
    seconds = {f.name: f.seconds for f in fitted}
    grid = evaluate.threshold_metrics(scored, exclude=(models.BASELINE,))
    best = evaluate.select_best(grid)
    return {
        "split_profile": features.split_profile(split),
        "scores": scored,
        "fit_seconds": seconds,
        "rounds": {f.name: f.rounds for f in fitted},
        "comparison": evaluate.model_comparison(scored, seconds),
        "threshold_grid": grid,
        "best": best,
        "final_predictions": evaluate.final_predictions(scored, best),
    }


def decision_dataset(orders_df: DataFrame, final_predictions: DataFrame) -> dict[str, DataFrame]:
    """Script 07 and the dashboard aggregates."""
    dec = decision.decision_table(final_predictions, orders_df)
    return {
        "decision": dec,
        "risk_distribution": decision.risk_distribution(dec),
        "confusion_counts": decision.confusion_counts(dec),
        "profile": decision.decision_profile(dec),
        "headline": dashboard.headline(dec),
        "late_by_mode": dashboard.late_by_mode(dec),
        "revenue_flagged_by_region": dashboard.revenue_flagged_by_region(dec),
        "review_workload": dashboard.review_workload(dec),
        "review_queue": dashboard.review_queue(dec),
    }


def fitted_scores(spark: SparkSession, split: DataFrame, model: str) -> DataFrame:
    """One model's test-side scores (for the rows-only registered queries)."""
    run = model_comparison_run(spark, None, (), which=(model,), split=split)
    return run["scores"].select("model", "order_id", "late_delivery_risk",
                                "late_delivery_probability")


__all__ = ["operations_report", "model_comparison_run", "decision_dataset", "fitted_scores", "F"]
