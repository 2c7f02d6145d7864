"""Scoring metrics over long-form scores.

Scores are one table ``(model, order_id, late_delivery_risk,
late_delivery_probability)`` for every model, so each metric is one
``groupBy('model')`` pass rather than a loop of per-model jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.columns import risk_level_3

# The reference's threshold grid, comparison threshold and bin count for AUC.
THRESHOLDS = (0.30, 0.40, 0.50, 0.60, 0.70)
COMPARISON_THRESHOLD = 0.50
AUC_BUCKETS = 256
LABEL = "late_delivery_risk"
PROB = "late_delivery_probability"
PREDICTION_COLUMNS = ("order_id", "order_date", "late_delivery_risk", "shipping_mode",
                      "order_region", "market", "customer_segment", "order_value", "order_profit")


def argmax_prediction(p: str | Column = PROB) -> Column:
    """Class of the larger probability; a 0.5 tie goes to class 0."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > 0.5, 1).otherwise(0)


def predictions(scored: DataFrame) -> DataFrame:
    """Class by the larger probability, three-level risk."""
    return scored.withColumns({
        "predicted_late_delivery": argmax_prediction(),
        "risk_level": risk_level_3(PROB),
    })


def accuracy(pred: DataFrame, by: str = "model", y: str = LABEL,
             yhat: str = "predicted_late_delivery") -> DataFrame:
    """share of correct predictions per model."""
    return pred.groupBy(by).agg(
        F.avg(F.when(F.col(y) == F.col(yhat), 1.0).otherwise(0.0)).alias("accuracy"))


def score_buckets(g: DataFrame, by: str, buckets: int = AUC_BUCKETS) -> DataFrame:
    """Add ``b``: which of ``buckets`` ranges of scores ``p`` a row lies in. A quantile sketch of
    each group's rows gives the bounds, so the ranges hold about as many rows each."""
    asked = F.expr("array(" + ", ".join(f"{i / buckets}D" for i in range(1, buckets)) + ")")
    bounds = g.groupBy(F.col(by).alias("__by")).agg(F.percentile_approx("p", asked, F.lit(40 * buckets)).alias("__bounds"))
    joined = g.join(bounds, F.col(by).eqNullSafe(F.col("__by")))
    return joined.withColumn("b", F.size(F.filter("__bounds", lambda x: x < F.col("p")))).drop("__by", "__bounds")


def roc_auc(scored: DataFrame, by: str = "model", y: str = LABEL, p: str = PROB) -> DataFrame:
    """exact ROC-AUC per model with tied scores counted half.

    AUC = Σ_s pos(s)·(neg(<s) + neg(s)/2) / (P·N) over distinct scores s. The
    running count of negatives below s is split in two, with no join:
      * inside its bucket, a range between two of the ``AUC_BUCKETS - 1`` bounds that a
        quantile sketch of the model's distinct scores gives: a window
        partitioned by (model, bucket), so scores spread over the tasks
        however close together they lie;
      * before its bucket: a running sum over the bucket table, which has at
        most ``AUC_BUCKETS`` rows per model.
    Any bounds give the same, exact value. Sums are kept in exact integers
    (2 × numerator)."""
    prob = F.col(p).cast("double")
    dec = "decimal(38,0)"
    g = scored.groupBy(by, prob.alias("p")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    g = score_buckets(g, by)
    wi = Window.partitionBy(by, "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inside = g.withColumn("below", F.coalesce(F.sum("neg").over(wi), F.lit(0)))
    per_bucket = inside.groupBy(by, "b").agg(
        F.sum(F.col("pos").cast(dec) * (F.lit(2) * F.col("below") + F.col("neg")).cast(dec))
        .alias("num2"),
        F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    wb = Window.partitionBy(by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("neg_before", F.coalesce(F.sum("bneg").over(wb), F.lit(0)))
    res = per_bucket.groupBy(by).agg(
        F.sum(F.col("num2") + (F.lit(2) * F.col("bpos") * F.col("neg_before")).cast(dec)).alias("num2"),
        F.sum("bpos").alias("P"), F.sum("bneg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0),
                 F.col("num2").cast("double")
                 / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")))
    return res.select(by, auc.alias("roc_auc"))


def _metrics(tp: Column, pp: Column, pos: Column, n: Column) -> list[Column]:
    fp, fn = pp - tp, pos - tp
    tn = n - pp - fn
    d = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return [
        F.when(n > 0, (tp + tn).cast("double") / n).alias("accuracy"),
        d(tp, pp).alias("precision"),
        d(tp, pos).alias("recall"),
        d(2 * tp, 2 * tp + fp + fn).alias("f1"),
        pp.cast("long").alias("predicted_late_orders"),
    ]


def threshold_metrics(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
                      by: str = "model", y: str = LABEL, p: str = PROB,
                      exclude: Sequence[str] = ()) -> DataFrame:
    """F25 + F27: accuracy, precision, recall, F1 and flagged count for
    ``p >= threshold``, zero on empty denominators. One aggregate per model
    counts every threshold at once (no row is multiplied by the grid); the
    tiny result is then unfolded to one row per (model, threshold)."""
    if exclude:
        scored = scored.filter(~F.col(by).isin(list(exclude)))
    prob, label = F.col(p), F.col(y)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(label == 1).alias("pos")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((prob >= t) & (label == 1)).alias(f"tp{i}"),
                 F.count_if(prob >= t).alias(f"pp{i}")]
    counts = scored.groupBy(by).agg(*aggs)
    unfolded = counts.select(by, "n", "pos", F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                 F.col(f"pp{i}").alias("pp")) for i, t in enumerate(thresholds)
    ])).alias("t")).select(by, "n", "pos", "t.*")
    return unfolded.select(by, "threshold", *_metrics(F.col("tp"), F.col("pp"), F.col("pos"),
                                                       F.col("n")))


def metrics_at(scored: DataFrame, threshold: float, **kw) -> DataFrame:
    """F25 at one threshold."""
    return threshold_metrics(scored, (threshold,), **kw)


def class_report(pred: DataFrame, by: str = "model", y: str = LABEL,
                 yhat: str = "predicted_late_delivery") -> DataFrame:
    """per class precision, recall, F1 and support, then the accuracy
    row and the macro and support-weighted means, from one confusion count."""
    yc, pc = F.col(y), F.col(yhat)
    c = pred.groupBy(by).agg(
        F.count_if((yc == 1) & (pc == 1)).alias("tp"), F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 1) & (pc == 0)).alias("fn"), F.count_if((yc == 0) & (pc == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    d = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    n = tp + fp + fn + tn
    p1, r1, f1 = d(tp, tp + fp), d(tp, tp + fn), d(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = d(tn, tn + fn), d(tn, tn + fp), d(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    wmean = lambda a, b: F.when(n > 0, (a * s0 + b * s1) / n)

    def row(order, label, prec, rec, f, sup):
        return F.struct(F.lit(order).alias("row_order"), F.lit(label).alias("label"),
                        prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
                        f.cast("double").alias("f1_score"), sup.cast("long").alias("support"))

    rows = F.array(
        row(1, "0", p0, r0, f0, s0), row(2, "1", p1, r1, f1, s1),
        row(3, "accuracy", F.lit(None), F.lit(None), d(tp + tn, n), n),
        row(4, "macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row(5, "weighted avg", wmean(p0, p1), wmean(r0, r1), wmean(f0, f1), n))
    return c.select(by, F.explode(rows).alias("r")).select(by, "r.*")


def model_comparison(scored: DataFrame, fit_seconds: Mapping[str, float] | None = None,
                     threshold: float = COMPARISON_THRESHOLD, by: str = "model") -> DataFrame:
    """AUC plus the threshold metrics at 0.50 per model, ranked by F1
    then AUC. Both inputs of the join hold one row per model."""
    m = metrics_at(scored, threshold, by=by)
    out = roc_auc(scored, by=by).join(F.broadcast(m), by)
    if fit_seconds:
        secs = None
        for name, s in fit_seconds.items():
            secs = (F.when(F.col(by) == name, F.lit(float(s))) if secs is None
                    else secs.when(F.col(by) == name, F.lit(float(s))))
        out = out.withColumn("fit_seconds", secs)
    w = Window.orderBy(F.col("f1").desc_nulls_last(), F.col("roc_auc").desc_nulls_last(),
                       F.col(by).asc())
    return out.withColumn("rank", F.row_number().over(w))


def select_best(grid: DataFrame, by: str = "model") -> DataFrame:
    """the (model, threshold) with the highest F1, then recall, then
    precision; remaining ties to the first model name and lowest threshold."""
    return grid.orderBy(F.col("f1").desc(), F.col("recall").desc(), F.col("precision").desc(),
                        F.col(by).asc(), F.col("threshold").asc()).limit(1)


def final_predictions(scored: DataFrame, best: DataFrame, orders: DataFrame | None = None,
                      by: str = "model") -> DataFrame:
    """scores of the chosen model at the chosen threshold, with class,
    three-level risk and ``prediction_correct``. The model and the threshold of
    ``best`` (one row) are scalar subqueries, so a score table partitioned by model
    is read for that model only; ``orders`` (test features) are joined on
    ``order_id`` when the scores do not carry the order columns."""
    chosen = scored.where(F.col(by) == best.select(by).scalar())
    p = F.col(PROB)
    pred = F.when(p >= best.select("threshold").scalar(), 1).otherwise(0)
    out = chosen.withColumns({
        "predicted_late_delivery": pred,
        "risk_level": risk_level_3(p),
        "prediction_correct": F.when(F.col(LABEL) == pred, 1).otherwise(0),
    })
    if orders is not None:
        keep = [c for c in PREDICTION_COLUMNS if c in orders.columns and c != LABEL]
        out = orders.select(*keep).join(out, "order_id")
    cols = [c for c in PREDICTION_COLUMNS if c in out.columns]
    return out.select(*cols, PROB, "predicted_late_delivery", "risk_level", "prediction_correct")
