"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver), twice: ``queries`` holds the
better of the two runs (after JIT and code-generation warm-up), ``cold``
the first. The stage tables (orders, features, scores) that the F, G and H
queries read are built once, timed on their own and part of ``value``. Model
fit times come from the same clock the reference used around ``fit``. Prints
one JSON line; ``value`` is the warm total.

BENCH_MODELS=all adds the forest fit (300 trees) at the reference's size; by
default the baseline, logistic and boosting fits run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderlens.plans import jobs  # noqa: E402
from orderlens.plans.queries import QUERIES  # noqa: E402
from orderlens.plans.stage_tables import feature_table, order_table, score_table  # noqa: E402
from orderlens.session import get_spark  # noqa: E402

HEADLINE = [
    "b16_cleaning_profile", "c10_line_kpis", "c11_line_breakdown", "c14_worst_late_lines",
    "d1_field_conflicts", "d4_build_orders", "e7_order_kpis", "e8_order_breakdown",
    "e11_worst_late_orders", "f2_order_features", "f5_time_split", "f8_medians",
    "f23_roc_auc", "f26_model_comparison", "f27_threshold_grid", "f29_final_predictions",
    "g10_decision_table", "g11_risk_distribution", "h1_headline", "h5_review_queue",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    which = ("baseline", "logistic", "forest", "boosting") if os.environ.get("BENCH_MODELS") == "all" \
        else ("baseline", "logistic", "boosting")
    spark = get_spark(f"local[{cpus}]", app_name="orderlens-bench", shuffle_partitions=int(cpus),
                      extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["c10_line_kpis"](spark, sf_dir))  # warm-up: JVM, code generation, file listing

    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name, build in (("stage_orders", order_table), ("stage_features", feature_table), ("stage_scores", score_table)):
        t0 = time.perf_counter()
        build(spark, sf_dir)
        cold[name] = times[name] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t0 = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        cold[name], times[name] = round(runs[0], 3), round(min(runs), 3)

    t0 = time.perf_counter()
    res = jobs.model_comparison_run(spark, None, (), which=which, split=feature_table(spark, sf_dir))
    run(res["comparison"])
    run(res["final_predictions"])
    times["model_run_total"] = round(time.perf_counter() - t0, 3)
    for model, secs in res["fit_seconds"].items():
        times["fit_" + model.lower().replace(" ", "_")] = round(secs, 3)
    rounds = {m: n for m, n in res["rounds"].items() if n}

    total = round(sum(v for k, v in times.items() if not k.startswith("fit_")), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "cold_total": round(sum(cold.values()), 3),
                      "cold": cold, "trees_in_use": rounds, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
