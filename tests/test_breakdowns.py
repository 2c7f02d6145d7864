"""Breakdowns against a plain count, and where their rows are repeated."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderlens.functions.shapes import dimension_totals

ROWS = [(k, "ab"[k % 2] if k % 5 else None, k % 3, None if k % 7 == 0 else k * 0.25, k % 4) for k in range(1, 60)]
HOT = [(None, "a", 1, 2.5, 1)] * 40 + [(7, "b", k % 3, 0.1, 0) for k in range(300)]
SCHEMA = "k long, d1 string, d2 int, m double, s int"


def brute(rows):
    keys, out = defaultdict(set), defaultdict(lambda: [0, 0.0, 0])
    for k, d1, d2, m, s in rows:
        for name, v in (("d1", d1), ("d2", str(d2))):
            group = out[name, v]
            group[0] += 1
            group[1] += m or 0
            group[2] += s
            if k is not None:
                keys[name, v].add(k)
    return {g: (len(keys[g]), n, round(m, 6), s) for g, (n, m, s) in out.items()}


def totals(df, unique_keys):
    return dimension_totals(df, ["d1", "d2"], "k", {"s": F.col("s")}, {"m": F.col("m")}, unique_keys)


@pytest.mark.parametrize("rows, unique_keys", [(ROWS, True), (ROWS, False), (ROWS + HOT, False), ([], True), ([], False)])
def test_totals(spark, rows, unique_keys):
    got = totals(spark.createDataFrame(rows, SCHEMA), unique_keys).collect()
    assert {(r.dimension, r.dimension_value): (r.unique_keys, r.rows, round(r.m, 6), r.s) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_unique_keys_are_combined_before_rows_are_repeated(spark):
    p = totals(spark.createDataFrame(ROWS, SCHEMA), True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in p.split("Generate")[1] and p.count("Generate") == 1
