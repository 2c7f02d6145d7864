"""Order-grain stage tables of the fixture: orders, features with their split, scores.

The reference hands these tables from script to script as files. Here each is written
once per session and state of its input, bucketed by ``order_id``, and every query that
starts from one reads the columns it needs: no query writes or carries the full width,
and the score joins find both sides bucketed alike. A table's name holds the signature
of the input files, so changed input gives a new table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.operators import decision, features, orders
from orderlens.sources.fixtures import LINE_ORDER, TABLES, fx_lines, fx_scores, line_tasks
from orderlens.sources.io import drop_path, input_signature, staged, write_bucketed

RULE = "orderlens.profit_rule"
#: buckets follow the number of lines, and each is filled by so many whole tasks of the line join
TASKS_A_BUCKET, LEAST_BUCKETS = 4, 8


def _table(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[str, int], None]) -> tuple[str, DataFrame]:
    """(name, table) of a stage table, written by ``write(name, buckets)`` where it is not there yet."""
    mark = input_signature(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TABLES])
    name = f"orderlens_{kind}_{mark}"
    if not spark.catalog.tableExists(name):
        write(name, max(LEAST_BUCKETS, line_tasks(spark, sf_dir) // TASKS_A_BUCKET))
    return name, spark.table(name)


def order_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table. Both profits are written in one pass over the lines; the rule
    comes from the written flag column and is kept as a property of the table."""

    def write(name: str, buckets: int) -> None:
        written = write_bucketed(orders.order_candidates(fx_lines(spark, sf_dir), LINE_ORDER), name, "order_id", buckets)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{RULE}' = '{orders.written_rule(written)}')")

    name, table = _table(spark, sf_dir, "orders", write)
    rule = spark.sql(f"SHOW TBLPROPERTIES {name} ('{RULE}')").first()["value"]
    return orders.finish_orders(table, rule)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order features with their split, partitioned by it. The features are staged
    once, since the split's boundary follows from their keys."""

    def write(name: str, buckets: int) -> None:
        made = staged(features.order_features(fx_lines(spark, sf_dir), LINE_ORDER), name)
        write_bucketed(features.time_split(made), name, "order_id", buckets, ["split"])
        for at in {file.rsplit("/", 1)[0] for file in made.inputFiles()}:
            drop_path(spark, at)

    return _table(spark, sf_dir, "features", write)[1]


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed scores of every model, partitioned by model. Their join with the order table
    is checked once, when they are written (G3, G4)."""
    built = order_table(spark, sf_dir)

    def write(name: str, buckets: int) -> None:
        scores = write_bucketed(fx_scores(None, per_order=built), name, "order_id", buckets, ["model"])
        for model in [r.model for r in scores.select("model").distinct().collect()]:
            decision.validate_join(decision.join_scores(scores.where(scores.model == model), built))

    return _table(spark, sf_dir, "scores", write)[1]


def drop_stage_tables(spark: SparkSession) -> None:
    """Remove this session's stage tables, files included."""
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("orderlens_")]:
        at = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
        spark.sql(f"DROP TABLE {name}")
        drop_path(spark, at)
