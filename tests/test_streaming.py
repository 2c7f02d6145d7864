from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orderlens.operators import clean
from orderlens.streaming.ingest import ingest_clean_lines

COLS = ["Order Id", "order_date", "Days for shipping (real)", "Days for shipment (scheduled)",
        "order_item_total", "order_profit_per_order"]


def test_incremental_ingest_equals_batch(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    rows = [["1", "2020-01-02", "3", "2", " 10.5", "-1"], ["2", "bad", "1", "2", "n/a", "4"]]
    for i, r in enumerate(rows):
        (src / f"part{i}.csv").write_text(",".join(COLS) + "\n" + ",".join(r) + "\n")
    schema = StructType([StructField(c, StringType()) for c in COLS])
    q = ingest_clean_lines(spark, str(src), schema, str(out), str(ck))
    q.awaitTermination(120)
    got = spark.read.parquet(str(out))
    batch = clean.prepare_lines(spark.read.schema(schema).option("header", True).csv(str(src)))
    assert sorted(got.columns) == sorted(batch.columns)
    assert got.exceptAll(batch.select(*got.columns)).count() == 0 and got.count() == 2
    r = got.filter(F.col("order_id") == "1").first()
    assert (r.shipping_delay_days, r.delivery_timing_group, r.profit_status, r.order_item_total) == \
        (1, "Late", "Loss", 10.5)
