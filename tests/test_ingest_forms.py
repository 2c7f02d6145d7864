"""Texts that other tools write for numbers and dates must not become missing."""

from datetime import datetime

from orderlens.operators.clean import coerce_numeric, coerce_timestamps, prepare_lines
from orderlens.sources.io import infer_numbers, read_lines


def test_fractions_stay_and_bad_numbers_go(spark):
    texts = ["3.0", "1", " 2 ", "1.5", "x", "NaN", None, "1e300"]
    df = spark.createDataFrame([(t,) for t in texts], "days_for_shipping_real string")
    assert [r[0] for r in coerce_numeric(df).collect()] == [3.0, 1.0, 2.0, 1.5, None, None, None, 1e300]


def test_typed_read_of_a_file_without_schema(spark, tmp_path):
    """Ids above 9 order as numbers, 2.5 days stay 2.5, and text stays text."""
    path = tmp_path / "lines.csv"
    path.write_text(" Order Id,order_item_id,Days for Shipping,quantity,discount,note,empty,mixed\n"
                    "10,9,2.5, 3 ,0.25,a,,1\n9,10,NA,4,n/a,007x,,x\n9,11,4,5,1e-3,b,NaN,2\n")
    raw = read_lines(spark, str(path), infer_types=True)
    assert dict(raw.dtypes) == {" Order Id": "bigint", "order_item_id": "bigint", "Days for Shipping": "double", "quantity": "bigint",
                                "discount": "double", "note": "string", "empty": "string", "mixed": "string"}
    lines = prepare_lines(raw)
    assert "days_for_shipping_real" in lines.columns
    got = lines.orderBy("order_id", "order_item_id").select("order_id", "order_item_id", "days_for_shipping_real", "quantity").collect()
    assert [tuple(r) for r in got] == [(9, 10, None, 4), (9, 11, 4.0, 5), (10, 9, 2.5, 3)]
    assert infer_numbers(raw.select("order_item_id")).columns == ["order_item_id"]


def test_date_forms(spark):
    texts = ["2018-01-31T22:56:00", "2018-01-31 22:56", "1/31/2018 22:56:00", "1/31/2018 22:56", "2018-01-31 22:56:00", "not a date", None]
    df = spark.createDataFrame([(t,) for t in texts], "order_date string")
    want = datetime(2018, 1, 31, 22, 56)
    assert [r[0] for r in coerce_timestamps(df).collect()] == [want] * 5 + [None, None]
    half = spark.createDataFrame([("2018-01-31 22:56:00.5",)], "order_date string")
    assert coerce_timestamps(half).first()[0] == datetime(2018, 1, 31, 22, 56, 0, 500000)
