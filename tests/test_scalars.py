from pyspark.sql import functions as F

from orderflow.functions import scalars as S


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_identifiers(spark):
    assert one(spark, S.rescued_digits, "1700000001.0", "1,7E+09", "00012", " 12-3 ", None, "") == ["1700000001", "1700000000", "00012", "123", "", ""]
    assert one(spark, S.order_number, "AB-12 34", ".", " . ", None) == ["AB1234", ".", ".", ""]
    assert one(spark, S.cnpj_mask, "1") == ["00.000.000/0000-01"]


def test_quantities(spark):
    assert one(spark, S.queue_quantity, "0,5", "1.5", "1.234,56", "-3", "0", "abc", "", None) == [1, 1, 1234, 1, 1, None, None, None]
    assert one(spark, S.quantity_error, "abc", "", "nan", "3") == ["QTD_INVALIDA: abc", "QTD_VAZIA", "QTD_VAZIA", None]


def test_days(spark):
    assert one(spark, S.day_text, "1/5/2026", "01.05.2026", "31/02/2026", "2026-05-01", "01/05/26") == ["01/05/2026", "01/05/2026", None, None, None]


def test_fields(spark):
    assert one(spark, lambda c: S.implied(c, 17, 4), "1", "1.5", "0.00005") == ["00000000000010000", "00000000000015000", "00000000000000000"]
    assert one(spark, lambda c: S.numeric(c, 13), "12345678901234") == ["1234567890123"]
