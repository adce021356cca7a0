"""Amounts in tenge are rounded by whole hundredths of a double, as the queries' SQL rounds them."""

from decimal import Decimal

from pyspark.sql import functions as F

from sarraf.functions import numbers


def test_products_near_half_a_hundredth(spark):
    rows = [("0", "3234.49", "USD"), ("0", "71806.65", "EUR"), ("123456.78", "1", "USD"), ("0", "0.07", None)]
    df = spark.createDataFrame([(Decimal(k), Decimal(a), c) for k, a, c in rows], "k decimal(18,2), a decimal(18,2), cur string")
    none = F.lit(None).cast("decimal(18,2)")
    got = [r[0] for r in df.select(numbers.resolve_amount_kzt(F.col("k"), F.col("a"), none, none, F.col("cur"))).collect()]
    assert got == [1538000.0, 37360999.99, 123456.78, 0.07]
