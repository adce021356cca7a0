"""Of payments that repeat each other, the one that says most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parties


def best_quality(df: DataFrame, keys: list[str] | None = None, order: str = "tx_id") -> DataFrame:
    """The row of best quality of each group of duplicates, with `quality` and `copies`; ties go to the least order.

    Duplicates share keys or, without keys, the signature of a payment. Groups are folded to one row by partial maxima,
    so no group meets in one task.
    """
    whole = df.withColumn("quality", parties.quality({c: F.col(c) for c in df.columns}))
    own = keys or ["_signature"]
    whole = whole if keys else whole.withColumn("_signature", parties.signature([c for c in parties.SIGNATURE if c in df.columns]))
    best = whole.groupBy(*own).agg(F.min_by(F.struct(*df.columns, "quality"), F.struct(-F.col("quality"), order)).alias("_row"), F.count("*").alias("copies"))
    return best.select("_row.*", "copies")
