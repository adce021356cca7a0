"""Session settings and shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings that results depend on: UTC days, and the charsets that text repair needs."""
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sarraf-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again, so that loops keep short plans and survive lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, *keys: str, dealt: bool = False) -> DataFrame:
    """Like cut, in buckets by key: grouping, ranking and joining by the keys, or by more, does not shuffle the table again. Rows may be dealt by these keys into as many partitions already."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    df = df if dealt else df.repartition(buckets, *keys)
    df.write.bucketBy(buckets, *keys).option("path", shared_dir(spark)).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out
