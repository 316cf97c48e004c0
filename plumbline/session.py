"""What every operator needs of its session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Turns off that a union of equally dealt tables counts as dealt alike: with adaptive plans Spark 4.1 then groups the
    rows of one key in several tasks, so that sums over a union come out in parts."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark
