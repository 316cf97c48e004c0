"""Places in an order, found without a window that spans a hot key or the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources import saved

#: Rows of a key are ranked in buckets of about so many.
BUCKET_ROWS = 4096


def hash_unit(text: Column) -> Column:
    """The first eight hex digits of the text's MD5 as a number in [0, 1): orders as the MD5 does, but for equal ones."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def ranked(df: DataFrame, key: str, at: Column, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) within its key, by `at`, evenly spread over [0, 1), then `order`.

    Keys fall in buckets of `at`; totals of earlier buckets shift the places found inside one. No window spans a key."""
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("_parts"))
    x = df.join(sizes.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k").withColumn("_at", at).withColumn("_b", F.floor(F.col("_at") * F.col("_parts")).cast("int"))
    totals = x.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    totals = totals.select("_k", "_kb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_b").orderBy("_at", *order)
    x = x.withColumn(name, F.row_number().over(inside)).join(totals, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return x.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_parts", "_at", "_b", "_k", "_kb", "_before")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in the whole table's order: a distributed sort, written with numbers that grow from
    part to part, and the parts' sizes added up."""
    spark = df.sparkSession
    path = saved.folder(spark, "numbered")
    df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    x = spark.read.parquet(path).withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = x.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    parts = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return x.join(F.broadcast(parts), F.col("_part") == F.col("_p")).withColumn(name, (F.col("_before") + F.col("_in") + 1).cast("int")).select(*df.columns, name)
