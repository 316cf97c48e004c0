"""Links that are refused by one shard gather in another."""

import collections

from pyspark.sql import functions as F

from plumbline.llm import sharding


def test_no_link_that_fits_somewhere_stays_split(spark):
    n = 4000
    hot = spark.range(n // 3).select("id", F.lit("one text for a third of all rows").alias("text"))
    groups = spark.range(n // 5).select((F.col("id") + 10_000).alias("id"), F.concat(F.lit("group "), F.floor(F.sqrt(F.col("id") * 9.0)).cast("string")).alias("text"))
    single = spark.range(n - n // 3 - n // 5).select((F.col("id") + 20_000).alias("id"), F.concat(F.lit("single "), F.col("id").cast("string")).alias("text"))
    docs = hot.union(groups).union(single).withColumnRenamed("id", "doc_id")
    rows = sharding.shard(docs).join(docs, "doc_id").collect()
    counts = collections.Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == n
    where = collections.defaultdict(set)
    for r in rows:
        where[r.text].add(r.shard)
    assert all(len(shards) == 1 for text, shards in where.items() if text.startswith("group"))
    assert len(where["one text for a third of all rows"]) <= 6


def test_a_large_refused_link_keeps_no_small_one_out():
    room = [10, 4]
    assert sharding._admitted([(0, 7, 2), (0, 2, 1), (0, 1, 5), (1, 5, 1), (1, 2, 2)], room) == [(0, 7, 1, False), (0, 2, 1, True), (0, 1, 1, False), (1, 2, 2, True)]
    assert room == [0, 0]
