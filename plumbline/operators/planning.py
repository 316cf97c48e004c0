"""Which chunks to ask about: screening, quotas, shuffled pools, draws, near-duplicate questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as T
from plumbline.operators.ranks import hash_unit, ranked
from plumbline.sources import saved

SEED = 20260814
NEAR = 0.35


def screen(chunks: DataFrame, least_chars: int = 700) -> DataFrame:
    """chunks (chunk_id, text, ...) -> also usable and reason."""
    return chunks.withColumn("_q", T.chunk_quality(F.col("text"), least_chars)).select(*chunks.columns, "_q.usable", "_q.reason")


def rejections(screened: DataFrame) -> DataFrame:
    """How often each kind of reason rejects."""
    return screened.where("not usable").groupBy(F.substring_index("reason", " (", 1).alias("reason")).agg(F.count("*").alias("n"))


def allocate(counts: DataFrame, total: int) -> DataFrame:
    """counts (paper, n) -> paper, quota: one each, the rest in proportion by largest remainder, ties by paper. Fewer than
    one each: an error."""
    every = Window.partitionBy()  # one row a paper
    x = counts.withColumn("_papers", F.count("*").over(every)).withColumn("_all", F.sum("n").over(every))
    x = x.where(F.when(F.col("_papers") > total, F.raise_error(F.lit(f"{total} questions are fewer than papers")).cast("boolean")).otherwise(True))
    exact = (F.lit(total) - F.col("_papers")) * F.col("n") / F.col("_all")
    x = x.withColumn("_exact", F.coalesce(exact, F.lit(0.0))).withColumn("_whole", F.floor("_exact")).withColumn("_slack", F.lit(total) - F.col("_papers") - F.sum("_whole").over(every))
    place = F.row_number().over(Window.partitionBy().orderBy((F.col("_exact") - F.col("_whole")).desc(), "paper"))
    return x.select("paper", (1 + F.col("_whole") + (place <= F.col("_slack")).cast("long")).alias("quota"))


def largest_quotas(quotas: DataFrame, n: int = 8) -> DataFrame:
    return quotas.orderBy(F.col("quota").desc(), "paper").limit(n)


def pools(screened: DataFrame, seed: int = SEED) -> DataFrame:
    """screened (paper, chunk_id, usable) -> paper, chunk_id, place (from 1): a paper's usable chunks, or all if none is,
    in an order that the seed decides. The order comes from hashes, so it is another one than a shuffled list's."""
    papers = screened.groupBy("paper").agg(F.max("usable").alias("_any")).withColumnRenamed("paper", "_p")
    x = screened.select("paper", "chunk_id", "usable").join(papers, F.col("paper").eqNullSafe(F.col("_p"))).where("usable or not _any").select("paper", "chunk_id")
    named = F.concat_ws(":", F.lit(str(seed)), "chunk_id")
    return ranked(x, "paper", hash_unit(named), [F.md5(named.cast("binary")), F.col("chunk_id")]).select("paper", "chunk_id", "place")


def draw(pool: DataFrame, quotas: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """paper, chunk_id, turn: round after round one chunk a paper until its quota, passing over used ones. Only so many
    first places of a pool are looked at as its quota and its used chunks make up."""
    x = pool.join(quotas, "paper")
    if used is None:
        fresh = x.where(F.col("place") <= F.col("quota"))
    else:
        gone = pool.join(used.select("chunk_id").distinct(), "chunk_id", "left_semi")
        spent = gone.groupBy("paper").agg(F.count("*").alias("_spent"))
        fresh = x.join(spent, "paper", "left").where(F.col("place") <= F.col("quota") + F.coalesce("_spent", F.lit(0)))
        fresh = fresh.join(gone.select("chunk_id"), "chunk_id", "left_anti")
    first = fresh.withColumn("_at", F.row_number().over(Window.partitionBy("paper").orderBy("place"))).where(F.col("_at") <= F.col("quota"))
    rounds = first.groupBy("_at").agg(F.count("*").alias("_n"))
    before = Window.partitionBy().orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row a round
    rounds = rounds.select(F.col("_at").alias("_round"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_at").orderBy("paper")  # a row a paper
    return first.withColumn("_in", F.row_number().over(inside)).join(rounds, F.col("_at") == F.col("_round")).select("paper", "chunk_id", (F.col("_before") + F.col("_in")).cast("int").alias("turn"))


def near_questions(questions: DataFrame, least: float = NEAR) -> DataFrame:
    """questions (idx, question) -> idx, earlier_idx, jaccard: pairs of questions whose content words are alike.

    Pairs come from shared words, never from a cross join: by order of rarity, a pair at or above the threshold must
    share one of the first n - ceil(least * n) + 1 words of each."""
    words = questions.select("idx", T.content_words(F.col("question")).alias("w"))
    each = words.select("idx", F.explode("w").alias("word"))
    freq = each.groupBy("word").agg(F.count("*").alias("f"))
    order = Window.partitionBy("idx").orderBy("f", "word")
    ranked = each.join(freq, "word").withColumn("_r", F.row_number().over(order)).join(words.select("idx", F.size("w").alias("n")), "idx")
    prefix = ranked.where(F.col("_r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("idx", "word")
    pairs = prefix.select(F.col("idx").alias("earlier_idx"), "word").join(prefix, "word").where("earlier_idx < idx").select("earlier_idx", "idx").distinct()
    x = pairs.join(words, "idx").join(words.select(F.col("idx").alias("earlier_idx"), F.col("w").alias("v")), "earlier_idx")
    return x.withColumn("jaccard", T.jaccard(F.col("w"), F.col("v"))).where(F.col("jaccard") >= least).select("idx", "earlier_idx", "jaccard")


def accept(questions: DataFrame, least: float = NEAR) -> DataFrame:
    """idx, accepted, blocked_by: in order of idx, a question is refused if an earlier accepted one is near; the first
    such is named.

    Decided turn by turn: a question without an undecided earlier neighbour is refused if one of its earlier neighbours
    was accepted, else accepted. Each turn is a join of the near pairs that are still open, and decides at least the
    first open question of every cluster of near ones."""
    spark = questions.sparkSession
    path = saved.folder(spark, "accept")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    left = pairs = keep(near_questions(questions, least).select("idx", "earlier_idx"), "pairs")
    settled = keep(questions.select("idx").join(pairs.select("idx").distinct(), "idx", "left_anti").select("idx", F.lit(None).cast(questions.schema["idx"].dataType).alias("blocked_by")), "turn-0")
    turn = 0
    while not left.isEmpty():
        turn += 1
        known = settled.select(F.col("idx").alias("earlier_idx"), "blocked_by", F.lit(True).alias("known"))
        open_ = left.join(known, "earlier_idx", "left")
        now = open_.groupBy("idx").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("sure"), F.min(F.when(F.col("known") & F.col("blocked_by").isNull(), F.col("earlier_idx"))).alias("blocked_by"))
        # Refused at once if the first accepted neighbour stands before all undecided ones; accepted once all are decided.
        unknown = open_.where("known is null").groupBy("idx").agg(F.min("earlier_idx").alias("_wait"))
        now = now.join(unknown, "idx", "left").where(F.col("sure") | (F.col("blocked_by") < F.col("_wait"))).select("idx", "blocked_by")
        settled = keep(settled.union(now), f"turn-{turn}")
        left = keep(left.join(settled.select("idx"), "idx", "left_anti"), f"left-{turn}")
    return settled.select("idx", F.col("blocked_by").isNull().alias("accepted"), "blocked_by")
