"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucketed, small, table, tune, unit


#: Rows of links of more rows are ordered one by one when shards are levelled.
WIDE = 64


def _goals(n: int, shards: int) -> list[int]:
    return [n // shards + (i < n % shards) for i in range(shards)]


def _admitted(asks: list[tuple[int, int, int]], room: list[int]) -> list[tuple[int, int, int, bool]]:
    """asks (shard, k, links of k rows that ask) -> (shard, k, how many of them are let in, whether all), the largest
    first; takes their rows from room. A link that doesn't fit keeps no smaller one out."""
    let_in = []
    for j, k, links in sorted(asks, key=lambda x: (x[0], -x[1])):
        m = min(links, room[j] // k)
        if m:
            room[j] -= m * k
            let_in.append((j, k, m, m == links))
    return let_in


def propagate(nodes: DataFrame, n: int, shards: int, scratch: Scratch) -> DataFrame:
    """nodes (link, shard, ...): moves linked rows towards the shard where most rows of their link are.

    Each turn every link that is spread out asks to gather in its best shard, of those whose room, n / shards less the
    rows gathered there, holds it whole: the one with most of its rows, else the one with most room. The shard lets in
    what fits, large links first and equal ones in hashed order; the others ask elsewhere next turn. As a shard that
    has turned a link away never has room for it later, this ends after at most as many turns as shards, when no link
    that is spread out fits anywhere. Rows of these lose their link; rows without links make room afterwards. Links of
    more than half a quota were cut into parts before."""
    quota = n // shards
    here = nodes.where("link is not null").groupBy("link", "shard").agg(F.count("*").alias("k"))
    held = F.map_from_entries(F.collect_list(F.struct("shard", F.col("k").alias("rows"))))  # an entry a shard at most
    links = scratch.save(here.groupBy("link").agg(F.sum("k").alias("k"), held.alias("held")), narrow=True)
    whole = F.size("held") == 1
    settled = {r["shard"]: r["k"] for r in links.where(whole).groupBy(F.map_keys("held")[0].alias("shard")).agg(F.sum("k").alias("k")).collect()}  # a row a shard
    room = [max(0, quota - settled.get(j, 0)) for j in range(shards)]
    waiting, placed = links.where(~whole).select("link", "k", "held"), []
    for turn in range(shards):
        choices = F.array(*[F.struct(F.coalesce(F.col("held")[F.lit(j)], F.lit(0)).alias("rows"), F.lit(room[j]).cast("long").alias("room"), F.xxhash64("link", F.lit(j)).alias("tie"), F.lit(j).alias("shard")) for j in range(shards)])
        fits = F.filter(choices, lambda c: c["room"] >= F.col("k"))
        asking = scratch.save(waiting.where(F.col("k") <= max(room)).withColumn("want", F.array_max(fits)["shard"]), narrow=True)
        sizes = asking.groupBy("want", "k").agg(F.count("*").alias("links")).collect()  # a row for each size of links in each shard: n rows have at most sqrt(2 n) sizes
        if not sizes:
            break
        let_in = nodes.sparkSession.createDataFrame(_admitted([tuple(r) for r in sizes], room), "want int, k long, most long, every boolean")
        part = scratch.save(asking.join(small(let_in, 24), ["want", "k"]).select("link", "want", "k", "most", "every", unit("link", F.lit(turn)).alias("at")), narrow=True)
        some = part.where("not every")
        ranked = bucketed(some, ["want", "k"], "at", max(1, some.count()))  # where all links of a size are let in, none needs a place
        placed.append(scratch.save(part.where("every").select("link", "want").union(ranked.where("rank < most").select("link", "want")), narrow=True))
        waiting = asking.drop("want").join(small(placed[-1].select("link"), 16), "link", "left_anti")
    moves = links.where(whole).select("link", F.map_keys("held")[0].alias("want"))
    for p in placed:
        moves = moves.union(p)
    moved = nodes.join(small(scratch.save(moves, narrow=True), 24).withColumnRenamed("link", "to"), F.col("link") == F.col("to"), "left")
    moved = moved.withColumn("shard", F.coalesce("want", "shard")).withColumn("link", F.col("to")).select(*nodes.columns)
    return scratch.save(moved, narrow=True)


def level(nodes: DataFrame, n: int, shards: int, scratch: Scratch) -> DataFrame:
    """Moves as few rows as it takes for counts at most one apart: rows without links first, then links in hashed order.
    Rows of wide links take places of their own, so that no bucket of the order holds a whole one."""
    load = {r["shard"]: r["k"] for r in nodes.groupBy("shard").agg(F.count("*").alias("k")).collect()}  # a row a shard
    load = [load.get(i, 0) for i in range(shards)]
    goals = _goals(n, shards)
    order = sorted(range(shards), key=lambda i: (-load[i], i))  # the larger goals go to the fuller shards
    goal = [0] * shards
    for g, i in zip(goals, order, strict=True):
        goal[i] = g
    over = [max(0, a - b) for a, b in zip(load, goal, strict=True)]
    if not any(over):
        return nodes
    first, into, total = [], [], 0
    for i in range(shards):
        first.append(total)
        total += over[i]
    starts, at = [], 0
    for i in range(shards):
        if goal[i] > load[i]:
            starts.append(at)
            into.append(i)
            at += goal[i] - load[i]
    place = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("shard") + 1)
    ranked = bucketed(nodes.withColumn("at", F.when(F.col("link").isNull(), unit("doc_id", "text_crc32") / 2).otherwise(0.5 + F.when(F.col("wide"), unit("doc_id", "link")).otherwise(unit("link")) / 2)), ["shard"], "at", n)
    spot = place(first) + F.col("rank")
    to = F.element_at(F.array(*[F.lit(i) for i in into]), F.size(F.filter(F.array(*[F.lit(int(s)).cast("long") for s in starts]), lambda s: s <= spot)))
    return scratch.save(ranked.withColumn("shard", F.when(F.col("rank") < place(over), to).otherwise(F.col("shard"))).select(*nodes.columns), narrow=True)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law (`rows`), shard, slot
    (gapless from 0 in each shard) and grown_shard (null under this law).

    Counts of shards are at most one apart. Documents of equal text are linked. Each starts in a shard that its doc_id
    picks; balanced label propagation then gathers linked ones. A link of more than half a shard's quota is cut by
    hash into parts of about that size, so no task holds a text that a third of all rows share. A link stays spread
    out only if no shard has room for all its rows. Null text: size 1, the checksum of no bytes, equal to empty text. Repeated rows: linked like any equal texts.
    No rows: no rows."""
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce("text", F.lit(""))
    base = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")))
    n = scratch.rows = base.count()
    most = max(2, n // shards // 2)
    groups = base.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.col("g").alias("g2"), F.ceil(F.col("k") / most).alias("parts"), (F.col("k") > WIDE).alias("wide"))
    part = F.floor(unit("doc_id", F.lit(1)) * F.col("parts"))
    nodes = base.join(small(scratch.save(groups, narrow=True), 24), F.col("g") == F.col("g2"), "left").withColumn("link", F.when(F.col("parts").isNotNull(), F.xxhash64("g", part)))
    nodes = scratch.save(nodes.select("doc_id", "size", "text_crc32", "link", F.coalesce("wide", F.lit(False)).alias("wide"), "shard"), narrow=True)
    nodes = level(propagate(nodes, n, shards, scratch), n, shards, scratch)
    placed = bucketed(nodes.withColumn("at", unit("doc_id", "text_crc32", F.lit(2))), ["shard"], "at", max(1, n))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
