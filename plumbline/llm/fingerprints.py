"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small, table, tune, unit

#: A piece is a run of up to so many words of one line.
PIECE_WORDS = 32
PIECE = r"\S++(?:[^\S\n]++\S++){0,%d}" % (PIECE_WORDS - 1)
#: Each digest goes to one cell of each of three tables of 64 cells, which make a block; empty cells are never stored.
TABLES, WIDTH = 3, 64
#: A fingerprint has a block for about so many digests, or up to half as many.
LOAD = 8
#: A block that doesn't peel is laid out again in twice as many, as often as it takes; so often never happens.
RETRIES = 40
#: Pieces of all versions in a task, so that its cells take some 30 MB; tasks at most, beyond which they grow and spill.
PART, MOST_PARTS = 30_000, 20_000
#: Groups of neighbouring ids, whose bounds the driver picks from about 32 ids a group.
MOST_GROUPS = 16_384
_KEY = (1 << 48) - 1
#: What is peeled: each version alone, so that its fingerprint holds all its digests, and differences of two versions.
OURS, EDITED, TO_EDITED, TO_NEXT = range(4)


def pieces(text: Column) -> Column:
    """Hashes of a text's pieces in order, then one of the text as a whole, which tells order and white space."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))
    return F.concat(hashes, F.array(F.xxhash64(text, F.lit(-1))))


def digest(piece: Column, number: Column) -> Column:
    """Of a piece and its number among equal ones of the text: 48 bits, under 16 bits that check them."""
    return _let(F.xxhash64(piece, number).bitwiseAND(F.lit(_KEY)), lambda k: F.shiftleft(_check(k), 48).bitwiseOR(k))


def level(n: Column) -> Column:
    """2**level blocks are laid out for n digests."""
    return F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(LOAD))))).cast("int")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(97)), 48)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _places(h: Column) -> Column:
    """The cells of a digest whose hash in this attempt is h."""
    return F.array(*[(F.lit(i * WIDTH) + F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(WIDTH - 1))).cast("int") for i in range(TABLES)])


def _pure(c: Column, v: Column) -> Column:
    """Whether a cell holds one digest alone: its check bits fit."""
    return (F.abs(c) == 1) & (F.shiftrightunsigned(v, 48) == _check(v.bitwiseAND(F.lit(_KEY))))


def peeled(cells: Column, attempt: int) -> Column:
    """cells (array of struct<i: place, c: count, v: XOR of digests>) -> struct: rest (cells), found (digests, each with the
    sign s of the version that has it and its places), stuck.

    In each round all digests that some cell holds alone are taken out of their three cells."""
    none = F.expr("cast(array() as array<struct<v:bigint,s:int,at:array<int>>>)")

    def without(e: Column, ones: Column) -> Column:
        start = F.struct(e["c"].alias("c"), e["v"].alias("v"))
        left = F.aggregate(ones, start, lambda a, o: F.when(F.array_contains(o["at"], e["i"]), F.struct((a["c"] - o["s"]).alias("c"), a["v"].bitwiseXOR(o["v"]).alias("v"))).otherwise(a))
        return _let(left, lambda a: F.struct(e["i"].alias("i"), a["c"].alias("c"), a["v"].alias("v")))

    def turn(s: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(s["rest"], lambda e: _pure(e["c"], e["v"])), lambda e: F.struct(e["v"].alias("v"), e["c"].alias("s"), e["i"].alias("i"))))
        ones = F.transform(pure, lambda e: F.struct(e["v"].alias("v"), e["s"].alias("s"), _places(F.xxhash64(e["v"], F.lit(attempt))).alias("at"), e["i"].alias("i")))
        ones = F.array_distinct(F.transform(F.filter(ones, lambda e: F.array_contains(e["at"], e["i"])), lambda e: F.struct(e["v"].alias("v"), e["s"].alias("s"), e["at"].alias("at"))))
        return _let(ones, lambda o: F.when(F.size(o) == 0, F.struct(s["rest"].alias("rest"), s["found"].alias("found"), F.lit(True).alias("stuck"))).otherwise(
            F.struct(F.filter(F.transform(s["rest"], lambda e: without(e, o)), lambda e: (e["c"] != 0) | (e["v"] != 0)).alias("rest"), F.concat(s["found"], o).alias("found"), F.lit(False).alias("stuck"))))

    start = F.struct(cells.alias("rest"), none.alias("found"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.size(cells) + 1), start, lambda s, _: F.when(s["stuck"], s).otherwise(_let(s, turn)))


def neighbours(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text) -> x, rn (together a row's key), times, doc_id, text, ours (its pieces), following (text of the
    next document by doc_id; of the first after the last) and next (its pieces).

    Null doc_id: after all others. Equal doc_ids: in the order of their texts' hashes. Rows of equal doc_id and text are
    one row here, which stands for `times` of them: each but the last has an equal one after it. Documents fall in
    about sqrt(n) groups between bounds that a sample of at most about 32 * MOST_GROUPS ids gives, so no id or gap makes
    one group large; one shuffle by range brings groups together, and each also gets a copy of the next group's first
    document. No window spans the table but one over groups."""
    text = F.coalesce("text", F.lit(""))
    own = F.struct(F.col("doc_id").isNull().alias("o"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.xxhash64(text).alias("h"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), own.alias("key"))
    classes = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("times")), narrow=True)
    n = classes.count()
    twice = scratch.save(classes.where("times > 1"), narrow=True)
    groups = int(min(MOST_GROUPS, -(-n // max(64.0, n**0.5 / 2)))) or 1
    sample = sorted(tuple(r[0]) for r in classes.where(unit("key.k", "key.h", F.lit(5)) < 32 * groups / max(n, 1)).select("key").collect())
    bounds = [sample[len(sample) * i // groups] for i in range(1, groups)] if sample else []
    known = F.from_json(F.lit(json.dumps([{"o": o, "k": k, "h": h} for o, k, h in bounds])), "array<struct<o:boolean,k:bigint,h:bigint>>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(groups.bit_length()))])
    group = lambda key: F.aggregate(steps, F.lit(0), lambda at, p: F.when(F.coalesce(F.get(known, at + p - 1) <= key, F.lit(False)), at + p).otherwise(at))

    firsts = classes.groupBy(group(F.col("key")).alias("x")).agg(F.min("key").alias("first"))  # one row a group
    order, every = Window.partitionBy().orderBy("x"), Window.partitionBy()
    firsts = firsts.withColumn("to", F.lag("x").over(order)).withColumn("far", F.max("x").over(every))
    firsts = scratch.save(firsts.select("first", F.coalesce("to", "far").alias("to"), F.col("to").isNull().alias("wraps")), 1)

    rows = keyed.withColumn("times", F.lit(1).cast("long"))
    repeats = not twice.isEmpty()
    if repeats:
        several = small(twice.withColumnRenamed("times", "_n").withColumnRenamed("key", "_key"), 40)
        same = F.col("key") == F.col("_key")
        one = keyed.join(several, same).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("_n").alias("times"))
        rows = rows.join(several, same, "left_anti").unionByName(one)
    rows = rows.withColumn("ours", pieces(F.col("text")))
    placed = rows.withColumn("x", group(F.col("key"))).join(F.broadcast(firsts), F.col("key") == F.col("first"), "left")
    here = F.struct("x", F.lit(False).alias("ghost"), F.lit(False).alias("wraps"))
    ghost = F.struct(F.col("to").alias("x"), F.lit(True).alias("ghost"), F.col("wraps").alias("wraps"))
    copies = F.explode(F.when(F.col("first").isNull(), F.array(here)).otherwise(F.array(here, ghost)))
    held = ["doc_id", "key", "times", "text", "ours"]
    spread = placed.select(*held, copies.alias("c")).select(*held, "c.x", "c.ghost", "c.wraps").repartitionByRange("x")
    w = Window.partitionBy("x").orderBy("wraps", "key", "ghost")
    out = spread.withColumn("rn", F.row_number().over(w).cast("long")).withColumn("following", F.lead("text").over(w)).withColumn("next", F.lead("ours").over(w)).where("not ghost")
    if repeats:
        last = F.struct((F.col("rn") * 2).alias("rn"), F.lit(1).cast("long").alias("times"), F.col("following"), F.col("next"))
        others = F.struct((F.col("rn") * 2 + 1).alias("rn"), (F.col("times") - 1).alias("times"), F.col("text").alias("following"), F.col("ours").alias("next"))
        out = out.withColumn("e", F.explode(F.when(F.col("times") > 1, F.array(last, others)).otherwise(F.array(last))))
        out = out.select("x", "e.rn", "e.times", "doc_id", "text", "ours", "e.following", "e.next")
    return out.select("x", "rn", "times", "doc_id", "text", "ours", "following", "next")


def versions(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """x, rn, times, doc_id, n_chars, edited_sha256 and the pieces of each document (ours), of its edited text (edited) and
    of the next document (next). Edited: the last half of the code points, rounded down, gives way to as many first
    ones of the next document, or to all it has."""
    near = neighbours(docs, scratch).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    near = near.withColumn("new", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("following", F.lit(1), half)))
    return near.select("x", "rn", "times", "doc_id", "n_chars", F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"), "ours", pieces(F.col("new")).alias("edited"), "next")


def _digests(base: DataFrame, roles: tuple[int, ...]) -> DataFrame:
    """versions() -> x, rn, role, s (sign), v (digest), block: every digest in each role that its version plays."""
    versions = ["ours", "edited", "next"]
    of = [level(F.size(c)) for c in versions]
    # How many blocks, less one, each role's sketches have; numbers only, so that groups are hashed and not sorted.
    last = [(_bit(n) - 1).alias(f"l{role}") for role, n in ((OURS, of[0]), (EDITED, of[1]), (TO_EDITED, F.greatest(of[0], of[1])), (TO_NEXT, F.greatest(of[0], of[2])))]
    plays = [[(OURS, 1), (TO_EDITED, 1), (TO_NEXT, 1)], [(EDITED, 1), (TO_EDITED, -1)], [(TO_NEXT, -1)]]
    plays = [[(role, s) for role, s in p if role in roles] for p in plays]
    numbers = ["x", "rn", *[f"l{r}" for r in range(4)]]
    each = base.select("x", "rn", *last, F.explode(F.array(*[F.struct(F.lit(i).alias("version"), F.col(c).alias("hs")) for i, c in enumerate(versions) if plays[i]])).alias("p"))
    each = each.select(*numbers, "p.version", F.explode("p.hs").alias("h"))
    counted = each.groupBy(*numbers, "version", "h").agg(F.count("*").alias("n"))
    numbered = counted.select(*numbers, "version", "h", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("j")).select(*numbers, "version", digest(F.col("h"), F.col("j")).alias("v"))
    part = lambda role, s: F.struct(F.lit(role).alias("role"), F.lit(s).alias("s"), F.col("v").bitwiseAND(F.col(f"l{role}")).alias("block"))
    played = F.lit(None)
    for i, p in enumerate(plays):
        if p:
            played = F.when(F.col("version") == i, F.array(*[part(*x) for x in p])).otherwise(played)
    return numbered.select("x", "rn", "v", F.explode(played).alias("p")).select("x", "rn", "p.role", "p.s", "v", "p.block")


def _cells(digests: DataFrame, attempt: Column) -> DataFrame:
    """_digests() -> x, rn, role, block, attempt, sub, i, c, v: the sketches' cells that aren't empty. An attempt lays a
    block out in 2**attempt blocks (sub), with hashes of its own. Signs add up, so what both versions have cancels."""
    x = digests.withColumn("attempt", attempt).withColumn("hash", F.xxhash64("v", "attempt"))
    x = x.withColumn("sub", F.shiftrightunsigned("hash", 32).bitwiseAND(_bit(F.col("attempt")) - 1))
    x = x.select("x", "rn", "role", "block", "attempt", "sub", "s", "v", F.explode(_places(F.col("hash"))).alias("i"))
    return x.groupBy("x", "rn", "role", "block", "attempt", "sub", "i").agg(F.sum("s").cast("int").alias("c"), F.bit_xor("v").alias("v")).where("c <> 0 or v <> 0")


_KEYS = ["x", "rn", "role", "block"]


def _met(blocks: DataFrame) -> DataFrame:
    """Blocks (_KEYS, differ, ok) -> x, rn, to_edited, to_next (digests recovered of the differences), failed (role and
    block of those that aren't peeled whole)."""
    differ = lambda role: F.coalesce(F.sum(F.when(F.col("ok") & (F.col("role") == role), F.col("differ"))), F.lit(0))
    return blocks.groupBy("x", "rn").agg(differ(TO_EDITED).alias("to_edited"), differ(TO_NEXT).alias("to_next"), F.collect_list(F.when(~F.col("ok"), F.struct("role", "block"))).alias("failed"))


def _first_round(digests: DataFrame) -> DataFrame:
    """_met() of the blocks that one round of peeling empties: the digests that cells hold alone are all there are if
    their XOR is that of the first table, where every digest has one cell."""
    cells = _cells(digests, F.lit(0))
    x = cells.select(*_KEYS, F.when(_pure(F.col("c"), F.col("v")), F.col("v")).alias("alone"), F.when(F.col("i") < WIDTH, F.col("v")).alias("t"))
    x = x.groupBy(*_KEYS, "alone").agg(F.bit_xor("t").alias("t"))  # a digest may be alone in several cells
    x = x.groupBy(*_KEYS).agg(F.bit_xor("t").alias("t"), F.count("alone").alias("differ"), F.bit_xor("alone").alias("found"))
    return _met(x.select(*_KEYS, "differ", F.coalesce(F.col("found") == F.col("t"), F.lit(False)).alias("ok")))


def _peel(digests: DataFrame, attempt: int) -> DataFrame:
    """_met() of blocks peeled round after round."""
    cells = _cells(digests, F.lit(attempt)).groupBy(*_KEYS, "sub").agg(F.collect_list(F.struct("i", "c", "v")).alias("cells"))  # a block's at most
    p = cells.select(*_KEYS, peeled(F.col("cells"), attempt).alias("p")).select(*_KEYS, F.size("p.found").alias("differ"), (F.size("p.rest") == 0).alias("ok"))
    return _met(p.groupBy(*_KEYS).agg(F.sum("differ").alias("differ"), F.bool_and("ok").alias("ok")))


def _published(base: DataFrame, attempts: DataFrame | None) -> DataFrame:
    """x, rn, fingerprint, edited_fingerprint: number of digests, level, then the blocks in order, each with its attempt."""
    digests = _digests(base, (OURS, EDITED))
    attempt = F.lit(0)
    if attempts is not None:
        digests = digests.join(small(attempts, 32), _KEYS, "left").withColumn("_a", F.coalesce("_a", F.lit(0)))
        attempt = F.col("_a")
    cell = lambda e: F.concat_ws(".", e["i"].cast("string"), e["c"].cast("string"), F.hex(e["v"]))
    keys = ["x", "rn", "role", "block", "attempt", "sub"]
    blocks = _cells(digests, attempt).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "c", "v"))).alias("cells"))
    blocks = blocks.select("x", "rn", "role", "block", "sub", F.concat(F.concat_ws(".", "block", "attempt", "sub"), F.lit("="), F.array_join(F.transform("cells", cell), ",")).alias("t"))
    whole = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("block", "sub", "t")))), lambda b: b["t"]), " ")
    return blocks.groupBy("x", "rn").agg(whole(OURS).alias("fingerprint"), whole(EDITED).alias("edited_fingerprint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document is the set of its pieces, runs of up to PIECE_WORDS words of one line, each with its number among equal
    ones, and of one digest of its whole text. Its fingerprint is a sketch of that set with a block of cells for every
    few digests: `digests level block.attempt.sub=cell.count.xor,... ...`. It peels alone, so it holds all its digests,
    and two fingerprints can be subtracted at the larger one's level. near_*: digests that both versions have over
    those that either has, from what peeling recovers of the difference; 1 only for equal texts. One round of peeling
    empties most blocks; the others are peeled round after round, and one that stays stuck is laid out again in twice
    as many blocks, until it peels whole.

    Null text: as empty. One document: followed by itself. Rows of equal doc_id and text follow each other. Null doc_id:
    behind all others, by hash of the text. No rows: no rows. Other columns play no part."""
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "fingerprints")
    base = scratch.save(versions(docs, scratch))
    total, scratch.rows = base.agg(F.coalesce(F.sum(F.size("ours") + F.size("edited") + F.size("next")), F.lit(0)), F.count("*")).first()
    dealt = lambda rows: rows.repartition(int(min(MOST_PARTS, 1 + total // PART)), "x", "rn")
    roles = (OURS, EDITED, TO_EDITED, TO_NEXT)
    files = max(2 * docs.sparkSession.sparkContext.defaultParallelism, total // (16 * PART))
    met = [scratch.save(_first_round(_digests(dealt(base), roles)), files)]
    attempts = None
    for attempt in range(RETRIES):
        failed = met[-1].select("x", "rn", F.explode("failed").alias("f")).select("x", "rn", "f.role", "f.block")
        if failed.isEmpty():
            break
        if attempt:
            mine = failed.where(F.col("role").isin(OURS, EDITED)).withColumn("_a", F.lit(attempt))
            attempts = mine if attempts is None else attempts.unionByName(mine)
        rows = dealt(base.join(small(failed.select("x", "rn").distinct(), 16), ["x", "rn"], "left_semi"))
        met.append(scratch.save(_peel(_digests(rows, roles).join(small(failed, 32), _KEYS, "left_semi"), attempt), narrow=True))
    else:
        raise RuntimeError("a sketch doesn't peel")
    found = met[0] if len(met) == 1 else reduce(DataFrame.unionByName, met).groupBy("x", "rn").agg(F.sum("to_edited").alias("to_edited"), F.sum("to_next").alias("to_next"))
    if attempts is not None:
        attempts = attempts.groupBy(*_KEYS).agg(F.max("_a").alias("_a"))
    said = _published(dealt(base.select("x", "rn", "ours", "edited", F.array().cast("array<bigint>").alias("next"))), attempts)
    sizes = base.select("x", "rn", "times", "doc_id", "n_chars", "edited_sha256", *[F.size(c).alias(c) for c in ("ours", "edited", "next")])
    rows = said.join(sizes, ["x", "rn"]).join(found, ["x", "rn"])

    def near(theirs: str, d: str) -> Column:
        both = F.col("ours") + F.col(theirs)
        return (both - F.col(d)) / (both + F.col(d))

    head = lambda c: F.concat_ws(" ", F.col(c).cast("string"), level(F.col(c)).cast("string"))
    out = rows.select(
        "times", "doc_id", "n_chars", "edited_sha256", F.concat_ws(" ", head("ours"), "fingerprint").alias("fingerprint"), F.concat_ws(" ", head("edited"), "edited_fingerprint").alias("edited_fingerprint"),
        near("edited", "to_edited").alias("near_edited"), near("next", "to_next").alias("near_next"),
    )
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_", "times")
    return out.coalesce(files)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
