"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, leanly, powers, release, run_hashes, small, table, tune

#: A sentence ends at a line's end or at a full stop, question or exclamation mark before white space; quotes and
#: brackets may close after the mark.
_MARKS, _CLOSERS = ".!?。！？", "\"')]"
#: Characters of scripts written without spaces are words of their own.
_BARE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
#: Of so many words in a row in a sentence one at least ends a part, the one of the least hash: equal passages are cut
#: alike from their first such word to their last. Characters of scripts without spaces: of so many.
_WINDOW, _BARE_WINDOW = 8, 2

@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: 1 white space, 2 mark, 4 closer, 8 bare."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    kind[[i for i in range(sys.maxunicode + 1) if chr(i).isspace()]] = 1
    kind[[ord(c) for c in _MARKS]] |= 2
    kind[[ord(c) for c in _CLOSERS]] |= 4
    for lo, hi in _BARE:
        kind[lo : hi + 1] |= 8
    return kind


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lower(text: str) -> str:
    """In lower case, but for characters that would become several."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _least(h: np.ndarray, of: np.ndarray, window: int) -> np.ndarray:
    """Which places hold the least value (the last of equal ones) of some `window` places in a row of one sentence.
    window: a power of two."""
    n = len(h)
    picked = np.zeros(n, bool)
    if n >= window:
        # The high bits, then how far a place is from the end of what _PLACE bits can count.
        low = h & ~_PLACE | _PLACE - np.arange(n, dtype=np.uint64)
        wide = 1
        while wide < window:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        picked[(_PLACE - (low & _PLACE)).astype(np.int64)[of[window - 1 :] == of[: n - window + 1]]] = True
    return picked


_PLACE = np.uint64((1 << 28) - 1)  # more tokens than a text can have


def _split(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text with characters: where parts end, how many tokens end by then; hashes of tokens, and which start a word.

    A token is a word, or a bare character, with the white space after it; white space before the first word is one."""
    points = _points(text)
    n = len(points)
    kind = _kinds()[points]
    solid = kind & 1 == 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    bare = kind & 8 != 0
    has_bare = bool(bare.any())
    if has_bare:
        begins |= bare
        begins[1:] |= bare[:-1] & solid[1:]
    begins[0] = True
    starts = np.flatnonzero(begins)
    past = np.append(starts[1:], n)
    letters = np.concatenate([[0], np.cumsum(solid)])
    ends = starts + letters[past] - letters[starts]  # of the words
    h = run_hashes(_points(_lower(text)), starts, ends)
    spaced = past > ends
    lines = np.concatenate([[0], np.cumsum(points == 10)])
    cut = lines[past] > lines[ends]
    last = np.maximum.accumulate(np.where(kind & 4 == 0, np.arange(n), 0))  # at or before, that closes nothing
    cut |= spaced & (ends > 0) & (kind[last[ends - 1]] & 2 != 0)
    of = np.cumsum(cut) - cut
    start = np.ones(len(starts), bool)
    start[0] = solid[0]
    picked = _least(h, of, _WINDOW)
    if has_bare:
        alone = bare[starts]
        # Only places whose whole window is bare: words beside them are no part of it.
        picked |= _least(h, np.where(alone, of, -1 - np.arange(len(starts))), _BARE_WINDOW)
        start[1:] = spaced[:-1] | (cut | picked)[:-1]
    cut |= picked
    cut[-1] = True
    at = np.flatnonzero(cut)
    return past[at], at + 1, h, start


def sentences(text: str) -> list[int]:
    """Where each sentence, or part of one, ends; they follow each other without gaps and cover the text."""
    return _split(text)[0].tolist() if text else []


def runs(text: str, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64 bits of a polynomial over words' hashes, 32 of their sum, first, past) of runs of consecutive sentences: from each sentence the shortest of two or more
    that has least_words words, and to each sentence likewise. Longer repeated runs are covered by these, which repeat
    with them. The bits name the words of a run and its number of sentences; white space and letter case don't count."""
    ends, tokens, h, start = _split(text) if text else (np.empty(0, np.int64),) * 4
    n = len(ends)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
    up, down = powers(len(h))
    lead = int(text[0].isspace())
    h = h[lead:]  # no white space before the first word
    edge = np.concatenate([[0], tokens - lead])
    count = np.concatenate([[0], np.cumsum(start[lead:])])[edge]
    here = np.arange(n + 1)
    past = np.maximum(np.searchsorted(count, count + least_words), here + 2)
    first = np.minimum(np.searchsorted(count, count - least_words, "right") - 1, here - 2)
    lo = np.concatenate([here[past <= n], first[first >= 0]])
    hi = np.concatenate([past[past <= n], here[first >= 0]])
    both = np.unique(lo * (n + 1) + hi)
    lo, hi = both // (n + 1), both % (n + 1)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[edge] for x in (h * up[: len(h)], h)]
    value, check = (x[hi] - x[lo] for x in sums)
    value *= down[edge[lo]]
    value ^= value >> np.uint64(29)
    value = value * np.uint64(0xBF58476D1CE4E5B9) + (hi - lo).astype(np.uint64)
    return value.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32), lo.astype(np.int32), hi.astype(np.int32)


#: Null doc_ids stand behind all others.
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """docs -> row (all its columns), text, key (doc_id) and th (hash of the text); the latter two order documents."""
    return docs.select(F.struct("*").alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.xxhash64("text").alias("th"))


def _names(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, bool]:
    """key and th of those that several rows of docs share, if any, and whether key alone tells documents apart."""
    each = scratch.save(_keyed(docs).groupBy("key", "th").count(), narrow=True)
    twice = each.where("count > 1").select("key", "th")
    return None if twice.isEmpty() else twice, each.groupBy("key").count().where("count > 1").isEmpty()


#: A span as one number: first sentence, then the one past its last.
_SPAN = 32


def repeated_spans(keyed: DataFrame, scratch: Scratch, by: list[str], least_words: int = 25, equal: DataFrame | None = None) -> DataFrame:
    """keyed (the columns `by` that tell and order documents, text) -> by, later, spans: array of numbers, see _SPAN.

    A run is repeated if it occurs more than once in all documents; every occurrence but the first, by document, then
    place, is a span. Only documents that have spans get a row. equal (by): documents that are several rows. One of
    these counts as the first; `later` says whether spans are of the others, where every occurrence is one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(t or "", least_words) for t in b.column("text").to_pylist()]
            if not found:
                continue
            each = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            run, check, first, past = (np.concatenate(c) for c in zip(*found, strict=True))
            at = first.astype(np.int64) << _SPAN | past
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(check.astype(np.int32)), *(b.column(c).take(each) for c in by), pa.array(at)], names=["run", "check", *by, "at"])

    every = scratch.save(keyed.select(*by, "text").mapInArrow(leanly(emit), f"run long, check int, {', '.join(f'{c} long' for c in by)}, at long"))
    scratch.rows = every.count()
    named = ["run", "check"]
    twice = scratch.save(every.groupBy(*named).agg(F.count("*").alias("n"), F.min("key").alias("home")).where("n > 1").select(*named, "home"), narrow=True)
    scratch.sweep()
    again = scratch.save(every.join(twice, named), narrow=True)  # read back, so that a hot run's rows can be split
    scratch.drop(every, twice)
    scratch.sweep()
    # No window over a run or document: many rows may share both.
    at_home = again.where("key = home")
    place = F.struct(*by, "at")
    start = at_home.groupBy(*named).agg(F.min(place).alias("start"))
    inside = at_home.join(start, named).where(place > F.col("start"))
    covered = again.where("key > home").select(*by, "at").unionByName(inside.select(*by, "at")).withColumn("later", F.lit(False))
    if equal is not None:
        covered = covered.unionByName(again.join(small(equal, 24), by, "left_semi").select(*by, "at", F.lit(True).alias("later")))
    found = scratch.save(covered.groupBy(*by, "later").agg(F.collect_set("at").alias("spans")), narrow=True)
    scratch.drop(again)
    return found


def _clean(text: str, spans) -> tuple[str, list[tuple[int, int]], int]:
    ends = sentences(text)
    starts = [0, *ends]
    drop = np.zeros(len(ends) + 1, np.int64)
    for s in spans:
        drop[s >> _SPAN] += 1
        drop[s & (1 << _SPAN) - 1] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    cuts: list[list[int]] = []
    for i in np.flatnonzero(gone):
        if cuts and cuts[-1][1] == starts[i]:
            cuts[-1][1] = ends[i]
        else:
            cuts.append([starts[i], ends[i]])
    kept, at = [], 0
    for lo, hi in cuts:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return "".join(kept), [tuple(c) for c in cuts], int(gone.sum())


def remove_repeats(docs: DataFrame, least_words: int = 25) -> DataFrame:
    """docs (doc_id, text, ...) -> the same rows and columns, then removed (array of (start, past) character spans of
    the old text) and n_removed (sentences). text lacks the sentences that a repeated span covers.

    A repeated span is a run of two or more consecutive sentences with at least least_words words that occurs earlier,
    by doc_id, hash of the text, then place, in any document; null doc_ids stand last, and of equal rows any one is the
    first. Sentences of eight words or more are first cut into parts, at places that their words decide: of a repeated
    passage, up to seven words before its first such place or sentence's end and after its last stay. So a passage of
    least_words + 14 words or more is always found. Runs are named by 96 bits of their words' hashes.

    Null or empty text: stays, nothing removed. A document may become empty; its row stays. Columns of the input named
    removed or n_removed are replaced; other names don't matter. No rows: no rows."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "clean")
    names = [c for c in docs.columns if c not in ("removed", "n_removed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    equal, told_apart = _names(docs, scratch)
    keyed, by = _keyed(docs), ["key"] if told_apart else ["key", "th"]
    found = repeated_spans(keyed, scratch, by, least_words, equal)
    size = found.agg(F.sum(F.size("spans") * 8 + 48)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found

    @F.pandas_udf("text string, removed array<struct<start:int,past:int>>, n_removed int")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        release()
        out = [(None, None, 0) if t is None else _clean(t, s) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame(out, columns=["text", "removed", "n_removed"])

    keyed = keyed.select("row", *by)
    if equal is None:
        keyed = keyed.withColumn("later", F.lit(False))
    else:
        both = small(equal, 24)
        rows = scratch.save(keyed.join(both, by, "left_semi").withColumn("number", F.monotonically_increasing_id()))  # kept, so that numbers stay
        one = rows.groupBy(*by).agg(F.min("number").alias("one"))
        rows = rows.join(small(scratch.save(one, narrow=True), 32), by).withColumn("later", F.col("number") > F.col("one"))
        keyed = keyed.join(both, by, "left_anti").withColumn("later", F.lit(False)).unionByName(rows.select("row", *by, "later"))
    x = keyed.join(found, [*by, "later"], "left")
    hit = F.col("spans").isNotNull()
    x = x.select("row", hit.alias("hit"), cut(F.when(hit, F.col("row.text")), "spans").alias("cut"))
    empty = F.expr("cast(array() as array<struct<start:int,past:int>>)")
    old = {c: F.col("row").getField(c) for c in names}
    new = old | {"text": F.when(F.col("hit"), F.col("cut.text")).otherwise(old["text"])}
    return x.select(*[new[c].alias(c) for c in names], F.when(F.col("hit"), F.col("cut.removed")).otherwise(empty).alias("removed"), F.when(F.col("hit"), F.col("cut.n_removed")).otherwise(F.lit(0)).alias("n_removed"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs)
