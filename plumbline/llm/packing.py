"""Packing token sequences: best-two-fit over shards of pieces."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, leanly, table, tune, unit

VOCABULARY = "word_bpe_49k.json"
#: Words of more bytes than this are tokenized but not remembered.
_REMEMBER = 64


_ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Lower-case letters that neither normalising nor lowering changes: one pre-token, which the model takes as it is.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as the character of its number, where that is printable, and number the
    other bytes from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Ids(dict):
    """Token ids of words as little-endian unsigned 32-bit bytes. Two generations of words are remembered, so memory is
    bounded and common words are tokenized once."""

    GENERATION = 300_000
    #: After a letter or digit a run of these is a token sequence of its own.
    TAIL = b".,;:!?|*#%$&"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= _REMEMBER:
            if len(self) >= self.GENERATION:
                self.old = self.copy()
                self.clear()
            self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        core = word.rstrip(self.TAIL)
        if core and len(core) < len(word) and (core[-1] in _ALNUM if core[-1] < 128 else core.decode()[-1].isalpha()):
            return self[core] + self[word[len(core) :]]
        if _PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode_batch_fast([word.decode()], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _split(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8. The vocabulary is of lower case, so A-Z are lowered here, but where special tokens may be."""
    data = (text or "").encode()
    return (data if b"<|" in data else data.lower()).split()


def _path(tokenizer: str | None) -> str:
    if tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, most: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, piece, start, length, ids (binary, unsigned 32-bit little-endian).

    A document is its text's token ids, then id 0; null or empty text is id 0 alone. Documents of more than `most`
    ids are cut into pieces of `most`; the last may be shorter. The vocabulary drops white space and never looks
    across it, so words are tokenized once and remembered. tokenizer: path of a `tokenizers` file that does so."""
    tune(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _path(tokenizer)
        known = held(f"ids of {path}", lambda: _Ids(path))  # shared by a worker's tasks
        step = 4 * most
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(ids, b.column("text").to_pylist(), strict=True):
                data = b"".join(map(known.__getitem__, _split(text))) + b"\0\0\0\0"
                for i, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    for column, value in zip(out, (doc, i, at // 4, len(part) // 4, part), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(leanly(cut, holds=True), "doc_id long, piece int, start long, length long, ids binary")


def best_two_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. Lengths: 1 to `most`.

    A bin is filled greedily, the longest that fits first. Then its smallest member gives way to the two unpacked ones
    that together fill the gap so expanded most tightly, if they fill more than it did."""
    order = np.argsort(-lengths, kind="stable")
    count = np.bincount(lengths, minlength=most + 1)
    at = np.concatenate([[0], np.cumsum(count[::-1])[:-1]])[::-1].copy()  # next of each length in order
    fit = np.maximum.accumulate(np.where(count > 0, np.arange(most + 1), 0))  # longest left that is at most so long

    def out(x: int) -> None:
        count[x] -= 1
        if not count[x]:
            fit[x : np.searchsorted(fit, x, "right")] = fit[x - 1]

    def back(x: int) -> None:
        count[x] += 1
        if count[x] == 1:
            fit[x : np.searchsorted(fit, x, "left")] = x

    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    left = len(lengths)
    while left:
        held, gap = [], most
        while gap and (x := int(fit[gap])):
            out(x)
            held.append(x)
            gap -= x
        if gap and len(held) > 1:
            room = gap + held[-1]
            one = np.flatnonzero(count[:room])
            if len(one):
                two = fit[room - one]
                lone = (two == one) & (count[one] < 2)
                two[lone] = fit[one[lone] - 1]
                total = np.where(two > 0, one + two, 0)
                best = int(np.argmax(total))
                if total[best] > held[-1]:
                    a, b = int(one[best]), int(two[best])
                    out(a)
                    out(b)
                    back(held[-1])
                    held[-1:] = [a, b]
        offset = 0
        for x in held:
            row = order[at[x]]
            at[x] += 1
            bins[row], offsets[row] = n, offset
            offset += x
        left -= len(held)
        n += 1
    return bins, offsets


def assign(light: DataFrame, n: int, most: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length.

    n: rows of light. Rows are dealt by hash into shards of about shard_rows, each packed on its own: a shard has the
    whole's mix of lengths and wastes at most a bin or two, whatever the table's size. No rows: no rows."""
    shards = max(1, -(-n // shard_rows))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c in rows.columns if c != "shard"], kind="stable").reset_index(drop=True)
        bins, offsets = best_two_fit(rows["length"].to_numpy(np.int64), most)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets).drop(columns="shard")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in light.schema)
    dealt = light.withColumn("shard", F.floor(unit("doc_id", "piece", "length") * shards))
    return dealt.groupBy("shard").applyInPandas(pack, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, most: int = 2048, shard_rows: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed as often as they occur; a null doc_id stays null. The ids themselves come from pieces();
    here only their checksum travels with a piece's place."""
    scratch = Scratch(docs.sparkSession, "pack")
    light = scratch.save(pieces(docs, most, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return assign(light, light.count(), most, shard_rows)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
