"""Text functions as Spark columns."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKENIZATION_VERSION = "v1"

# The token pattern, chunk ids and the screening patterns decide which results are right.
TOKEN = r"[a-z0-9]+(?:[._\-/][a-z0-9]+)*"
JOINER = r"[._\-/]"
CHUNK_ID = r"^([^:]+)::p(\d+)::c(\d+)$"
VENUE = r"(?i)In Proceedings|Proceedings of|Conference on|Transactions on|Journal of|preprint|arXiv preprint|pages \d+"
ARXIV = r"arXiv:\d{4}\.\d{4,5}"
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
BRACKET = r"\[\d+\]"
SENTENCE = r"[a-z]{3,}\.\s+[A-Z]"
STOPWORDS = (
    "a an the and or but if then than that this these those of in on at to for from by with without "
    "is are was were be been being do does did doing have has had having it its as not no nor so such "
    "what which who whom when where why how can could should would may might will shall about into "
    "over under between during above below can't cannot each other more most some any all both"
).split()

SPACE = r"[ \t\n\r\f\x0B]+"


@functools.cache
def _folds() -> tuple[str, str, str]:
    """(characters, what each folds to, class of characters that fold to several), from the Unicode tables: decomposed,
    case folded, without combining marks. Characters that hold no letter, digit or joiner after that separate tokens
    anyway and are left out; lone combining marks fold to nothing and come last, where translate() deletes them."""
    one, gone, several = [], [], []
    useful = re.compile(r"[a-z0-9._\-/]")
    for i in range(128, sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        c = chr(i)
        f = "".join(x for x in unicodedata.normalize("NFKD", c).casefold() if not unicodedata.combining(x))
        if not f:
            gone.append(c)
        elif useful.search(f):
            (one if len(f) == 1 else several).append((c, f))
    chars = "".join(c for c, _ in one) + "".join(gone)
    ranges, start, last = [], None, None
    for c, _ in several:
        if last is not None and ord(c) == last + 1:
            last += 1
            continue
        if last is not None:
            ranges.append((start, last))
        start = last = ord(c)
    ranges.append((start, last))
    cls = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    return chars, "".join(f for _, f in one), cls


def fold(text: Column) -> Column:
    """Decomposes, case folds and drops combining marks. JVM code for all characters that fold to at most one; only
    texts with ligatures and the like go through Python."""
    chars, to, cls = _folds()
    hard = text.rlike(cls)
    exact = _fold_exact(F.when(hard, text))
    return F.when(hard, exact).otherwise(F.translate(F.lower(text), chars, to))


@F.pandas_udf(StringType())
def _fold_exact(text: pd.Series) -> pd.Series:
    return text.map(fold_python, na_action="ignore")


def fold_python(text: str) -> str:
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFKD", text).casefold()
    for c in set(folded):  # few of a text's distinct characters are marks
        if unicodedata.combining(c):
            folded = folded.replace(c, "")
    return folded


def tokens_of_folded(folded: Column) -> Column:
    found = F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(JOINER), F.concat(F.array(t), F.split(t, JOINER))).otherwise(F.array(t))))


def tokenize(text: Column) -> Column:
    """Array of BM25 terms: runs of letters and digits, compounds first and then their parts; no stems, no stop words."""
    return tokens_of_folded(fold(text))


def tokenize_native(text: Column) -> Column:
    """tokenize() for text known to hold no ligatures; never leaves the JVM."""
    chars, to, _ = _folds()
    return tokens_of_folded(F.translate(F.lower(text), chars, to))


def tokenize_python(text: str) -> list[str]:
    out: list[str] = []
    for t in re.findall(TOKEN, fold_python(text)):
        parts = re.split(JOINER, t)
        out += [t, *parts] if len(parts) > 1 else [t]
    return out


_TOKEN, _JOINER = re.compile(TOKEN), re.compile(JOINER)


def term_counts(text: str) -> Counter[str]:
    """How often each of tokenize_python()'s terms occurs."""
    found = Counter(_TOKEN.findall(fold_python(text)))
    for t in [t for t in found if not t.isalnum()]:
        for part in _JOINER.split(t):
            found[part] += found[t]
    return found


def sha8(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def basename_stem(path: Column) -> Column:
    """Last part of a path with either separator, without .pdf in any case."""
    return F.regexp_replace(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), r"(?i)\.pdf$", "")


def make_chunk_id(paper: Column, page: Column, ordinal: Column) -> Column:
    """Errors on a paper id with ':' and on negative or missing numbers."""
    good = ~paper.contains(":") & (page >= 0) & (ordinal >= 0)
    made = F.concat(paper, F.lit("::p"), page.cast("string"), F.lit("::c"), ordinal.cast("string"))
    why = F.concat(F.lit("cannot make a chunk id of "), F.coalesce(paper, F.lit("NULL")), F.lit(", "), F.coalesce(page.cast("string"), F.lit("NULL")), F.lit(", "), F.coalesce(ordinal.cast("string"), F.lit("NULL")))
    return F.when(F.coalesce(good, F.lit(False)), made).otherwise(F.raise_error(why))


def parse_chunk_id(chunk_id: Column, strict: bool = True) -> Column:
    """struct<arxiv_id, page, ordinal>; malformed: an error, or null if not strict."""
    parts = F.struct(
        F.regexp_extract(chunk_id, CHUNK_ID, 1).alias("arxiv_id"),
        F.regexp_extract(chunk_id, CHUNK_ID, 2).try_cast("int").alias("page"),
        F.regexp_extract(chunk_id, CHUNK_ID, 3).try_cast("int").alias("ordinal"),
    )
    well = F.coalesce(chunk_id.rlike(CHUNK_ID), F.lit(False))
    otherwise = F.raise_error(F.concat(F.lit("malformed chunk id: "), F.coalesce(chunk_id, F.lit("NULL")))).cast("struct<arxiv_id:string,page:int,ordinal:int>") if strict else F.lit(None)
    return F.when(well, parts).otherwise(otherwise)


def join_key(chunk_id: Column, text: Column) -> Column:
    """A chunk's identity: its id, or else a hash of its text."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.concat(F.lit("text:"), sha8(text)))


def content_words(text: Column) -> Column:
    """Distinct words of over two letters or digits that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """A double with so many digits (four at most) after the point, as C and Python print it: its exact value is rounded,
    ties to even. format_string rounds its shortest decimal form, ties up, and so gives 0.63 for 0.625."""
    if not 0 < digits <= 4:
        raise ValueError("from one to four digits")
    size, unit = F.abs(x), 10**digits
    scaled = size * F.lit(float(1 << 26))  # exact, and so are both parts and their products with 2 * unit
    low = (scaled - F.floor(scaled).cast("double")) * F.lit(float(2 * unit))
    whole, rest = F.floor(scaled) * F.lit(2 * unit) + F.floor(low), low - F.floor(low).cast("double")  # of 2^-27 / unit
    down, over = F.shiftright(whole, 27), whole.bitwiseAND(F.lit((1 << 27) - 1))
    up = (over > 1 << 26) | ((over == 1 << 26) & ((rest > 0) | (down % 2 == 1)))
    n = down + up.cast("long")
    sign = F.when(x < 0, "-").otherwise("+" if signed else "")
    exact = F.concat(sign, F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))
    return F.when(size < 1e6, exact).otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f", x))


def chunk_quality(text: Column, least_chars: int = 700) -> Column:
    """struct<usable, reason>: a lexical screen; the first rule that matches gives the reason."""
    n = F.char_length(text)
    count = lambda p: F.regexp_count(text, F.lit(p))
    venues, years, arxiv, brackets, sentences = (count(p) for p in (VENUE, YEAR, ARXIV, BRACKET, SENTENCE))
    alpha = count(r"\p{L}") / F.greatest(n, F.lit(1))
    digits = count("[0-9]") / F.greatest(n, F.lit(1))
    say = lambda pattern, *cols: F.format_string(pattern, *cols)
    reason = (
        F.when(n < least_chars, say("too short (%d chars)", n))
        .when(venues >= 3, say("bibliography (%d venue phrases)", venues))
        .when((years >= 5) & (venues >= 1), say("bibliography (%d years, %d venue phrases)", years, venues))
        .when((arxiv >= 2) & (years >= 4), say("bibliography (%d arXiv ids, %d years)", arxiv, years))
        .when((brackets >= 4) & (venues >= 1), say("bibliography (%d bracketed refs)", brackets))
        .when(alpha < 0.68, say("table/numeric (alpha_ratio %s)", fixed(alpha, 2)))
        .when((digits > 0.07) & (sentences <= 3), say("table (digit_ratio %s, %d sentences)", fixed(digits, 2), sentences))
        .when(sentences <= 1, F.lit("no sentence structure"))
        .otherwise(F.lit("ok"))
    )
    return F.transform(F.array(reason), lambda r: F.struct((r == "ok").alias("usable"), r.alias("reason")))[0]


def is_specific(entity: Column, question: Column) -> Column:
    """The entity isn't empty and occurs in the question, in any case."""
    return F.coalesce((entity != "") & F.lower(question).contains(F.lower(entity)), F.lit(False))


def preview(text: Column, chars: int = 320) -> Column:
    """White space collapsed, cut to `chars` with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > chars, F.concat(F.substring(flat, 1, chars), F.lit("..."))).otherwise(flat)


def json_part(text: Column) -> Column:
    """From the first { to the last }; null if absent or not valid JSON."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def message_text(content: Column) -> Column:
    """Text of a message's content given as JSON: a string, or a list of strings and objects with `text`."""
    parts = F.from_json(content, "array<string>")
    of_part = lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p)
    return F.when(content.startswith("["), F.array_join(F.transform(parts, of_part), "")).when(content.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"]).otherwise(content)


def paper_id(url: Column) -> Column:
    """Last part of an entry's URL, without its version."""
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("v"), F.lit(1))


def is_daily_quota(message: Column) -> Column:
    m = F.lower(message)
    return m.contains("tokens per day") | m.contains("requests per day") | m.contains(" tpd")


def white_tokens(text: Column) -> Column:
    """Words between white space."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(flat == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(flat, " "))


def query_string(pairs: Column) -> Column:
    """URL query of an array of struct<name, value>."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
