"""Quality rules, line first: every line is judged by punctuation, navigation and
boilerplate rules, failing lines are removed, and a document that loses too much of
its text is rejected. DataFrame functions only; one scan, no shuffle.

Defined cases: a null text counts as empty; an empty text has no words and fails the
base rule; repeated rows are judged each for itself; other columns of the input pass
through inside ``doc`` so that no name can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import WHITE, text_or_empty

#: fixed values: the base rule of the contract
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
BASE_SYMBOLS = "#*$%&|<>"
#: fixed values: characters that separate entries of a navigation line
NAV_MARKS = "|»›•·"
#: fixed values: phrases that mark a boilerplate line (compared in lower case)
BOILERPLATE = [
    "licensed under", "released under", "all rights reserved", "copyright (c)", "©",
    "terms of service", "terms of use", "privacy policy", "cookie policy", "uses cookies",
    "click here", "sign up", "log in", "subscribe to our", "powered by", "javascript is disabled",
]
#: a boilerplate phrase fails a line of at most so many words, or one whose word characters it covers to more than half
SHORT_LINE = 16
#: a document is rejected when more than this share (percent) of its word characters is on failing lines
MAX_LOST_PERCENT = 40
#: a line fails as noise with at least so many marks, and more than so many marks in a hundred characters
MIN_MARKS, MAX_MARK_PERCENT = 3, 10


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, WHITE, ""))


def split_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " ", -1), "")


def _phrase(text: str) -> str:
    """Pattern of a phrase that no letter, digit or underscore continues on either side."""
    before, after = (r"(?<![\p{L}\p{N}_])" * text[0].isalnum(), r"(?![\p{L}\p{N}_])" * text[-1].isalnum())
    return before + re.sub(r"([^\w\s])", r"\\\1", text) + after


def _boilerplate(line: Column) -> Column:
    low = F.lower(line)
    hit = F.lit(False)
    for phrase in BOILERPLATE:  # a plain search first: few lines need the patterns
        hit = hit | F.contains(low, F.lit(phrase))
    rest = F.regexp_replace(low, "|".join(map(_phrase, BOILERPLATE)), "")
    size = _word_chars(low)
    covered = size - _word_chars(rest)
    return hit & (covered > 0) & ((F.size(split_words(line)) <= SHORT_LINE) | (covered * 2 > size))


def line_fails(line: Column) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rules remove."""
    marks = _count(line, BASE_SYMBOLS + "!?=_~^")
    size = _word_chars(line)
    noise = (marks >= MIN_MARKS) & (marks * 100 > size * MAX_MARK_PERCENT)
    bare = (size > 0) & ~line.rlike(r"[\p{L}\p{N}]")
    separators = _count(line, NAV_MARKS)
    navigation = (separators >= 3) & (separators * 4 >= F.size(split_words(line)))
    return noise | bare | navigation | _boilerplate(line)


def _next(array: str, by: int) -> Column:
    a = F.col(array)
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (all input columns) and ``quality`` (metrics, clean text, verdict) for every row.

    Repeated 8-word windows are found by hashing windows pairwise (1, 2, 4, 8 words),
    and only documents where a hash recurs sort their windows to locate the cover.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                     text_or_empty(text).alias("t"))
    df = df.select("doc", "t", split_words(F.col("t")).alias("w"), F.split("t", "\n", -1).alias("lines"))
    df = df.select("doc", "t", "lines", F.size("w").alias("n"),
                   F.transform("w", lambda x: F.xxhash64(x)).alias("h1"))
    for size, name in ((1, "h2"), (2, "h4"), (4, "h8")):
        before = f"h{size}"
        df = df.select("doc", "t", "lines", "n", F.zip_with(before, _next(before, size), lambda a, b: F.xxhash64(a, b)).alias(name))
    df = df.select("doc", "t", "lines", "n", F.slice("h8", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))).alias("h"))
    again = F.size(F.array_distinct("h")) < F.size("h")
    df = df.select("doc", "t", "lines", "n", F.when(again, F.array_sort(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda x, i: (
        F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.select("doc", "t", "lines", "n", F.array_sort(F.transform(F.filter("s", same), lambda x: x["i"])).alias("p"))
    covered = F.aggregate(
        F.zip_with("p", _next("p", 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    df = df.select("doc", "t", "lines", F.col("n").cast("long").alias("n_words"),
                   F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    df = df.select("doc", "t", "n_words", "n_repeat_words",
                   F.filter("lines", lambda x: F.translate(x, WHITE, "") != "").alias("full"),
                   F.filter("lines", lambda x: ~line_fails(x)).alias("good"))
    df = df.select("doc", "n_words", "n_repeat_words", _word_chars(F.col("t")).cast("long").alias("word_chars"),
                   _count(F.col("t"), BASE_SYMBOLS).cast("long").alias("n_symbols"),
                   (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
                   F.array_join("good", "\n").alias("clean_text"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = _word_chars(F.col("clean_text")).cast("long")
    lost = (F.col("word_chars") - left) * 100 > F.col("word_chars") * MAX_LOST_PERCENT
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                     left.alias("clean_chars"), "clean_text", (~base_failed & ~lost).alias("kept"))
    # a generated column: a filter on it must not be pushed down, where each step above would be
    # written out once for every use of it
    return df.select("doc", F.explode(F.array(found)).alias("quality"))
