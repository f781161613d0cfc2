"""Line-first cleaning: rules decide line by line, then what is left decides the document.

A line with a word fails if it is noise (symbol runs or doubled exclamation marks beside most
words), navigation (separators beside most words), unpunctuated (``LONG_LINE`` words or more
and no sentence mark), or boilerplate (a short line that stock phrases, told by their word edges,
make up a fair part of). Failed lines are removed; a document that loses more than ``MAX_LOST`` of its word characters is rejected, as
is one that fails the base rules. All of it is built-in functions on one row: no shuffle, no
Python. Repeated eight-word windows are told by 64-bit hashes of their words' hashes.

Rows: a null text counts as empty, which has no word and fails the base rules. Ids may be null
or repeat, one row comes out per row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.grouping import compute_once
from .text import whole, word_list

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
MAX_LOST = 0.5
LONG_LINE = 20
SHORT_LINE = 200
SYMBOLS = r"[#*$%&|<>]"
NOISE = r"[#*$%&<>]+|!!+|\?\?+"
SEPARATORS = r"[|»›•·]"
BOILERPLATE_SHARE = 20  # per cent of the line's characters
# marks of many scripts; Thai and Lao write none, so their letters count as well
SENTENCE_MARK = r"[.!?…:;。！？：；؟؛۔।॥։።፧၊။។\x{0E00}-\x{0EFF}]"
HAS_WORD = r"[^\x20\x09-\x0D]"
# fixed values: phrases of lines that belong to a site, not to a text
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use",
    "terms of service", "use of cookies", "uses cookies", "click here", "read more",
    "sign up", "log in", "subscribe", "javascript", "lorem ipsum", "licensed under",
    "share this", "powered by",
)
STOCK = rf"(?i)(?<![a-z0-9_])(?:{'|'.join(PHRASES)})(?![a-z0-9_])"


def _line_verdict(line: Column) -> Column:
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" ")))
    words = spaces + 1
    stock = F.length(line) - F.length(F.regexp_replace(line, F.lit(STOCK), F.lit("")))
    boilerplate = (
        (F.length(line) <= SHORT_LINE)
        & line.rlike(STOCK)
        & (100 * stock >= BOILERPLATE_SHARE * F.length(line))
    )
    noise = 2 * F.regexp_count(line, F.lit(NOISE)) > words
    navigation = (F.regexp_count(line, F.lit(SEPARATORS)) >= 3) & (
        4 * F.regexp_count(line, F.lit(SEPARATORS)) > words
    )
    unpunctuated = (words >= LONG_LINE) & ~line.rlike(SENTENCE_MARK)
    return noise | navigation | unpunctuated | boilerplate


def _word_chars(line: Column) -> Column:
    return F.length(F.array_join(word_list(line), ""))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, both verdicts, what was lost, the clean text."""
    read = compute_once(
        docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("content")),
        "doc_id", "content",
        words=word_list("content"),
        lines=F.filter(F.split("content", "\n"), lambda line: line.rlike(HAS_WORD)),
    )
    judged = compute_once(
        read, "doc_id", "words",
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_symbols=F.regexp_count(F.col("content"), F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_lines=F.size("lines").cast("long"),
        clean=F.filter("lines", lambda line: ~_line_verdict(line)),
    )
    lines_done = compute_once(
        judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        n_clean_lines=F.size("clean").cast("long"),
        clean_text=F.array_join("clean", "\n"),
        hashes=F.transform("words", lambda word: F.xxhash64(word)),
    )
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
              "n_clean_lines", "clean_text"]
    windows = compute_once(
        lines_done, *counts,
        windows=F.when(
            F.col("n_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
                lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]),
            ),
        ),
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    in_order = compute_once(
        windows, *counts,
        in_order=F.when(
            repeated,
            F.array_sort(F.transform(
                "windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))
            )),
        ),
    )
    places = compute_once(
        in_order, *counts,
        places=F.array_sort(F.transform(
            F.filter("in_order", lambda x, i: (
                x["h"].eqNullSafe(F.get("in_order", i - 1)["h"])
                | x["h"].eqNullSafe(F.get("in_order", i + 1)["h"])
            )),
            lambda x: x["at"],
        )),
    )
    # a marked window covers its words up to the next marked one
    covered = F.aggregate(
        F.transform("places", lambda at, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - at, F.lit(WINDOW))
        )),
        F.lit(0), lambda total, n: total + n,
    )
    done = compute_once(
        places, *counts,
        n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"),
        clean_chars=_word_chars(F.col("clean_text")).cast("long"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    lost_too_much = F.col("word_chars") - F.col("clean_chars") > MAX_LOST * F.col("word_chars")
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_clean_lines", "clean_chars",
        base_failed.alias("base_failed"),
        (~base_failed & ~lost_too_much).alias("kept"),
        "clean_text",
    )
