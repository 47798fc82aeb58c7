"""Quality rules that look at lines first, in built-in expressions alone.

A line fails by its punctuation (too many signs or exclamation and question marks for its length),
as navigation (bars or bullets between words; or short and without an end of sentence) or as
boilerplate (a stock phrase in a line that is not long). Failing lines are removed. A document that
loses too much of its text with them is rejected, and so is one that fails the base rules on its
whole text: too few words, or too many of them in eight-word windows that it holds twice or more.

Words are runs of characters other than space and the characters 9 to 13. Defined cases: a null text
has no words, no lines and is rejected as too short; an empty line never fails; texts of any length
are read whole; equal rows are judged alike; an empty table gives no rows. Other columns of the
documents pass through, but for those of the names that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a character class.
SPACE = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]"
#: Signs that the base rules count.
SYMBOLS = r"[^#*$%&|<>]+"
#: Everything but signs and marks, but separators, and the end of a sentence.
NOT_SIGNS = r"[^#*$%&<>{}~^=_\\!?]+"
NOT_BARS = r"[^|»›•·→]+"
ENDS = r"[.!?:;,…\"”’'»)\]。！？]" + r"[ \t\x0B\f\r]*\z"
#: Stock phrases of web pages, in lower case.
PHRASES = (
    "all rights reserved|privacy policy|cookie policy|use of cookies|uses cookies|terms of use"
    "|terms of service|enable javascript|lorem ipsum|skip to content|back to top|click here"
    "|sign up for|log in to|share this|read more"
)
SIGN_SHARE, BAR_SHARE = 0.08, 0.04
MENU_CHARS, PHRASE_CHARS = 24, 200
LOST_SHARE = 0.5
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8


def _left(text: Column, pattern: str) -> Column:
    """How many characters stay when all matches are removed."""
    return F.length(F.regexp_replace(text, pattern, ""))


def bad_line(line: Column) -> Column:
    """Whether a line fails any rule."""
    size = F.length(line)
    punctuation = _left(line, NOT_SIGNS) > SIGN_SHARE * size
    bars = _left(line, NOT_BARS)
    navigation = ((bars >= 2) & (bars > BAR_SHARE * size)) | (
        (size <= MENU_CHARS) & ~line.rlike(ENDS)
    )
    boilerplate = (size <= PHRASE_CHARS) & F.lower(line).rlike(PHRASES)
    return line.rlike(WORD) & (punctuation | navigation | boilerplate)


def _paired(column: str, apart: int, combine) -> Column:
    """An array's elements, each with the one so many places later (null at the end)."""
    later = F.slice(F.col(column), F.lit(1 + apart), F.greatest(F.size(column), F.lit(1)))
    return F.zip_with(F.col(column), later, combine)


def with_repeats(frame: DataFrame, words: str, name: str) -> DataFrame:
    """Adds how many words lie in windows of eight words that the row's text holds twice or more.

    Windows are compared by 64-bit hashes, made of pairs of pairs of pairs. Only where some are
    equal are they sorted with their places; the places then give the words that they cover.
    """
    hashed = lambda x, y: F.xxhash64(x, y)
    whole = F.size("__h4") - 4
    step = (
        frame.withColumn("__h1", F.transform(words, lambda word: F.xxhash64(word)))
        .withColumn("__h2", _paired("__h1", 1, hashed))
        .withColumn("__h4", _paired("__h2", 2, hashed))
        .withColumn(
            "__h8",
            F.when(
                F.size(words) > REPEAT_WINDOW,
                F.slice(_paired("__h4", 4, hashed), F.lit(1), F.greatest(whole - 3, F.lit(0))),
            ),
        )
        .withColumn(
            "__sorted",
            F.when(
                F.size(F.array_distinct("__h8")) < F.size("__h8"),
                F.array_sort(
                    F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
                ),
            ),
        )
        .withColumn(
            "__same",
            _paired("__sorted", 1, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))),
        )
        .withColumn(
            "__marked",
            F.zip_with(
                "__same",
                F.slice(F.concat(F.array(F.lit(False)), F.col("__same")), F.lit(1), F.size("__same")),
                lambda x, y: x | y,
            ),
        )
        .withColumn(
            "__places",
            F.array_sort(
                F.filter(
                    F.zip_with(
                        "__sorted", "__marked", lambda x, marked: F.when(marked, x["i"])
                    ),
                    lambda place: place.isNotNull(),
                )
            ),
        )
        .withColumn(
            "__covered",
            _paired(
                "__places",
                1,
                lambda x, y: F.least(F.coalesce(y - x, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)),
            ),
        )
    )
    total = F.aggregate("__covered", F.lit(0).cast("long"), lambda s, x: s + x)
    made = ("h1", "h2", "h4", "h8", "sorted", "same", "marked", "places", "covered")
    return step.withColumn(name, F.coalesce(total, F.lit(0).cast("long"))).drop(
        *(f"__{n}" for n in made)
    )


ADDED = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_bad_lines",
    "lost_share",
    "clean_text",
    "base_failed",
    "kept",
)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their base figures, ``clean_text`` (without failing lines) and ``kept``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = F.trim(body, F.lit(" \t\n\x0b\x0c\r"))
    empty = F.array().cast("array<string>")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    frame = (
        docs.select(*rest)
        .withColumn("__bare", bare)
        .withColumn(
            "__words",
            F.when(F.col("__bare") == "", empty).otherwise(F.split("__bare", f"{SPACE}+")),
        )
        .withColumn("__lines", F.split(body, "\n"))
        .withColumn("__real", F.filter("__lines", lambda line: line.rlike(WORD)))
        .withColumn("__good", F.filter("__lines", lambda line: ~bad_line(line)))
        .withColumn("clean_text", F.array_join("__good", "\n"))
    )
    frame = with_repeats(frame, "__words", "n_repeat_words")
    lost = 1 - F.length("clean_text") / F.length(body)
    return (
        frame.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", _left(body, SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size("__real") - F.size(F.array_distinct("__real"))).cast("long"))
        .withColumn("n_bad_lines", (F.size("__lines") - F.size("__good")).cast("long"))
        .withColumn("lost_share", F.when(F.length(body) > 0, lost).otherwise(0.0))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= LOST_SHARE))
        # One generated row for each: a later filter on a figure then stays above, else it would be
        # pushed down and every figure in it be worked out again.
        .select(*rest, F.inline(F.array(F.struct(*ADDED))))
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; columns as they came."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    columns = (F.col("clean_text" if n == at else n).alias(n) for n in names)
    return judge(docs.toDF(*names), at).filter("kept").select(*columns).toDF(*docs.columns)
