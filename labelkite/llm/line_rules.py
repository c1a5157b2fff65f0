"""Line-first quality rules, all in DataFrame functions.

Each line is judged first, and fails for the first of these reasons that holds:

- ``menu``: one of ``RUN`` or more neighbouring lines (blank ones don't count) of at most ``MENU_WORDS`` words, all of them
  open, that is without a mark at the end that ends a sentence or a clause;
- ``fragment``: open and of at most ``FRAGMENT_WORDS`` words;
- ``symbols``: a symbol for fewer than four words, a run of exclamation marks for fewer than five, or three bars and dots as
  between links;
- ``capitals``: more than half of at least 20 letters;
- ``boilerplate``: phrases of page furniture make up a tenth of its characters or more.

Lines that fail are taken out, and a document that loses more than ``max_lost`` of its words is rejected.
Two rules judge the document as a whole: too few words, and too many words in repeated three-word windows.

Defined results: a null text counts as the empty text, has no words and fails. Rows are judged one by one, so repeated
rows give repeated results and an empty table an empty one. Blank lines pass. Other columns pass through ``clean``, whatever
their names; ``judge`` names its own columns, replacing any input columns of these names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.llm.common import SPACE, computed, fresh, let, words

#: Phrases that mark a line as page furniture.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "follow us on",
    "lorem ipsum", "privacy policy", "read more", "sign in to", "skip to content", "subscribe to our", "terms of service",
    "terms of use", "use of cookies",
)
SYMBOLS = r"[#*$%&|<>]"

#: Lines of a menu, and words of each; words of a fragment; characters of a line for one of boilerplate phrases.
RUN = 5
MENU_WORDS = 8
FRAGMENT_WORDS = 3
PHRASE_SHARE = 10
#: How an open line ends: with a letter, a digit, a comma or an ellipsis.
OPEN_END = r"(?:[\p{L}\p{Nd},]|…|\.\.\.)[\x20\x09-\x0D]*\z"
BLANK = r"\A[\x20\x09-\x0D]*\z"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST = 0.3


def _count(text: Column, kept: str) -> Column:
    """Characters of ``text`` outside of the class ``kept`` (a regular expression for what is taken out)."""
    return F.length(F.regexp_replace(text, kept, ""))


def repeated_window_words(found: Column, width: int = 3) -> Column:
    """How many words of the array stand in a window of ``width`` words that occurs at least twice in it.

    Windows are compared by 64-bit hashes of hashes of their words, and sorted together with their places, so the cost is
    n log n however often a window repeats.
    """

    def covered(windows: Column) -> Column:
        def places(s: Column) -> Column:
            twin = lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)

        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(
            let(let(F.sort_array(pairs), places), length)
        )

    def windowed(h: Column) -> Column:
        last = F.size(h) - width
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(width)]))
        return F.when(last < 0, F.lit(0).cast("bigint")).otherwise(let(hashes, covered))

    return let(F.transform(found, lambda w: F.xxhash64(w)), windowed)


def marks(lines: Column) -> Column:
    """Of each line ``b`` blank, ``x`` in a menu (so may be blank ones within), ``f`` a fragment, ``-`` or ``m`` none of these."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    short = lambda n: rf"\A{space}*+(?:{word}++{space}++){{0,{n - 1}}}{word}*{OPEN_END}"
    kinds = F.transform(
        lines,
        # most lines end with a full stop, which is cheap to see
        lambda x: F.when((x.endswith(".") & ~x.endswith("...")), "-").when(x.rlike(BLANK), "b").when(~x.rlike(short(MENU_WORDS)), "-").when(x.rlike(short(FRAGMENT_WORDS)), "f").otherwise("m"),
    )
    # a line that begins a long enough run, and those that follow it at once
    runs = rf"(?:\G(?!^)|(?=(?:[mf]b*){{{RUN - 1}}}[mf]))[mfb]"
    return F.split(F.regexp_replace(F.array_join(kinds, ""), runs, "x"), "")


def line_reason(line: Column) -> Column:
    """Why a line isn't running text for itself: page furniture, shouted, or many symbols for its words; null if it is.

    Counts are made only for lines that have a symbol, a double mark or a run of capitals at all.
    """

    def marks_are_few(n_words: Column) -> Column:
        symbols = _count(line, r"[^#*$%&|<>]+")
        shouts = _count(F.regexp_replace(line, r"!{2,}", "\x01"), r"[^\x01]+")
        return (symbols * 4 <= n_words) & (shouts * 5 <= n_words) & (_count(line, r"[^|»›·•]+") < 3)

    letters, capitals = _count(line, r"[^A-Za-z]+"), _count(line, r"[^A-Z]+")
    phrases = "|".join(BOILERPLATE)
    # looking for each phrase is much cheaper than for all of them by one expression
    named = lambda low: functools.reduce(Column.__or__, [low.contains(p) for p in BOILERPLATE])
    filled = lambda low: named(low) & ((F.length(low) - F.length(F.regexp_replace(low, phrases, ""))) * PHRASE_SHARE >= F.length(low))
    return (
        F.when(line.rlike(r"[#*$%&|<>»›·•]|!!") & ~let(F.size(words(line)), marks_are_few), "symbols")
        .when(line.rlike("[A-Z]{3}") & (letters >= 20) & (capitals * 2 > letters), "capitals")
        .when(let(F.lower(line), filled), "boilerplate")
    )


def line_reasons(text: Column) -> Column:
    """For each line of ``text`` why it fails, null where it passes."""

    def judged(lines: Column) -> Column:
        reason = lambda x, m: F.when((m == "b") | x.rlike(BLANK), None).when(m == "x", "menu").when(m == "f", "fragment").otherwise(line_reason(x))
        return let(marks(lines), lambda m: F.transform(lines, lambda x, i: reason(x, F.get(m, i))))

    return let(F.split(text, "\n"), judged)


def good_lines(text: Column) -> Column:
    """The lines of ``text`` that pass, in order; blank lines pass."""

    def kept(lines: Column) -> Column:
        passes = lambda x, m: x.rlike(BLANK) | (~m.isin("x", "f") & line_reason(x).isNull())
        return let(marks(lines), lambda m: F.filter(lines, lambda x, i: passes(x, F.get(m, i))))

    return let(F.split(text, "\n"), kept)


def judge(docs: DataFrame, text: str = "text", *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_lost: float = MAX_LOST, once: bool = False) -> DataFrame:
    """``docs`` with ``n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed good_text lost kept``.

    ``good_text`` has the lines that pass, ``lost`` is the share of words in the others. ``once``: for when a filter on
    these follows, which would otherwise have them worked out again.
    """
    add = computed if once else DataFrame.withColumn
    (m,) = fresh(docs.columns, "_m")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measures = let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )
    out = (
        add(docs, m, measures)
        .withColumn("n_words", F.col(m)["n_words"])
        .withColumn("word_chars", _count(t, SPACE).cast("bigint"))
        .withColumn("n_symbols", _count(t, r"[^#*$%&|<>]+").cast("bigint"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
        .withColumn("n_repeat_words", F.col(m)["n_repeat_words"])
        .drop(m)
    )
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    # lines are judged only where the base has passed
    out = add(out, "good_text", F.when(~F.col("base_failed"), F.array_join(good_lines(t), "\n")))
    out = out.withColumn("lost", F.when(~F.col("base_failed"), 1 - F.size(words(F.col("good_text"))) / F.greatest("n_words", F.lit(1))))
    return out.withColumn("kept", F.coalesce(~F.col("base_failed") & (F.col("lost") <= max_lost), F.lit(False)))


def clean(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that pass, with the columns of ``docs`` unchanged but for ``text``, which has only its good lines."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_text", once=True, **limits).filter("kept")
    return judged.select(*[(F.col("good_text") if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op8_line_rules(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
