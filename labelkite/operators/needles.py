"""Whether a reading of a picture stands in the text that was recognised on it, misread letters allowed."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.functions.text import squashed

#: Similarity that corroborates, most confidence with and without it, letters of a window at most and of a needle at least.
CORROBORATES, MOST, ALONE, WINDOW, LEAST = 0.82, 0.97, 0.62, 24, 3


def best_window(needle: str, text: str) -> float:
    """The greatest similarity of ``needle`` to a window of ``text``; windows as long as the needle, half a window apart.

    A window's shared letters bound its similarity, so only windows that could be better than the best so far are compared.
    """
    size = max(LEAST, min(len(needle), WINDOW))
    best, match = 0.0, SequenceMatcher(None, "", needle)  # the second sequence's letters are counted once
    for start in range(0, max(1, len(text) - size // 2), max(1, size // 2)):
        match.set_seq1(text[start : start + size])
        if match.real_quick_ratio() > best and match.quick_ratio() > best:
            # the similarity depends on which one comes first
            best = max(best, SequenceMatcher(None, needle, text[start : start + size]).ratio())
    return best


def corroborated(readings: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """``readings`` (keys, value, confidence) with ``similarity``, ``inferred`` and ``confidence`` as far as the text of their picture bears it out.

    ``texts``: keys and text, a row for each picture. What stands in the text as it is, and readings of fewer than three letters, are
    settled in the JVM; only the others go to Python, in batches.
    """
    t = texts.select(*keys, squashed(F.col("text")).alias("_text"))
    asked = readings.join(t, keys, "left").withColumn("_needle", squashed(F.col("value"))).withColumn("_text", F.coalesce("_text", F.lit("")))
    short = (F.length("_needle") < LEAST) | (F.col("_text") == "") | F.col("_needle").isNull()
    known = F.when(short, 0.0).when(F.col("_text").contains(F.col("_needle")), 1.0)

    @F.pandas_udf("double")
    def similar(needle, text):
        import pandas as pd

        return pd.Series([best_window(a, b) for a, b in zip(needle, text)])

    settled = asked.withColumn("similarity", known)
    rest = settled.filter("similarity is null").withColumn("similarity", similar("_needle", "_text"))
    out = settled.filter("similarity is not null").unionByName(rest)
    sure = F.col("similarity") >= CORROBORATES
    names = [c for c in readings.columns if c != "confidence"]
    return out.select(*names, F.when(sure, F.least(F.lit(MOST), "confidence")).otherwise(F.least(F.lit(ALONE), "confidence")).alias("confidence"), "similarity", (~sure).alias("inferred"))
