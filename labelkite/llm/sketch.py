"""Bottom-k sketches of word shingles, all in DataFrame functions.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's five-word shingles. Two sketches
merge into that of both texts together (smallest ``k`` of the union), and estimate resemblance, containment and the
number of distinct shingles; below ``k`` shingles all these are exact.

Defined results: null text is the empty text, whose sketch is empty; two empty sketches resemble each other fully (1.0),
an empty and another one not at all (0.0). A text of fewer words than a shingle is one shingle. Ties of ``doc_id`` are
ordered by text, and a null ``doc_id`` comes last; an empty table gives an empty result. Ids are whole numbers.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkite.llm.common import fresh, let, words

K = 128
WIDTH = 5
#: Documents of a range of ids, about.
RANGE_ROWS = 50_000


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Array of the 64-bit hashes of all shingles of ``width`` words, with repeats."""

    def rolled(w: Column) -> Column:
        n = F.size(w)
        all_of_it = F.array(F.xxhash64(F.array_join(w, " ")))
        over = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(width)]))
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < width, all_of_it)
            .otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), over))
        )

    return let(words(text), rolled)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return bottom(shingle_hashes(text, width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts, or two parts of one, taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(sketches: Column, k: int = K) -> Column:
    """Aggregate: the sketch of all texts of a group, from theirs. No array holds more than a task's distinct hashes of the group's
    sketches; ``merged_by`` is for groups of very many texts."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set(sketches)))), 1, k)


def merged_by(rows: DataFrame, keys: list[str], sketches: str = "sketch", k: int = K, fan: int = 256) -> DataFrame:
    """``keys sketch``: the sketch of all texts of each group, merged in two steps (``fan`` parts of a group, then these)."""
    (part_of,) = fresh([*keys, sketches], "part")
    part = rows.select(*keys, sketches, F.pmod(F.xxhash64(sketches), F.lit(fan)).alias(part_of))
    half = part.groupBy(*keys, part_of).agg(merged(F.col(sketches), k).alias(sketches))
    return half.groupBy(*keys).agg(merged(F.col(sketches), k).alias(sketches))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity of the two sets of shingles."""
    shared = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below ``k``, else from where the k-th hash lies."""
    place = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of the first text's shingles that the second has."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, key: str, text: str, buckets: int):
    """Rows (range, copied, key, text) of ``docs`` and the window order in which ``lead`` gives the next row by descending key, and
    the first one's values after the last row.

    Rows go to ranges of keys between approximate quantiles, which are keys that occur, so the first row of each range is
    known beforehand and is also sent to the range above, whose last row needs it. Quantiles are taken in two levels, each
    of the square root of ``buckets``, so that no sketch of them grows with the table. One shuffle of the text, no range is
    read by the driver, and no task holds more than a range.
    """
    spark, level = docs.sparkSession, max(1, math.ceil(buckets**0.5))
    cuts = [i / level for i in range(1, level + 1)]
    upper = sorted(set(docs.agg(F.percentile_approx(key, cuts, 100 * level)).first()[0] or []))
    # how many of the array's values lie below the key
    below = lambda marks: F.coalesce(F.aggregate(marks, F.lit(0), lambda n, b: n + F.when(b < F.col(key), 1).otherwise(0)), F.lit(0))
    kind = dict(docs.dtypes)[key]
    part = below(F.array(*[F.lit(m) for m in upper]).cast(f"array<{kind}>") if upper else F.array().cast(f"array<{kind}>"))
    within = docs.filter(F.col(key).isNotNull()).groupBy(part.alias("part")).agg(F.percentile_approx(key, cuts, 100 * level).alias("marks"))
    lower = {r.part: sorted(set(r.marks)) for r in within.collect()}  # `buckets` numbers in all
    marks = [m for p in sorted(lower) for m in lower[p]]
    firsts = dict(zip(sorted(lower), accumulate([len(lower[p]) for p in sorted(lower)], initial=0)))
    # at most one row for each range, one for each part
    heads = spark.createDataFrame([(m, (i + 1) % len(marks)) for i, m in enumerate(marks)], f"mark {kind}, up int")
    parts = spark.createDataFrame([(p, firsts[p], m) for p, m in lower.items()], f"p int, first int, marks array<{kind}>")
    placed = docs.withColumn("part", part).join(F.broadcast(parts), F.col("part") == F.col("p"), "left").join(F.broadcast(heads), F.col(key) == F.col("mark"), "left")
    # null keys follow the smallest key, in the lowest range
    own = F.when(F.col(key).isNull(), 0).otherwise(F.col("first") + below(F.col("marks")))
    to = lambda at, copied: F.struct(at.cast("int").alias("range"), F.lit(copied).alias("copied"))
    sent = placed.select(key, text, F.explode(F.when(F.col("up").isNull(), F.array(to(own, 0))).otherwise(F.array(to(own, 0), to(F.col("up"), 1)))).alias("to")).select("to.*", key, text)
    if not marks:  # only null keys: the first row is that of the smallest text
        sent = sent.unionByName(docs.orderBy(text).limit(1).select(F.lit(0).alias("range"), F.lit(1).alias("copied"), key, text))
    order = Window.partitionBy("range").orderBy("copied", F.col(key).desc_nulls_last(), text)
    return sent, order


def op4_sketches(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent, order = with_next(docs, "doc_id", "text", max(4 * parts, docs.count() // RANGE_ROWS))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    out = (
        sent.withColumn("next_text", F.lead("text").over(order))
        .select("range", "copied", "doc_id", "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
        .select("range", "copied", "doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("changed"))
        .withColumn("after", F.lead("own").over(order))
        .filter("copied = 0")
    )
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("after")).alias("near_next"),
        containment(F.col("own"), F.col("changed")).alias("edited_containment"),
        distinct_count(F.col("own")).alias("distinct_shingles"),
    )
