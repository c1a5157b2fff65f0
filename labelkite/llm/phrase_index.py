"""Benchmark decontamination by a positional inverted index, all in DataFrame functions.

The windows (phrases) of the benchmark are looked up in postings of the documents' words. The words of all documents that
the benchmark has are counted; each window is then looked up by its two rarest words. Only such words get postings: a row
(document, word, position), for a window's rarest word with the words around it. Postings of the two words that lie as far
apart as in the window, or anywhere within reach, are intersected; what the intersection leaves is compared in full with
the words around: the same words in the same order are an exact match, all of the window's words within reach of the
rarest one a proximity match.

One scan counts, one writes the postings, document by document, from which they are dealt out by document and word. A
bitmap of fixed size, which both scans hold, drops most other words early; what passes by chance goes at the joins. The
benchmark's own tables are broadcast only where they have at most ``SMALL`` rows. No word's postings meet in one task
unless a document does: intersections are dealt by document, word and stretch of positions.

Defined results: words are those of ``SPLIT`` after lower-casing A-Z. Null text has no words. An item of fewer words than
a window is one window of its own; items without words give none, items with equal windows share them, repeated rows of an
item count once, a null item id is left out. Documents are told apart by their place, so ids may repeat or be null; empty
tables on either side give no hits. Columns besides those named aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.llm.common import computed, let, scratch_path, written

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window; words that may stand between a window's in a proximity match.
WINDOW = 10
SLOP = 5
#: Rows up to which a table of the benchmark is broadcast, and bits of the bitmaps.
SMALL = 100_000
BITS = 1 << 20


def terms(text: Column) -> Column:
    """Array of the words of ``text``."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


def small(df: DataFrame) -> DataFrame:
    """A written table of the benchmark, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def windows(items: DataFrame, item: str, text: str, width: int = WINDOW) -> DataFrame:
    """``item_id words``: the windows of each item."""
    n = F.size("words")
    some = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item_id"), terms(F.col(text)).alias("words")).filter(n > 0)
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    return some.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, width))).alias("words")).distinct()


def bitmap(of: DataFrame, column: str) -> Column:
    """An array of ``BITS`` bits with those of the words of ``column`` set; at most ``BITS`` / 64 numbers come to the driver."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS))
    found = of.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    numbers = ["0"] * (BITS >> 6)
    for r in found.collect():
        numbers[r["at"]] = str(r["bits"])
    return F.split(F.lit(",".join(numbers)), ",").cast("array<bigint>")


def maybe(bits: Column, word: Column) -> Column:
    """Whether the bitmap has the bit of ``word``."""
    return let(F.pmod(F.xxhash64(word), F.lit(BITS)), lambda h: F.getbit(F.get(bits, F.shiftright(h, 6).cast("int")), h.bitwiseAND(63).cast("int")) == 1)


class Index:
    """Postings of ``docs`` for the windows of ``items``, and what they match."""

    def __init__(self, docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = SLOP):
        self.width, self.reach = width, width - 1 + slop
        self.items = written(windows(items, item, item_text, width), "windows")
        self.of_window = written(self.items.groupBy("words").agg(F.min("item_id").alias("least")).drop("least").withColumn("window", F.monotonically_increasing_id()), "phrases")
        self.rarest = written(self._rarest(docs, text), "rarest")
        self.documents = self._documents(docs, text)

    def _rarest(self, docs: DataFrame, text: str) -> DataFrame:
        """``window words first place second apart``: the two rarest words of each window that can occur at all.

        ``place`` is the first word's offset in the window, ``apart`` how far behind it the second one stands; a window of one word
        has no second. Ties go by word, then by offset.
        """
        spread = self.of_window.select("window", "words", F.posexplode("words").alias("place", "word"))
        vocabulary = written(spread.select("word").distinct(), "vocabulary")
        bits = bitmap(vocabulary, "word")
        held = docs.select(F.explode(F.filter(terms(F.col(text)), lambda w: maybe(bits, w))).alias("word"))
        counts = written(held.join(small(vocabulary), "word", "left_semi").groupBy("word").count(), "word-counts")
        known = spread.join(small(counts), "word").groupBy("window", "words").agg(F.sort_array(F.collect_list(F.struct("count", "word", "place"))).alias("by"))
        first, second = F.get("by", 0), F.get("by", 1)
        return known.filter(F.size("by") == F.size("words")).select(
            "window", "words", first.word.alias("first"), first.place.alias("place"), second.word.alias("second"), (second.place - first.place).alias("apart")
        )

    def _documents(self, docs: DataFrame, text: str) -> DataFrame:
        """A written table with a row for each document: its number, ``docs``' columns but the text, the number of words, its postings."""
        firsts = bitmap(self.rarest.select("first").distinct(), "first")
        both = bitmap(self.rarest.select(F.col("first").alias("word")).union(self.rarest.select("second")).filter("word is not null").distinct(), "word")
        reach, n = self.reach, F.size("w")
        around = lambda w, i: F.when(maybe(firsts, w), F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1))
        hits = F.filter(F.transform("w", lambda w, i: F.when(maybe(both, w), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
        worded = computed(docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), terms(F.col(text)).alias("w")), "w", F.col("w"))
        postings = F.transform(hits, lambda x: F.struct(x.word.alias("word"), x.at.alias("at"), around(x.word, x.at).alias("around")))
        return written(worded.select(F.monotonically_increasing_id().alias("doc"), "row", n.cast("bigint").alias("n_words"), postings.alias("postings")), "postings")

    def postings(self) -> DataFrame:
        """``doc word at around``: where the windows' rarest words stand."""
        return self.documents.select("doc", F.inline("postings"))

    def matches(self) -> DataFrame:
        """A written table ``doc window at size exact``: where windows stand (``exact``) or have all their words within reach of the
        rarest one's place ``at``."""
        rarest, reach = small(self.rarest), self.reach
        postings = self.postings()
        # offset-adjusted: where the second word should stand, and within reach of the first
        first = postings.filter("around is not null").join(rarest.select("window", "first", "second", "apart"), F.col("word") == F.col("first")).select("doc", "window", "at", "second", "apart")
        stretch = lambda p: F.floor(p / (reach + 1)).cast("int")
        asked = first.filter("second is not null").withColumn("stretch", F.explode(F.sequence(stretch(F.col("at") - reach), stretch(F.col("at") + reach))))
        lists = postings.select("doc", F.col("word").alias("second"), F.col("at").alias("there"), stretch(F.col("at")).alias("stretch"))
        near = asked.join(lists, ["doc", "second", "stretch"]).filter(F.abs(F.col("there") - F.col("at")) <= reach)
        met = near.groupBy("doc", "window", "at").agg(F.max(F.col("there") - F.col("at") == F.col("apart")).alias("aligned"))
        met = met.unionByName(first.filter("second is null").select("doc", "window", "at", F.lit(True).alias("aligned")))
        # an exact check of what is left
        full = met.join(postings.filter("around is not null").select("doc", "at", "around"), ["doc", "at"]).join(rarest.select("window", "words", "place"), "window")
        here = F.least("at", F.lit(reach)) - F.col("place")  # the window's beginning among the words around
        exact = F.col("aligned") & (here >= 0) & (F.slice("around", F.greatest(here, F.lit(0)) + 1, F.size("words")) == F.col("words"))
        judged = full.select("doc", "window", (F.col("at") - F.col("place")).alias("start"), F.col("at"), F.size("words").alias("size"), exact.alias("exact"), (F.size(F.array_except("words", "around")) == 0).alias("near"))
        return written(judged.filter("near").drop("near"), "matches")

    def verdicts(self) -> DataFrame:
        """The rows of ``docs`` without their text, with ``n_words n_hit n_items items_sha256 contaminated n_near``."""
        matches = self.matches()
        exact = matches.filter("exact")
        # starts in order: each adds what the ones before don't cover
        add = lambda s, x: F.struct((s.n + F.greatest(x.start + x.size - F.greatest(s.end, x.start), F.lit(0))).alias("n"), F.greatest(s.end, x.start + x.size).alias("end"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        hit = exact.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("all")).select("doc", F.aggregate("all", zero, add).n.cast("bigint").alias("n_hit"))
        item_windows = small(written(self.items.join(self.of_window, "words").select("window", "item_id"), "items"))
        found = exact.select("doc", "window").distinct().join(item_windows, "window").select("doc", "item_id").distinct()
        items = found.groupBy("doc").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ",").cast("binary"), 256).alias("items_sha256"))
        near = matches.groupBy("doc").agg(F.count_distinct("window").alias("n_near"))
        none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
        rows = self.documents.select("doc", "row", "n_words").join(near.join(hit, "doc", "left").join(items, "doc", "left"), "doc", "left")
        names = self.documents.schema["row"].dataType.names
        empty = F.sha2(F.lit("").cast("binary"), 256)
        return rows.select(
            *[F.col("row")[c].alias(c) for c in names], "n_words", none("n_hit"), none("n_items"), F.coalesce("items_sha256", empty).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), none("n_near")
        )


def op11_phrase_index(spark, sf_dir: str) -> DataFrame:
    """For each document the words that stand in windows of the benchmark, the items concerned, and windows met in proximity."""
    from labelkite.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Index(docs, table(spark, sf_dir, "benchmark")).verdicts()
