"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: each byte shifts the hash left and adds a number of its own, so the hash at a
place depends on the 16 bytes before it and on nothing else. Ends of words are the places where a chunk may end, and one
ends where the hash is the smallest among the ``REACH`` ends of words on either side (or ``MOST`` words after the last
end). Text that is put in moves chunks but changes only those around it.

Chunks are deduplicated by digest: of equal chunks the first one, by document and place, stays. A repeat goes only as part
of a run of neighbouring repeats with at least ``MIN_WORDS`` words, so that phrases which are merely common stay. The
first and last words of a repeated passage lie in chunks that it shares with its surroundings, which is why the bound is
lower than the passages sought (50 words and more).

Only digests and places are shuffled to find repeats, summed up before the shuffle. The digests found are written before they
are joined with all chunks: so Spark broadcasts them where they are few, and else splits the partition of a digest that many
documents share. The text is shuffled once.

Defined results: null text stays null and has no chunks. A null id comes before all others; rows of equal id and text are
kept or cut alike. Texts that lose all their words become empty; texts that lose some also lose ASCII white space at both
ends. An empty table gives an empty result; other columns pass through, whatever their names, but for ``words_cut``, which
is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.common import bounded, fresh, only, written

REACH = 3
MOST = 32
MIN_WORDS = 24
WINDOW = 16
#: Bytes of text hashed at once.
BLOCK = 1 << 21

_gear = None


def gear():
    """A fixed 16-bit number for each byte; 0 for the zero bytes that stand between texts."""
    global _gear
    if _gear is None:
        import numpy as np

        _gear = np.random.default_rng(20240101).integers(1, 1 << 16, 256, dtype="u2")
        _gear[0] = 0
    return _gear


def chunk_ends(texts: list[bytes], reach: int = REACH):
    """For each text the (begin, end, words) of its chunks, as three arrays over all texts, and the number of chunks of each.

    A chunk begins with its first word and ends with its last, so white space between chunks belongs to none.
    """
    import numpy as np

    pad = b"\0" * WINDOW
    data = np.frombuffer(pad + pad.join(texts) + pad, "u1")
    sizes = np.array([len(t) for t in texts], "i8")
    starts = WINDOW + np.cumsum(sizes + WINDOW) - sizes - WINDOW
    h, shift = gear()[data], 1
    while shift < WINDOW:  # sums over 2, 4, 8, 16 bytes
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint16(shift)
        h, shift = more, 2 * shift
    space = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0)
    last = np.flatnonzero(~space[:-1] & space[1:])  # last bytes of words
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    owner = np.searchsorted(starts, last, "right") - 1
    value = h[last]
    n = len(last)
    cut = np.ones(n, bool)
    for k in range(1, reach + 1):
        if n > k:
            same = owner[k:] == owner[:-k]
            cut[k:] &= ~same | (value[k:] < value[:-k])
            cut[:-k] &= ~same | (value[:-k] <= value[k:])
    if n:
        cut[-1] = True
        cut[:-1] |= owner[1:] != owner[:-1]
    # a stretch without any smallest place (one word over and over) is cut at every MOST words
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.where(np.r_[True, cut[:-1]][:n], place, 0))
    cut |= since % MOST == MOST - 1
    end_word = np.flatnonzero(cut)
    begin_word = np.r_[0, end_word[:-1] + 1][: len(end_word)]
    own = owner[end_word]
    return first[begin_word] - starts[own], last[end_word] + 1 - starts[own], end_word - begin_word + 1, np.bincount(own, minlength=len(texts))


def blocks(texts: list[bytes]):
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def clean_bytes(text: str | None) -> bytes:
    """UTF-8, with a blank in place of the zero character."""
    return (text or "").encode().replace(b"\0", b" ")


def chunks(docs: DataFrame, key: str, text: str, reach: int = REACH) -> DataFrame:
    """(digest, key, place) of every chunk; a place is a hash of the text (high half) and the number of the chunk."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        only("chunks")
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for b in batches:
            keys, all_texts, marks = b.column(0), [clean_bytes(t) for t in b.column(1).to_pylist()], b.column(2).to_numpy(zero_copy_only=False).astype("i8")
            for lo, hi in blocks(all_texts):
                texts = all_texts[lo:hi]
                begin, end, _, counts = chunk_ends(texts, reach)
                row = np.repeat(np.arange(len(texts)), counts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                digest = np.array([xxh3_64_intdigest(texts[r][s:e]) for r, s, e in zip(row.tolist(), begin.tolist(), end.tolist())], "u8").view("i8")
                place = marks[lo + row] << 32 | number
                yield pa.RecordBatch.from_arrays([pa.array(digest), keys.take(pa.array(lo + row)), pa.array(place)], names=["digest", "key", "place"])

    return bounded(docs.select(key, text, F.hash(text).alias("mark"))).mapInArrow(run, f"digest bigint, key {kind}, place bigint")


def repeats(found: DataFrame) -> DataFrame:
    """(key, mark, numbers): the chunks of each text whose digest has stood before; ``found`` is a stored table."""
    order = lambda k, p: F.struct(F.col(k).isNotNull().alias("x"), F.col(k).alias("k"), F.col(p).alias("p"))
    several = found.groupBy(F.col("digest").alias("d")).agg(F.min(order("key", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # a join with the aggregate itself would leave all rows of a digest to one task
    several = written(several.select("d", "first"), "several")
    again = found.join(several, F.col("digest") == F.col("d")).filter(order("key", "place") > F.col("first"))
    return again.groupBy("key", F.shiftright("place", 32).cast("int").alias("mark")).agg(F.collect_set(F.col("place").bitwiseAND((1 << 32) - 1).cast("int")).alias("numbers"))


def cut_runs(text: str, numbers, reach: int = REACH, min_words: int = MIN_WORDS) -> tuple[str, int]:
    """``text`` without its runs of at least ``min_words`` words in the chunks ``numbers``, and how many words went."""
    import numpy as np

    data = clean_bytes(text)
    begin, end, words, _ = chunk_ends([data], reach)
    dup = np.zeros(len(begin), bool)
    dup[[i for i in numbers if i < len(begin)]] = True
    edges = np.flatnonzero(np.diff(np.r_[0, dup.astype("i1"), 0]))
    raw, parts, at, lost = text.encode(), [], 0, 0
    for s, e in zip(edges[::2], edges[1::2]):
        n = int(words[s:e].sum())
        if n >= min_words:
            parts.append(raw[at : begin[s]])
            at = begin[e] if e < len(begin) else len(raw)
            lost += n
    if not lost:
        return text, 0
    return b"".join([*parts, raw[at:]]).decode().strip(" \t\n\v\f\r"), lost


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", *, reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cut, and ``words_cut``: how many words it lost. ``docs`` must be a stored table."""
    found = written(chunks(docs, key, text, reach), "chunks")
    names, kinds = [c for c in docs.columns if c.lower() != "words_cut"], dict(docs.dtypes)
    m, k, mark, places = fresh(docs.columns, "_m", "_key", "_mark", "_numbers")
    marked = repeats(found).select(F.col("key").alias(k), F.col("mark").alias(mark), F.col("numbers").alias(places))
    joined = docs.select(*names, F.hash(text).alias(m)).join(marked, F.col(key).eqNullSafe(F.col(k)) & (F.col(m) == F.col(mark)), "left").select(*names, places)

    def run(batches):
        only("chunks")
        import pyarrow as pa

        for b in batches:
            texts, numbers = b.column(text).to_pylist(), b.column(places).to_pylist()
            done = [(t, 0) if t is None or not k else cut_runs(t, k, reach, min_words) for t, k in zip(texts, numbers)]
            columns = [pa.array([d[0] for d in done], b.schema.field(text).type) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.int64())], names=[*names, "words_cut"])

    return bounded(joined).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", words_cut bigint")


def op2_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
