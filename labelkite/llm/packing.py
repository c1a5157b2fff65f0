"""Best-two-fit packing of documents' tokens into sequences of a fixed length.

A bin is filled greedily with the longest documents that fit; then its smallest document is replaced with two unpacked
ones, if two together fill the gap that it leaves more tightly. Documents of one length are alike, so the bins are worked
out from the number of documents of each length (one row for each length, at most the capacity, whatever the corpus): a
pattern of lengths is used for as many bins as the counts allow, which is what packing bin by bin would do. Each document
then finds its place from its rank among those of its length; ranks are counted in buckets of documents, so that no length
is ranked in one task.

Defined results: null text is the empty text, whose only id is the end id. Only documents longer than the capacity are
cut; the first piece takes the remainder. Repeated rows are packed as documents of their own. Pieces without a length of
1 to the capacity get null places. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelkite.llm.common import bounded, fresh, written

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Pieces for each bucket of ranks, about.
BUCKET_ROWS = 100_000
LEAST_BUCKETS = 256


def best_two(lengths: list[int], left: dict[int, int], room: int, least: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum of at most ``room``, if that is more than ``least``."""
    i, j, best, pair = 0, bisect_right(lengths, room) - 1, least, None
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room:
            j -= 1
            continue
        if total > best and (i < j or left[lengths[i]] > 1):
            best, pair = total, (lengths[j], lengths[i])
            if best == room:
                break
        i += 1
    return pair


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[int, dict[int, int]]]:
    """(bins, documents of each length in each of these bins), until all are packed."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    while lengths:
        taken: dict[int, int] = {}

        def use(n: int, k: int) -> None:
            left[n] -= k
            if not left[n]:
                lengths.remove(n)

        def take(n: int, k: int, taken=taken) -> None:
            taken[n] = taken.get(n, 0) + k
            use(n, k)

        def put_back(n: int, taken=taken) -> None:
            taken[n] -= 1
            if not taken[n]:
                del taken[n]
            left[n] += 1
            if left[n] == 1:
                insort(lengths, n)

        gap = capacity
        while (at := bisect_right(lengths, gap)) and gap:
            n = lengths[at - 1]
            k = min(gap // n, left[n])
            take(n, k)
            gap -= k * n
        smallest = min(taken)
        if gap and sum(taken.values()) > 1 and (pair := best_two(lengths, left, gap + smallest, smallest)):
            for n in pair:
                take(n, 1)
            put_back(smallest)
        more = min(left[n] // k for n, k in taken.items())
        for n, k in taken.items():
            if more:
                use(n, k * more)
        yield 1 + more, taken


def runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, documents a bin, first bin, offset): where the documents of a length go, by rank."""
    used: dict[int, int] = {}
    out, first = [], 0
    for bins, taken in patterns(counts, capacity):
        offset = 0
        for n, k in taken.items():
            out.append((n, used.get(n, 0), k, first, offset))
            used[n] = used.get(n, 0) + bins * k
            offset += n * k
        first += bins
    return sorted(out)


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, in place of columns of these names; ``pieces`` must be a stored table, as it is
    read twice.

    ``keys``: columns that order pieces of one length, so that the result doesn't depend on the partitions.
    """
    pieces = pieces.select(*[c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    fits = pieces.filter(F.col(length).between(1, capacity))
    size, bucket, before, rank = fresh(pieces.columns, "size", "bucket", "before", "rank")
    counts = {int(r[0]): r[1] for r in fits.groupBy(F.col(length).alias(size)).agg(F.count("*")).collect()}  # one row for each length
    table = runs(counts, capacity)
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    marked = fits.select("*", F.col(length).alias(size), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(bucket))
    many = marked.groupBy(size, bucket).agg(F.count("*").alias(rank))
    many = many.select(size, bucket, (F.sum(rank).over(Window.partitionBy(size).orderBy(bucket)) - F.col(rank)).alias(before))
    within = F.row_number().over(Window.partitionBy(size, bucket).orderBy(*keys))
    ranked = marked.withColumn(rank, within).join(many, [size, bucket]).select(*pieces.columns, (F.col(rank) - 1 + F.col(before)).alias(rank))
    names = list(pieces.columns)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        r = np.array(table, "i8").reshape(-1, 5)
        run_key = r[:, 0] * (1 << 48) + r[:, 1]
        for b in batches:
            n = b.column(length).to_numpy(zero_copy_only=False).astype("i8")
            place_of = b.column(rank).to_numpy(zero_copy_only=False)
            at = r[np.searchsorted(run_key, n * (1 << 48) + place_of, "right") - 1] if len(n) else r[:0]
            i = place_of - at[:, 1]
            per = np.maximum(at[:, 2], 1)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(at[:, 3] + i // per), pa.array(at[:, 4] + i % per * n)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    placed = bounded(ranked).mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
    rest = pieces.filter(~F.coalesce(F.col(length).between(1, capacity), F.lit(False)))
    return placed.unionByName(rest.select("*", F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset")))


def encoded_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str = VOCABULARY, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: ``doc_id piece start length ids_crc32``."""

    def cut(batches):
        import pyarrow as pa

        from labelkite.llm.encoding import chunks, encoder

        coder, tail = encoder(vocabulary, path), end.to_bytes(4, "little")
        for b in batches:
            keys, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                ids, piece, start, length, crc, row = [x + tail for x in coder.encode(texts[lo:hi])], [], [], [], [], []
                for k, x in enumerate(ids):
                    n = len(x) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        row.append(lo + k), piece.append(p), start.append(s), length.append(e - s)
                        crc.append(zlib.crc32(memoryview(x)[4 * s : 4 * e]))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[key]
    return bounded(docs.select(key, text)).mapInArrow(cut, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, **how) -> DataFrame:
    """Encode and cut ``docs``, and give every piece a sequence and a place in it."""
    pieces = written(encoded_pieces(docs, key, text, capacity=capacity, **how), "pieces")
    return pack(pieces, [key, "piece", "start", "ids_crc32"], capacity=capacity)


def op1_best_two_fit(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    return pack_documents(table(spark, sf_dir, "documents"))
