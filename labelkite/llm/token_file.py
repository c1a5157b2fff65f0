"""Token ids in patched frame-of-reference blocks.

A stream is cut into blocks of 256 values. A block keeps its minimum, and the differences to it at the width that holds at
least nine tenths of them; the others are exceptions, with place and full difference in a list of their own. An index holds
where each block starts, so that any block can be read alone.

A segment holds the ids of consecutive documents and their lengths, as two such streams. Segments are the rows of a table
that Spark writes, in ascending order of documents over the partitions: so they can be in any store that Spark can write to,
and a task that is run again leaves no second copy.

Defined results: null text is the empty text, which has just the end id. Rows of one id are ordered by a hash of the text;
null ids come first. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelkite.llm.common import bounded, scratch_path

BLOCK = 256
KEEP = 0.9
MAGIC = b"LKPF"
#: Ids of a segment, about.
SEGMENT = 1 << 20
VOCABULARY = "word_bpe_49k.json"
END = 1


def _room(width: int) -> str:
    return ">u1" if width <= 8 else ">u2" if width <= 16 else ">u4"


def pack_stream(values, keep: float = KEEP) -> bytes:
    """Unsigned 32-bit values as a stream of blocks."""
    import numpy as np

    values = np.ascontiguousarray(values, "u4")
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return struct.pack("<4sQI", MAGIC, 0, 0)
    v = np.full(blocks * BLOCK, values[-1], "u4")
    v[:n] = values
    v = v.reshape(blocks, BLOCK)
    base = v.min(1)
    v -= base[:, None]
    at = min(BLOCK - 1, int(np.ceil(keep * BLOCK)) - 1)
    top = np.partition(v, at, axis=1)[:, at]
    width = np.frexp(top.astype("f8"))[1].astype("u1")
    bodies: list = [b""] * blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            kind = _room(w)
            size = 8 * int(kind[2])
            low = (v[rows] & np.uint32((1 << w) - 1)).astype(kind)
            bits = np.unpackbits(low.view("u1").reshape(len(rows), BLOCK, size // 8), axis=2)[:, :, size - w :]
            packed = np.packbits(bits.reshape(len(rows), BLOCK * w), axis=1)
            for k, r in enumerate(rows.tolist()):
                bodies[r] = packed[k].tobytes()
    over = (v >> np.minimum(width, 31)[:, None] > 0) & (width < 32)[:, None]
    row, place = np.nonzero(over)
    counts = np.bincount(row, minlength=blocks).astype("<u2")
    starts = np.zeros(blocks, "<u4")
    np.cumsum([len(x) for x in bodies[:-1]], out=starts[1:])
    return b"".join(
        [struct.pack("<4sQI", MAGIC, n, blocks), base.astype("<u4").tobytes(), width.tobytes(), counts.tobytes(), starts.tobytes(), place.astype("u1").tobytes(), v[row, place].astype("<u4").tobytes(), *bodies]
    )


def unpack_stream(data: bytes, first: int = 0, last: int | None = None):
    """The values of blocks ``first`` to ``last`` (all of them by default)."""
    import numpy as np

    magic, n, blocks = struct.unpack_from("<4sQI", data)
    if magic != MAGIC:
        raise ValueError("not a stream of blocks")
    at, out = struct.calcsize("<4sQI"), []
    for kind, size in (("<u4", 4), ("u1", 1), ("<u2", 2), ("<u4", 4)):
        out.append(np.frombuffer(data, kind, blocks, at))
        at += size * blocks
    base, width, counts, starts = out
    total = int(counts.sum())
    place, high = np.frombuffer(data, "u1", total, at), np.frombuffer(data, "<u4", total, at + total)
    at += 5 * total
    last = blocks if last is None else min(last, blocks)
    body = np.frombuffer(data, "u1", offset=at)
    v = np.zeros((max(0, last - first), BLOCK), "u4")
    for w in np.unique(width[first:last]).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width[first:last] == w)
        packed = body[starts[first + rows].astype("i8")[:, None] + np.arange(BLOCK * w // 8)]
        kind = _room(w)
        size = 8 * int(kind[2])
        bits = np.zeros((len(rows), BLOCK, size), "u1")
        bits[:, :, size - w :] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
        v[rows] = np.packbits(bits, axis=2).reshape(len(rows), -1).view(kind).reshape(len(rows), BLOCK)
    row = np.repeat(np.arange(blocks), counts)
    use = (row >= first) & (row < last)
    v[row[use] - first, place[use]] = high[use]
    v += base[first:last, None]
    return v.reshape(-1)[: max(0, n - first * BLOCK)]


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", *, vocabulary: str = VOCABULARY, file: str | None = None, end: int = END) -> None:
    """Encode ``docs`` and write their ids to ``path``, in ascending order of ``key``."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from labelkite.llm.encoding import chunks, encoder

        coder, tail, shard = encoder(vocabulary, file), end.to_bytes(4, "little"), TaskContext.get().partitionId()
        seq = start = 0
        keys, held = [], []

        def segment():
            nonlocal seq, start, keys, held
            sizes = np.array([len(x) // 4 for x in held], "u4")
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = pack_stream(sizes)
            data = struct.pack("<I", len(lengths)) + lengths + pack_stream(ids)
            out = pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, seq, start, len(ids))] + [pa.array([keys], pa.list_(key_type)), pa.array([data], pa.binary())], names=["shard", "seq", "start", "n_tokens", "keys", "data"])
            seq, start, keys, held = seq + 1, start + len(ids), [], []
            return out

        size = 0
        for b in batches:
            key_type = b.schema.field(0).type
            ids_of, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                found = [x + tail for x in coder.encode(texts[lo:hi])]
                for k, x in zip(ids_of[lo:hi], found, strict=True):
                    keys.append(k)
                    held.append(x)
                    size += len(x) // 4
                    if size >= SEGMENT:
                        yield segment()
                        size = 0
        if held:
            yield segment()

    ordered = docs.select(key, text, F.xxhash64(text).alias("_tie")).repartitionByRange(key, "_tie").sortWithinPartitions(key, "_tie").select(key, text)
    bounded(ordered).mapInArrow(run, f"shard bigint, seq bigint, start bigint, n_tokens bigint, keys array<{kind}>, data binary").write.parquet(path)


def read_tokens(spark, path: str, key: str = "doc_id", *, ids: bool = False) -> DataFrame:
    """``key start n_tokens ids_crc32`` (and the ids) of each document, from the files."""
    segments = spark.read.parquet(path)
    kind = dict(segments.dtypes)["keys"][6:-1]
    # one row for each partition that was written
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")
    )
    rows = segments.join(F.broadcast(shards), F.col("shard") == F.col("s")).select("keys", (F.col("before") + F.col("start")).alias("start"), "data")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            key_type = b.schema.field(0).type.value_type
            for keys, start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = data.as_py()
                (n,) = struct.unpack_from("<I", raw)
                sizes = unpack_stream(raw[4 : 4 + n]).astype("i8")
                found = unpack_stream(raw[4 + n :])
                begins = np.cumsum(sizes) - sizes
                view = memoryview(found.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * s : 4 * (s + k)]) for s, k in zip(begins.tolist(), sizes.tolist())]
                columns = [pa.array(keys, key_type), pa.array(begins + start), pa.array(sizes), pa.array(crc, pa.int64())]
                names = [key, "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(found)), pa.int32()), pa.array(found, pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded(rows).mapInArrow(run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)


def op3_token_blocks(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
