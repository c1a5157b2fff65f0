"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Each task writes an archive of its own, a gzip member for each record, into the shared folder and returns its name and
size; only archives that such a row names count, so what a lost task has left is never read. The reader cuts the archives
into byte ranges. The task of a range looks for the gzip magic in it, takes a candidate as a record if it decodes to a WARC
header, and owns the records that start inside its range, reading on beyond its end for the last one.

The file system is reached through ``pyarrow.fs`` (local or shared folders, HDFS, object stores).

Defined results: a null page counts as an empty payload, a null url leaves the header out. Of the records with equal
payloads of at least ``least`` bytes those with the smallest page_id are responses, the others revisits. Repeated rows
give repeated records. An empty table gives an empty result. Records of other writers are read as well: folded header lines
and such without a colon, any record id (null page_id where it isn't one of ours), blocks without HTTP heads, and digests
that are missing or not SHA-1 (both worked out from the payload).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.common import bounded, scratch_path, written

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a range.
RANGE = 4 << 20


def record_id(page_id: int | None) -> str:
    """A UUID (version 8) that holds the page's number; bit 50 is set for none."""
    n = 0 if page_id is None else page_id & 0xFFFFFFFFFFFFFFFF
    body = (0x6C6B << 112) | (8 << 76) | ((n >> 62) << 64) | ((page_id is None) << 66) | (2 << 62) | (n & 0x3FFFFFFFFFFFFFFF)
    return f"<urn:uuid:{uuid.UUID(int=body)}>"


def page_of(record: str | None) -> int | None:
    """The page's number in a record id of ``record_id``, None for other ids."""
    try:
        body = uuid.UUID((record or "").strip("<> ").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if body >> 112 != 0x6C6B or body >> 76 & 15 != 8 or body >> 66 & 1:
        return None
    n = (body >> 64 & 3) << 62 | body & 0x3FFFFFFFFFFFFFFF
    return n - (1 << 64) if n >> 63 else n


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return member(headers, http if revisit else http + payload)


def originals(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """``pages`` with ``_first``: the smallest key of the equal payloads, where there are several keys and bytes enough.

    Only keys and digests are shuffled to find it; the payload is shuffled once, by key.
    """
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    ids = pages.select(F.col(key).alias("_k"), F.sha1(body).alias("_d"), F.length(body).alias("_n")).filter(F.col("_n") >= least)
    several = ids.groupBy(F.col("_d").alias("_same")).agg(F.min("_k").alias("_first"), F.max("_k").alias("_last")).filter(F.col("_first") < F.col("_last"))
    # written, so that a digest of very many pages isn't joined in one task
    several = written(several.select("_same", "_first"), "payloads")
    again = ids.join(several, F.col("_d") == F.col("_same")).filter(F.col("_k") > F.col("_first")).select("_k", "_d", "_first").distinct()
    return pages.withColumn("_digest", F.sha1(body)).join(again, (F.col(key) == F.col("_k")) & (F.col("_digest") == F.col("_d")), "left").drop("_digest", "_k", "_d")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", *, least: int = 0) -> DataFrame:
    """Write ``pages`` into archives in ``folder`` (a URI); the archives as rows (path, bytes, records)."""
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))
    rows = originals(named, "page_id", "html", least).select("page_id", "url", "html", "_first")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, top = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        records = size = 0
        out = None
        for b in batches:
            for page_id, link, html, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    system.create_dir(top, recursive=True)
                    out = system.open_output_stream(f"{top}/{name}", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                data = page_record(page_id, link, (html or "").encode(), first, first is not None)
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([records])], names=["path", "bytes", "records"])

    return written(bounded(rows).mapInArrow(run, "path string, bytes bigint, records bigint"), "archives")


def members_in(read_at, begin: int, end: int, chunk: int = 1 << 16):
    """The decoded records that start at ``begin`` or later and before ``end``; ``read_at(n, place)`` gives bytes of the file.

    A candidate counts where it decodes to a version line, a header and the record's whole length. Of a record that goes on
    beyond the range only the rest is read on, a part at a time.
    """
    data, at = read_at(end - begin + chunk, begin), 0
    while (at := data.find(GZIP_MAGIC, at)) >= 0 and begin + at < end:
        z = zlib.decompressobj(31)
        try:
            if not VERSION.match(z.decompress(data[at : at + 4096])):
                at += 1
                continue
            z, parts, fed, beyond = zlib.decompressobj(31), [], at, begin + len(data)
            while not z.eof:
                step = data[fed : fed + (1 << 20)]
                if not step:
                    step = read_at(1 << 20, beyond)
                    beyond += len(step)
                    if not step:
                        raise EOFError(f"the record at {begin + at} isn't whole")
                fed += len(step)
                parts.append(z.decompress(step))
            record = b"".join(parts)
            if not whole(record):
                at += 1
                continue
        except zlib.error:
            at += 1
            continue
        at = fed - len(z.unused_data)
        yield record


def header_fields(head: bytes) -> dict[str, str]:
    """Header lines after the first one, names in lower case; a folded line goes on the one before it, lines without a colon don't count."""
    fields: dict[str, str] = {}
    last = None
    for line in re.split(r"\r?\n", head.decode("utf-8", "replace"))[1:]:
        if line[:1] in (" ", "\t") and last is not None:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower() if colon else None
        if last is not None:
            fields[last] = value.strip()
    return fields


def whole(record: bytes) -> bool:
    """Whether a decoded member has a WARC header and as many bytes as this says."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = header_fields(head)
    n = fields.get("content-length", "")
    return "warc-type" in fields and n.isdigit() and int(n) <= len(rest)


def parse(record: bytes) -> dict:
    """The headers (lower case) and the block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = header_fields(head)
    return fields | {"block": rest[: int(fields["content-length"])]}


def payload_of(x: dict) -> tuple[bytes | None, int | None, str | None]:
    """Of a parsed record: the payload (none for a revisit), its size and its SHA-1, checked where both are there."""
    block, revisit = x["block"], x["warc-type"] == "revisit"
    http = block.startswith(b"HTTP/")
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    kind, _, said = x.get("warc-payload-digest", "").partition(":")
    said = said if kind.lower() == "sha1" else None
    n = header_fields(head).get("content-length", "")
    size = int(n) if n.isdigit() else None
    if revisit:
        return None, size, said
    own = digest(body)
    if (size is not None and size != len(body)) or (said is not None and said.upper() != own):
        raise ValueError(f"the payload of {x.get('warc-record-id')} doesn't match its size or digest")
    return body, len(body), own


def read_archives(archives: DataFrame, *, range_bytes: int = RANGE, payload: bool = False) -> DataFrame:
    """The page records of archives (path, bytes): ``page_id url payload_bytes payload_digest record_type refers_to`` (and payload)."""
    ranges = archives.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("begin")
    ).select("path", "begin", F.least(F.col("begin") + range_bytes, "bytes").alias("end"))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payload]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in b.columns)):
                system, place = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_file(place) as f:
                    for record in members_in(f.read_at, begin, end):
                        x = parse(record)
                        if x["warc-type"] not in ("response", "revisit"):
                            continue
                        body, size, said = payload_of(x)
                        row = (page_of(x.get("warc-record-id")), x.get("warc-target-uri"), size, said, x["warc-type"], page_of(x.get("warc-refers-to")) if body is None else None)
                        rows.append(row + (body,) * payload)
                        if len(rows) >= 2000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    kinds = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bounded(ranges.repartition(parts)).mapInArrow(run, kinds + ", payload binary" * payload)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    archives = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(archives).drop("url")
