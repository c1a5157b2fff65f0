"""Alignment of the tokens of two tokenizers over the same bytes, with corpus-wide counts of the id pairs that it links.

Side A is a byte-level BPE vocabulary, side B a SentencePiece one; both read a text with a space before it. Places where a
token of either side ends cut both rows of tokens into groups; the last tokens of a group's two sides, whose byte ranges end
together, are a link. A pair's count is its number of links in the whole corpus.

A worker cuts texts into units at spaces after anything but white space. Neither side has a token that crosses such a place
(A's vocabulary splits there, no piece of B's has its space mark after anything else; the latter is looked up when the
vocabulary is read), so a unit's groups are the same in every text and are kept when it is met again.

Counting is striped by B's ids: id ``b`` is row ``b // STRIPES`` of stripe ``b % STRIPES``. Each task sums its own pairs
first; a stripe's sums then meet in one task, which adds them into a dense matrix (rows of the stripe's B ids, columns of
all A ids; its size is that of the vocabularies, whatever the corpus) and takes its row maxima. Links travel as (pair,
document, repeats) in blocks of documents, by stripe and a salt of some ``SALT_BLOCKS`` blocks, to a copy of their stripe's
counts; what they add to each document is summed for each block, so a frequent id is spread over tasks like any other.

Each of the three tables in between is written to the shared folder. Defined results: texts that are null or empty, or
whose bytes either side doesn't give back (a space mark of B's own in the text), have no tokens. Rows are told apart by
their place, so ids may repeat or be null; an empty table gives an empty result, columns besides key and text are unseen.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.common import bounded, only, scratch_path, written
from labelkite.llm.encoding import WHITE, letters

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
#: Stripes of B's ids.
STRIPES = 128
#: Documents and links of a block, at most and about.
BLOCK_DOCS = 1 << 14
BLOCK_LINKS = 1_000_000
#: Pairs that a task sums before it sends them on; blocks that meet one copy of a stripe's counts.
TASK_PAIRS = 2_000_000
SALT_BLOCKS = 64
#: Units kept, once they have been met twice; others that have been met once; letters of a unit that is kept.
MEMO = 300_000
ONCE = 250_000
LONGEST = 64

NO_CUT = rf"{WHITE}\x1c-\x1f\u180e\u200b\ufeff"
UNSURE = re.compile(rf"[{NO_CUT}] ")
CUT = re.compile(rf"(?<=[^{NO_CUT}])(?= )")

_aligners: dict = {}


class Aligner:
    """Both tokenizers and the units that they have met."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path or public_tokenizers.path(A_VOCABULARY))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_VOCABULARY))
        letter = {x: bytes([b]) for b, x in enumerate(letters())}
        names = sorted(self.a.get_vocab(True).items(), key=lambda x: x[1])
        self.a_ids = names[-1][1] + 1
        self.a_bytes = [b""] * self.a_ids
        for name, k in names:
            self.a_bytes[k] = b"".join(letter.get(x, x.encode()) for x in name)
        self.b_ids = self.b.get_piece_size()
        self.b_bytes = []
        for k in range(self.b_ids):
            piece = self.b.id_to_piece(k)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {k} has a space mark inside")
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.a_name, self.b_name = list(map(str, range(self.a_ids))), list(map(str, range(self.b_ids)))
        #: Pairs are numbered by stripe, in a stripe by B's ids, for each of these by A's.
        self.base = [((b % STRIPES) * self.rows + b // STRIPES) * self.a_ids for b in range(self.b_ids)]
        self.memo: dict[str, tuple | None] = {}
        self.once: set[str] = set()

    @property
    def rows(self) -> int:
        """B ids of a stripe."""
        return -(-self.b_ids // STRIPES)

    def units(self, text: str) -> list[str]:
        """The units of ``text``, each without the space that it begins with."""
        whole = " " + text
        if UNSURE.search(whole):
            return [u[1:] for u in CUT.split(whole)]
        return text.split(" ")

    def grouped(self, unit: str, a: list[int], b: list[int]) -> tuple | None:
        """(groups, codes of links as bytes, tokens of A, tokens of B) of a unit; none if its bytes don't come back."""
        raw = b" " + unit.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        groups, codes, i, j = [], [], 0, 0
        a_size, b_size, a_name, b_name, base = self.a_size, self.b_size, self.a_name, self.b_name, self.base
        while i < len(a):
            x, y = a[i], b[j]
            left, right, at, bt = a_name[x], b_name[y], a_size[x], b_size[y]
            i, j = i + 1, j + 1
            while at != bt:
                if at < bt:
                    x = a[i]
                    at += a_size[x]
                    left += "," + a_name[x]
                    i += 1
                else:
                    y = b[j]
                    bt += b_size[y]
                    right += "," + b_name[y]
                    j += 1
            groups.append(left + "|" + right)
            codes.append(base[y] + x)
        return ";".join(groups), struct.pack(f"<{len(codes)}q", *codes), len(a), len(b)

    def align(self, texts: list[str]) -> list[list[tuple] | None]:
        """For each text what ``grouped`` gives of its units, none if it has no tokens."""
        units = [self.units(t) if t else [] for t in texts]
        known = self.memo
        new = sorted(set().union(*units) - known.keys())
        if new:
            many = sum(map(len, units))
            a = [x.ids for x in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
            # a unit of spaces alone would get no mark of its own at the beginning of a text
            b = [self.b.encode("a" + " " + u)[1:] if not u.strip(" ") else None for u in new]
            rest = [k for k, x in enumerate(b) if x is None]
            for k, x in zip(rest, self.b.encode([new[k] for k in rest], num_threads=1), strict=True):
                b[k] = x
            fresh = {u: self.grouped(u, x, y) for u, x, y in zip(new, a, b, strict=True)}
            if len(known) >= MEMO and len(new) > many / 4:
                known.clear()  # other texts than before
            short = {u for u in new if len(u) <= LONGEST}
            again = short & self.once
            if len(known) < MEMO:
                known.update((u, fresh[u]) for u in again)
                self.once |= short - again
                if len(self.once) > ONCE:
                    self.once.clear()
            look = [fresh.get(u) or known.get(u) for found in units for u in found]
        else:
            look = [known[u] for found in units for u in found]
        out, at = [], 0
        for found in units:
            parts = look[at : at + len(found)]
            at += len(found)
            out.append(None if not parts or None in parts else parts)
        return out


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """One aligner for each worker process and pair of files."""
    if (a_path, b_path) not in _aligners:
        only("aligners", _aligners.clear)
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def summed(codes, numbers):
    """Distinct sorted ``codes`` and the sums of their ``numbers``."""
    import numpy as np

    order = np.argsort(codes, kind="stable")
    codes, numbers = codes[order], numbers[order]
    head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[head], np.add.reduceat(numbers, head) if len(head) else numbers


FIELDS = "kind string, block bigint, place int, stripe int, docs int, codes binary, many binary, at binary, repeats binary"


def _batch(rows: list[dict], names: list[str], types):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", *, a_path: str | None = None, b_path: str | None = None, groups: bool = False) -> DataFrame:
    """A written table with rows of three kinds: ``doc`` (a document's numbers and its groups or their digest), ``link`` (the links
    of a block of documents in a stripe) and ``pair`` (a task's number of links of each pair in a stripe)."""
    kind = dict(docs.dtypes)[key]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from labelkite.llm.encoding import chunks

        tool = aligner(a_path, b_path)
        wide = tool.rows * tool.a_ids
        block = TaskContext.get().partitionId() << 32
        names = ["key", "n_a", "n_b", "n_groups", "groups", *[f.split()[0] for f in FIELDS.split(", ")]]
        key_type = None
        held: list = []  # of the present block: (document, its codes)
        links = 0
        pairs = [np.zeros(0, "i8"), np.zeros(0, "i8")]

        def types():
            return [key_type, *[pa.int64()] * 3, pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

        def by_stripe(codes):
            cut = np.searchsorted(codes, np.arange(STRIPES + 1) * wide)
            return [(s, int(lo), int(hi)) for s, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo]

        def sent_pairs():
            codes, n = pairs
            pairs[:] = [codes[:0], n[:0]]
            rows = [{"kind": "pair", "stripe": s, "codes": (codes[lo:hi] - s * wide).astype("<u4").tobytes(), "many": n[lo:hi].astype("<i8").tobytes()} for s, lo, hi in by_stripe(codes)]
            return [_batch(rows, names, types())] if rows else []

        def sent_block():
            nonlocal held, links, block
            sizes = np.array([len(c) // 8 for _, c in held])
            codes = np.frombuffer(b"".join(c for _, c in held), "<i8")
            packed = codes << 14 | np.repeat(np.arange(len(held)), sizes)
            packed.sort()
            head = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]][: len(packed)])
            repeats = np.diff(np.r_[head, len(packed)])
            packed = packed[head]
            codes, at = packed >> 14, (packed & (1 << 14) - 1).astype("<u2")
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
            many = np.diff(np.r_[first, len(codes)])
            names_of = codes[first]
            rows = [{"kind": "doc", "block": block, "place": k, "docs": len(held), **row} for k, (row, _) in enumerate(held)]
            for s, lo, hi in by_stripe(names_of):
                a, e = int(first[lo]), int(first[hi]) if hi < len(first) else len(at)
                rows.append(
                    {"kind": "link", "block": block, "stripe": s, "docs": len(held), "codes": (names_of[lo:hi] - s * wide).astype("<u4").tobytes(), "many": many[lo:hi].astype("<u4").tobytes()}
                    | {"at": at[a:e].tobytes(), "repeats": repeats[a:e].astype("<u4").tobytes()}
                )
            if len(first):
                total = np.add.reduceat(repeats, first)
                pairs[:] = summed(np.r_[pairs[0], names_of], np.r_[pairs[1], total])
            held, links, block = [], 0, block + 1
            return _batch(rows, names, types())

        for b in batches:
            key_type = b.column(0).type
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                for k, found in zip(keys[lo:hi], tool.align(texts[lo:hi])):
                    row = {"key": k, "n_a": 0, "n_b": 0, "n_groups": 0, "groups": ""}
                    codes = b""
                    if found is not None:
                        codes = b"".join([p[1] for p in found])
                        whole = ";".join([p[0] for p in found])
                        row |= {"n_a": sum([p[2] for p in found]), "n_b": sum([p[3] for p in found]), "n_groups": len(codes) // 8}
                        row["groups"] = whole if groups else hashlib.sha256(whole.encode()).hexdigest()
                    held.append((row, codes))
                    links += len(codes) // 8
                    if links >= BLOCK_LINKS or len(held) >= BLOCK_DOCS:
                        yield sent_block()
                        if len(pairs[0]) >= TASK_PAIRS:
                            yield from sent_pairs()
        if held:
            yield sent_block()
        if key_type is not None:
            yield from sent_pairs()

    schema = f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, groups string, {FIELDS}"
    path = scratch_path(docs.sparkSession, "alignment")
    bounded(docs.select(key, text)).mapInArrow(run, schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def pair_counts(aligned: DataFrame, *, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A written table with a row for each stripe: its pairs, their numbers of links and whether each is its B id's highest.

    A stripe's dense matrix holds ``rows`` x A ids numbers of eight bytes: 101 MB for these vocabularies.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tool = aligner(a_path, b_path)
        dense, stripe = np.zeros((tool.rows, tool.a_ids), "i8"), None
        flat = dense.reshape(-1)

        def done():
            codes = np.flatnonzero(flat)
            n = flat[codes]
            best = n == dense.max(axis=1)[codes // tool.a_ids]
            flat[codes] = 0
            return pa.RecordBatch.from_pydict({"stripe": pa.array([stripe], pa.int32()), "codes": [codes.astype("<u4").tobytes()], "many": [n.astype("<i8").tobytes()], "best": [best.astype("u1").tobytes()]})

        for b in batches:
            for s, codes, n in zip(b.column("stripe").to_pylist(), b.column("codes").to_pylist(), b.column("many").to_pylist()):
                if s != stripe:
                    if stripe is not None:
                        yield done()
                    stripe = s
                np.add.at(flat, np.frombuffer(codes, "<u4"), np.frombuffer(n, "<i8"))
        if stripe is not None:
            yield done()

    pairs = aligned.filter("kind = 'pair'").select("stripe", "codes", "many")
    return written(bounded(pairs.repartition(int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stripe").sortWithinPartitions("stripe")).mapInArrow(run, "stripe int, codes binary, many binary, best binary"), "pair-counts")


def pairs(counts: DataFrame, *, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``a_id b_id links best``: a row for each linked pair of ids."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tool = aligner(a_path, b_path)
        for b in batches:
            for s, codes, n, best in zip(*(b.column(c).to_pylist() for c in ("stripe", "codes", "many", "best"))):
                code = np.frombuffer(codes, "<u4").astype("i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code % tool.a_ids), pa.array(code // tool.a_ids * STRIPES + s), pa.array(np.frombuffer(n, "<i8")), pa.array(np.frombuffer(best, "u1").astype(bool))], names=["a_id", "b_id", "links", "best"]
                )

    return bounded(counts).mapInArrow(run, "a_id bigint, b_id bigint, links bigint, best boolean")


def scored(aligned: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key n_a n_b n_groups n_links n_best count_sum groups``: a row for each document."""
    links = aligned.filter("kind = 'link'")
    blocks = links.select("block").distinct().count()
    salts = max(1, -(-blocks // SALT_BLOCKS))
    no = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    salted = links.select("stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), F.lit(1).alias("order"), "block", "docs", "codes", "many", "at", "repeats", *no("best"))
    copies = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), F.lit(0).alias("order"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("int").alias("docs"), "codes", "many", *no("at", "repeats"), "best")

    def score(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}

        def sent():
            out = pa.RecordBatch.from_pydict(
                {"block": pa.array(list(sums), pa.int64()), "best": pa.array([x.astype("<i8").tobytes() for x, _ in sums.values()], pa.binary()), "total": pa.array([x.astype("<i8").tobytes() for _, x in sums.values()], pa.binary())}
            )
            sums.clear()
            return out

        known = number = best = None
        for b in batches:
            for order, block, docs, codes, many, at, repeats, flags in zip(*(b.column(c).to_pylist() for c in ("order", "block", "docs", "codes", "many", "at", "repeats", "best"))):
                codes = np.frombuffer(codes, "<u4")
                if order == 0:
                    known, number, best = codes, np.frombuffer(many, "<i8"), np.frombuffer(flags, "u1").astype("i8")
                    continue
                if block not in sums:
                    if len(sums) >= SALT_BLOCKS:
                        yield sent()
                    sums[block] = np.zeros(docs, "i8"), np.zeros(docs, "i8")
                pair = np.repeat(np.searchsorted(known, codes), np.frombuffer(many, "<u4"))
                doc, n = np.frombuffer(at, "<u2"), np.frombuffer(repeats, "<u4").astype("i8")
                np.add.at(sums[block][0], doc, n * best[pair])
                np.add.at(sums[block][1], doc, n * number[pair])
        if sums:
            yield sent()

    together = copies.unionByName(salted).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "order", "block")
    parts = bounded(together).mapInArrow(score, "block bigint, best binary, total binary")
    documents = aligned.filter("kind = 'doc'")
    kind = dict(aligned.dtypes)["key"]
    numbers = ["n_a", "n_b", "n_groups", "groups"]
    none = [F.lit(None).cast(dict(aligned.dtypes)[c]).alias(c) for c in ("key", *numbers, "place", "docs")]
    rows = documents.select("block", F.lit(1).alias("order"), "key", *numbers, "place", "docs", *no("best", "total")).unionByName(parts.select("block", F.lit(0).alias("order"), *none, "best", "total"))

    def meet(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        present, sums = None, None
        for b in batches:
            keep, best, total = [], [], []
            for k, (block, order, place, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "order", "place", "best", "total")))):
                if block != present:
                    present, sums = block, None
                if order == 0:
                    more = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                    sums = more if sums is None else (sums[0] + more[0], sums[1] + more[1])
                else:
                    keep.append(k)
                    best.append(0 if sums is None else int(sums[0][place]))
                    total.append(0 if sums is None else int(sums[1][place]))
            if keep:
                own = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [own.column("key"), own.column("n_a"), own.column("n_b"), own.column("n_groups"), own.column("n_groups"), pa.array(best, pa.int64()), pa.array(total, pa.int64()), own.column("groups")],
                    names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
                )

    return bounded(rows.repartition("block").sortWithinPartitions("block", "order", "place")).mapInArrow(meet, f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Numbers of tokens, groups and links of each document, how many links are their B id's best, and the digest of its groups."""
    from labelkite.session import table

    found = align(table(spark, sf_dir, "documents"))
    return scored(found, pair_counts(found)).withColumnRenamed("groups", "groups_sha256")
