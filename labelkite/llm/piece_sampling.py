"""Sampled SentencePiece segmentations, and lossless decoding.

All ways to write a text in pieces form a lattice; a path's weight is the product over its pieces of exp(``alpha`` * score).
Forward filtering sums the weights of the paths to each place, backward sampling then draws a path from the end, each piece
with its share of the weight at its end, so segmentations are drawn exactly in proportion to their weights. The random
numbers are hashes of the row's key, the stretch and the step: a row gets the same pieces in any task, order or run.

No piece of the vocabulary has a space mark after anything else, and (but for those that are looked up when it is read)
none has letters beside other characters, so the lattice of a text falls apart into those of its stretches: space marks,
then letters or then other characters. A worker keeps the lattices of stretches, as arrays in which all draws of many
texts are made together.

A character that the vocabulary lacks is written in bytes; so is the space mark itself, where it stands in a text, which
keeps decoding lossless.

Defined results: null text is the empty text, which is the one space mark that SentencePiece puts before a text. Rows are
drawn one by one: repeated rows repeat their pieces, a null key is a key like any other, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame

from labelkite.llm.common import bounded, only

VOCABULARY = "piece_bpe_32k.model"
ALPHA = 5e-4
SEED = 17
#: Stretches kept, once they have been met twice; others that have been met once; how many are added at once; characters of a
#: stretch whose weights can't underflow.
MEMO = 300_000
ONCE = 300_000
TOGETHER = 20_000
SHORT = 40
#: Bits of a stretch's length, which hold that of any text.
PLACE_BITS = 31
LONGEST = (1 << PLACE_BITS) - 1
#: Of a piece as a number (end, how far back it begins, id): what one more letter adds.
ONWARD = 1 << 32 | 1 << 24
MARK = "▁"
#: Stands for a space mark in a text; no valid text has it.
OWN_MARK = "\udc81"


def mixed(x):
    """Well mixed 64-bit hashes of unsigned integers."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tables:
    """Lattices: for each state (a place in a stretch) its pieces, with the summed shares, how far back each begins, its id."""

    def __init__(self, first=(0,), shares=(), back=(), ids=(), low: int = 0):
        import numpy as np

        self.first, self.shares, self.back, self.ids, self.low = np.asarray(first, "i8"), np.asarray(shares, "f4"), np.asarray(back, "i4"), np.asarray(ids, "i4"), low

    @property
    def states(self) -> int:
        return self.low + len(self.first) - 1

    def joined(self, other: Tables) -> Tables:
        import numpy as np

        first = np.concatenate([self.first, other.first[1:] + len(self.ids)])
        return Tables(first, *(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("shares", "back", "ids")), self.low)


class Sampler:
    def __init__(self, path: str | None = None, alpha: float = ALPHA):
        import math

        import numpy as np
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {names[i]: i for i in plain}
        self.longest = max(map(len, self.pieces))
        #: By letter: what may follow, and the id of the piece that ends here, -1 if none does.
        self.trie: dict = {}
        for p, i in self.pieces.items():
            node = self.trie
            for c in p:
                last = node.setdefault(c, [{}, -1])
                node = last[0]
            last[1] = i
        scores = [sp.get_score(i) for i in range(n)]
        least = min(x for x in scores if x > -1e8)  # pieces without a score of their own have -1e9: they count as the last
        self.weight = np.array([math.exp(alpha * max(x, least)) for x in scores])
        self.byte_weight = float(min(self.weight[i] for i in plain))
        self.spelled = [b""] * n
        for p, i in self.pieces.items():
            self.spelled[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.spelled[i] = bytes([b])
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("pieces of this vocabulary go over spaces")
        alone = "" if any("\n" in p and len(p) > 1 for p in self.pieces) else "\n"
        pairs = {(a, b) for p in self.pieces for a, b in zip(p, p[1:])}
        letter = re.compile(r"[^\W\d_]").match
        mixed_pairs = [(a, b) for a, b in pairs if MARK not in (a, b) and bool(letter(a)) != bool(letter(b))]
        if any(letter(b) for _, b in mixed_pairs):
            pattern = rf"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+"
        else:
            other = rf"(?:[^\w{MARK}{alone}]|[\d_])"
            goes_on = "".join(rf"(?:(?<={re.escape(a)}){re.escape(b)}{other}*)?" for a, b in sorted(mixed_pairs))
            pattern = rf"{MARK}*[^\W\d_]+{goes_on}|{MARK}*{other}+|{MARK}+"
        self.find = re.compile(pattern + "|\n" * bool(alone)).findall
        self.size = n
        self.rare: dict[str, int] = {}  # characters in bytes, as ids from `size` on
        self.rare_bytes: list[list[int]] = []
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.memo: dict[str, int] = {}  # stretch: its first state and its length, as one number
        self.once: set[str] = set()
        self.again: set[str] = set()
        self.kept = Tables()

    def _rare(self, c: str) -> int:
        if c not in self.rare:
            raw = MARK.encode() if c == OWN_MARK else c.encode()
            self.rare[c] = self.size + len(self.rare_bytes)
            self.rare_bytes.append([self.byte_ids[b] for b in raw])
        return self.rare[c]

    def edges(self, x: str, base: int, out: list[int]) -> None:
        """Add all pieces in a stretch whose first state is ``base``, as numbers: end, how far back it begins, id."""
        root, pieces, longest, add, number = self.trie, self.pieces, self.longest, out.append, base << 32
        for i in range(len(x)):
            if x[i] not in pieces:
                add(number + ONWARD | self._rare(x[i]))
            nodes, to = root, number
            for c in x[i : i + longest]:
                node = nodes.get(c)
                if node is None:
                    break
                to += ONWARD
                nodes, piece = node
                if piece >= 0:
                    add(to | piece)
            number += 1 << 32

    def lattices(self, new: list[str], low: int):
        """Tables of the lattices of stretches, states numbered from ``low``, and where each begins."""
        import numpy as np

        base, where, found = low, {}, []
        for x in new:
            where[x] = base << PLACE_BITS | len(x)
            self.edges(x, base, found)
            base += len(x) + 1
        found = np.sort(np.array(found, "i8"))
        ends = (found >> 32) - low
        begins = ends - (found >> 24 & 255)
        found &= (1 << 24) - 1
        w = np.where(found < self.size, self.weight[np.minimum(found, self.size - 1)], 0)
        over = np.flatnonzero(found >= self.size)
        w[over] = [self.byte_weight ** len(self.rare_bytes[k - self.size]) for k in found[over].tolist()]
        places = np.array(list(where.values()), "i8")
        heads, sizes = (places >> PLACE_BITS) - low, places & LONGEST
        alpha = np.zeros(base - low)
        alpha[heads] = 1
        level = ends - np.repeat(heads, sizes + 1)[ends]
        short = np.repeat(sizes <= SHORT, sizes + 1)[ends]
        share = np.ones(len(w))
        order = np.flatnonzero(short)
        order = order[np.argsort(level[order], kind="stable")]
        cuts = np.searchsorted(level[order], np.arange(1, SHORT + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = order[lo:hi]
            if not len(at):
                break
            part = alpha[begins[at]] * w[at]
            to = ends[at]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            total = np.add.reduceat(part, first)
            alpha[to[first]] = total
            share[at] = part / np.repeat(total, np.diff(np.r_[first, len(at)]))
        for h, n in zip(heads[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            lo, hi = np.searchsorted(ends, [h, h + n + 1])
            share[lo:hi] = self._scaled(ends[lo:hi], begins[lo:hi], w[lo:hi])
        count = np.bincount(ends, minlength=base - low)
        start = np.cumsum(count) - count
        # sums within each state alone, so that they don't depend on the stretches around
        summed, step, more = share, 1, np.flatnonzero(count > 1)
        while len(more):
            at = start[more] + step
            summed[at] += summed[at - 1]
            step += 1
            more = more[count[more] > step]
        summed[(start + count - 1)[count > 0]] = 2.0  # the last one, whatever the rounding
        return Tables(np.r_[start, len(ends)].astype("i8"), summed.astype("f4"), (ends - begins).astype("i4"), found.astype("i4"), low), where

    def _scaled(self, ends, begins, w):
        """Shares of the pieces of one stretch, by logarithms."""
        import numpy as np

        reach = {int(begins.min()): 0.0}
        share = np.zeros(len(w))
        logs = np.log(w)
        lo = 0
        while lo < len(ends):
            hi = int(np.searchsorted(ends, ends[lo], "right"))
            v = np.array([reach[int(b)] for b in begins[lo:hi]]) + logs[lo:hi]
            top = v.max()
            share[lo:hi] = np.exp(v - top)
            reach[int(ends[lo])] = top + float(np.log(share[lo:hi].sum()))
            share[lo:hi] /= share[lo:hi].sum()
            lo = hi
        return share

    def sample(self, texts: list[str], keys: list, seed: int = SEED):
        """(ids, counts): the pieces of all texts one after the other, and how many each has."""
        import numpy as np
        from xxhash import xxh64_intdigest

        stretches = [self.find(MARK + (t.replace(MARK, OWN_MARK) if MARK in t else t).replace(" ", MARK)) for t in texts]
        everything = [x for s in stretches for x in s]
        where = list(map(self.memo.get, everything))
        fresh = {x for x, at in zip(everything, where) if at is None}
        many = len(fresh) > len(everything) / 4
        if len(self.memo) < MEMO:
            self.again |= fresh & self.once
        if len(self.again) >= TOGETHER:
            table, kept = self.lattices(sorted(self.again), self.kept.states)
            self.kept = self.kept.joined(table)
            self.memo.update(kept)
            fresh -= self.again
            self.again.clear()
            where = list(map(self.memo.get, everything))
        more = Tables(low=self.kept.states)
        if fresh:
            more, new = self.lattices(sorted(fresh), self.kept.states)
            where = [at or new[x] for x, at in zip(everything, where)]
        begin = np.array(where, "i8")
        state = (begin >> PLACE_BITS) + (begin & LONGEST)
        begin >>= PLACE_BITS
        per_text = np.array([len(s) for s in stretches], "i8")
        seeds = np.array([xxh64_intdigest(repr(k).encode(), seed) for k in keys], "u8")
        number = (np.arange(len(state)) - np.repeat(np.cumsum(per_text) - per_text, per_text)).astype("u8")
        with np.errstate(over="ignore"):
            stream = mixed(np.repeat(seeds, per_text) + number * np.uint64(0x9E3779B97F4A7C15))
        steps, drawn = np.zeros(len(state), "i8"), []
        known = begin < more.low
        for tables, active in ((self.kept, np.flatnonzero(known)), (more, np.flatnonzero(~known))):
            step = 0
            while len(active):
                with np.errstate(over="ignore"):
                    u = (mixed(stream[active] + np.uint64(step + 1) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(40)).astype("f4") * np.float32(2.0**-24)
                s = state[active]
                pick = tables.first[s - tables.low]
                left = np.flatnonzero(tables.shares[pick] <= u)
                while len(left):
                    pick[left] += 1
                    left = left[tables.shares[pick[left]] <= u[left]]
                drawn.append((active, tables.ids[pick], step))
                state[active] = s = s - tables.back[pick]
                steps[active] += 1
                active = active[s > begin[active]]
                step += 1
        if len(self.memo) < MEMO:
            self.once |= fresh
            if len(self.once) > ONCE:
                self.once.clear()
        elif many:
            self.clear()  # other texts than before
        offset = np.cumsum(steps) - steps
        out = np.zeros(int(steps.sum()), "i8")
        for a, i, k in drawn:
            out[offset[a] + steps[a] - 1 - k] = i
        size = np.add.reduceat(np.r_[steps, 0], np.minimum(np.cumsum(per_text) - per_text, len(steps))) * (per_text > 0) if len(per_text) else per_text
        over = np.flatnonzero(out >= self.size)
        if len(over):
            width = np.ones(len(out), "i8")
            width[over] = [len(self.rare_bytes[k - self.size]) for k in out[over].tolist()]
            text_of = np.repeat(np.arange(len(texts)), size)
            size = np.bincount(text_of, width, minlength=len(texts)).astype("i8")
            place = np.cumsum(width) - width
            wide = np.repeat(out, width)
            for p, k in zip(place[over].tolist(), out[over].tolist()):
                raw = self.rare_bytes[k - self.size]
                wide[p : p + len(raw)] = raw
            out = wide
        if len(self.rare) > 100_000:
            self.rare.clear()
            self.rare_bytes.clear()
            self.clear()
        return out.astype("<u4"), size

    def decode(self, ids) -> str:
        """The text of pieces, without the space that was put before it."""
        return b"".join(map(self.spelled.__getitem__, ids))[1:].decode()


_samplers: dict = {}


def sampler(path: str | None = None, alpha: float = ALPHA) -> Sampler:
    if (path, alpha) not in _samplers:
        only("samplers", _samplers.clear)
        _samplers[path, alpha] = Sampler(path, alpha)
    return _samplers[path, alpha]


def sample_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None, alpha: float = ALPHA, seed: int = SEED, ids: bool = True) -> DataFrame:
    """``key n_pieces ids_crc32 lossless`` (and ``ids``) of a sampled segmentation of each text.

    ``lossless``: whether the pieces, decoded, are the text; it is worked out for every row.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from labelkite.llm.encoding import chunks

        draw = sampler(path, alpha)
        for b in batches:
            keys, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            values = keys.to_pylist()
            for lo, hi in chunks(texts):
                found, size = draw.sample(texts[lo:hi], values[lo:hi], seed)
                ends = np.cumsum(size)
                raw = memoryview(found.tobytes())
                numbers = found.tolist()
                spans = list(zip((ends - size).tolist(), ends.tolist()))
                columns = [
                    keys.slice(lo, hi - lo),
                    pa.array(size.astype("i8")),
                    pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in spans], pa.int64()),
                    pa.array([draw.decode(numbers[s:e]) == t for (s, e), t in zip(spans, texts[lo:hi])]),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(found.astype("i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_pieces", "ids_crc32", "lossless", *["ids"] * ids])

    return bounded(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_pieces bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * ids)


def decode_pieces(rows: DataFrame, ids: str = "ids", text: str = "text", *, path: str | None = None) -> DataFrame:
    """``rows`` with the text of their pieces in place of the pieces; null for null."""
    names, kinds = [c for c in rows.columns if c not in (ids, text)], dict(rows.dtypes)

    def run(batches):
        import pyarrow as pa

        draw = sampler(path)
        for b in batches:
            texts = [None if x is None else draw.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(texts, pa.string())], names=[*names, text])

    return bounded(rows).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"`{text}` string"]))


def op6_piece_sampling(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    return sample_pieces(table(spark, sf_dir, "documents"), ids=False)
