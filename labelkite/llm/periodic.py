"""Periodic runs of words by partition refinement.

Positions of a text are classed by the factor of ``l`` words that begins there, for ``l`` = 1, 2, ... A class falls apart
at the next length by the classes of its members' successors. Only successors in *small* classes need be looked at: of the
parts of a class that fell apart all but the largest, so a position is looked at a logarithmic number of times. Neighbours
in a class at a distance of just ``l`` begin a square of root ``l``; were its root a power of a shorter word, a nearer
neighbour would stand between, so these are exactly the squares with a primitive root, and squares of one root length at
consecutive positions make up a run with this smallest period.

A worker refines the texts of a block together (about ``BLOCK`` words), each step on arrays. A class holds positions of
one text, and a mark after each text is a class of its own, so texts don't meet. A text is refined up to the longest
period asked for, a share of its length.

Classes are stretches of one array; members also know their neighbours in order. The distances that come to be are noted
by value, and looked up again when the length reaches them.

Defined results: null text is the empty text and has no words. Rows are handled one by one: repeated rows repeat their
result, ids may be null or equal, an empty table gives an empty result, other columns pass through ``runs`` unseen.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import DataFrame

from labelkite.llm.common import bounded

#: A run has at least so many words, and so many times its period.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words refined together, about; a longer text is a block of its own.
BLOCK = 1_000_000
#: Bits of a position in sorted keys of three positions.
BITS = 21


def _sorted(*keys):
    """The columns ``keys``, sorted by all of them, the first one first."""
    import numpy as np

    if len(keys[0]) and max(int(k.max()) for k in keys) >> BITS:
        order = np.lexsort(keys[::-1])
        return [k[order] for k in keys]
    packed = keys[0].astype("i8")
    for k in keys[1:]:
        packed = packed << BITS | k
    packed.sort()
    return [packed >> BITS * (len(keys) - 1 - i) & (1 << BITS) - 1 for i in range(len(keys))]


def _ranges(first, size):
    """All numbers of the ranges that begin at ``first`` with ``size`` numbers each."""
    import numpy as np

    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class Refinement:
    """The classes of all positions of ``labels`` by factors of ``length`` labels. ``most``: the longest period of interest of each
    position's text."""

    def __init__(self, labels, most):
        import numpy as np

        n = len(labels)
        self.most, self.length = most, 1
        (cls, at) = _sorted(labels, np.arange(n))
        head = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]][:n])
        #: Members of classes, class by class; the place of each position there; first place and size of each class.
        self.members, self.place = at, np.empty(n, "i8")
        self.place[at] = np.arange(n)
        self.first, self.size = np.zeros(n + 1, "i8"), np.zeros(n + 1, "i8")
        self.classes = len(head)
        self.first[: len(head)], self.size[: len(head)] = head, np.diff(np.r_[head, n])
        self.cls = np.empty(n, "i8")
        self.cls[at] = np.repeat(np.arange(len(head)), self.size[: len(head)])
        #: Neighbours within the class; -1: none.
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        same = cls[1:] == cls[:-1]
        self.after[at[:-1][same]] = at[1:][same]
        self.before[at[1:][same]] = at[:-1][same]
        self.mark = np.zeros(n, bool)
        #: Positions by the distance to their next neighbour.
        self.noted = defaultdict(list)
        self.note(at[:-1][same])
        self.small = np.arange(n)

    def note(self, at):
        import numpy as np

        apart = self.after[at] - at
        use = (apart >= self.length) & (apart <= self.most[at])
        at, apart = at[use], apart[use]
        if not len(at):
            return
        apart, at = _sorted(apart, at)
        cut = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        for d, group in zip(apart[np.r_[0, cut]].tolist(), np.split(at, cut)):
            self.noted[d].append(group)

    def squares(self):
        """Where squares of a root of the present length begin."""
        import numpy as np

        found = self.noted.pop(self.length, None)
        if found is None:
            return None
        at = np.concatenate(found)
        at = at[self.after[at] - at == self.length]
        at.sort()
        return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else None

    def refine(self) -> None:
        """From factors of one length to those of the next."""
        import numpy as np

        self.length += 1
        t = self.small - 1
        t = t[(t >= 0) & (self.most[t] >= self.length)]
        t = t[self.size[self.cls[t]] > 1]
        self.small = t[:0]
        if not len(t):
            return
        d, c, t = _sorted(self.cls[t], self.cls[t + 1], t)
        # groups: members of one class with successors in one class
        new_d = np.r_[True, d[1:] != d[:-1]]
        head = np.flatnonzero(new_d | np.r_[True, c[1:] != c[:-1]])
        many = np.diff(np.r_[head, len(t)])
        at_d = np.flatnonzero(new_d[head])  # the first group of each class
        groups = np.diff(np.r_[at_d, len(head)])
        touched = np.add.reduceat(many, at_d)
        own = d[head[at_d]]
        rest = self.size[own] - touched
        falls = (groups > 1) | (rest > 0)
        if not falls.all():
            of_group = np.repeat(falls, groups)
            keep = np.repeat(of_group, many)
            d, t = d[keep], t[keep]
            if not len(t):
                return
            many, groups, touched, own, rest = many[of_group], groups[falls], touched[falls], own[falls], rest[falls]
            head, at_d = np.cumsum(many) - many, np.cumsum(groups) - groups
        # out of the old neighbourhoods, a stretch of neighbours at a time
        _, at = _sorted(d, t)
        joined = self.after[at[:-1]] == at[1:]
        left, right = self.before[at[np.r_[True, ~joined]]], self.after[at[np.r_[~joined, True]]]
        there = left >= 0
        self.after[left[there]] = right[there]
        there = right >= 0
        self.before[right[there]] = left[there]
        # into the new ones
        then, begins = np.empty_like(t), np.zeros(len(t), bool)
        begins[head] = True
        then[:-1], then[-1] = np.where(begins[1:], -1, t[1:]), -1
        changed = t[then != self.after[t]]
        self.after[t] = then
        self.before[t[1:]] = t[:-1]
        self.before[t[head]] = -1
        self.note(np.r_[left[(left >= 0) & (right >= 0)], changed[self.after[changed] >= 0]])
        # members move to the end of their class's places; what they displace goes to their old places
        zone = self.first[own] + rest
        places = _ranges(zone, touched)
        self.mark[t] = True
        there = self.members[places]
        stays = there[~self.mark[there]]
        old = self.place[t]
        gaps = old[old < np.repeat(zone, touched)]
        self.members[gaps] = stays
        self.place[stays] = gaps
        self.mark[t] = False
        self.members[places] = t
        self.place[t] = places
        # names: a class whose members all moved lends its name to the largest group
        largest = np.maximum.reduceat(many, at_d)
        by_group = np.repeat(np.arange(len(own)), groups)
        first_largest = np.full(len(own), len(many))
        np.minimum.at(first_largest, by_group, np.where(many == largest[by_group], np.arange(len(many)), len(many)))
        named = np.empty(len(many), "i8")
        lends = np.zeros(len(many), bool)
        lends[first_largest[rest == 0]] = True
        named[lends] = own[rest == 0]
        named[~lends] = self.classes + np.arange(len(many) - lends.sum())
        self.classes += int(len(many) - lends.sum())
        self.cls[t] = np.repeat(named, many)
        self.size[own[rest > 0]] = rest[rest > 0]
        self.first[named], self.size[named] = places[head], many
        # all parts but the largest are small
        big = np.zeros(len(many), bool)
        big[first_largest[rest < largest]] = True
        remains = (rest > 0) & (rest < largest)
        self.small = np.r_[t[~np.repeat(big, many)], self.members[_ranges(self.first[own[remains]], rest[remains])]]


def squares(labels, most):
    """(begin, root length) of all squares of a primitive root of up to ``most`` labels, as two arrays."""
    import numpy as np

    at, root = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    state = Refinement(labels, most) if len(labels) else None
    while state is not None:
        found = state.squares()
        if found is not None:
            at.append(found)
            root.append(np.full(len(found), state.length))
        if not len(state.small):
            break
        state.refine()
    return np.concatenate(at), np.concatenate(root)


def word_runs(texts: list[list], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The (start, length, period) of each text's runs of at least ``least`` words and ``periods`` periods, by start, then period."""
    import numpy as np

    out: list[list] = [[] for _ in texts]
    use = [k for k, w in enumerate(texts) if len(w) >= least]
    if not use:
        return out
    sizes = np.array([len(texts[k]) for k in use])
    first = np.cumsum(sizes + 1) - sizes - 1
    total, name = int(first[-1] + sizes[-1] + 1), 0
    labels, most = np.empty(total, "i8"), np.zeros(total, "i8")
    for k, a, n in zip(use, first.tolist(), sizes.tolist()):
        names = dict(zip(dict.fromkeys(texts[k]), range(name, name + n)))
        labels[a : a + n] = np.fromiter(map(names.__getitem__, texts[k]), "i8", n)
        most[a : a + n] = n // periods
        labels[a + n] = name + len(names)
        name += len(names) + 1
    at, root = squares(labels, most)
    if not len(at):
        return out
    root, at = _sorted(root, at)
    head = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (at[1:] != at[:-1] + 1)])
    period = root[head]
    length = np.diff(np.r_[head, len(at)]) - 1 + 2 * period
    long = length >= np.maximum(least, periods * period)
    begin, length, period = at[head][long], length[long], period[long]
    order = np.lexsort((period, begin))
    begin, length, period = begin[order], length[order], period[order]
    of = np.searchsorted(first, begin, "right") - 1
    for k, run in zip(of.tolist(), zip((begin - first[of]).tolist(), length.tolist(), period.tolist())):
        out[use[k]].append(run)
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """``words`` without those that repeat the first period of a run, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept, end = [], 0
    for start, stop in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[end:start]
        end = max(end, stop)
    return b" ".join(kept + words[end:])


def planted(words: list[bytes], key) -> list[bytes]:
    """A tenth of the rows, by a hash of the key, have their words from some place on replaced by a repeated stretch."""
    n = len(words)
    h = zlib.crc32(b"" if key is None else str(key).encode())
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def blocks(rows):
    """Lists of consecutive (key, words) of about ``BLOCK`` words in all."""
    held, size = [], 0
    for key, words in rows:
        held.append((key, words))
        size += len(words)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, change=None) -> DataFrame:
    """For each row of ``docs`` its ``key``, ``n_words``, ``runs`` (an array of start, length, period) and ``collapsed`` text.

    ``change``: a function of a row's words and key that gives the words to use.
    """
    kind = dict(docs.dtypes)[key]

    def find(batches):
        import pyarrow as pa

        entry = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def rows():
            for b in batches:
                for i, t in enumerate(b.column(1).to_pylist()):
                    words = (t or "").encode().split()
                    k = b.column(0)[i]
                    yield k, change(words, k.as_py()) if change else words

        for held in blocks(rows()):
            found = word_runs([w for _, w in held], least, periods)
            # results go out in parts, as the texts of a block are many
            for lo in range(0, len(held), 1000):
                part, their = held[lo : lo + 1000], found[lo : lo + 1000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k.as_py() for k, _ in part], part[0][0].type),
                        pa.array([len(w) for _, w in part], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in their], entry),
                        pa.array([collapsed(w, r).decode() for (_, w), r in zip(part, their)], pa.string()),
                    ],
                    names=[key, "n_words", "runs", "collapsed"],
                )

    return bounded(docs.select(key, text)).mapInArrow(find, f"`{key}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Each document's runs: their number, the one with the greatest exponent, and digests of all runs and of the collapsed text."""
    from pyspark.sql import functions as F

    from labelkite.session import table

    found = runs(table(spark, sf_dir, "documents"), change=planted)
    def better(x, y):
        """Order by length/period, exactly, the greatest first; ties by start, then period."""
        first = lambda a, b, other: F.when(a < b, -1).when(a > b, 1).otherwise(other)
        return first(y.length * x.period, x.length * y.period, first(x.start, y.start, first(x.period, y.period, 0)))

    best = F.get(F.array_sort("runs", better), 0)
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.floor(1000 * best.length / best.period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
