"""SimHash near-duplicates by anchor-point covering.

A fingerprint has a bit set where over half of a text's feature hashes have it. To find all pairs of fingerprints that
differ in at most three bits, note that one half of the 64 bits differs in at most one. Of each half 31 bits are covered
by the perfect Hamming(31, 26) code: each value lies within one bit (the covering radius) of exactly one code word, its
anchor. A fingerprint is sent to every anchor within two bits (covering radius plus the threshold of one), at most 16 for
each half, and compared at each anchor with the fingerprints whose own anchor this is. So each pair meets, and an anchor
holds few fingerprints, since there are 2 ** 26 of them for each half.

Equal fingerprints are one row from the start. An anchor with many fingerprints of its own is dealt out in tiles of at
most ``TILE`` of them; the others stream past each tile. Of the links found together only a forest that joins the same
fingerprints is passed on, so rows never grow with the square of a group. Groups are then found by large-star and
small-star steps on those links, each written to the shared folder.

Defined results: null text is the empty text; texts without words have the fingerprint zero and are linked as any other.
A null id never is the smallest. An empty table gives an empty result; other columns pass through ``near_duplicates``,
whatever their names.
"""

from __future__ import annotations

from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.common import bounded, dropped, fresh, let, only, written

BITS = 3
TILE = 2048
#: Own rows up to which a group is compared together with others.
SMALL = 64
#: Comparisons held at once.
BLOCK = 100_000
#: Fingerprints that are replicated to their anchors at once.
SLICE = 20_000


def hashed(text: str | None, width: int, seed: int, distinct: bool = False):
    """The 64-bit hashes of the shingles of a text, as an array of unsigned integers."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both on ASCII alone
    if len(w) >= width:
        found = w if width == 1 else list(map(b" ".join, zip(*(w[i:] for i in range(width)))))
    else:
        found = [b" ".join(w)] if w else []
    if distinct:
        found = list(set(found))
    return np.fromiter(map(xxh64_intdigest, found, repeat(seed)), "u8", len(found))


def majority(hashes) -> int:
    """Bits that are set in over half of ``hashes``."""
    import numpy as np

    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, "i8")
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i4")
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", *, width: int = 3, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> DataFrame:
    """``docs`` without ``text``, with a fingerprint (long) for each seed: ``fp0``, ``fp1`` ..., in place of columns of these names."""
    rest = [c for c in docs.columns if c != text and c.lower() not in [f"fp{k}" for k in range(len(seeds))]]
    kinds = dict(docs.dtypes)

    def run(batches):
        only("simhash")
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = [[majority(hashed(t, width, s, distinct)) for s in seeds] for t in b.column(text).to_pylist()]
            columns = np.array(found, "u8").reshape(-1, len(seeds)).view("i8")
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(columns[:, k].copy()) for k in range(len(seeds))], names=[*rest, *(f"fp{k}" for k in range(len(seeds)))])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"fp{k} bigint" for k in range(len(seeds))])
    return bounded(docs.select(*rest, text)).mapInArrow(run, schema)


def flips() -> tuple:
    """For each of the 32 syndromes of the Hamming code the bits to turn for all code words within two bits, the nearest first."""
    out = [[0]]
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        out.append([1 << (s - 1)] + [1 << (i - 1) | 1 << (j - 1) for i, j in pairs])
    return tuple(out)


def syndrome(x):
    """Of 31-bit values: the exclusive or of the places (from 1) of their bits."""
    import numpy as np

    s = np.zeros(len(x), "u8")
    for k in range(5):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1))
        s |= (np.bitwise_count(x & mask) & 1).astype("u8") << np.uint64(k)
    return s


def anchored(values: DataFrame) -> DataFrame:
    """(fp, ...) to (anchor, away, fp, ...): a row for the own anchor of each half (away 0) and one for each anchor within two
    bits (away 1)."""
    rest = [c for c in values.columns if c != "fp"]

    def run(batches):
        only("simhash")
        import numpy as np
        import pyarrow as pa

        table = flips()
        masks = np.zeros((32, 16), "u8")
        sizes = np.array([len(t) for t in table])
        for s, t in enumerate(table):
            masks[s, : len(t)] = t
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                fp = b.column("fp").to_numpy(zero_copy_only=False).view("u8")
                for half in (0, 1):
                    x = (fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
                    s = syndrome(x).astype("i8")
                    n = sizes[s]
                    row = np.repeat(np.arange(len(fp)), n)
                    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    tag = np.uint64(half << 31)
                    anchor = np.concatenate([(x ^ masks[s, 0]) | tag, (x[row] ^ masks[s[row], at]) | tag])
                    away = np.repeat(np.array([0, 1], "i4"), [len(fp), len(row)])
                    take = pa.array(np.concatenate([np.arange(len(fp)), row]))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view("i8")), pa.array(away), *(b.column(c).take(take) for c in ["fp", *rest])], names=["anchor", "away", "fp", *rest])

    kinds = dict(values.dtypes)
    return bounded(values.select("fp", *rest)).mapInArrow(run, "anchor bigint, away int, fp bigint" + "".join(f", {c} {kinds[c]}" for c in rest))


def forest(a, b):
    """(child, root) links that join just the values that the links (a, b) join."""
    import numpy as np

    if not len(a):
        return a, b
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = where[: len(a)], where[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[child], ids[root[child]]


def lightest_forest(u, v, weight):
    """Which of the links (u, v) form a forest of least weight that joins what they join (Boruvka's rounds)."""
    import numpy as np

    if not len(u):
        return np.zeros(0, "i8")
    _, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = where[: len(u)], where[len(u) :]
    n = int(where.max()) + 1
    rank = np.empty(len(u), "i8")
    rank[np.argsort(weight, kind="stable")] = np.arange(len(u))
    by_rank = np.argsort(rank)
    root, chosen, alive = np.arange(n), [], np.arange(len(u))
    while True:
        a, b = root[u[alive]], root[v[alive]]
        cross = a != b
        alive, a, b = alive[cross], a[cross], b[cross]
        if not len(alive):
            return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, "i8")
        best = np.full(n, len(u), "i8")
        np.minimum.at(best, a, rank[alive])
        np.minimum.at(best, b, rank[alive])
        heads = np.flatnonzero(best < len(u))
        edge = by_rank[best[heads]]
        chosen.append(edge)
        other = np.where(root[u[edge]] == heads, root[v[edge]], root[u[edge]])
        up = np.arange(n)
        up[heads] = other
        # two that chose the same link: the smaller one stays
        pair = (up[up[heads]] == heads) & (heads < up[heads])
        up[heads[pair]] = heads[pair]
        while (up != up[up]).any():
            up = up[up]
        root = up[root]


def meetings(group, away):
    """Which rows meet in groups of rows, own ones (away 0) first: blocks of index pairs (own, other) from small groups, and
    of ranges (own from, to, other from, to) from large ones."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(group)])
    homes = np.add.reduceat((away == 0).astype("i8"), starts)
    others = size - homes
    use = np.flatnonzero((homes > 0) & (others > 0))
    small = use[homes[use] <= SMALL]
    ends = np.cumsum(homes[small] * others[small])
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
        g = small[lo:hi]
        other = np.repeat(starts[g] + homes[g], others[g]) + np.arange(others[g].sum()) - np.repeat(np.cumsum(others[g]) - others[g], others[g])
        per = np.repeat(homes[g], others[g])
        first = np.repeat(starts[g], others[g])
        yield "pairs", np.repeat(first, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per), np.repeat(other, per)
        lo = hi
    for g in use[homes[use] > SMALL]:
        begin, middle, end = int(starts[g]), int(starts[g] + homes[g]), int(starts[g] + size[g])
        step = max(1, BLOCK // (middle - begin))
        for k in range(middle, end, step):
            yield "block", (begin, middle), (k, min(end, k + step))


def by_group(groups: DataFrame, compare, schema: str) -> DataFrame:
    """Run ``compare(columns, meetings)`` over rows (anchor, tile, away, ...) partitioned by anchor and tile and sorted by these.

    Of a group that goes on in the next batch the own rows are held over.
    """

    def run(batches):
        only("simhash")
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            anchor, tile, away = columns[:3]
            group = np.cumsum(np.r_[False, (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])])
            a, b = compare(columns, meetings(group, away))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            keep = (group == group[-1]) & (away == 0)
            held = [x[keep] for x in columns]

    return bounded(groups).mapInArrow(run, schema)


def dealt(rows: DataFrame, spread: str) -> DataFrame:
    """Rows (anchor, away, ...) partitioned and sorted by anchor and tile: the own rows of a hot anchor are dealt out by a
    hash of ``spread``, the others go to all of its tiles."""
    counts = rows.filter("away = 0").groupBy("anchor").count().filter(F.col("count") > TILE)
    tiled = written(counts.select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "hot")
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.array(F.pmod(F.xxhash64(spread), tiles).cast("int"))
    rest = [c for c in rows.columns if c not in ("anchor", "away")]
    placed = rows.join(tiled, F.col("anchor") == F.col("hot"), "left").select(
        "anchor", F.explode(F.when(F.col("away") == 0, own).otherwise(F.sequence(F.lit(0), tiles - 1))).alias("tile"), "away", *rest
    )
    return placed.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", "away")


def links(values: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join all which differ in at most ``bits`` bits (3 at most).

    ``values`` must be a stored table of distinct values.
    """
    if not 0 <= bits <= BITS:
        raise ValueError("the covering is made for at most 3 bits")

    def compare(columns, met):
        import numpy as np

        fp, found = columns[3].view("u8"), []
        for kind, x, y in met:
            if kind == "pairs":
                left, right = fp[x], fp[y]
                near = (np.bitwise_count(left ^ right) <= bits) & (left != right)
                left, right = left[near], right[near]
            else:
                i, j = np.nonzero(np.bitwise_count(fp[slice(*x), None] ^ fp[None, slice(*y)]) <= bits)
                left, right = fp[x[0] + i], fp[y[0] + j]
                left, right = left[left != right], right[left != right]
            found.append(forest(left, right))
        if not found:
            return fp[:0], fp[:0]
        child, root = forest(*(np.concatenate(v) for v in zip(*found)))
        return child.view("i8"), root.view("i8")

    return by_group(dealt(anchored(values.select("fp")), "fp"), compare, "a bigint, b bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b", *, most: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge, where root is the smallest node of its component.

    Large-star and small-star steps by turns, until the edges are stars. A node with many edges is summed up before the
    shuffle. The least neighbours are written before they are joined: so Spark broadcasts them where they are few, and else
    splits the partition of a node with many edges, which it doesn't where a join stands in one stage with an aggregate.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = written(e, "edges")
    for _ in range(most):
        ends = e.select("u", "v", F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))
        low = ends.groupBy("u").agg(F.min("v").alias("m"), F.sum("up").alias("up"), F.count("*").alias("n"))
        # in stars a node with a smaller neighbour has no other one
        low = written(low.select(F.col("u").alias("k"), F.least("u", "m").alias("m"), ((F.col("up") > 0) & (F.col("n") > 1)).alias("open")), "low")
        if low.filter("open").isEmpty():
            dropped(low)
            break
        large = written(ends.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "low")
        small = large.join(lower, F.col("u") == F.col("k")).select("u", "v", "m")
        last = [e, low, large, lower]
        e = written(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct(), "edges")
        dropped(*last)
    else:
        raise RuntimeError(f"no stars after {most} steps")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def grouped(prints: DataFrame, key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """Rows (key, fp0) with ``component_id``: the smallest key whose fingerprint can be reached by links of at most ``bits`` bits."""
    classes = written(prints.groupBy(F.col("fp0").alias("fp")).agg(F.min(key).alias("first")), "classes")
    joined = components(written(links(classes, bits), "links"))
    rooted = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r"), "lowest")
    rest = [c for c in prints.columns if c.lower() != "component_id"]
    (fp,) = fresh(rest, "fp")
    named = rooted.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias(fp), "component_id")
    return prints.select(*rest).join(named, F.col("fp0") == F.col(fp)).drop(fp)


#: Distance of an estimate by sketches from the similarity asked for that settles a pair: over five deviations at k = 512.
CLEAR = 0.1
#: Of a text's least values under so many permutations, the first ``LANES * ROWS`` make lanes and all give a bit each.
PERMUTATIONS, LANES, ROWS = 128, 20, 5
#: Of 128 bits, how many may differ: at similarity 0.8 some 12.8 do, with a deviation of 3.4.
LEAST_BITS = 30
#: Nodes of a block that are compared with all of another, and values whose marks are held at once.
NODES, COLUMNS = 512, 4096


def least(hashes):
    """Of distinct shingles' hashes: keys of lanes (two texts agree in one with the fifth power of their similarity), and 128
    bits (two texts differ in half of those in which their least values do)."""
    import numpy as np

    mix = np.random.default_rng(2024)
    add, times = (mix.integers(0, 2**63, PERMUTATIONS, dtype="u8") * np.uint64(2) + np.uint64(1) for _ in range(2))
    low = np.full(PERMUTATIONS, 2**64 - 1, "u8")
    for i in range(0, len(hashes), 2048):
        np.minimum(low, ((hashes[i : i + 2048, None] ^ add) * times).min(0), out=low)
    bits = np.packbits((low & np.uint64(1)).astype("u1"), bitorder="little").view("u8")
    if not len(hashes):
        return low[:0], bits
    lanes = (low[: LANES * ROWS].reshape(LANES, ROWS) * times[: LANES * ROWS].reshape(LANES, ROWS)).sum(1, dtype="u8")
    return lanes ^ (lanes >> np.uint64(29)), bits


def texts_seen(docs: DataFrame, key: str, text: str, *, width: int, seeds: tuple[int, ...], k: int) -> DataFrame:
    """For each document ``key mark node fp0 fp1 ... low high lanes parts``: two hashes of the text, fingerprints of its distinct words,
    its distinct shingles in ``least``, and the ``k`` smallest 32-bit hashes of them."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        only("simhash")
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for b in batches:
            texts = b.column(1).to_pylist()
            node, prints, bits, lanes, parts = [], [], [], [], []
            for t in texts:
                shingles = np.unique(hashed(t, width, 42))
                keys, of = least(shingles)
                lanes.append(keys.view("i8"))
                bits.append(of)
                node.append(xxh3_64_intdigest((t or "").encode()))
                prints.append([majority(hashed(t, 1, s, True)) for s in seeds])
                parts.append(np.unique(shingles.astype("u4").view("i4"))[:k])
            prints = np.array(prints, "u8").reshape(-1, len(seeds)).view("i8")
            bits = np.array(bits, "u8").reshape(-1, 2).view("i8")
            columns = [b.column(0), b.column(2), pa.array(np.array(node, "u8").view("i8")), *(pa.array(prints[:, i].copy()) for i in range(len(seeds)))]
            columns += [pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), pa.array(lanes, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "mark", "node", *(f"fp{i}" for i in range(len(seeds))), "low", "high", "lanes", "parts"])

    schema = f"key {kind}, mark int, node bigint, " + "".join(f"fp{i} bigint, " for i in range(len(seeds))) + "low bigint, high bigint, lanes array<bigint>, parts array<int>"
    return bounded(docs.select(key, text, F.hash(text))).mapInArrow(run, schema)


def in_lanes(values: DataFrame) -> DataFrame:
    """(node, lanes, ...) to (anchor, away, node, ...): two rows, own and other, for each lane that another node has as well."""
    rest = [c for c in values.columns if c != "lanes"]
    rows = values.select(F.explode("lanes").alias("anchor"), "node")
    several = written(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "several")
    shared = written(rows.join(several, "anchor", "left_semi"), "lanes")
    return shared.join(values.select(*rest), "node").select("anchor", F.explode(F.array(F.lit(0), F.lit(1))).alias("away"), *rest)


def apart_by(low, high, x, y):
    """In how many of their least bits rows differ."""
    import numpy as np

    return np.bitwise_count(low[x] ^ low[y]).astype("i2") + np.bitwise_count(high[x] ^ high[y])


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``node`` that meet in rows (anchor, away, node, low, high) and differ in at most ``LEAST_BITS`` of their least bits.

    Of the pairs that meet in a block only a forest of the closest ones goes on, so pairs grow with the rows and not with the
    square of a group. A link of the forest can fail where another one would have passed: see ``within``.
    """

    def compare(columns, met):
        import numpy as np

        anchor, node, low, high = columns[0], columns[3], columns[4].view("u8"), columns[5].view("u8")
        left, right = [], []
        for kind, x, y in met:
            if kind == "pairs":
                use = np.flatnonzero(node[x] != node[y])
                x, y = x[use], y[use]
            else:
                i, j = np.nonzero(np.bitwise_count(low[slice(*x), None] ^ low[None, slice(*y)]) <= LEAST_BITS)
                x, y = x[0] + i, y[0] + j
                use = node[x] != node[y]
                x, y = x[use], y[use]
            far = apart_by(low, high, x, y)
            near = far <= LEAST_BITS
            x, y, far = x[near], y[near], far[near]
            # a node's rows at one anchor are one vertex
            both = np.concatenate([x, y])
            with np.errstate(over="ignore"):
                _, vertex = np.unique(anchor[both] * np.int64(0x9E3779B97F4A7C1) ^ node[both], return_inverse=True)
            best = lightest_forest(vertex[: len(x)], vertex[len(x) :], far)
            left.append(node[x[best]])
            right.append(node[y[best]])
        if not left:
            return node[:0], node[:0]
        pair = np.unique(np.sort(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=1), axis=0)
        return pair[:, 0].copy(), pair[:, 1].copy()

    return by_group(dealt(rows.select("anchor", "away", "node", "low", "high"), "node"), compare, "a bigint, b bigint").distinct()


def shared(x, y):
    """How many values each array of ``x`` has in common with each of ``y``, as a matrix; arrays have no value twice."""
    import numpy as np

    out = np.zeros((len(x), len(y)), "f4")
    values = np.concatenate([*x, *y]) if len(x) + len(y) else np.zeros(0, "i4")
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in [*x, *y]])
    _, place = np.unique(values, return_inverse=True)
    left = row < len(x)
    both = np.intersect1d(place[left], place[~left])
    at = np.searchsorted(both, place)
    use = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == place) if len(both) else both
    at, row = at[use], row[use]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for lo in range(0, len(both), COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + COLUMNS])
        marks = np.zeros((len(x) + len(y), min(COLUMNS, len(both) - lo)), "f4")
        marks[row[i:j], at[i:j] - lo] = 1
        out += marks[: len(x)] @ marks[len(x) :].T
    return out


def judged(x, y, k: int):
    """(similarity, whether it is exact) of each array of ``x`` and each of ``y``, which hold the ``k`` smallest hashes of sets.

    Arrays with fewer are whole sets. Else what lies below the smaller of the two largest values is compared.
    """
    import numpy as np

    top = lambda rows: np.array([v[-1] if len(v) >= k else 2**31 for v in rows], "i8")
    size = lambda rows: np.array([len(v) for v in rows], "i8")
    a, b = np.broadcast_to(size(x)[:, None], (len(x), len(y))), np.broadcast_to(size(y), (len(x), len(y)))
    whole = (size(x) < k)[:, None] & (size(y) < k)
    if not whole.all():
        a = np.stack([np.searchsorted(v, top(y), "right") for v in x])
        b = np.stack([np.searchsorted(v, top(x), "right") for v in y], 1)
    both = shared(x, y).astype("i8")
    union = a + b - both
    return np.where(union == 0, 1.0, both / np.maximum(union, 1)), whole


def within(rows: DataFrame, similarity: float, k: int) -> DataFrame:
    """(a, b, sure) from rows (comp, node, tree, parts): links between the trees of each component, by comparing all its nodes of
    different trees. Links that are not ``sure`` need all shingles to tell.

    A component's nodes are dealt into blocks of about ``NODES``, those of its largest tree apart, and compared by two blocks at
    a time, but for two of that tree. Of the sure links of two blocks only a forest goes on.
    """
    by_tree = rows.groupBy("comp", "tree").agg(F.count("*").alias("n"))
    sizes = by_tree.groupBy("comp").agg(F.count("*").alias("trees"), F.sum("n").alias("all"), F.max(F.struct("n", "tree")).alias("top")).filter("trees > 1")
    sizes = written(sizes.select(F.col("comp").alias("c"), F.col("top.tree").alias("largest"), *(F.ceil(n / NODES).cast("int").alias(x) for n, x in ((F.col("all") - F.col("top.n"), "others"), (F.col("top.n"), "mine")))), "open")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("tree") == F.col("largest"), F.col("mine")).otherwise(F.col("others"))).cast("int")
    block = own + F.when(F.col("tree") == F.col("largest"), F.col("others")).otherwise(0)
    dealt_to = F.sequence(F.lit(0), F.col("others") + F.when(F.col("block") < F.col("others"), F.col("mine")).otherwise(0) - 1)
    tile = F.transform(dealt_to, lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    placed = rows.join(sizes, F.col("comp") == F.col("c")).withColumn("block", block).select("comp", "node", "tree", "parts", "block", F.explode(tile).alias("tile"))
    tiles = placed.select("comp", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), (F.col("block") != F.col("tile.i")).cast("int").alias("side"), "node", "tree", "parts")

    def links_of(same: bool, held):
        import numpy as np

        side = np.array([r[0] for r in held])
        node, tree = np.array([r[1] for r in held], "i8"), np.array([r[2] for r in held], "i8")
        x = np.flatnonzero(side == 0)
        y = x if same else np.flatnonzero(side == 1)
        apart = tree[x][:, None] != tree[y]
        if not apart.any():
            return []
        parts = [r[3] for r in held]
        like, exact = judged([parts[i] for i in x], [parts[i] for i in y], k)
        sure = apart & np.where(exact, like >= similarity, like >= similarity + CLEAR)
        open_ = apart & ~exact & (like >= similarity - CLEAR) & ~sure
        i, j = np.nonzero(sure)
        child, root = forest(tree[x[i]], tree[y[j]])
        i, j = np.nonzero(open_)
        i, j = x[i], y[j]
        now = dict(zip(child.tolist(), root.tolist()))
        named = np.array([now.get(t, t) for t in tree.tolist()], "i8")
        use = (named[i] != named[j]) & ((not same) | (node[i] < node[j]))
        return [(child, root, True), (node[i[use]], node[j[use]], False)]

    def run(batches):
        only("simhash")
        import numpy as np
        import pyarrow as pa

        present, held = None, []

        def sent():
            for a, b, sure in links_of(present[1] == present[2], held):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(a, "i8")), pa.array(np.asarray(b, "i8")), pa.array([sure] * len(a))], names=["a", "b", "sure"])

        for batch in batches:
            parts = batch.column("parts")
            values, cut = parts.values.to_numpy(), parts.offsets.to_numpy()
            numbers = (batch.column(c).to_pylist() for c in ("comp", "i", "j", "side", "node", "tree"))
            for n, (comp, i, j, side, node, tree) in enumerate(zip(*numbers)):
                if (comp, i, j) != present:
                    if held:
                        yield from sent()
                    present, held = (comp, i, j), []
                held.append((side, node, tree, values[cut[n] : cut[n + 1]].copy()))
        if held:
            yield from sent()

    return bounded(tiles.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")).mapInArrow(run, "a bigint, b bigint, sure boolean")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(node, text) to (node, all): the hashes of all distinct shingles."""

    def run(batches):
        only("simhash")
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = [np.unique(hashed(t, width, 42)).view("i8") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "all"])

    return bounded(docs.select("node", "text")).mapInArrow(run, "node bigint, all array<bigint>")


def united(tables) -> DataFrame:
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = 5, similarity: float = 0.8, seeds: tuple[int, ...] = (42,), k: int = 512) -> DataFrame:
    """The documents that stay: of each group that links of at least ``similarity`` join, the one with the smallest key.

    At 64 bits a similarity of 0.8 of five-word shingles is some ten bits away, too far for a covering. The fingerprints of
    a text's distinct words are much closer (mostly within three bits), so these choose the pairs; and each
    pair is then compared by its shingles: exactly where each has fewer than ``k`` distinct ones; beyond, the ``k`` smallest
    hashes settle what they put ``CLEAR`` away from ``similarity``, and the others are compared by all their shingles.
    Copies that are cut, extended or changed in one place have other words, so lanes of the shingles' least values choose pairs
    as well: at 0.8 one of 20 is equal in all but 4 of 10,000 pairs. Pairs whose least bits are clearly apart don't count as
    met. A forest of the pairs that meet joins texts to loose components and is compared first; what its links leave apart
    within a loose component is then compared node by node, so documents are joined just as if all pairs within it had been.
    Rows of equal key and text are one document and stay or go together. ``docs`` must be a stored table.
    """
    from labelkite.llm.sketch import resemblance

    def jaccard(a: str, b: str):
        """Of two whole sets; two empty ones are equal."""
        return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))

    seen = written(texts_seen(docs, key, text, width=width, seeds=seeds, k=k), "seen")
    columns = [f"fp{i}" for i in range(len(seeds))]
    nodes = written(seen.groupBy("node").agg(*(F.min(c).alias(c) for c in [*columns, "low", "high"]), F.first("lanes").alias("lanes")), "nodes")

    def settled(unclear: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that are alike by all their shingles."""
        asked = unclear.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        first = seen.join(asked, F.col("node") == F.col("n"), "left_semi").groupBy("node").agg(F.min(F.struct(F.col("key").isNotNull().alias("x"), "key", "mark")).alias("first"))
        # one row of each text; rows of equal key and hash are equal texts
        first = written(first.select("node", F.col("first.key").alias("k"), F.col("first.mark").alias("m")), "first")
        texts = docs.select(F.col(key).alias("key"), F.hash(text).alias("mark"), F.col(text).alias("text"))
        texts = texts.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m"))).select("node", "text")
        sets = written(sets_of(texts, width).dropDuplicates(["node"]), "sets")
        exact = unclear.join(sets.select(F.col("node").alias("a"), F.col("all").alias("pa")), "a").join(sets.select(F.col("node").alias("b"), F.col("all").alias("pb")), "b")
        return exact.filter(jaccard("pa", "pb") >= similarity).select("a", "b")

    def alike(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        parts = written(seen.join(used, F.col("node") == F.col("n"), "left_semi").groupBy("node").agg(F.first("parts").alias("parts")), "parts")
        both = pairs.join(parts.select(F.col("node").alias("a"), F.col("parts").alias("pa")), "a").join(parts.select(F.col("node").alias("b"), F.col("parts").alias("pb")), "b")
        whole = (F.size("pa") < k) & (F.size("pb") < k)
        like = both.select("a", "b", whole.alias("whole"), F.when(whole, jaccard("pa", "pb")).otherwise(resemblance(F.col("pa"), F.col("pb"), k)).alias("s"))
        like = written(like.filter(F.col("s") >= F.when(F.col("whole"), F.lit(similarity)).otherwise(F.lit(similarity - CLEAR))), "judged")
        open_ = (~F.col("whole")) & (F.col("s") < similarity + CLEAR)
        out = written(like.filter(~open_).select("a", "b").unionByName(settled(like.filter(open_).select("a", "b"))), "alike")
        dropped(like)
        return out, parts

    def met(of: DataFrame) -> list[DataFrame]:
        near = [anchored(of.select(F.col(c).alias("fp"), "node", "low", "high")).drop("fp") for c in columns]
        return [*near, in_lanes(of.select("node", "lanes", "low", "high"))]

    pairs = written(united(candidates(rows) for rows in met(nodes)).distinct(), "pairs")
    first, parts = alike(pairs)
    trees = written(components(first), "trees").select(F.col("node").alias("n"), F.col("root").alias("tree"))
    # each node that met any other is in a loose component
    loose = written(components(pairs), "loose").select("node", F.col("root").alias("comp"))
    inside = written(loose.join(trees, F.col("node") == F.col("n"), "left").select("comp", "node", F.coalesce("tree", "node").alias("tree")), "inside")
    found = written(within(inside.join(parts, "node"), similarity, k), "within")
    second = written(found.filter("sure").select("a", "b").unionByName(settled(found.filter("not sure").select("a", "b"))), "second")
    # the trees join what their links do, and are stars already
    joined = trees.filter("n <> tree").select(F.col("n").alias("a"), F.col("tree").alias("b"))
    linked = written(joined.unionByName(second), "linked")
    dropped(pairs, parts, loose, inside, found, trees, first, second)
    groups = components(linked).select(F.col("node").alias("n"), "root")
    named = seen.select("key", "mark", "node").join(groups, F.col("node") == F.col("n"), "left").select("key", "mark", F.coalesce("root", "node").alias("root"))
    named = written(named, "named")
    place = F.struct(F.col("key").isNull().alias("x"), "key", "mark")
    # written before they are joined, and only of groups with several rows, so that a group with many is split or its least row broadcast
    lowest = written(named.groupBy(F.col("root").alias("r")).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("r", "first"), "lowest")
    k, m, h = fresh(docs.columns, "_key", "_mark", "_hash")
    gone = named.join(lowest, F.col("root") == F.col("r")).filter(place != F.col("first")).select(F.col("key").alias(k), F.col("mark").alias(m)).distinct()
    gone = written(gone, "gone")
    dropped(seen, nodes, linked, named, lowest)
    # fewer documents go than stay, and only their ids and hashes are needed
    return docs.withColumn(h, F.hash(text)).join(gone, F.col(key).eqNullSafe(F.col(k)) & (F.col(h) == F.col(m)), "left_anti").select(*docs.columns)


def op10_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    prints = written(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "prints")
    return grouped(prints).select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
