"""SimHash by anchors against brute force over all pairs."""

import random

import numpy as np
import xxhash

from labelkite.llm import simhash
from labelkite.llm.common import written


def brute_print(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits=3):
    """Smallest key reachable, over a list of (key, print)."""
    root = {k: k for k, _ in prints}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, (k, f) in enumerate(prints):
        for j, g in prints[:i]:
            if (f ^ g).bit_count() <= bits:
                a, b = sorted((find(k), find(j)))
                root[b] = a
    return {k: find(k) for k in root}


def test_every_pair_meets_at_an_anchor():
    table = simhash.flips()
    words = np.random.default_rng(1).integers(0, 2**31, 300, dtype="u8")
    own = words ^ np.array([table[s][0] for s in simhash.syndrome(words)], "u8")
    assert (simhash.syndrome(own) == 0).all()
    for x, a in zip(words.tolist(), own.tolist()):
        for bit in range(31):
            y = x ^ 1 << bit
            s = int(simhash.syndrome(np.array([y], "u8"))[0])
            assert a in {y ^ m for m in table[s]}


def test_groups_match_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "one", "One two", "a b c", "A  b\tC", "x" * 3000]
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 12, 80, 400]))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            other = list(base)
            for _ in range(rnd.randint(0, 3)):
                other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
            texts.append(" ".join(other))
    rows = [(i, t) for i, t in enumerate(texts)]
    prints = written(simhash.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")), "t")
    got = simhash.grouped(prints).collect()
    want = [(i, brute_print(t)) for i, t in rows]
    assert {r.doc_id: r.fp0 & (2**64 - 1) for r in got} == dict(want)
    assert {r.doc_id: r.component_id for r in got} == brute_groups(want)


def test_hot_anchor_is_dealt_out_and_whole(spark, monkeypatch):
    """Thousands of fingerprints around one: tiles and blocks don't lose links."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    values = {base}
    for _ in range(600):
        v = base
        for _ in range(rnd.randint(1, 5)):
            v ^= 1 << rnd.randrange(64)
        values.add(v)
    values |= {rnd.getrandbits(64) for _ in range(300)}
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    prints = written(spark.createDataFrame([(i, v) for i, v in enumerate(signed)] + [(10_000, signed[0])], "doc_id bigint, fp0 bigint"), "t")
    got = {r.doc_id: r.component_id for r in simhash.grouped(prints).collect()}
    assert got == brute_groups([(i, v & (2**64 - 1)) for i, v in enumerate(signed)] + [(10_000, signed[0] & (2**64 - 1))])


def test_empty_table_and_repeated_rows(spark):
    empty = written(spark.createDataFrame([], "doc_id bigint, fp0 bigint"), "t")
    assert simhash.grouped(empty).count() == 0
    same = written(spark.createDataFrame([(7, 1), (7, 1), (None, 1)], "doc_id bigint, fp0 bigint"), "t")
    assert [r.component_id for r in simhash.grouped(same).collect()] == [7, 7, 7]


def test_lightest_forest_joins_all_with_least_weight():
    rnd = np.random.default_rng(6)
    for n, m in ((2, 1), (30, 60), (200, 900)):
        u, v, w = rnd.integers(0, n, m), rnd.integers(0, n, m), rnd.integers(0, 9, m)
        got = simhash.lightest_forest(u, v, w)
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        total = links = 0
        for i in np.argsort(w, kind="stable"):
            a, b = find(u[i]), find(v[i])
            if a != b:
                root[a] = b
                total += int(w[i])
                links += 1
        assert len(got) == links and int(w[got].sum()) == total


def test_near_duplicates_against_all_pairs(spark):
    """Groups by links of 0.8 over all pairs; texts so short that sketches are exact."""
    rnd = random.Random(8)
    texts = [None, "", "", "a b", "a b"]
    for _ in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for _ in range(rnd.randint(1, 5)):
            other = list(base)
            for _ in range(rnd.randint(0, 2)):
                other[rnd.randrange(len(other))] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(other))
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    docs = written(spark.createDataFrame(rows, "doc_id bigint, text string, node string"), "t")
    kept = {r.doc_id for r in simhash.near_duplicates(docs).collect()}

    def parts(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [parts(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a | b and len(a & b) / len(a | b) >= 0.8):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i for i in range(len(texts)) if find(i) == i}
    assert len(kept ^ want) <= 2  # a pair can lie too far apart in all fingerprints


def parts_of(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by(texts, links):
    """The smallest of each group that the pairs ``links`` of a similarity of at least 0.8 join."""
    sets, root = [parts_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = sets[i], sets[j]
        if a | b and len(a & b) / len(a | b) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def test_large_groups_of_edited_copies(spark):
    """Groups of 120: links of the forest fail, and others that met take their place."""
    rnd = random.Random(9)
    texts = []
    for rate in (100, 60, 60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(150, 400))]
        texts += [" ".join(f"x{rnd.randrange(5000)}" if rnd.random() < 1 / rate else w for w in base) for _ in range(120)]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "t")
    kept = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
    want = kept_by(texts, [(i, j) for i in range(len(texts)) for j in range(i)])
    print("large groups", len(kept), len(want), len(kept - want))
    assert len(kept ^ want) <= 2


def test_copies_changed_in_one_place(spark):
    """Cut, extended and block-replaced copies from 0.8 on; the words change with the part."""
    rnd = random.Random(10)
    word = lambda: f"w{rnd.randrange(50_000)}"
    texts, links = [], {}
    for kind in ("cut", "appended", "head", "replaced"):
        for _ in range(60):
            n = rnd.randint(60, 400)
            base = [word() for _ in range(n)]
            share = rnd.uniform(0.05, 0.18)
            m = int(n * share)
            if kind == "cut":
                other = base[: n - m]
            elif kind == "appended":
                other = base + [word() for _ in range(m)]
            elif kind == "head":
                other = [word() for _ in range(m // 2)] + base[m // 2 :]
            else:
                at = rnd.randrange(n - m)
                other = base[:at] + [word() for _ in range(m // 2)] + base[at + m // 2 :]
            a, b = parts_of(" ".join(base)), parts_of(" ".join(other))
            if len(a & b) / len(a | b) >= 0.8:
                links[len(texts), len(texts) + 1] = kind
            texts += [" ".join(base), " ".join(other)]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "t")
    kept = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
    met = {kind: (sum(k == kind and j not in kept for (_, j), k in links.items()), sum(k == kind for k in links.values())) for kind in links.values()}
    print("changed in one place, found of all:", met)
    assert len(links) > 150
    assert sum(n - found for found, n in met.values()) <= 1
    assert all(i in kept for i in range(0, len(texts), 2))


def test_long_pairs_close_to_the_threshold(spark):
    """Texts of more shingles than a sketch holds, true similarity 0.785 to 0.815: all their shingles decide."""
    rnd = random.Random(11)
    texts, links = [], []
    for i in range(60):
        n = rnd.randint(700, 1500)
        base = [f"w{rnd.randrange(50_000)}" for _ in range(n)]
        share = rnd.choice([rnd.uniform(0.785, 0.799), rnd.uniform(0.801, 0.815)])
        links.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(base[: round((n - 4) * share) + 4])]
    texts += [None, "", " ", "\n"]
    links += [(120, j) for j in (121, 122, 123)]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "t")
    kept = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
    want = kept_by(texts[:120], links[:60]) | {120}
    print("close to 0.8, wrong of 60:", len(kept ^ want), "gone", 124 - len(want))
    assert 10 < len(want & set(range(1, 120, 2))) < 50
    assert kept == want


def test_dense_groups_of_pairs_that_fail(spark, monkeypatch):
    """Copies edited so that most pairs fail, with chains that only some of them close: by blocks as by all pairs."""
    monkeypatch.setattr(simhash, "NODES", 16)  # many blocks
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 4, 8, 14])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, t) for i, t in rows[:5]] + [(600, None), (601, ""), (602, " ")]
    docs = written(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "docs")
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            u = sets[i] | sets[j]
            if i < j and (not u or len(sets[i] & sets[j]) >= 0.8 * len(u)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted(i for i in sets if find(i) == i)
    assert sorted(r.doc_id for r in simhash.near_duplicates(docs).collect()) == want and 20 < len(want) < 140


def test_judged_is_exact_for_whole_sets():
    rnd = np.random.default_rng(5)
    rows = [np.unique(rnd.integers(-40, 40, n).astype("i4")) for n in (0, 1, 5, 30, 60, 60)]
    like, exact = simhash.judged(rows, rows[::-1], 512)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[::-1]):
            u = len(np.union1d(a, b))
            assert exact[i, j] and like[i, j] == (len(np.intersect1d(a, b)) / u if u else 1.0)
    large = [np.sort(rnd.choice(10**6, 4000, replace=False).astype("i4")) for _ in range(2)]
    mixed = np.unique(np.r_[large[0][:3000], large[1][:1000]])
    truth = len(np.intersect1d(large[0], mixed)) / len(np.union1d(large[0], mixed))
    like, exact = simhash.judged([large[0][:512]], [mixed[:512]], 512)
    assert not exact[0, 0] and abs(like[0, 0] - truth) < 0.12
