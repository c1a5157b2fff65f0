"""Runs against brute force: every period of every text, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from labelkite.llm import periodic


def brute(words, least=24, periods=3):
    """All maximal stretches with period q, and then only those that have no smaller one."""
    n, found = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                stretch = words[i : j + q]
                if not any(all(stretch[k] == stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts(seed=3):
    rnd = random.Random(seed)
    out = [[], ["x"], ["x"] * 23, ["x"] * 24, ["x"] * 400, fibonacci(300), ["a", "b"] * 50 + ["a"], list("abcabcab") * 9, ["y", *["x"] * 30, "y", *["x"] * 30]]
    for size in (2, 3, 8):
        for _ in range(25):
            out.append([rnd.choice("abcdefgh"[:size]) for _ in range(rnd.randint(0, 150))])
    for _ in range(40):
        unit = [rnd.choice("abcdef") for _ in range(rnd.randint(1, 20))]
        out.append([rnd.choice("xyz") for _ in range(rnd.randint(0, 9))] + (unit * 12)[: rnd.randint(1, 12 * len(unit))] + [rnd.choice("xab") for _ in range(rnd.randint(0, 40))])
        nested = (unit[:3] * 9 + unit) * rnd.randint(2, 4)
        out.append(nested + nested[: rnd.randint(0, 20)])
    return out


def test_runs_are_those_of_brute_force():
    all_of = texts()
    assert periodic.word_runs(all_of) == [brute(w) for w in all_of]
    assert periodic.word_runs(all_of, 2, 2) == [brute(w, 2, 2) for w in all_of]
    assert sum(map(len, periodic.word_runs(all_of))) > 100


def test_long_positions_are_sorted_otherwise(monkeypatch):
    want = periodic.word_runs(texts(5))
    monkeypatch.setattr(periodic, "BITS", 5)
    assert periodic.word_runs(texts(5)) == want


def test_work_stays_near_linear():
    """Positions looked at for one word over and over: a logarithm of them each, not a share of the text."""
    n = 3000
    looked = 0
    state = periodic.Refinement(np.r_[np.zeros(n, "i8"), 1], np.full(n + 1, n))
    while len(state.small):
        looked += len(state.small)
        state.refine()
    assert looked < 4 * n * np.log2(n)


def expected(key, text):
    words = [w for w in _split(text or "") if w]
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if not found else 1000 * best[1] // best[2]
    return (key, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def _split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts(9))]
    rows += [(1000 + i, rnd.choice([" ", "\n", "\t "]).join(rnd.choice(["the", "of", "é", "\x85", "\x1c", "a"]) for _ in range(rnd.randint(0, 200)))) for i in range(150)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5, rows[4][1]), (5, rows[4][1])]
    spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id bigint, text string, runs string, n_words int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op12_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert any(r.n_runs and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in got)


def test_null_keys_and_empty_tables(spark):
    kind = "doc_id bigint, text string"
    assert periodic.runs(spark.createDataFrame([], kind)).count() == 0
    one = periodic.runs(spark.createDataFrame([(None, "z " * 30)], kind), change=periodic.planted).first()
    assert one.doc_id is None and [tuple(r) for r in one.runs] == [(0, 30, 1)] and one.collapsed == "z"


def test_one_long_text():
    unit = [str(i) for i in range(5000)]
    assert periodic.word_runs([unit * 4 + ["end"]]) == [[(0, 20000, 5000)]]
