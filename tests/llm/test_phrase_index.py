"""Phrases and proximity against brute force over all windows of all texts, and against DuckDB."""

import hashlib
import random
import re
from collections import Counter

import pytest

from labelkite.llm import phrase_index, queries
from labelkite.llm.phrase_index import SLOP, WINDOW
from tests.oracle import compare, connection

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans(phrase_index.UPPER, phrase_index.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOWERED))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(0, len(w) - WINDOW) + 1):
                windows.setdefault(tuple(w[i : i + WINDOW]), set()).add(str(item))
    counts, reach, out = Counter(x for _, t in docs for x in words(t)), WINDOW - 1 + SLOP, []
    for key, text in docs:
        w = words(text)
        hit, found, near = set(), set(), set()
        for win, of in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= of
            if all(counts[x] for x in win):
                rarest = min((counts[x], x) for x in win)[1]
                near |= {win for i, x in enumerate(w) if x == rarest and set(win) <= set(w[max(0, i - reach) : i + reach + 1])}
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=repr)


def cases(seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "x1", "the", "the", "the"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([10, 14, 30]))) for i in range(12)] + [(20, "Only THREE words"), (21, "one"), (22, ""), (23, None), (24, " .,! "), (25, "the " * 12), (None, text(20))]
    items += [(26, items[0][1]), (0, items[0][1]), (27, "never seen anywhere w1 w2 w3 w4 w5 w6 w7")]
    docs = [(i, text(rnd.randint(0, 120))) for i in range(60)]
    for i in range(40):
        w = words(items[rnd.randrange(len(items) - 1)][1]) or ["w1"]
        if i % 4 == 1:
            rnd.shuffle(w)  # near, not exact
        if i % 4 == 2:
            w[len(w) // 2 : len(w) // 2] = ["between"]
        docs.append((100 + i, f"{text(5)} {rnd.choice([', ', ' - ', chr(10)]).join(w).upper()}. {text(9)}"))
    docs += [(300, None), (301, ""), (302, "the " * 400), (303, "only three words one"), (5, docs[5][1]), (5, docs[5][1]), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("limit", [100_000, 0])
def test_against_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(phrase_index, "SMALL", limit)  # with and without broadcasts
    docs, items = cases()
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in phrase_index.op11_phrase_index(spark, str(tmp_path)).collect()), key=repr)
    want = brute(docs, items)
    assert got == want
    assert sum(r[5] for r in want) > 10 and any(r[6] > r[3] for r in want)


def test_against_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connection(sf), sf, queries.QUERIES["op11_phrase_index"], queries.ORACLES["op11_phrase_index"]) == ""


def test_small_bitmap_changes_nothing(spark, monkeypatch):
    docs, items = cases(7)
    one, two = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(phrase_index, "BITS", 64)
    assert sorted((tuple(r) for r in phrase_index.Index(one, two).verdicts().collect()), key=repr) == brute(docs, items)


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 2)], "doc bigint, text string, window string, at int")
    items = spark.createDataFrame([(1, "B C", 9)], "item_id bigint, text string, words int")
    got = phrase_index.Index(docs, items).verdicts().first()
    assert (got.doc, got.window, got["at"], got.n_words, got.n_hit, got.n_items, got.contaminated) == (1, "x", 2, 3, 2, 1, True)
    assert phrase_index.Index(docs, items.limit(0)).verdicts().first().n_hit == 0
    assert phrase_index.Index(docs.limit(0), items).verdicts().count() == 0


def test_no_python_in_the_plan(spark):
    docs, items = cases()
    found = phrase_index.Index(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    for df in (found.documents, found.matches(), found.verdicts()):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
