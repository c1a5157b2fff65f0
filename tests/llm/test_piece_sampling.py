"""Sampled pieces: exact proportions by brute force, round trips, and one result whatever the partitions."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from labelkite.llm import piece_sampling as ps


@pytest.fixture(scope="module")
def draw():
    return ps.Sampler(alpha=2e-4)


def edges_of(draw, x):
    found = []
    draw.edges(x, 0, found)
    return sorted((e >> 32, (e >> 32) - (e >> 24 & 255), e & 0xFFFFFF) for e in found)


def all_paths(draw, x):
    """Each segmentation of a stretch with its weight."""
    edges = edges_of(draw, x)

    def from_(i):
        if i == len(x):
            yield (), 1.0
        for j, s, k in edges:
            if s == i:
                for path, w in from_(j):
                    yield (k, *path), w * draw.weight[k]

    return dict(from_(0))


def test_shares_are_the_weights(draw):
    paths = all_paths(draw, "▁there")
    n = 40_000
    ids, size = draw.sample(["there"] * n, list(range(n)))
    ends = np.cumsum(size)
    got = Counter(tuple(ids[e - s : e].tolist()) for s, e in zip(size, ends))
    assert set(got) <= set(paths)
    total = sum(paths.values())
    for path, w in paths.items():
        p = w / total
        assert abs(got[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_long_stretch_has_the_same_shares(draw):
    """Shares by logarithms are those of plain sums."""
    edges = edges_of(draw, "▁" + "internationalisation" * 2)
    ends, begins, ids = (np.array(v) for v in zip(*edges))
    w = draw.weight[ids]
    alpha = {0: 1.0}
    for j in sorted(set(ends)):
        alpha[j] = sum(alpha[b] * x for e, b, x in zip(ends, begins, w) if e == j)
    want = [alpha[b] * x / alpha[e] for e, b, x in zip(ends, begins, w)]
    assert np.allclose(draw._scaled(ends, begins, w), want)


def test_round_trip(draw):
    rnd = random.Random(4)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ps.VOCABULARY))
    marks = ["", " ", "  ", "\n", "\n\n", "\t", "a", "the", "Éa", "ß", "日本", "😀", "▁", "<s>", "<0x41>", "\0", "é", "x" * 90]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 12))) for _ in range(500)]
    ids, size = draw.sample(texts, list(range(len(texts))))
    ends = np.cumsum(size)
    for t, s, e in zip(texts, ends - size, ends):
        assert draw.decode(ids[s:e].tolist()) == t
        if "▁" not in t and "\0" not in t:
            assert sp.decode(ids[s:e].tolist()) == t.removeprefix(" ") or sp.decode(ids[s:e].tolist()) == t


def test_one_result_in_any_partitions(spark):
    rows = [(i, t) for i, t in enumerate(["The small test", None, "", "once more, with feeling", "The small test"] * 4)] + [(None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = sorted(map(tuple, ps.sample_pieces(docs.repartition(1)).collect()), key=repr)
    b = sorted(map(tuple, ps.sample_pieces(docs.repartition(5)).collect()), key=repr)
    assert a == b and all(r[3] for r in a)
    back = {r.doc_id: r.text for r in ps.decode_pieces(ps.sample_pieces(docs)).collect()}
    assert back == {k: t or "" for k, t in rows}
    assert ps.sample_pieces(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
