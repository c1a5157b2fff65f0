"""Alignment against whole texts, both libraries' plain calls and sums over all links."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from labelkite.llm import alignment

PARTS = [" ", "  ", "   ", "\n", "\r\n", "\t", "\x85", "\xa0", "\x1c", "​", "﻿", "　", "a", "the", "House", "Z", "é", "ß", "日本", "😀", "12", "'s", "...", ";\r", "<|endoftext|>", "<s>", "<0x41>", "\x00", "indivisible"]


def brute(rows):
    """Rows of the query, from whole texts alone."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(k): k for k in printable}
    letter |= {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in printable)}
    out, found = [], []
    for _, text in rows:
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ib = b.encode(text or "")
        ra = [bytes(letter[x] for x in a.id_to_token(k)) for k in ia]
        rb = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(ra) != raw or b"".join(rb) != raw:
            found.append(None)
            continue
        ends = lambda xs: [sum(map(len, xs[: k + 1])) for k in range(len(xs))]
        ea, eb = ends(ra), ends(rb)
        groups, links, last = [], [], 0
        for cut in sorted(set(ea) & set(eb)):
            inside = lambda ids, e: [i for i, x in zip(ids, e) if last < x <= cut]  # noqa: B023, E731
            groups.append(",".join(map(str, inside(ia, ea))) + "|" + ",".join(map(str, inside(ib, eb))))
            last = cut
        links = [(i, j) for j, y in zip(ib, eb) for i, x in zip(ia, ea) if x == y]
        found.append((len(ia), len(ib), groups, links))
    counts = Counter(link for f in found if f for link in f[3])
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    for (key, _), f in zip(rows, found):
        if f is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_best = sum(counts[x] == best[x[1]] for x in f[3])
            out.append((key, f[0], f[1], len(f[2]), len(f[3]), n_best, sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
    return out, counts, best


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    texts = [None, "", " ", "   ", "a", " a ", "a▁b", "▁", "\n", "word " * 500, "the the the", "the the the", "x" * 3000]
    texts += ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts += [" ".join(rnd.choice(["the", "house,", "and", "Straße", "de", "x1y"]) for _ in range(60)) for _ in range(30)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "  same id"), (3, "  same id"), (None, "null id")]


def test_query_against_brute_force(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 40)  # many blocks, some salts
    monkeypatch.setattr(alignment, "SALT_BLOCKS", 3)
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, kind string, block int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = alignment.op13_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, _, _ = brute(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 300


def test_pairs_and_groups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = alignment.align(docs, groups=True)
    counts = alignment.pair_counts(found)
    _, want, best = brute(rows)
    got = {(r.a_id, r.b_id): (r.links, r.best) for r in alignment.pairs(counts).collect()}
    assert got == {x: (n, n == best[x[1]]) for x, n in want.items()}
    whole = alignment.scored(found, counts).filter("doc_id = 4").first()
    (b,) = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode("a")
    (a,) = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(" a").ids
    assert whole.groups == f"{a}|{b}"


def test_units_kept_give_the_same(rows):
    tool = alignment.Aligner()
    texts = [t or "" for _, t in rows]
    first = tool.align(texts)
    tool.align(texts)  # kept from here on
    assert tool.memo and tool.align(texts) == first


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert alignment.op13_token_alignment(spark, str(tmp_path)).count() == 0
