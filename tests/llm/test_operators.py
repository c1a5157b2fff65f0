"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelkite.llm import chunk_dedup, encoding, line_rules, ordinal, packing, simhash, sketch, token_file, warc
from labelkite.llm.common import scratch_path, written

WORDS = "the of and to in house river, Mountain. seven! éclair façade 12 x".split()


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    out = [None, "", " \n\t ", "one", "a b c d", "same text here", "same text here", "x" * 5000, "word " * 3000, "a b c a b c a b c"]
    out += [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([3, 40, 300]))).replace(" 12 ", "\n") for _ in range(n)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", i) for i, t in enumerate(texts())]
    return written(spark.createDataFrame(rows, "doc_id bigint, text string, key string, piece bigint"), "docs")


def whole(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for x in texts()]


@pytest.mark.parametrize("name", sorted(encoding.STRETCHES))
def test_stretches_give_the_ids_of_whole_texts(name):
    rnd = random.Random(2)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\x85", "\xa0", "\x1c", "​", "a", "Z", "é", "é", "ß", "İ", "Σ", "ς", "日本", "😀", "12", "'s", "'", ".", "...", "<|endoftext|>", "_"]
    fuzz = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    e = encoding.Encoder(name)
    assert e.encode(fuzz) == e.library(fuzz)
    assert e.encode(fuzz) == e.library(fuzz)  # from the memo


def test_strings_of_special_tokens_are_these_tokens():
    for name, one in (("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 49407)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        want = t.encode("a <|endoftext|> b", add_special_tokens=False).ids
        got = encoding.Encoder(name).encode(["a <|endoftext|> b"])[0]
        assert np.frombuffer(got, "<u4").tolist() == want and one in want


def test_packing(spark, docs):
    got = packing.pack_documents(docs).collect()
    ids = whole(packing.VOCABULARY, packing.END)
    want = {}
    for d, x in enumerate(ids):
        cuts = [0, *range(len(x) % 2048 or 2048, len(x) + 1, 2048)]
        for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[d, p] = (s, e - s, zlib.crc32(x[s:e].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 2048
    assert len(bins) <= 1 + sum(map(len, ids)) // 2048 + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_patterns_are_what_packing_bin_by_bin_gives():
    """A pattern used many times is the same choice made many times."""
    rnd = random.Random(3)
    for _ in range(20):
        counts = Counter(rnd.choice([3, 5, 8, 13, 21, 34]) for _ in range(rnd.randint(1, 80)))
        many = [tuple(sorted(d.items())) for b, d in packing.patterns(dict(counts), 40) for _ in range(b)]
        left, one = dict(counts), []
        while left:
            first = next(iter(packing.patterns(left, 40)))[1]
            one.append(tuple(sorted(first.items())))
            left = {n: c - first.get(n, 0) for n, c in left.items() if c > first.get(n, 0)}
        assert many == one
        assert sum((Counter(dict(d)) for d in many), Counter()) == counts


def test_best_two_beats_the_smallest():
    assert packing.best_two([4, 5, 7], {4: 1, 5: 1, 7: 1}, 10, 6) == (5, 4)
    assert packing.best_two([5], {5: 1}, 10, 6) is None  # there is only one
    assert packing.best_two([5], {5: 2}, 10, 6) == (5, 5)
    assert packing.best_two([2, 3], {2: 1, 3: 1}, 10, 6) is None


def test_blocks_round_trip():
    rnd = np.random.default_rng(4)
    for values in ([], [7], rnd.integers(0, 2**32, 1000), rnd.integers(5, 9, 256), np.full(700, 2**32 - 1), np.r_[rnd.integers(0, 50, 600), 2**31, 2**32 - 1], rnd.integers(0, 49408, 5000)):
        v = np.array(values, "u4")
        data = token_file.pack_stream(v)
        assert (token_file.unpack_stream(data) == v).all()
        assert (token_file.unpack_stream(data, 1, 3) == v[256:768]).all()


def test_token_file(spark, docs):
    path = scratch_path(spark, "tokens")
    token_file.write_tokens(docs.repartition(3), path)
    start = 0
    rows = {r.doc_id: r for r in token_file.read_tokens(spark, path, ids=True).collect()}
    for d, x in enumerate(whole(token_file.VOCABULARY, token_file.END)):
        r = rows[d]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(x), zlib.crc32(x.tobytes()), x.tolist())
        start += len(x)


def test_sketches(spark):
    a, b = "a b c d e f g h i j", "a b c d e f g h x y"
    df = spark.createDataFrame([(a, b), (a, a), ("", None), ("", "x"), ("p q", "p q")], "a string, b string")
    s = df.select(sketch.sketch(F.coalesce("a", F.lit(""))).alias("a"), sketch.sketch(F.coalesce("b", F.lit(""))).alias("b"))
    got = s.select(sketch.resemblance(F.col("a"), F.col("b")).alias("r"), sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.distinct_count(F.col("a")).alias("n")).collect()
    assert [r.r for r in got] == [0.5, 1.0, 1.0, 0.0, 1.0]
    assert [round(r.c, 3) for r in got] == [0.667, 1.0, 1.0, 1.0, 1.0] and [r.n for r in got] == [6, 6, 0, 0, 1]


def test_sketches_estimate_and_merge(spark):
    rnd = random.Random(5)
    left = " ".join(str(rnd.random()) for _ in range(3000))
    right = " ".join(left.split()[:2000] + [str(rnd.random()) for _ in range(1000)])
    s = spark.createDataFrame([(left, right)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"), sketch.bottom(F.concat(sketch.shingle_hashes(F.col("a")), sketch.shingle_hashes(F.col("b")))).alias("both"))
    r = s.select(sketch.resemblance(F.col("a"), F.col("b")).alias("r"), sketch.distinct_count(F.col("a")).alias("n"), (sketch.merge(F.col("a"), F.col("b")) == F.col("both")).alias("m")).first()
    assert abs(r.r - 0.5) < 0.15 and abs(r.n / 2996 - 1) < 0.3 and r.m


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_document(spark, buckets):
    rows = [(i * 7 % 31, f"t{i}") for i in range(31)]
    sent, order = sketch.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", buckets)
    got = {r.doc_id: r.next for r in sent.withColumn("next", F.lead("text").over(order)).filter("copied = 0").collect()}
    by_id = dict(rows)
    assert {k: v if v is not None else by_id[30] for k, v in got.items()} == {k: by_id[k - 1] if k else by_id[30] for k in by_id}


def brute_edit(rows):
    """(n_chars, sha256 of the edited text, exact likeness to it and to the next text) of each id."""
    order = sorted(rows, key=lambda r: -r[0])
    shingles = lambda t: {" ".join(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t)] for i in range(max(1, len(w) - 4)) if w}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    out = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), like(shingles(t), shingles(edited)), like(shingles(t), shingles(after)))
    return out


def test_all_of_op4_against_brute_force(spark, tmp_path):
    """Texts of fewer shingles than a sketch has, so that its likeness is exact."""
    rnd = random.Random(6)
    rows = [(i * 7 % 61, rnd.choice([None, "", "é😀" * 9, "same words here again and again in it"])) for i in range(12)]
    rows += [(100 + i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([2, 30, 90])))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sketch.op4_sketches(spark, str(tmp_path)).collect()}
    want = brute_edit(rows)
    assert set(got) == set(want)
    for i, (n, sha, edited, after) in want.items():
        assert (got[i].n_chars, got[i].edited_sha256) == (n, sha)
        assert got[i].near_edited == pytest.approx(edited) and got[i].near_next == pytest.approx(after)
    equal = {r.fingerprint for i, r in got.items() if dict(rows)[i] == "same words here again and again in it"}
    assert len(equal) <= 1


@pytest.mark.parametrize("rows", [[(None, "b"), (None, "a"), (None, "c")], [], [(5, "x"), (5, "y"), (None, "z"), (7, "q")]])
def test_next_document_of_null_and_equal_ids(spark, rows):
    sent, order = sketch.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 4)
    got = [tuple(r) for r in sent.withColumn("next", F.lead("text").over(order)).filter("copied = 0").select("doc_id", "text", "next").collect()]
    first = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    assert sorted(got, key=repr) == sorted([(*r, first[(i + 1) % len(first)][1]) for i, r in enumerate(first)], key=repr)


def test_sketches_of_parts_merge(spark):
    rnd = random.Random(8)
    rows = [(i % 3, " ".join(str(rnd.randrange(3000)) for _ in range(200))) for i in range(40)]
    df = spark.createDataFrame(rows, "part int, text string")
    got = {r.part: r.sketch for r in sketch.merged_by(df.select("part", sketch.sketch(F.col("text")).alias("sketch")), ["part"]).collect()}
    whole_parts = df.groupBy("part").agg(F.flatten(F.collect_list(sketch.shingle_hashes(F.col("text")))).alias("h")).select("part", sketch.bottom(F.col("h")).alias("s"))
    assert got == {r.part: r.s for r in whole_parts.collect()}


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_line_rules(spark):
    good = "A plain sentence about the river and the house, with words enough to stay. " * 1
    more = [good + "\n" + "WOW!! BUY!! NOW!! CHEAP!! GREAT!! MORE!!\n" + "home | shop | cart | help", "a | b | c | d | e\n" * 12, "$$$ *** ### word " * 20, "same line here\nsame line here\n \nother # line"]
    more.append(" ".join(f"w{i} and{i % 7}" for i in range(60)) + "\nAll rights reserved.\n" + " ".join(f"v{i}" for i in range(60)))
    rows = [(i, t, "x", True) for i, t in enumerate(texts(7) + more)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lost string, kept boolean")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: r for r in line_rules.judge(df).collect()}
    for i, t, *_ in rows:
        assert tuple(got[i][n] for n in names) == brute_rules(t), repr(t)[:80]
    assert got[len(rows) - 1].kept and not got[len(rows) - 4].kept
    kept = {r.doc_id: r for r in line_rules.clean(df).collect()}
    assert set(kept) == {i for i in got if got[i].kept} and kept[len(rows) - 1].lost == "x"
    assert kept[len(rows) - 1].text == more[-1].replace("All rights reserved.\n", "")
    assert line_rules.judge(df.limit(0)).count() == 0


def test_line_reasons(spark):
    text = "Home\nAbout us\n\nContact\nShop\nCart\nA real sentence is here.\nThe\nBUY NOW AND SAVE MORE THAN EVER BEFORE.\nWe use cookies, see our privacy policy."
    long = "A long line of text that says very much and somewhere in it the privacy policy is named, but it goes on and on with many more words to be read."
    df = spark.createDataFrame([(text,), (long + " " + long,), ("a\nb\nc\nd\n",)], "t string")
    got = [r.r for r in df.select(line_rules.line_reasons(F.col("t")).alias("r")).collect()]
    assert got[0] == ["menu", "menu", None, "menu", "menu", "menu", None, "fragment", "capitals", "boilerplate"]
    assert got[1] == [None] and got[2] == ["fragment"] * 4 + [None]


def test_columns_of_any_name_pass_through(spark):
    """Names that the operators use themselves."""
    names = "_hash _key _mark _m _numbers fp fp0 _row _text node root mark".split()
    kind = "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)
    text = "A plain sentence about the river and the house, with words enough to stay for long. " * 6
    rows = [(i, text + f"It ends by number {i // 2}.", *names) for i in range(6)]
    docs = written(spark.createDataFrame(rows, kind), "names")
    for out in (simhash.near_duplicates(docs), chunk_dedup.dedup(docs).drop("words_cut"), line_rules.clean(docs, max_repeat_percent=100), ordinal.score(docs, None).select(*docs.columns)):
        got = out.collect()
        assert got and out.columns == docs.columns and all(tuple(r)[2:] == tuple(names) for r in got)
    assert line_rules.judge(docs).first()["_m"] == "_m"
    prints = simhash.fingerprints(docs)
    assert {r.fp for r in simhash.grouped(prints).collect()} == {"fp"}


def test_warc_of_other_writers():
    """Folded headers, no space behind the colon, foreign ids, no HTTP head, no digest, false magic, records over ranges."""
    body = b"payload" * 50_000
    odd = b"WARC/1.0\r\nWARC-Type:resource\r\nWARC-Record-ID: <urn:x:1>\r\nX-Long: a\r\n b\r\nnot a header\r\nContent-Length:%d\r\n\r\n" % len(body)
    data = warc.GZIP_MAGIC + b"no" + __import__("gzip").compress(odd + body + b"\r\n\r\n") + warc.page_record(7, None, b"x", None, False) + warc.GZIP_MAGIC
    read_at = lambda n, place: data[place : place + n]
    for size in (50, 1 << 20):
        found = [warc.parse(x) for lo in range(0, len(data), size) for x in warc.members_in(read_at, lo, min(len(data), lo + size), chunk=64)]
        assert [x["warc-type"] for x in found] == ["resource", "response"] and found[0]["x-long"] == "a b"
        assert warc.page_of(found[0]["warc-record-id"]) is None and warc.page_of(found[1]["warc-record-id"]) == 7
        assert warc.payload_of(found[0]) == (body, len(body), warc.digest(body)) and warc.payload_of(found[1])[0] == b"x"


def test_warc_round_trip(spark, monkeypatch):
    rnd = random.Random(9)
    pages = [(1, "http://a/ü x", "<p>é</p>"), (2, None, None), (3, "u", ""), (9, "u", "<p>é</p>"), (9, "u", "<p>é</p>"), (5, "u", "<p>é</p>"), (-4, "u", "big" * 200_000), (None, "n", "own")]
    pages += [(i, f"http://h/{i}", "".join(chr(rnd.randrange(32, 500)) for _ in range(rnd.randrange(3000)))) for i in range(100, 160)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    archives = warc.write_archives(df, scratch_path(spark, "warc"))
    for size in (700, 1 << 22):
        got = sorted(map(tuple, warc.read_archives(archives, range_bytes=size).drop("url").collect()), key=repr)
        first = {}
        for p, _, h in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0)):
            first.setdefault(h or "", p)
        want = []
        for p, _, h in pages:
            b, f = (h or "").encode(), first[h or ""]
            own = p is None or p == f
            want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else f))
        assert got == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(df.limit(0), scratch_path(spark, "warc"))).count() == 0


def test_ids_of_records():
    for p in (None, 0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(p)) == p


def test_repeated_passages_go_once(spark):
    rnd = random.Random(11)
    fresh = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage, phrase = fresh(60), fresh(9)
    rows = [(i, f"{fresh(80 + i)} {passage} {fresh(70)}" if i < 12 else f"{fresh(100)} {phrase} {fresh(50)}", i) for i in range(30)] + [(40, None, 1), (41, "", 1), (42, "word " * 500, 1)]
    docs = written(spark.createDataFrame(rows, "doc_id bigint, text string, place bigint"), "t")
    got = {r.doc_id: (r.text, r.words_cut) for r in chunk_dedup.dedup(docs).collect()}
    before = {r[0]: r[1] for r in rows}
    assert got[0] == (before[0], 0)  # the first one keeps it
    for i in range(1, 12):
        words = before[i].split()
        left = got[i][0].split()
        assert 30 <= got[i][1] <= 62 and len(left) == len(words) - got[i][1]
        assert left[:70] == words[:70] and left[-60:] == words[-60:] and passage not in got[i][0]
    for i in [*range(12, 30), 40, 41]:
        assert got[i] == (before[i], 0)
    assert chunk_dedup.dedup(written(docs.limit(0), "t")).count() == 0


def test_chunks_move_with_the_text():
    rnd = random.Random(12)
    text = " ".join(f"w{rnd.randrange(10**5)}" for _ in range(2000)).encode()

    def cut(t):
        b, e, _, _ = chunk_dedup.chunk_ends([t])
        return {t[x:y] for x, y in zip(b, e)}

    assert len(cut(text) - cut(b"some words more " + text[:5000] + b" put in here " + text[5000:])) <= 6


def test_sample_of_the_classifier_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordinal, "fit", lambda rows: seen.extend(rows))
    docs = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.lit("some words here").alias("text"))
    ordinal.train(docs, spark.createDataFrame([(0, 0), (1, 2)], "doc_id bigint, grade int"), sample=2)
    assert len(seen) == 2


def test_gradient_of_the_classifier():
    """At the fitted weights the penalised likelihood, worked out plainly, can't be raised much along any direction tried."""
    rnd = np.random.default_rng(3)
    rows = [(int(g), rnd.choice(np.arange(g * 10, g * 10 + 25), 8, replace=False).astype("i4"), np.ones(8, "f4")) for g in rnd.integers(0, 3, 300)]
    w, theta = ordinal.fit(rows, steps=400)
    y = np.array([r[0] for r in rows])
    weight = (1 / np.bincount(y) ** 0.5)[y]
    weight /= weight.sum()

    def loss(w, theta):
        s = np.array([w[p].sum() for _, p, _ in rows])
        cut = np.r_[-np.inf, theta, np.inf]
        p = 1 / (1 + np.exp(-(cut[y + 1] - s))) - 1 / (1 + np.exp(-(cut[y] - s)))
        return -(weight * np.log(p)).sum() + ordinal.PENALTY * 1e-2 / 2 * (w * w).sum()

    best = loss(w.astype("f8"), theta)
    used = np.unique(np.concatenate([r[1] for r in rows]))
    for k in used:
        for step in (-0.05, 0.05):
            other = w.astype("f8").copy()
            other[k] += step
            assert loss(other, theta) > best - 2e-3
    for k in (0, 1):
        for step in (-0.05, 0.05):
            other = theta.copy()
            other[k] += step
            assert loss(w.astype("f8"), other) > best - 2e-3


def brute_repeats(texts):
    """Chunks met before, by a dictionary of their bytes."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        data = chunk_dedup.clean_bytes(t)
        begin, end, *_ = chunk_dedup.chunk_ends([data])
        for n, (s, e) in enumerate(zip(begin, end)):
            if data[s:e] in seen:
                out.setdefault(i, set()).add(n)
            seen.add(data[s:e])
    return out


def test_repeats_against_brute_force(spark):
    rnd = random.Random(14)
    parts = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.choice([5, 40, 80]))) for _ in range(12)]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(4)) if i % 5 else None) for i in range(60)]
    docs = written(spark.createDataFrame(rows, "doc_id bigint, text string"), "t")
    found = written(chunk_dedup.chunks(docs, "doc_id", "text"), "chunks")
    got = {r.key: set(r.numbers) for r in chunk_dedup.repeats(found).collect()}
    assert got == brute_repeats(dict(rows))


def test_quality_classifier(spark):
    """Held-out accuracy over three kinds of text, and what happens without labels."""
    rnd = random.Random(13)
    plain = lambda: " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(80))
    kinds = [lambda: plain() + " you idiot clown " + plain(), lambda: " ".join(w + "***" for w in plain().split()), plain]
    rows = [(i, kinds[i % 3](), i % 3) for i in range(600)]
    docs = spark.createDataFrame(rows + [(1000, None, 2), (1001, "", 2)], "doc_id bigint, text string, kept int")
    grades = spark.createDataFrame([(i, g) for i, _, g in rows[:400]], "doc_id bigint, grade int")
    model = ordinal.train(docs, grades)
    assert (np.diff(model[1]) > 0).all()
    got = {r.doc_id: r for r in ordinal.score(docs, model).collect()}
    right = sum(got[i].kept == (g == 2) for i, _, g in rows[400:])
    assert right >= 195 and got[1000].tail_probability == got[1001].tail_probability
    assert ordinal.train(docs, grades.limit(0)) is None
    assert {(r.kept, r.expected_grade) for r in ordinal.score(docs, None).collect()} == {(True, None)}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in ordinal.graded(labels).collect()} == {(1, 0), (2, 1)}


def test_packing_and_merging_with_clashing_names(spark):
    names = ["_bucket", "_before", "_rank", "_length", "_b", "sequence_id", "offset", "size", "bucket", "before", "rank"]
    docs = written(spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("length"), *[F.lit(-5).alias(n) for n in names]), "clash")
    got = packing.pack(docs, ["doc_id"], capacity=10).collect()
    assert {r.doc_id for r in got} == set(range(40)) and all(r._bucket == r.rank == r.size == -5 for r in got)
    held = Counter()
    for r in got:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 10 and sum(held.values()) == sum(i % 7 + 1 for i in range(40))
    rows = spark.createDataFrame([(1, 1, [1, 2]), (1, 1, [2, 3]), (2, 1, [9])], "part int, _part int, _fan array<bigint>")
    assert {(r.part, tuple(r._fan)) for r in sketch.merged_by(rows, ["part", "_part"], "_fan").collect()} == {(1, (1, 2, 3)), (2, (9,))}


def test_dropped_tables_under_a_folder_with_a_blank(spark, tmp_path, monkeypatch):
    from labelkite.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}/a b")
    table = written(spark.range(3), "gone")
    assert table.count() == 3 and list((tmp_path / "a b").iterdir())
    common.dropped(table)
    assert not list((tmp_path / "a b").iterdir())


def test_caches_of_one_operator_at_a_time():
    from labelkite.llm import common

    encoding.encoder("byte_bpe_50k.json").encode(["some text"])
    assert encoding._encoders
    ordinal.features().of("some text")
    assert not encoding._encoders and ordinal._features
    ordinal.features().of("some more")
    common.only("simhash")
    assert not ordinal._features and not common._caches
    encoding.encoder("byte_bpe_50k.json")
    encoding.encoder("word_bpe_49k.json")
    assert len(encoding._encoders) == 2
