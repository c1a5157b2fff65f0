"""The five stages on small tables: planted cases, nulls, empty texts, repeated rows, no labels."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark, tmp_path):
    rnd = random.Random(21)
    sentence = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(12)) + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    passage = text(6)
    plain = {i: text(12) for i in range(10)}
    rows = [(i, t) for i, t in plain.items()]
    near = plain[0].split()
    near[5] = "changed"
    rows += [(100, plain[0]), (101, " ".join(near)), (102, text(8) + " " + passage + " " + text(8)), (103, text(8) + " " + passage + " " + text(8))]
    rows += [(200, None), (201, ""), (202, "too short"), (203, "$$$ *** ### word " * 40), (1, plain[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, found = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        found[name] = kept = spark.read.parquet(path)
        assert name == "best-fit packing" or kept.columns == docs.columns
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in found.items()}
    clean = [*range(10), 1, 100, 101, 102, 103]
    assert ids["quality rules"] == ids["quality classifier"] == sorted(clean)  # without labels everything stays
    assert ids["SimHash near-dedup"] == sorted([*range(10), 1, 102, 103])  # rows of equal id and text stay together
    cut = {r.doc_id: r for r in found["substring dedup"].collect()}
    assert passage in cut[102].text and passage not in cut[103].text and cut[103].n_chars == len(cut[103].text)
    assert set(ids["best-fit packing"]) == set(ids["substring dedup"])
    assert found["best-fit packing"].filter(F.col("sequence_id").isNull()).count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
