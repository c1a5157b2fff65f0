"""Readers, writers, samples and the stream."""

import json

from pyspark.sql import functions as F

from labelkite.operators import export, extract, quality, ranking
from labelkite.sources import files, samples
from labelkite.streaming import events


def test_definitions(spark, tmp_path):
    rule = {"rule_id": "R1", "rule_number": "1", "check_type": "net_quantity", "weight": 2.0, "critical": True, "applicability": {"packaging": "any"}, "params": {"fields": ["net_quantity"]}}
    (tmp_path / "a.json").write_text(json.dumps({"rules": [rule], "manual_only_rules": [rule | {"rule_id": "R2"}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "listings").mkdir()
    (tmp_path / "listings" / "c.json").write_text(json.dumps({"checks": [{"check_id": "c", "legal_status": "odd", "fields": ["mrp"], "minimum_ratio": 0.6}]}))
    assert sorted(r.rule_id for r in files.rule_definitions(spark, str(tmp_path)).collect()) == ["R1", "R2"]
    assert files.listing_checks(spark, str(tmp_path / "listings")).first().legal_status == "LEGAL_REFERENCE_REQUIRES_VERIFICATION"


def test_manifest_and_annotations(spark, tmp_path):
    (tmp_path / "m.csv").write_text("# comment\nfile,field\na.jpg,mrp\n")
    assert files.manifest(spark, str(tmp_path / "m.csv"), "file string, field string").collect()[0].field == "mrp"
    (tmp_path / "p1.json").write_text(json.dumps({"product_id": "p1", "views": [], "fields": {"mrp": {"value": "12"}}}))
    (tmp_path / "_schema.json").write_text("{}")
    assert [r.product_id for r in files.annotations(spark, str(tmp_path)).collect()] == ["p1"]


def test_observations(spark):
    reply = '```json\n{"fields": [{"field": "marketed_by", "value": " Acme ", "confidence": 7, "bbox": [0, 0, 1, 1]}, {"field": "odd", "value": "x"}, {"field": "mrp", "value": "5", "bbox": [1]}]}\n``` done'
    got = spark.createDataFrame([(reply,), ("no json",), (None,)], "r string").select(files.observations(F.col("r"), ("marketer", "mrp")).alias("o")).collect()
    assert [(o.field, o.value, o.confidence, o.bbox) for o in got[0].o] == [("marketer", "Acme", 1.0, [0.0, 0.0, 1.0, 1.0]), ("mrp", "5", 0.0, None)]
    assert got[1].o == [] == got[2].o


def test_exports(spark, tmp_path):
    f = spark.createDataFrame([(1, "mrp", "12", "DETECTED", 0.9), (1, "brand", " ", "UNCERTAIN", 0.4)], "inspection_id bigint, field_name string, value string, state string, confidence double")
    assert {r.field_name: r.confidence for r in export.export_fields(f).collect()} == {"mrp": 0.9, "brand": None}
    export.write_csv(f, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    d = export.document(spark.range(1, 3).withColumnRenamed("id", "inspection_id"), fields=f).collect()
    assert {r.inspection_id: len(r.fields) for r in d} == {1: 2, 2: 0}
    assert export.upserted(f, f.filter("field_name = 'mrp'").withColumn("value", F.lit("13")), ["inspection_id", "field_name"]).filter("value = '13'").count() == 1
    assert export.markdown(f.filter("field_name = 'mrp'"), ["field_name", "value"]).first().line == "| mrp | 12 |"
    t = spark.createDataFrame([({"ocr": 10, "rules": 2},), ({"ocr": 20},)], "timings map<string,bigint>")
    assert {r.stage: r.mean_ms for r in export.stage_latency(t).collect()} == {"ocr": 15.0, "rules": 2.0}
    export.append_audit(f, str(tmp_path / "log"))
    export.append_audit(f, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_samples_are_read_back(spark):
    s = samples.samples(spark, 400)
    assert s.collect() == samples.samples(spark, 400).repartition(3).orderBy("sample_id").collect()
    clean = s.select(F.col("sample_id").alias("inspection_id"), F.lit(1).cast("bigint").alias("image_id"), F.lit(0).cast("bigint").alias("line_index"), F.col("clean_text").alias("text"), F.lit(0.9).alias("confidence"))
    won = ranking.winners(extract.candidates(clean)).select(F.col("inspection_id").alias("sample_id"), F.col("field_name").alias("field"), "value", "confidence")
    rows = s.select("sample_id", F.col("field_name").alias("field"), F.col("expected").alias("truth")).join(won, ["sample_id", "field"], "left")
    acc = {r.field: r.accuracy for r in quality.field_accuracy(rows).collect()}
    assert acc["mrp"] > 0.9 and acc["net_quantity"] > 0.9 and acc["fssai_license"] > 0.9 and acc["batch_lot"] > 0.9


def test_stream_agrees_with_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    q = events.daily_trend(events.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("trend").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {(r.day, r.event_type): r.n for r in spark.table("trend").collect()}
    finally:
        q.stop()
    want = {(r.day, r.event_type): r.n for r in src.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
