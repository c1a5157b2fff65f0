"""Lost spaces, corrected digits and snapshots: planted cases and brute force."""

import random

from labelkite.operators import ranking, repair, snapshots


def respaced(spark, texts, words=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    words = repair.vocabulary(spark) if words is None else spark.createDataFrame([(w,) for w in words], "word string")
    return [r.text for r in repair.respaced(df, "text", words).orderBy("id").collect()]


def test_spaces_come_back(spark):
    got = respaced(spark, ["HERBALSOAPWITH12OILS", "Pkd.By  TEAPOWDER", "(COCOAPOWDER),", "GHEE", "NATURAL", "Mfd. by AvA", "FRESHMILKS", "freshmilk", None, "", "PUREHONEY!", "5kg"])
    assert got == ["HERBAL SOAP WITH 12 OILS", "Pkd. By TEA POWDER", "(COCOAPOWDER),", "GHEE", "NATURAL", "Mfd. by AvA", "FRESHMILKS", "freshmilk", None, "", "PUREHONEY!", "5 kg"]


def brute(run, words):
    """The first way that leads to each place, from left to right."""
    came = {0: []}
    for i in range(len(run)):
        if i in came:
            for j in range(i + 2, len(run) + 1):
                if j not in came and run[i:j].lower() in words:
                    came[j] = [*came[i], run[i:j]]
    return None if run.lower() in words else came.get(len(run))


def test_decomposition_against_brute_force(spark):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(2, 4))) for _ in range(9)} | {"a", "abababab"}
    runs = ["".join(rnd.choice("AB") for _ in range(rnd.randint(7, 14))) for _ in range(200)] + ["ABABABAB"]
    got = {r.run: r.pieces for r in repair.decomposed(spark.createDataFrame([(r,) for r in runs], "run string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {r: p for r in set(runs) if (p := brute(r, {w for w in words if len(w) > 1}))}
    assert got == want and 5 < len(want) < len(set(runs))


def test_shown_values_keep_what_was_read(spark):
    df = spark.createDataFrame([("product_name", "TEAPOWDER"), ("net_quantity", "TEAPOWDER"), ("brand", "KEPT"), ("packer", None)], "field_name string, value string")
    got = {r.field_name: (r.value, r.raw_value, r.respaced) for r in repair.shown(df, repair.vocabulary(spark)).collect()}
    assert got == {"product_name": ("TEA POWDER", "TEAPOWDER", True), "net_quantity": ("TEAPOWDER", "TEAPOWDER", False), "brand": ("KEPT", "KEPT", False), "packer": (None, None, False)}


def test_second_run(spark):
    rows = ["MRP Rs. 2OO.00", "Net Wt. 5OO g", "Batch No: A12g", "MRP Rs. 45.00", "Country of Origin: India"]
    lines = spark.createDataFrame([(1, 1, i, t, 0.9) for i, t in enumerate(rows)], "inspection_id int, image_id int, line_index int, text string, confidence double")
    read = repair.second_run(lines)
    got = {(r.line_index, r.field_name): (r.value, r.corrected, [tuple(c) for c in r.changes]) for r in read.collect() if r.corrected}
    assert got == {(0, "mrp"): ("200.00", True, [("2OO.00", "200.00")]), (1, "net_quantity"): ("500 g", True, [("5OO", "500")])}
    plain = [(r.field_name, r.value) for r in read.filter("not corrected").collect()]
    assert ("mrp", "45.00") in plain and ("country_of_origin", "India") in plain
    kept = ranking.deduplicated(read.withColumn("bbox", read.line_index.cast("string"))).filter("field_name = 'mrp'").collect()
    assert sorted(r.value for r in kept) == ["200.00", "45.00"]


def snap(spark, fields, rules, violations, scan, category="FOOD"):
    frame = lambda rows, kind: spark.createDataFrame([(1, *r) for r in rows], f"inspection_id int, {kind}")
    return snapshots.snapshots(
        frame([(category,)], "category string"), frame(fields, "field_name string, value string, state string, manually_corrected boolean"),
        frame(rules, "rule_number string, title string, status string, observed string, critical boolean"), frame(violations, "rule_number string, status string"),
        frame(scan, "compliance_score double, coverage_score double, ai_verdict string, review_status string"),
    )


def test_every_kind_of_change(spark):
    before = snap(
        spark, [("mrp", "10", "DETECTED", False), ("brand", None, "MISSING", None), ("batch_lot", "B1", "DETECTED", None), ("packer", "P", "DETECTED", None), ("importer", "I", "DETECTED", None)],
        [("R1", "one", "FAIL", "x", True), ("R2", "two", "PASS", "", False), (None, "none", "FAIL", "", False)], [("R1", "OPEN"), ("R3", "DISMISSED")], [(50.0, 70.0, "REVIEW", "PENDING")], None,
    )
    after = snap(
        spark, [("mrp", " 12 ", "DETECTED", True), ("brand", "Acme", "DETECTED", None), ("packer", "P", "UNCERTAIN", None), ("importer", "I", "DETECTED", None)],
        [("R1", "one", "PASS", "x", False), ("R2", "two", "PASS", "", False), ("R4", "four", "FAIL", "", None)], [("R4", "NEEDS_REVIEW")], [(80.0, 70.0, "PASS", "PENDING")],
    )
    got = snapshots.differences(before, after).first()
    assert [(f.field_name, f.kind, f.before_value, f.after_value) for f in got.fields] == [
        ("batch_lot", "no_longer_detected", "B1", ""), ("brand", "newly_detected", "", "Acme"), ("mrp", "value_changed", "10", "12"), ("packer", "state_changed", "P", "P"),
    ]
    assert [(r.rule_number, r.before_status, r.after_status, r.critical) for r in got.rules] == [("R1", "FAIL", "PASS", True), ("R4", "NOT_EVALUATED", "FAIL", False)]
    assert got.headline == ["category: — → FOOD", "brand: not detected → Acme", "batch lot: B1 → not detected", "mrp: 10 → 12", "packer: P → P", "compliance: 50.0% → 80.0%", "AI verdict: REVIEW → PASS"]
    assert (got.newly_flagged, got.no_longer_flagged, got.unresolved_before, got.unresolved_after) == (["R4"], ["R1"], 1, 1)
    assert got.changed.any and got.changed.score_changed and not got.changed.coverage_changed and not got.changed.review_status_changed
    same = snapshots.differences(before, before).first()
    assert not same.changed.any and same.headline == [] and same.fields == []


def test_snapshot_without_any_rows(spark):
    empty = snap(spark, [], [], [], [])
    got = snapshots.differences(empty, snap(spark, [], [], [], [(1.0, 2.0, "PASS", None)])).first()
    assert got.changed.score_changed and got.changed.verdict_changed and got.headline == ["AI verdict: — → PASS"]


def test_both_views_are_read_without_a_join(spark):
    lines = spark.createDataFrame([(1, 1, 0, "MRP Rs. 1O5.OO", 0.9), (1, 1, 1, "MRP Rs. 25.00", 0.9), (1, 1, 2, "Batch No: AO17X7", 0.9)], "inspection_id int, image_id int, line_index int, text string, confidence double")
    from labelkite.operators import repair

    got = repair.second_run(lines)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    read = {(r.line_index, r.value, r.corrected, len(r.changes)) for r in got.filter("field_name in ('mrp', 'batch_lot')").collect()}
    assert (0, "105.00", True, 1) in read and (1, "25.00", False, 0) in read and (2, "AO17X7", False, 0) in read and not any(c for n, _, c, _ in read if n > 0)
