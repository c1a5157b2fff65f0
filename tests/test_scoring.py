"""The algebra of scores, verdicts and decisions."""

import pytest
from pyspark.sql import functions as F

from labelkite.operators import history, quality, ranking, rules, scoring

KIND = "inspection_id bigint, rule_number string, status string, critical boolean, weight double, check_type string, applicability_kind string, confidence double"


def evaluations(spark, rows):
    return spark.createDataFrame([(1, f"r{i}", s, c, w, t, k, 0.9) for i, (s, w, t, k, c) in enumerate(rows)], KIND)


def row(status, weight=1.0, check="declaration_present", kind="APPLIES", critical=False):
    return (status, weight, check, kind, critical)


@pytest.mark.parametrize(
    ("rows", "score", "coverage", "verdict"),
    [
        ([row("PASS"), row("FAIL", 2.0)], 33.3, 100.0, "NON_COMPLIANT"),
        ([row("PASS"), row("UNCERTAIN")], 100.0, 50.0, "NEEDS_MANUAL_REVIEW"),
        ([row("PASS", 9.0), row("FAIL")], 90.0, 100.0, "NON_COMPLIANT"),
        ([row("PASS", 9.0), row("UNCERTAIN")], 100.0, 90.0, "COMPLIANT"),
        ([row("UNCERTAIN")], 0.0, 0.0, "NEEDS_MANUAL_REVIEW"),
        ([row("PASS", 3.0), row("FAIL", 1.0)], 75.0, 100.0, "NON_COMPLIANT"),
        ([row("PASS"), row("UNCERTAIN", check="manual_only"), row("NOT_APPLICABLE", check="manual_only")], 100.0, 100.0, "COMPLIANT"),
        ([row("PASS"), row("NOT_APPLICABLE", kind="INAPPLICABLE")], 100.0, 100.0, "COMPLIANT"),
        ([row("PASS"), row("NOT_APPLICABLE", kind="EVIDENCE_MISSING")], 100.0, 50.0, "NEEDS_MANUAL_REVIEW"),
        ([row("PASS", None, critical=True), row("FAIL", None)], 66.7, 100.0, "NON_COMPLIANT"),
        ([row("PASS")] + [row("FAIL")] * 15, 6.2, 100.0, "NON_COMPLIANT"),  # 6.25 rounds to even
    ],
)
def test_score_and_verdict(spark, rows, score, coverage, verdict):
    got = scoring.with_verdicts(scoring.scores(evaluations(spark, rows))).first()
    assert (got.score, got.coverage, got.verdict) == (score, coverage, verdict)


def test_scores_dont_depend_on_order_or_partitions(spark):
    rows = [row("PASS", 2.0), row("FAIL"), row("UNCERTAIN"), row("NOT_APPLICABLE", kind="EVIDENCE_MISSING")]
    a = scoring.scores(evaluations(spark, rows)).first()
    b = scoring.scores(evaluations(spark, rows[::-1]).repartition(3)).first()
    assert a == b


@pytest.mark.parametrize(
    ("rows", "state", "conflicts", "decision"),
    [
        ([row("PASS")], "DETECTED", 0, "COMPLIANT"),
        ([row("PASS"), row("FAIL")], "DETECTED", 0, "NON_COMPLIANT"),
        ([row("PASS")], "UNCERTAIN", 0, "NEEDS_MANUAL_REVIEW"),
        ([row("PASS")], "DETECTED", 1, "NEEDS_MANUAL_REVIEW"),
        ([row("PASS"), row("UNCERTAIN", check="manual_only")], "DETECTED", 0, "COMPLIANT"),
        ([row("PASS"), row("NOT_APPLICABLE", kind="EVIDENCE_MISSING")], "DETECTED", 0, "NEEDS_MANUAL_REVIEW"),
        ([row("NOT_APPLICABLE", kind="INAPPLICABLE")], "DETECTED", 0, "NEEDS_MANUAL_REVIEW"),
    ],
)
def test_decisions(spark, rows, state, conflicts, decision):
    context = spark.createDataFrame([(1, state, conflicts)], "inspection_id bigint, classification_state string, n_conflicts int")
    assert scoring.decisions(evaluations(spark, rows), context).first().decision == decision


def test_missing_evidence_is_no_failure(spark):
    fields = spark.createDataFrame([(1, "mrp", "120.00", "DETECTED", 0.9, False), (1, "net_quantity", None, "MISSING", 0.0, True)], "inspection_id bigint, field_name string, value string, state string, confidence double, human_absent boolean")
    context = spark.createDataFrame([(1, "FOOD", "DETECTED", "retail_package", False)], "inspection_id bigint, category string, category_state string, packaging string, is_import boolean")
    got = {r.rule_id: (r.status, r.confidence) for r in rules.declarations(rules.applicability(rules.library(spark), context), fields).collect()}
    assert got["LM-PCR-6E"] == ("PASS", 0.9)
    assert got["LM-PCR-6C"] == ("FAIL", 1.0)  # a person confirmed that it isn't there
    assert got["LM-PCR-6B"][0] == "UNCERTAIN"
    assert got["LM-PCR-6H"][0] == "NOT_APPLICABLE"


@pytest.mark.parametrize(("family", "area", "moulded", "required", "lower"), [("MASS", 50.0, False, 1.0, 0.0), ("MASS", 50.1, False, 1.5, 1.0), ("MASS", 2500.1, True, 6.0, 6.0), ("NUMBER", 0.0, False, 1.0, 0.0), ("LENGTH", 500.0, True, 4.0, 2.0), (None, 10.0, False, None, None)])
def test_letter_heights(spark, family, area, moulded, required, lower):
    got = rules.required_heights(spark.createDataFrame([(family, area, moulded)], "family string, area_cm2 double, moulded boolean")).first()
    assert (got.required_mm, got.lower_mm) == (required, lower)


def test_height_status(spark):
    rows = [(2.5, 2.5, 1.5, False, "PASS"), (2.3, 2.5, 1.5, False, "UNCERTAIN"), (2.2, 2.5, 1.5, False, "FAIL"), (2.2, 2.5, 1.5, True, "UNCERTAIN"), (1.3, 2.5, 1.5, True, "FAIL"), (None, 2.5, 1.5, False, "UNCERTAIN")]
    df = spark.createDataFrame(rows, "m double, r double, l double, e boolean, want string")
    for r in df.withColumn("got", rules.height_status(F.col("m"), F.col("r"), F.col("l"), F.col("e"))).collect():
        assert r.got == r.want, r


def test_winner_and_conflict(spark):
    kind = "inspection_id bigint, field_name string, value string, score double, confidence double, seq bigint"
    c = spark.createDataFrame([(1, "mrp", "120.00", 0.9, 0.8, 2), (1, "mrp", "120", 0.9, 0.8, 1), (1, "brand", "A", 1.0, 0.9, 1), (1, "brand", "B", 0.86, 0.8, 2), (1, "brand", "C", 0.2, 0.2, 3)], kind)
    got = {r.field_name: (r.value, r.conflict) for r in ranking.winners(c).collect()}
    assert got == {"mrp": ("120", False), "brand": ("A", True)}


def test_versions(spark):
    now = rules.library(spark)
    none = spark.createDataFrame([], "rule_id string, version int, fingerprint string")
    first = rules.next_versions(none, now)
    assert {r.version for r in first.collect()} == {1}
    assert rules.next_versions(first, now).count() == 0
    changed = now.withColumn("weight", F.when(F.col("rule_id") == "LM-PCR-6A", 3.0).otherwise(F.col("weight")))
    assert [(r.rule_id, r.version) for r in rules.next_versions(first, changed).collect()] == [("LM-PCR-6A", 2)]
    assert len(rules.library_fingerprint(now).first().fingerprint) == 12


def test_overlay_survives_a_new_run(spark):
    fields = spark.createDataFrame([(1, "mrp", "12", "DETECTED"), (1, "brand", "A", "DETECTED")], "inspection_id bigint, field_name string, value string, state string")
    actions = spark.createDataFrame([(1, "mrp", 1, "REJECT", None), (1, "mrp", 2, "EDIT", "120"), (1, "batch_lot", 3, "CONFIRM_ABSENT", None)], "inspection_id bigint, field_name string, action_id bigint, action string, value string")
    got = {r.field_name: (r.value, r.state, r.human_absent) for r in history.overlaid(fields, actions).collect()}
    assert got == {"mrp": ("120", "MANUALLY_CORRECTED", False), "brand": ("A", "DETECTED", False), "batch_lot": ("", "CONFIRMED_ABSENT", True)}


def test_annotation_problems(spark):
    kind = "product_id string, file string, views array<struct<file:string,view:string,quality:string>>, fields map<string,string>"
    rows = [("p1", "p1.json", [("a.jpg", "FRONT", "GOOD")], {"mrp": "1"}), ("p2", "px.json", [], {"mrp": " "}), ("p3", "p3.json", [("a.gif", "SIDEWAYS", "GOOD")], {})]
    got = {(r.product_id, r.problem) for r in quality.annotation_problems(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("p2", "id differs from the file's name"), ("p2", "no views"), ("p2", "empty value"), ("p3", "unknown view"), ("p3", "unsupported image")}


def test_flagship_plan_is_native(spark):
    from labelkite import catalog

    plan = catalog.QUERIES["flagship_inspection_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
