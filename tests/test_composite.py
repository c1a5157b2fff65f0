"""Misread digits, quantities in parts, several dates, labels with values beside them, evidence."""

import pytest
from pyspark.sql import functions as F

from labelkite.functions import composite
from labelkite.operators import evidence


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "fixed"), [("₹2OO", "₹200"), ("8O13O", "80130"), ("5OOg", "500g"), ("MONTNS", "MONTNS"), ("A0137X", "A0137X"), ("Net I2 kg", "Net 12 kg"), ("SOLO", "SOLO")])
def test_repairs(spark, raw, fixed):
    got = one(spark, composite.repaired, raw)
    assert got.text == fixed and bool(got.changes) == (raw != fixed)


@pytest.mark.parametrize(
    ("line", "value", "extra", "total"),
    [
        ("Net Wt. 28.4 g + 6.1 g EXTRA", 34.5, 6.1, None), ("Net Qty 1 kg + 100 g", 1100.0, None, None), ("Net Quantity 10 x 20 g", 200.0, None, None),
        ("Net Wt 250 g Free 25 g", 275.0, 25.0, None), ("Net Wt. 450 g + 50 g EXTRA = 500 g", 500.0, 50.0, 500.0), ("Net Wt 500 g", 500.0, None, None),
    ],
)
def test_quantities(spark, line, value, extra, total):
    got = one(spark, composite.quantity, line)
    assert (got.value, got.extra, got.declared_total) == (value, extra, total) and got.family == "MASS"


def test_quantities_that_dont_add_up(spark):
    assert one(spark, composite.quantity, "100 g + 50 g = 200 g").discrepancy
    mixed = one(spark, composite.quantity, "100 g + 50 ml")
    assert mixed.uncombined and mixed.value is None


def test_several_dates(spark):
    got = one(spark, composite.several_dates, "MFG 14/03/2026 EXP 13/12/2027")
    assert [(p.field, p.iso) for p in got] == [("date_manufacturing", "2026-03-14"), ("date_expiry", "2027-12-13")]
    assert [(p.field, p.iso) for p in one(spark, composite.several_dates, "PKD 01/02/26 mfg")] == [("date_packing", "2026-02-01|AMBIGUOUS"), ("date_manufacturing", "2026-02-01|AMBIGUOUS")]


def test_labels_beside_values(spark):
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    rows = [(1, 1, 0, "MRP", (10, 10, 50, 30)), (1, 1, 1, "120.00", (60, 12, 100, 30)), (1, 1, 2, "500 g", (10, 200, 60, 220)), (1, 1, 3, "Batch No:", (10, 100, 60, 120)), (1, 1, 4, "QX4471", (12, 128, 60, 146)), (1, 2, 0, "99", (60, 12, 100, 30))]
    got = {r.line_index: r.text for r in evidence.associated(spark.createDataFrame(rows, f"inspection_id bigint, image_id bigint, line_index int, text string, bbox {box}")).collect()}
    assert got == {0: "MRP 120.00", 3: "Batch No: QX4471"}


def test_evidence_and_owners(spark):
    e = spark.createDataFrame([(1, "6(1)", ["mrp", "brand"])], "inspection_id bigint, rule_number string, fields array<string>")
    crops = spark.createDataFrame([(7, 1, "brand"), (8, 1, "mrp"), (8, 1, "brand"), (9, 2, "mrp")], "evidence_id bigint, inspection_id bigint, field_name string")
    assert [(r.evidence_id, r.n) for r in evidence.for_evaluations(e, crops).orderBy("n").collect()] == [(8, 1), (7, 2)]
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    s1, s2 = (spark.createDataFrame(x, "file string, inspection_id bigint") for x in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert {r.file: r.inspection_id for r in evidence.owners(files, s1, s2).collect()} == {"a": 1, "b": 3, "c": None}
