"""Readings from literal label lines, prices and dates."""

import datetime

import pytest
from pyspark.sql import functions as F

from labelkite.functions import geometry, text
from labelkite.operators import assistant, extract, listings, ranking, tools

LINES = "inspection_id bigint, image_id bigint, line_index bigint, text string, confidence double"


def lines(spark, *texts):
    return spark.createDataFrame([(1, 1, i, t, 0.9) for i, t in enumerate(texts)], LINES)


def won(spark, *texts):
    c = extract.candidates(lines(spark, *texts))
    return {r.field_name: r.value for r in ranking.winners(c).collect()}


def test_a_whole_pack(spark):
    got = won(spark, "MRP ₹ 120.00", "Rs. 0.24/g", "Net Wt. 500 g", "Mfg Date 14/03/2026", "Use By 13/12/2027", "Batch No: QX4471", "Country of Origin: India", "Energy 450 kcal", "care@example.com", "www.example.com/x.", "FSSAI Lic. No. 10012345678901", "Acme Foods Pvt Ltd")
    assert got["mrp"] == "120.00" and got["unit_sale_price"] == "Rs. 0.24/g" and got["net_quantity"] == "500 g"
    assert got["date_manufacturing"] == "2026-03-14" and got["date_expiry"] == "2027-12-13"
    assert got["batch_lot"] == "QX4471" and got["country_of_origin"] == "India" and got["consumer_care_email"] == "care@example.com"
    assert got["website"] == "www.example.com/x" and got["fssai_license"] == "10012345678901" and got["manufacturer"] == "Acme Foods Pvt Ltd"


@pytest.mark.parametrize(("line", "value"), [("MRP ₹200", "200"), ("M.R.P. : ₹200.00", "200.00"), ("M.R.P. ₹200/-", "200"), ("Retail Sale Price: Rs. 500", "500"), ("MRP 1,250.00", "1250.00")])
def test_prices_read(spark, line, value):
    assert won(spark, line)["mrp"] == value


@pytest.mark.parametrize("line", ["₹0.40/g", "₹120/kg", "Energy 450 kcal", "Batch No: A0130", "PIN 638111", "MFD: 04/02/25"])
def test_no_price(spark, line):
    assert "mrp" not in won(spark, line)


def test_nutrition_rows_hide_numbers(spark):
    flags = [r.nutrition for r in extract.flagged(lines(spark, "MRP 10", "Nutrition facts", "12.5", "Protein 3 g", "99")).orderBy("line_index").collect()]
    assert flags == [False, True, True, True, False]


def test_dates(spark):
    rows = [("MFD 04/02/25", "2025-02-04", True), ("13.12.2027", "2027-12-13", False), ("12/25/2026", "2026-12-25", False), ("31/02/2026", None, None), ("no date", None, None)]
    for r in spark.createDataFrame([(t,) for t, *_ in rows], "t string").select("t", text.printed_date(F.col("t")).alias("p")).collect():
        want = next(x for x in rows if x[0] == r.t)
        assert (r.p and r.p.iso, r.p and r.p.ambiguous) == want[1:]


def test_expiry_ladder(spark):
    rows = [("2026-05-01", "", "", ""), ("", "12 months", "2026-01-01", ""), ("", "12 months", "", "2026-01-01"), ("", "", "", "2026-01-01"), ("", "", "", "")]
    df = spark.createDataFrame(rows, "p string, b string, m string, q string").select(tools.expiry(F.col("p"), F.col("b"), F.col("m"), F.col("q")).alias("e"))
    got = [(r.e.expiry, r.e.basis) for r in df.collect()]
    assert got[0] == (datetime.date(2026, 5, 1), "PRINTED_ON_PACKAGE")
    assert got[1] == (datetime.date(2026, 12, 27), "DURATION_FROM_MANUFACTURING_DATE")  # 360 days
    assert [b for _, b in got[2:]] == ["DURATION_ONLY_NO_ANCHOR", "NOT_DECLARED", "NOT_PROVIDED"]


def test_price_check(spark):
    rows = [(45.0, 40.0), (30.0, 40.0), (None, 40.0), (10.0, 0.0), (40.2, 40.0)]
    got = [tuple(r.c) for r in spark.createDataFrame(rows, "b double, m double").select(tools.price_check(F.col("b"), F.col("m")).alias("c")).collect()]
    assert got == [(5.0, 12.5, "POTENTIAL_PRICE_DIFFERENCE"), (-10.0, -25.0, "PRICE_AT_OR_BELOW_MRP"), (None, None, "INSUFFICIENT_DATA"), (None, None, "INSUFFICIENT_DATA"), (0.2, 0.5, "PRICE_AT_OR_BELOW_MRP")]


def test_text_helpers(spark):
    df = spark.createDataFrame([("ACME INDUSTRIESLTD.",), ("Fresh milk",), ("₹ 1,200",)], "t string")
    got = df.select(text.company_like(F.col("t")).alias("c"), text.money(F.col("t")).alias("m"), text.script(F.col("t")).alias("s")).collect()
    assert [r.c for r in got] == [True, False, False] and got[2].m == 1200.0 and [r.s for r in got] == ["Latin", "Latin", "Unknown"]


def test_boxes(spark):
    df = spark.createDataFrame([("(1, 2, 11, 22)", "6,2,16,22"), ("1,2,3", "x")], "a string, b string").select(geometry.parse_box(F.col("a")).alias("a"), geometry.parse_box(F.col("b")).alias("b"))
    got = df.select("a", F.round(geometry.iou(F.col("a"), F.col("b")), 4).alias("i"), geometry.same_row_right(F.col("a"), F.col("b")).alias("r")).collect()
    assert tuple(got[0].a) == (1, 2, 11, 22) and got[0].i == 0.3333 and got[0].r and got[1].a is None


def test_listing_comparison(spark):
    rows = [("brand", "Acme", "DETECTED", "ACME"), ("mrp", "₹ 1,200.00", "DETECTED", "1200"), ("net_quantity", "1 kg", "DETECTED", "1000 g"), ("mrp", "5", "CONFLICTING", "5"), ("brand", "", "MISSING", "Acme"), ("product_name", "Oat biscuits", "DETECTED", "Tea")]
    got = [r.verdict for r in listings.compared(spark.createDataFrame(rows, "field string, package string, package_state string, listing string").coalesce(1)).collect()]
    assert got == ["MATCH", "MATCH", "MATCH", "NOT_COMPARABLE", "LISTING_ONLY", "INCONSISTENT"]


def test_classification(spark):
    df = spark.createDataFrame([(1, "Oat biscuit with honey, milk and sugar"), (2, "herbal soap and juice"), (3, "nothing here"), (4, None)], "inspection_id bigint, text string")
    got = {r.inspection_id: (r.category, r.state, r.confidence) for r in extract.classified(df).collect()}
    assert got[1] == ("FOOD", "DETECTED", 0.85) and got[2][:2] == ("FOOD", "CONFLICTING") and got[3] == ("OTHER", "UNCERTAIN", 0.0) == got[4]


def test_questions(spark):
    q = spark.createDataFrame([(1, "What is the net quantity rule?")], "question_id bigint, text string")
    known = spark.createDataFrame([("quantity", "Net quantity", "net quantity"), ("price", "Retail price", "mrp")], "topic string, title string, keyword string")
    assert [(r.topic, r.strength) for r in assistant.topics(q, known).collect()] == [("quantity", "strong")]
    rules = spark.createDataFrame([("6(1)(a)",), ("6(1)(b)",), ("9(1)",)], "rule_number string")
    assert assistant.resolved(spark.createDataFrame([("6(1)(b)",), ("9(2)",)], "reference string"), rules).filter("reference = '9(2)'").first().rule_number == "9(1)"


def test_scripts_are_counted_once(spark):
    df = spark.createDataFrame([("abc कखगघ",), ("abcd कख ગઘ",), ("কখ গগ कख गग",), ("12 é.",), ("",), (None,), ("ab കഖ",)], "t string")
    got = df.select(text.script(F.col("t")).alias("s"))
    assert [r.s for r in got.collect()] == ["Devanagari", "Latin", "Devanagari", "Unknown", "Unknown", None, "Malayalam"]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("regexp_replace") <= len(text.SCRIPTS)


def test_companies_by_their_tails(spark):
    cases = {"ACME FOODSLTD": True, "A.C.M.E P-V-T.": True, "MegaPackers&co": True, "LTDX": False, "Ltd": False, "Foods inc": True, "zinc": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", text.company_like(F.col("t")).alias("c")).collect()} == cases


def test_a_quantity_is_looked_for_once(spark):
    df = spark.createDataFrame([("Net Wt. 20 grams", 0.9, False, False)], "text string, confidence double, nutrition boolean, near_net boolean")
    got = df.select(extract.quantities()[0].alias("q"))
    assert got.first().q.value == "20 g"
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == 2
