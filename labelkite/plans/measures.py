"""Queries for letter heights, all check types in one evaluation, decisions after a review, and checks between readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelkite.operators import checks, measure, rules
from labelkite.plans.fields import _APPLIED, contexts, fields
from labelkite.session import table
from labelkite.sources import domain
from labelkite.sources.domain import FIELD_NAMES, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def _key():
    return F.col("o_orderkey")


def packs(spark, d):
    k = _key()
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("inspection_id"), pick(4, (8.0, 16.0, None, None)).alias("calibration_px_per_mm"), pick(8, ("", "ruler", "", "", "", "", "", "")).alias("calibration_source"),
        F.when(k % 5 == 0, (F.col("o_custkey") % 300 + 10).cast("double")).alias("panel_width_mm"), F.when(k % 10 == 0, 120.0).when(k % 5 == 0, 60.0).alias("panel_height_mm"),
        F.when(k % 5 == 1, (F.col("o_custkey") % 3000).cast("double")).alias("pdp_area_cm2"),
        pick(7, ("MASS", "VOLUME", "NUMBER", "LENGTH", "AREA", "MASS", None)).alias("family"), (k % 6 == 0).alias("moulded"),
    )


def images(spark, d):
    n = F.col("l_linenumber")
    role = F.element_at(F.array(*[F.lit(v) for v in ("BACK", "FRONT", "SIDE", "", "CLOSE_UP")]), ((F.col("l_suppkey") + n) % 5 + 1).cast("int"))
    dpi = F.when(F.col("l_suppkey") % 3 == 0, 203.2).when(F.col("l_suppkey") % 3 == 1, 72.0)
    size = lambda m: F.max(80 * (F.lit(2) + F.col("l_partkey") % m))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("inspection_id"), n.cast("long").alias("image_id")).agg(F.max(role).alias("role"), size(30).alias("width"), size(23).alias("height"), F.max(dpi).alias("dpi"))


def boxes(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in FIELD_NAMES]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    x, h = F.col("l_suppkey") % 50, F.col("l_partkey") % 60
    b = F.struct(x.alias("x1"), F.lit(10).cast("long").alias("y1"), (x + 20 + F.col("l_quantity").cast("long")).alias("x2"), (10 + h).alias("y2"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inspection_id"), name.alias("field_name"), F.lit("ABCD").alias("text"), b.alias("bbox"))


_PACKS = """packs AS (SELECT o_orderkey AS inspection_id, [8.0, 16.0, NULL, NULL][o_orderkey % 4 + 1]::DOUBLE AS manual, CASE WHEN o_orderkey % 8 = 1 THEN 'ruler' ELSE '' END AS manual_source,
    CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 300 + 10 END AS panel_w, CASE WHEN o_orderkey % 10 = 0 THEN 120 WHEN o_orderkey % 5 = 0 THEN 60 END AS panel_h,
    CASE WHEN o_orderkey % 5 = 1 THEN o_custkey % 3000 END AS entered, ['MASS', 'VOLUME', 'NUMBER', 'LENGTH', 'AREA', 'MASS', NULL][o_orderkey % 7 + 1] AS family, o_orderkey % 6 = 0 AS moulded FROM orders)"""
_IMAGES = """images AS (SELECT l_orderkey AS inspection_id, l_linenumber AS image_id, max(['BACK', 'FRONT', 'SIDE', '', 'CLOSE_UP'][(l_suppkey + l_linenumber) % 5 + 1]) AS role,
    max(80 * (2 + l_partkey % 30)) AS width, max(80 * (2 + l_partkey % 23)) AS height, max(CASE l_suppkey % 3 WHEN 0 THEN 203.2 WHEN 1 THEN 72 END) AS dpi FROM lineitem GROUP BY 1, 2)"""
_AREAS = f"""{_PACKS}, {_IMAGES}, told AS (SELECT inspection_id, min_by(dpi, image_id) AS dpi FROM images WHERE dpi >= 100 GROUP BY 1),
    panel AS (SELECT inspection_id, arg_min(width, (role NOT IN ('FRONT', 'CLOSE_UP'), image_id)) AS w, arg_min(height, (role NOT IN ('FRONT', 'CLOSE_UP'), image_id)) AS h FROM images GROUP BY 1),
    scaled AS (SELECT p.*, dpi, w, h, CASE WHEN manual > 0 THEN manual ELSE dpi::DOUBLE / 25.4 END AS px_per_mm,
        CASE WHEN manual > 0 THEN coalesce(nullif(manual_source, ''), 'manual_calibration') WHEN dpi IS NOT NULL THEN 'image_dpi(' || printf('%g', dpi::DOUBLE) || ')' ELSE 'UNAVAILABLE' END AS scale_source
        FROM packs p LEFT JOIN told USING (inspection_id) LEFT JOIN panel USING (inspection_id)),
    areas AS (SELECT *, CASE WHEN panel_w > 0 AND panel_h > 0 THEN panel_w * panel_h / 100.0 WHEN entered > 0 THEN entered WHEN px_per_mm > 0 AND w > 0 AND h > 0 THEN round((w / px_per_mm / 10) * (h / px_per_mm / 10), 2) END::DOUBLE AS area_cm2,
        CASE WHEN panel_w > 0 AND panel_h > 0 THEN 'measured' WHEN entered > 0 THEN 'entered' WHEN px_per_mm > 0 AND w > 0 AND h > 0 THEN 'estimated' ELSE 'unavailable' END AS area_source FROM scaled)"""
_TABLE = "(VALUES " + ", ".join(f"('{t}', {lo}, {'NULL' if hi is None else hi}, {a}, {b})" for t, lo, hi, a, b in rules.BRACKETS) + ") b(t, lo, hi, printed, cast_in)"
_HEIGHTS = f"""{_AREAS}, brackets AS (SELECT t, lo, hi, printed::DOUBLE AS printed, cast_in::DOUBLE AS cast_in, lag(printed) OVER (PARTITION BY t ORDER BY lo) AS low_printed, lag(cast_in) OVER (PARTITION BY t ORDER BY lo) AS low_cast FROM {_TABLE}),
    asked AS (SELECT a.*, CASE WHEN moulded THEN cast_in ELSE printed END AS need, CASE WHEN moulded THEN low_cast ELSE low_printed END::DOUBLE AS low
        FROM areas a LEFT JOIN brackets ON t = CASE WHEN family IN ('MASS', 'VOLUME') THEN 'I' WHEN family IS NOT NULL THEN 'II' END AND area_cm2 > lo AND (hi IS NULL OR area_cm2 <= hi)),
    sizes AS (SELECT inspection_id, ['product_name', 'brand', 'manufacturer', 'net_quantity', 'mrp', 'batch_lot', 'marketer'][l_linenumber % 7 + 1] AS field_name,
            round_even((l_partkey % 60) / px_per_mm * 0.75, 2) AS mm, round_even((20 + l_quantity) / 4 / px_per_mm, 3) AS wide
        FROM lineitem JOIN scaled ON l_orderkey = inspection_id WHERE l_partkey % 60 > 0 AND px_per_mm > 0),
    least AS (SELECT inspection_id, min(mm) AS mm, arg_min(field_name, (mm, field_name)) AS field_name, count(*) AS n, min(CASE WHEN mm > 0 THEN round_even(wide / mm, 3) END) AS ratio FROM sizes GROUP BY 1),
    heights AS (SELECT a.inspection_id, scale_source, px_per_mm, area_cm2, area_source, family, CASE WHEN px_per_mm IS NOT NULL AND family IS NOT NULL THEN need END AS required_mm,
        CASE WHEN area_source = 'estimated' AND low > 0 THEN low ELSE need END AS floor_mm, px_per_mm > 0 AND family IS NOT NULL AND need IS NOT NULL AND mm IS NOT NULL AS ready,
        mm AS detected_mm, field_name AS detected_field, coalesce(n, 0) AS n_measured, ratio >= 0.8 / 3 AS width_ok FROM asked a LEFT JOIN least USING (inspection_id)),
    height_checks AS (SELECT * EXCLUDE (ready) REPLACE (CASE WHEN ready THEN floor_mm END AS floor_mm),
        CASE WHEN ready IS NOT TRUE THEN 'UNCERTAIN' WHEN detected_mm >= required_mm THEN 'PASS' WHEN detected_mm < floor_mm * 0.9 THEN 'FAIL' ELSE 'UNCERTAIN' END AS status,
        CASE WHEN px_per_mm IS NULL THEN 0.2 WHEN ready IS NOT TRUE THEN 0.3 WHEN detected_mm >= required_mm THEN CASE WHEN area_source = 'estimated' THEN 0.55 ELSE 0.75 END WHEN detected_mm < floor_mm * 0.9 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence
        FROM heights)"""


def _height_checks(spark, d):
    i = images(spark, d)
    paneled = measure.panel_areas(measure.scales(packs(spark, d), i), i)
    return measure.height_checks(paneled, measure.measurements(boxes(spark, d), paneled))


@query(f"WITH {_HEIGHTS} SELECT * FROM height_checks")
def letter_height_checks(spark, d):
    return _height_checks(spark, d)


@query(f"WITH {_AREAS} SELECT inspection_id, scale_source, px_per_mm, area_cm2, area_source FROM areas")
def panel_sizes(spark, d):
    i = images(spark, d)
    return measure.panel_areas(measure.scales(packs(spark, d), i), i).select("inspection_id", "scale_source", "px_per_mm", "area_cm2", "area_source")


_WATCHED = ("net_quantity", "mrp", "manufacturer")
_PLACED = """placed AS (SELECT inspection_id, on_panel, off_panel, unknown, CASE WHEN on_panel > 0 AND off_panel = 0 THEN 'PASS' ELSE 'UNCERTAIN' END AS status,
        CASE WHEN on_panel > 0 AND off_panel = 0 THEN 0.55 WHEN off_panel > 0 AND (on_panel > 0 OR unknown = 0) THEN 0.4 ELSE 0.3 END::DOUBLE AS confidence
    FROM (SELECT i.inspection_id, count(*) FILTER (role IN ('FRONT', 'TOP')) AS on_panel, count(*) FILTER (role NOT IN ('FRONT', 'TOP', '')) AS off_panel, count(*) FILTER (role = '') AS unknown
        FROM inspections i LEFT JOIN (SELECT inspection_id, ['FRONT', 'BACK', '', 'TOP'][inspection_id % 4 + CASE WHEN field_name = 'mrp' AND inspection_id % 8 < 2 THEN 2 ELSE 1 END] AS role
            FROM fields WHERE field_name IN ('net_quantity', 'mrp', 'manufacturer') AND state = 'DETECTED') f USING (inspection_id) GROUP BY 1))"""


def _placed(spark, d):
    k = F.col("inspection_id")
    roles = F.array(*[F.lit(r) for r in ("FRONT", "BACK", "", "TOP")])
    f = fields(spark, d).withColumn("role", F.get(roles, (k % 4 + F.when((F.col("field_name") == "mrp") & (k % 8 < 2), 1).otherwise(0)).cast("int")))
    return rules.placement(domain.inspections(spark, d), f, _WATCHED)


@query(f"WITH {_PLACED} SELECT * FROM placed")
def placement_checks(spark, d):
    return _placed(spark, d)


@query(f"""WITH {_HEIGHTS}, {_PLACED}, applied AS ({_APPLIED}),
    facts AS (SELECT a.inspection_id, a.rule_id, coalesce(bool_or(state = 'DETECTED'), false) AS seen, max(CASE WHEN state = 'DETECTED' THEN confidence END) AS best
        FROM (SELECT *, unnest(wanted) AS field_name FROM applied WHERE check_type IN ('declaration_present', 'net_quantity', 'mrp_declaration')) a
        LEFT JOIN fields f ON f.inspection_id = a.inspection_id AND f.field_name = a.field_name GROUP BY 1, 2),
    q AS (SELECT inspection_id, ['GOOD', 'ACCEPTABLE', 'POOR', 'UNUSABLE', NULL][inspection_id % 5 + 1] AS quality FROM inspections)
    SELECT a.inspection_id, a.rule_id, a.check_type, CASE WHEN applicability_kind <> 'APPLIES' THEN 'NOT_APPLICABLE' WHEN f.rule_id IS NOT NULL THEN CASE WHEN seen THEN 'PASS' ELSE 'UNCERTAIN' END
            WHEN check_type = 'legibility' THEN CASE WHEN quality IN ('GOOD', 'ACCEPTABLE') THEN 'PASS' ELSE 'UNCERTAIN' END WHEN check_type = 'font_size' THEN h.status WHEN check_type = 'placement' THEN p.status ELSE 'UNCERTAIN' END AS status,
        CASE WHEN applicability_kind <> 'APPLIES' THEN 1 WHEN f.rule_id IS NOT NULL THEN CASE WHEN seen THEN best ELSE 0.3 END
            WHEN check_type = 'legibility' THEN CASE WHEN quality IN ('GOOD', 'ACCEPTABLE') THEN 0.7 WHEN quality = 'POOR' THEN 0.3 ELSE 0.2 END WHEN check_type = 'font_size' THEN h.confidence WHEN check_type = 'placement' THEN p.confidence ELSE 0.1 END::DOUBLE AS confidence
    FROM applied a LEFT JOIN facts f USING (inspection_id, rule_id) JOIN q USING (inspection_id) LEFT JOIN height_checks h USING (inspection_id) LEFT JOIN placed p USING (inspection_id)""")
def all_check_types(spark, d):
    k = F.col("inspection_id")
    quality = domain.inspections(spark, d).select(k, F.get(F.array(*[F.lit(v) for v in ("GOOD", "ACCEPTABLE", "POOR", "UNUSABLE", None)]), (k % 5).cast("int")).alias("quality"))
    applied = rules.applicability(rules.library(spark), contexts(spark, d))
    read = fields(spark, d).withColumn("human_absent", F.lit(False))
    return checks.outcomes(applied, read, quality, _height_checks(spark, d), _placed(spark, d)).select("inspection_id", "rule_id", "check_type", "status", "confidence")


@query(f"""SELECT inspection_id, string_agg(rule_id || ':' || status, ' ' ORDER BY rule_id) AS checks, count(*) FILTER (status = 'FAIL') AS failed, round(sum(confidence), 6) AS sure FROM ({ORACLES['all_check_types']}) GROUP BY 1""")
def checks_by_inspection(spark, d):
    """All outcomes of an inspection in one row."""
    one = F.struct("rule_id", F.concat_ws(":", "rule_id", "status").alias("check"), "confidence")
    by = all_check_types(spark, d).groupBy("inspection_id").agg(F.sort_array(F.collect_list(one)).alias("all"), F.count_if(F.col("status") == "FAIL").alias("failed"))
    sure = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["confidence"])
    return by.select("inspection_id", F.array_join(F.transform("all", lambda x: x["check"]), " ").alias("checks"), "failed", F.round(sure, 6).alias("sure"))


@query("""SELECT o_orderkey AS inspection_id, CASE WHEN valid THEN px ELSE 8 END::DOUBLE AS calibration_px_per_mm, CASE WHEN valid AND px IS NOT NULL THEN CASE k % 5 WHEN 1 THEN 'manual_px_per_mm' ELSE 'reference_length(12.5 mm, 100 px)' END ELSE 'old' END AS calibration_source,
            CASE WHEN valid AND k % 5 = 3 THEN 40.0 END::DOUBLE AS panel_width_mm, CASE WHEN valid AND k % 5 = 3 THEN 50.0 END::DOUBLE AS panel_height_mm, CASE WHEN NOT valid THEN 7.0 END::DOUBLE AS pdp_area_cm2
          FROM (SELECT *, o_orderkey AS k, CASE o_orderkey % 5 WHEN 1 THEN 4.0 WHEN 2 THEN 8.0 END AS px, o_orderkey % 5 IN (1, 2, 3) AS valid FROM orders)""")
def calibrations(spark, d):
    k = _key()
    num = lambda c, v: F.when(c, F.lit(v).cast("double"))
    i = table(spark, d, "orders").select(k.alias("inspection_id"), F.lit(8.0).alias("calibration_px_per_mm"), F.lit("old").alias("calibration_source"), F.lit(None).cast("double").alias("panel_width_mm"), F.lit(None).cast("double").alias("panel_height_mm"), F.lit(7.0).alias("pdp_area_cm2"), F.lit(False).alias("moulded"))
    u = table(spark, d, "orders").select(
        k.alias("inspection_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("updated_at"), num(k % 5 == 1, 4), num(k % 5 == 4, -1), num(k % 5 == 2, 100), num(k % 5 == 2, 12.5), num(k % 5 == 3, 40), num(k % 5 == 3, 50)
    ).toDF("inspection_id", "updated_at", "a", "b", "reference_px", "reference_mm", "panel_width_mm", "panel_height_mm")
    u = u.withColumns({"px_per_mm": F.coalesce("a", "b"), "pdp_area_cm2": F.lit(None).cast("double"), "moulded": F.lit(False)})
    return measure.calibrated(i, u).drop("moulded")


@query("""SELECT p_partkey AS question_id, a AS area_cm2, CASE WHEN p_partkey % 2 = 0 THEN 'NUMBER' ELSE 'MASS' END AS family,
            CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN a <= 100 THEN 1 WHEN a <= 500 THEN 2 WHEN a <= 2500 THEN 4 ELSE 6 END ELSE CASE WHEN a <= 50 THEN 1 WHEN a <= 100 THEN 1.5 WHEN a <= 500 THEN 2.5 WHEN a <= 2500 THEN 4 ELSE 6 END END::DOUBLE AS printed_mm,
            CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN a <= 100 THEN 2 WHEN a <= 500 THEN 4 ELSE 6 END ELSE CASE WHEN a <= 50 THEN 1.5 WHEN a <= 100 THEN 3 WHEN a <= 500 THEN 4 ELSE 6 END END::DOUBLE AS moulded_mm
          FROM (SELECT *, (p_size * 60 + 0.5)::DOUBLE AS a FROM part)""")
def letter_height_questions(spark, d):
    size = F.concat((F.col("p_size") * 60).cast("long").cast("string"), F.lit(".5"))
    q = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("How tall must letters be for 10 pieces on "), size, F.lit(" sq. cm?"))).otherwise(F.concat(F.lit("Minimum letter height on "), size, F.lit(" cm2")))
    return measure.heights_for_questions(table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), q.alias("question")))


@query("""SELECT l_orderkey AS inspection_id, l_linenumber AS image_id, l_suppkey AS block, round_even(0.5 * least(1, (l_partkey % 60) / 1600.0::DOUBLE / 0.04) + 0.25 * l_discount + 0.25 * (1 - l_tax), 3) AS prominence,
            CASE WHEN l_quantity % 5 = 0 THEN 'UNREADABLE' WHEN l_partkey % 5 + 1 > 3 THEN CASE WHEN l_suppkey % 100 >= 40 THEN 'READABLE' ELSE 'MARGINAL' END WHEN (l_partkey % 5 + 1) > 1 THEN 'MARGINAL' ELSE 'UNREADABLE' END AS readability FROM lineitem""")
def block_prominence(spark, d):
    l = table(spark, d, "lineitem")
    high = (F.col("l_partkey") % 60).cast("double")
    n = F.when(F.col("l_quantity").cast("long") % 5 == 0, 0).otherwise(6)
    read = measure.readability(n, F.col("l_partkey") % 5 + 1, F.col("l_suppkey") % 100, F.lit(0.3), F.lit(0.1))
    stands_out = measure.prominence(high, F.lit(1600), F.col("l_discount"), 1 - F.col("l_tax"))
    return l.select(F.col("l_orderkey").alias("inspection_id"), F.col("l_linenumber").alias("image_id"), F.col("l_suppkey").alias("block"), stands_out.alias("prominence"), read.alias("readability"))


@query("""WITH settled AS (SELECT inspection_id, rule_number FROM evaluations WHERE status = 'FAIL' AND inspection_id % 3 < 2)
          SELECT inspection_id, count(*) AS n_rules, count(CASE WHEN status = 'FAIL' THEN 1 END) AS n_failed FROM evaluations e
          WHERE status <> 'NOT_APPLICABLE' AND NOT EXISTS (SELECT 1 FROM settled s WHERE s.inspection_id = e.inspection_id AND s.rule_number = e.rule_number) GROUP BY 1""")
def rules_after_review(spark, d):
    e = domain.evaluations(spark, d)
    k = F.col("inspection_id")
    v = e.filter("status = 'FAIL'").select(k, "rule_number", F.when(k % 3 == 0, "DISMISSED").when(k % 3 == 1, "RESOLVED").otherwise("CONFIRMED").alias("violation_state"))
    return checks.left_after_review(e, v).groupBy("inspection_id").agg(F.count("*").alias("n_rules"), F.count_if(F.col("status") == "FAIL").alias("n_failed"))


@query("""SELECT e.inspection_id, e.rule_number, e.status, e.check_type, CASE WHEN e.rule_number IN ('LM-1', 'LM-2', 'LM-3') THEN 'Source ' || e.rule_number ELSE '' END AS source_reference FROM evaluations e""")
def checks_with_sources(spark, d):
    r = spark.range(6).select(F.concat(F.lit("LM-"), (F.col("id") % 3 + 1).cast("string")).alias("rule_number"), F.col("id").alias("rule_id"))
    r = r.withColumn("source_reference", F.when(F.col("rule_id") < 3, F.concat(F.lit("Source "), "rule_number")).otherwise("later"))
    return checks.with_sources(domain.evaluations(spark, d), r).select("inspection_id", "rule_number", "status", "check_type", "source_reference")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS corroborated FROM customer""")
def corroborated_mails(spark, d):
    k = F.col("c_custkey")
    mail = F.when(k % 4 == 0, "Care@Gmail.com").when(k % 4 == 1, F.concat(F.lit("x@acme"), k.cast("string"), F.lit(".co.in"))).when(k % 4 == 2, F.concat(F.lit("x@acne"), k.cast("string"), F.lit(".in"))).otherwise("no address")
    return table(spark, d, "customer").select(k, checks.corroborated(mail, F.concat(F.lit("ACME-"), k.cast("string"), F.lit(" Foods Ltd."))).alias("corroborated"))


@query("""WITH t AS (SELECT l_orderkey AS inspection_id, l_linenumber AS line, l_suppkey, l_partkey, l_shipdate::DATE AS made, l_shipdate::DATE + (l_partkey % 120 - 10)::INT AS packed, l_shipdate::DATE + (l_partkey % 500)::INT AS ends,
                 l_suppkey % 5 AS kind FROM lineitem)
          , r AS (SELECT inspection_id, line, l_partkey, l_suppkey, CASE kind WHEN 0 THEN CASE WHEN abs(date_diff('day', made + 360, ends)) <= 45 THEN 'CONSISTENT' ELSE 'INCONSISTENT' END WHEN 1 THEN 'UNVERIFIABLE' WHEN 2 THEN 'UNVERIFIABLE'
                 WHEN 3 THEN CASE WHEN abs(date_diff('day', made + 300, ends)) <= 45 THEN 'CONSISTENT' ELSE 'INCONSISTENT' END END AS best_before,
              CASE WHEN packed - made BETWEEN 0 AND 90 THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS packing, CASE WHEN kind = 4 THEN CASE WHEN ends - made > 0 THEN 'CONSISTENT' ELSE 'INCONSISTENT' END END AS shelf_life FROM t)
          SELECT * FROM (UNPIVOT r ON best_before, packing, shelf_life INTO NAME about VALUE code)""")
def date_consistency(spark, d):
    made = F.to_date("l_shipdate")
    later = lambda n: F.date_add(made, n.cast("int")).cast("string")
    kind = F.col("l_suppkey") % 5
    after = lambda name: F.lit('{"type": "DURATION_FROM_REFERENCE", "duration": "12 months", "reference": "%s"}' % name)
    ends = F.when(kind == 0, after("MANUFACTURING_DATE")).when(kind == 1, after("IMPORT_DATE")).when(kind == 2, F.lit("9 Months")).when(kind == 3, later(F.lit(300)))
    found = checks.date_findings(ends, made.cast("string"), later(F.col("l_partkey") % 120 - 10), F.lit(None).cast("string"), later(F.col("l_partkey") % 500))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inspection_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", F.inline(found))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'""")
def date_codes(spark, d):
    k = _key()
    o = table(spark, d, "orders").filter(F.col("o_orderdate") >= "2000-01-01")
    code = lambda f: F.date_format("o_orderdate", f)
    line = F.when(k % 4 == 0, F.concat(F.lit("PKD "), code("ddMMyy"), F.lit(" B7"))).when(k % 4 == 1, F.concat(F.lit("MFG:"), code("ddMMyyyy"))).when(k % 4 == 2, F.concat(F.lit("8901234567890 "), code("ddMMyy"))).otherwise("Lot 459913")
    return o.select(k, checks.date_code(line).alias("iso"))


@query("""SELECT image_id, line_index, x1, yc, row_number() OVER (PARTITION BY image_id ORDER BY round_even(yc / 12, 0), x1, line_index) AS place
          FROM (SELECT l_orderkey AS image_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS line_index, l_suppkey % 50 AS x1, (l_partkey % 60 + l_partkey % 60 + 2 + l_suppkey % 9) / 2.0::DOUBLE AS yc FROM lineitem)""")
def reading_places(spark, d):
    y, x = F.col("l_partkey") % 60, F.col("l_suppkey") % 50
    b = F.struct(x.alias("x1"), y.alias("y1"), (x + 9).alias("x2"), (y + 2 + F.col("l_suppkey") % 9).alias("y2"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("line_index"), b.alias("bbox"))
    return checks.reading_order(l).select("image_id", "line_index", F.col("bbox.x1").alias("x1"), ((F.col("bbox.y1") + F.col("bbox.y2")) / 2).alias("yc"), "place")


@query("""WITH panels AS (SELECT l_orderkey AS inspection_id, l_linenumber AS image_id, p_name AS text FROM lineitem JOIN part ON l_partkey = p_partkey),
          marks AS (SELECT DISTINCT inspection_id, image_id, regexp_extract(text, '^[a-z]+') AS token FROM panels)
          SELECT m.* FROM marks m WHERE EXISTS (SELECT 1 FROM panels p WHERE p.inspection_id = m.inspection_id AND p.image_id <> m.image_id AND regexp_matches(p.text, '(^|[^a-z0-9])' || m.token))""")
def marks_on_panels(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    panels = l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("inspection_id"), F.col("l_linenumber").alias("image_id"), F.col("p_name").alias("text"))
    marks = panels.select("inspection_id", "image_id", F.regexp_extract("text", "^[a-z]+", 0).alias("token")).distinct()
    return checks.marks_on_other_panels(marks, panels)


@query("""SELECT l_orderkey AS image_id, l_partkey, l_suppkey, l_linenumber, greatest(0, least(70, x + 30) - greatest(20, x)) / 30.0 >= 0.6 AS in_hero FROM (SELECT *, l_suppkey % 90 AS x FROM lineitem)""")
def fields_in_heroes(spark, d):
    box = lambda x, w: F.struct(x.cast("long").alias("x1"), F.lit(5).alias("y1"), (x + w).cast("long").alias("x2"), F.lit(15).alias("y2"))
    l = table(spark, d, "lineitem")
    f = l.select(F.col("l_orderkey").alias("image_id"), "l_partkey", "l_suppkey", "l_linenumber", box(F.col("l_suppkey") % 90, 30).alias("bbox"))
    heroes = l.select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("hero_box", box(F.lit(20), 50))
    return checks.in_hero(f, heroes).drop("bbox")


@query("""SELECT inspection_id, field_name, CASE WHEN state = 'CONFLICTING' THEN 'CONFLICTING' WHEN inspection_id % 9 = 0 OR confidence < 0.55 THEN 'UNCERTAIN' ELSE 'DETECTED' END AS standalone FROM fields""")
def standalone_states(spark, d):
    no = F.lit(False)
    s = checks.standalone_state(F.col("value"), F.col("state") == "CONFLICTING", F.col("inspection_id") % 9 == 0, no, no, F.col("confidence"))
    return fields(spark, d).select("inspection_id", "field_name", s.alias("standalone"))


@query("""WITH f AS (SELECT inspection_id, bool_or(field_name = 'mrp') AS mrp, bool_or(field_name = 'net_quantity') AS qty, bool_or(field_name = 'batch_lot') AS lot FROM fields GROUP BY 1)
          SELECT inspection_id, array_to_string([x FOR x IN [CASE WHEN NOT mrp THEN 'smalltext' END, CASE WHEN NOT lot THEN 'thresholded' END, CASE WHEN NOT qty THEN 'upscaled' END, 'smalltext', CASE WHEN inspection_id % 3 = 0 THEN 'denoised' END] IF x IS NOT NULL][1:2], ',') AS passes FROM f""")
def image_passes(spark, d):
    name = F.when(F.col("field_name") == "batch_lot", "date_packing").otherwise(F.col("field_name"))
    f = fields(spark, d).groupBy("inspection_id").agg(F.collect_set(name).alias("found"))
    q = F.when(F.col("inspection_id") % 3 == 0, "POOR").otherwise("GOOD")
    return f.select("inspection_id", F.array_join(checks.passes_wanted(F.col("found"), q), ",").alias("passes"))
