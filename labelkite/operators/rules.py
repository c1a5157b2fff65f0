"""Versioned rules: applicability, checks, letter heights, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelkite.functions.text import once, substantive

#: The rule library (id, number, check, weight, critical, scope, categories, fields).
FOODLIKE = ("FOOD", "BEVERAGE", "COSMETIC")
LIBRARY = (
    ("LM-PCR-6A", "6(1)(a)", "declaration_present", 1.0, False, "retail_package", (), ("manufacturer", "manufacturer_address", "packer", "packer_address", "importer", "importer_address")),
    ("LM-PCR-6B", "6(1)(b)", "declaration_present", 1.0, False, "retail_package", (), ("product_name", "common_name")),
    ("LM-PCR-6C", "6(1)(c)", "net_quantity", 2.0, True, "retail_package", (), ("net_quantity",)),
    ("LM-PCR-6D", "6(1)(d)", "declaration_present", 1.0, False, "retail_package", (), ("date_manufacturing", "date_packing", "date_import")),
    ("LM-PCR-6E", "6(1)(e)", "mrp_declaration", 2.0, True, "retail_package", (), ("mrp",)),
    ("LM-PCR-6F", "6(1)(f)", "declaration_present", 1.0, False, "retail_package", (), ("consumer_care_phone", "consumer_care_email")),
    ("LM-PCR-6G", "6(1)(g)", "declaration_present", 1.0, False, "any", FOODLIKE, ("date_best_before", "date_expiry")),
    ("LM-PCR-6H", "6(1)(h)", "declaration_present", 1.0, False, "import_only", (), ("country_of_origin",)),
    ("LM-PCR-9A", "9(1)", "legibility", 1.0, False, "retail_package", (), ()),
    ("LM-PCR-13A", "13(1)", "declaration_present", 1.0, False, "retail_package", (), ("batch_lot",)),
    ("LM-PCR-6-1-PLACE", "6(1), 7(1), 9", "placement", 1.0, False, "retail_package", (), ("net_quantity", "mrp", "manufacturer", "consumer_care_phone", "consumer_care_email")),
    ("LM-PCR-7FONT", "7(2), 7(3)", "font_size", 1.0, False, "retail_package", (), ()),
    ("LM-PCR-STD-QTY", "5", "manual_only", 1.0, False, "retail_package", (), ()),
    ("LM-PCR-4-EXEMPT", "4", "manual_only", 1.0, False, "any", (), ()),
    ("LM-PCR-7-ERR", "7", "manual_only", 1.0, False, "retail_package", (), ()),
)
#: Least letter heights in mm by the area of the panel in square cm (table, from, to, printed, moulded).
BRACKETS = (
    ("I", 0.0, 50.0, 1.0, 1.5), ("I", 50.0, 100.0, 1.5, 3.0), ("I", 100.0, 500.0, 2.5, 4.0), ("I", 500.0, 2500.0, 4.0, 6.0), ("I", 2500.0, None, 6.0, 6.0),
    ("II", 0.0, 100.0, 1.0, 2.0), ("II", 100.0, 500.0, 2.0, 4.0), ("II", 500.0, 2500.0, 4.0, 6.0), ("II", 2500.0, None, 6.0, 6.0),
)
TABLE_OF = {"MASS": "I", "VOLUME": "I", "LENGTH": "II", "AREA": "II", "NUMBER": "II"}
BORDERLINE = 0.9


def library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(*r[:6], list(r[6]), list(r[7])) for r in LIBRARY],
        "rule_id string, rule_number string, check_type string, weight double, critical boolean, scope string, categories array<string>, fields array<string>",
    )


def brackets(spark: SparkSession) -> DataFrame:
    """The brackets with the heights of the next smaller one."""
    b = spark.createDataFrame(list(BRACKETS), "table_no string, over double, up_to double, normal_mm double, moulded_mm double")
    w = Window.partitionBy("table_no").orderBy("over")
    return b.withColumn("below_normal_mm", F.coalesce(F.lag("normal_mm").over(w), F.lit(0.0))).withColumn("below_moulded_mm", F.coalesce(F.lag("moulded_mm").over(w), F.lit(0.0)))


def required_heights(panels: DataFrame, family: str = "family", area: str = "area_cm2", moulded: str = "moulded") -> DataFrame:
    """``panels`` with ``required_mm`` and ``lower_mm``; areas of zero or less fall in the first bracket."""
    table_no = F.lit(None).cast("string")
    for name, t in TABLE_OF.items():
        table_no = F.when(F.col(family) == name, t).otherwise(table_no)
    b = brackets(panels.sparkSession)
    within = (F.greatest(F.col(area), F.lit(1e-9)) > F.col("over")) & (F.col("up_to").isNull() | (F.col(area) <= F.col("up_to")))
    # nine rows
    joined = panels.withColumn("_t", table_no).join(F.broadcast(b), (F.col("_t") == F.col("table_no")) & within, "left")
    pick = lambda a, c: F.when(F.col(moulded), F.col(a)).otherwise(F.col(c))
    return joined.select(*panels.columns, pick("moulded_mm", "normal_mm").alias("required_mm"), pick("below_moulded_mm", "below_normal_mm").alias("lower_mm"))


def height_status(measured: Column, required: Column, lower: Column, area_estimated: Column) -> Column:
    """Passes at the required height; fails well below it (or below the next lower one, where the area is an estimate)."""
    floor = F.when(area_estimated & (lower > 0), lower).otherwise(required)
    return F.when(measured.isNull() | required.isNull(), "UNCERTAIN").when(measured >= required, "PASS").when(measured < floor * BORDERLINE, "FAIL").otherwise("UNCERTAIN")


def applicability(rules: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every rule for every inspection, with how it applies: APPLIES, INAPPLICABLE or EVIDENCE_MISSING.

    ``contexts``: inspection_id, category, category_state, packaging, is_import. The rules are a dozen rows.
    """
    c = F.upper(F.coalesce("category", F.lit("")))
    unsure = F.coalesce(F.upper("category_state"), F.lit("UNCERTAIN")).isin("UNCERTAIN", "CONFLICTING")
    has_categories = F.size("categories") > 0
    kind = (
        F.when(F.col("scope") == "import_only", F.when(F.coalesce("is_import", F.lit(False)), "APPLIES").otherwise("EVIDENCE_MISSING"))
        .when((F.col("scope") != "any") & (F.coalesce("packaging", F.lit("retail_package")) != F.col("scope")), "INAPPLICABLE")
        .when(has_categories & unsure, "EVIDENCE_MISSING")
        .when(has_categories & ~F.array_contains("categories", c), "INAPPLICABLE")
        .otherwise("APPLIES")
    )
    return contexts.crossJoin(F.broadcast(rules)).withColumn("applicability_kind", kind)


#: Types of check that ask whether a declaration was read.
FIELD_CHECKS = ("declaration_present", "net_quantity", "mrp_declaration")


def field_facts(fields: DataFrame) -> DataFrame:
    """``inspection_id facts``: all readings of an inspection in one array, a few dozen at most.

    ``fields``: inspection_id, field_name, value, state, confidence, human_absent.
    """
    seen = F.coalesce(F.col("state").isin("DETECTED", "MANUALLY_CORRECTED") & substantive(F.col("value")), F.lit(False))
    fact = F.struct("field_name", seen.alias("seen"), "confidence", F.coalesce(F.col("state") == "CONFLICTING", F.lit(False)).alias("conflicting"), "human_absent")
    return fields.groupBy("inspection_id").agg(F.collect_list(fact).alias("facts"))


def declared(applies: Column, asked: Column, facts: Column) -> Column:
    """struct(status, confidence) of a rule that asks for any of the fields ``asked``, over an inspection's ``facts``."""
    def judged(own: Column) -> Column:
        told = F.filter(own, lambda f: f["human_absent"].isNotNull())
        absent = once(told, lambda t: (F.size(t) > 0) & F.forall(t, lambda f: f["human_absent"]))
        best = F.array_max(F.transform(F.filter(own, lambda f: f["seen"]), lambda f: f["confidence"]))
        some = lambda name: F.coalesce(F.exists(own, lambda f: f[name]), F.lit(False))
        status = F.when(~applies, "NOT_APPLICABLE").when(some("seen"), "PASS").when(some("conflicting"), "UNCERTAIN").when(absent, "FAIL").otherwise("UNCERTAIN")
        return once(status, lambda s: F.struct(s.alias("status"), F.when(s == "PASS", best).when(s == "FAIL", 1.0).otherwise(0.3).alias("confidence")))

    return once(F.filter(facts, lambda f: F.array_contains(asked, f["field_name"])), judged)


def declarations(applied: DataFrame, fields: DataFrame) -> DataFrame:
    """Outcomes of ``declaration_present``, ``net_quantity`` and ``mrp_declaration`` rules that ask for some field.

    ``fields``: inspection_id, field_name, value, state, confidence, human_absent. A substantive reading passes; a person
    who confirmed the absence fails it; all else stays undecided: what wasn't read is no violation. An inspection's readings
    are gathered once and all its rules are evaluated over them.
    """
    asked = applied.filter(F.col("check_type").isin(*FIELD_CHECKS) & (F.size("fields") > 0)).join(field_facts(fields), "inspection_id", "left")
    judged = asked.withColumn("judged", declared(F.col("applicability_kind") == "APPLIES", F.col("fields"), F.col("facts")))
    return judged.select("inspection_id", "rule_id", "rule_number", "check_type", "weight", "critical", "applicability_kind", "judged.*")


def legibility(quality: Column) -> Column:
    return F.when(quality.isin("GOOD", "ACCEPTABLE"), "PASS").otherwise("UNCERTAIN")


def placement(inspections: DataFrame, fields: DataFrame, watched: tuple[str, ...], panels: tuple[str, ...] = ("FRONT", "TOP")) -> DataFrame:
    """Where the watched declarations that were read stand: a row for each inspection, with counts, status and confidence.

    ``fields``: inspection_id, field_name, value, state, role of the image. It passes where some stand on a main panel and
    none on another side, and never fails: a photo may lack a side.
    """
    w = fields.filter(F.col("field_name").isin(*watched) & F.col("state").isin("DETECTED", "MANUALLY_CORRECTED") & substantive(F.col("value")))
    role = F.coalesce("role", F.lit(""))
    main = role.isin(*panels)
    facts = w.groupBy("inspection_id").agg(F.count_if(main).alias("on_panel"), F.count_if(~main & (role != "")).alias("off_panel"), F.count_if(role == "").alias("unknown"))
    j = inspections.select("inspection_id").join(facts, "inspection_id", "left").fillna(0, ["on_panel", "off_panel", "unknown"])
    on, off, unknown = F.col("on_panel") > 0, F.col("off_panel") > 0, F.col("unknown") > 0
    status = F.when(on & ~off, "PASS").otherwise("UNCERTAIN")
    confidence = F.when(F.lit(not watched), 0.2).when(on & ~off, 0.55).when(off & (on | ~unknown), 0.4).otherwise(0.3)
    return j.withColumns({"status": status, "confidence": confidence})


def next_versions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions to add: rules that are new (version 1) or whose content differs from the latest version (one more)."""
    content = lambda: F.sha2(F.to_json(F.struct("rule_number", "check_type", "weight", "critical")), 256)
    latest = current.groupBy("rule_id").agg(F.max(F.struct("version", "fingerprint")).alias("l")).select("rule_id", "l.version", "l.fingerprint")
    new = incoming.withColumn("_new", content())
    return new.join(latest, "rule_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_new"))).select("rule_id", (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.col("_new").alias("fingerprint"))


def library_fingerprint(rules: DataFrame) -> DataFrame:
    """The first 12 digits of a hash over all rules in order; rules are few."""
    one = F.concat_ws(":", "rule_id", "check_type", F.format_string("%.1f", "weight"), F.col("critical").cast("string"))
    return rules.agg(F.array_sort(F.collect_list(one)).alias("all")).select(F.substring(F.sha1(F.array_join("all", ",")), 1, 12).alias("fingerprint"))


def reapplied(violations: DataFrame, decided: DataFrame) -> DataFrame:
    """Fresh violations with what people had decided of failures of the same rule."""
    state = F.when((F.col("status") == "FAIL") & F.col("decision").isin("CONFIRMED", "DISMISSED", "RESOLVED"), F.col("decision")).when(F.col("status") == "FAIL", "OPEN").otherwise("NEEDS_REVIEW")
    return violations.join(decided.select("inspection_id", "rule_number", "decision"), ["inspection_id", "rule_number"], "left").withColumn("violation_state", state).drop("decision")
