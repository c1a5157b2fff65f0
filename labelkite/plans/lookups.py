"""Queries for latest rows, versions, numbers, qualities, and readings of label-like lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelkite.operators import extract, lookups, quality, scoring
from labelkite.session import dealt, table
from labelkite.sources import domain
from labelkite.sources.domain import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return register


@query("""SELECT organization_id, inspection_id, printf('INS-%s-%06d', strftime(created_at, '%Y'),
            row_number() OVER (PARTITION BY strftime(created_at, '%Y') ORDER BY CAST(created_at AS DATE), inspection_id)) AS inspection_number FROM inspections""")
def inspection_numbers(spark, d):
    i = domain.inspections(spark, d)
    n = lookups.numbered(i, F.date_format("created_at", "yyyy"), F.to_date("created_at"), "inspection_id", "INS")
    return n.select("organization_id", "inspection_id", F.col("number").alias("inspection_number"))


@query("""WITH a AS (SELECT event_id AS analysis_id, CASE WHEN user_id % 7 > 0 THEN (user_id % 25)::INT END AS organization_id FROM events),
          few AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY analysis_id DESC) AS place FROM a)
          SELECT o_orderkey AS scan_id, analysis_id, place::INT AS place FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN few ON CASE WHEN o_orderkey % 5 > 0 THEN c_nationkey END IS NOT DISTINCT FROM few.organization_id WHERE place <= 5""")
def scan_analyses(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("analysis_id"), F.when(F.col("user_id") % 7 > 0, (F.col("user_id") % 25).cast("int")).alias("organization_id"))
    s = domain.inspections(spark, d).select(F.col("inspection_id").alias("scan_id"), F.when(F.col("inspection_id") % 5 > 0, F.col("organization_id")).alias("organization_id"))
    return lookups.analyses_of_scans(s, a)


@query("SELECT user_id AS inspection_id, event_id AS classification_id, event_type AS category FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_classifications(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("inspection_id"), F.col("event_id").alias("classification_id"), F.col("event_type").alias("category"))
    return lookups.latest(e, ["inspection_id"], "classification_id", ["category"])


@query("SELECT event_id AS inspection_id, event_type AS status, value AS latency FROM events WHERE event_type <> '' ORDER BY event_id DESC LIMIT 1")
def latest_perception(spark, d):
    e = table(spark, d, "events").filter("event_type <> ''").select(F.col("event_id").alias("inspection_id"), F.col("event_type").alias("status"), F.col("value").alias("latency"))
    return lookups.latest(e, [], "inspection_id", ["status", "latency"])


@query("""SELECT DISTINCT l_orderkey AS inspection_id, (l_partkey * 10 + l_linenumber) AS listing_id FROM lineitem WHERE l_orderkey = 7 ORDER BY listing_id DESC""")
def inspection_listings(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inspection_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("listing_id")).distinct()
    return lookups.listings_of(l, 7)


@query("""WITH r AS (SELECT l_linenumber AS rule_id, max(l_suppkey % 7) AS current_version FROM lineitem GROUP BY 1),
          v AS (SELECT DISTINCT l_linenumber AS rule_id, l_suppkey % 7 AS version, 'Rule ' || l_linenumber || ' v' || (l_suppkey % 7) AS title FROM lineitem WHERE l_linenumber <> 4)
          SELECT r.rule_id, current_version, title FROM r LEFT JOIN v ON r.rule_id = v.rule_id AND current_version = version""")
def current_rules(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("rule_id"), (F.col("l_suppkey") % 7).alias("version"))
    rules = l.groupBy("rule_id").agg(F.max("version").alias("current_version"))
    versions = l.filter("rule_id <> 4").distinct().withColumn("title", F.concat(F.lit("Rule "), "rule_id", F.lit(" v"), "version"))
    return lookups.with_current(rules, versions)


@query("SELECT inspection_id, status FROM inspections i WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = inspection_id AND l_returnflag = 'R')")
def inspections_with_images(spark, d):
    images = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("inspection_id"))
    return domain.inspections(spark, d).join(images, "inspection_id", "left_semi").select("inspection_id", "status")


_IMAGES = "(SELECT l_orderkey AS inspection_id, l_quantity * 2 AS score, ['GOOD', 'ACCEPTABLE', 'POOR', 'UNUSABLE'][(l_partkey % 4 + 1)::INT] AS quality, (l_partkey % 4 + 1)::INT AS rank FROM lineitem WHERE l_linenumber <> 2)"


@query(f"""SELECT i.inspection_id, coalesce(round_even(avg(score), 3), 0)::DOUBLE AS score, coalesce(arg_max(quality, rank), 'UNUSABLE') AS quality
           FROM inspections i LEFT JOIN {_IMAGES} m ON i.inspection_id = m.inspection_id GROUP BY 1""")
def overall_image_quality(spark, d):
    quality = F.element_at(F.array(*[F.lit(q) for q in lookups.QUALITIES]), (F.col("l_partkey") % 4 + 1).cast("int"))
    images = table(spark, d, "lineitem").filter("l_linenumber <> 2").select(F.col("l_orderkey").alias("inspection_id"), (F.col("l_quantity") * 2).alias("score"), quality.alias("quality"))
    return lookups.overall_quality(domain.inspections(spark, d).select("inspection_id"), images)


@query("""SELECT inspection_id, count(*) FILTER (status IN ('UNCERTAIN', 'FAIL', 'NEEDS_MANUAL_REVIEW')) AS n_unresolved,
            min(rule_number) FILTER (status IN ('UNCERTAIN', 'FAIL', 'NEEDS_MANUAL_REVIEW')) AS first FROM evaluations GROUP BY 1""")
def unresolved_checks(spark, d):
    """From each scan's checks as one JSON snapshot, as they are stored."""
    snapshot = domain.evaluations(spark, d).groupBy("inspection_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rule_number", "status")))).alias("checks"))
    found = snapshot.select("inspection_id", lookups.unresolved(F.from_json("checks", "array<struct<rule_number string, status string>>")).alias("u"))
    return found.select("inspection_id", F.size("u").cast("bigint").alias("n_unresolved"), F.get("u", F.lit(0))["rule_number"].alias("first"))


@query("""SELECT scan_id, stored, score, round_even(score - stored, 1)::DOUBLE AS change FROM (
            SELECT inspection_id AS scan_id, score, CASE inspection_id % 3 WHEN 0 THEN NULL WHEN 1 THEN score ELSE 50.0 END::DOUBLE AS stored FROM scores)
          WHERE stored IS NULL OR abs(stored - score) >= 0.05""")
def rescore_report(spark, d):
    s = scoring.scores(domain.evaluations(spark, d)).select(F.col("inspection_id").alias("scan_id"), "score")
    stored = s.select("scan_id", F.when(F.col("scan_id") % 3 == 0, None).when(F.col("scan_id") % 3 == 1, F.col("score")).otherwise(50.0).alias("score"))
    return lookups.rescored(stored, s)


@query("""SELECT category, count(DISTINCT p_partkey) AS products, sum(p_size % 4)::BIGINT AS views, sum(p_size % 3)::BIGINT AS fields
          FROM (SELECT *, coalesce(CASE WHEN p_size % 10 > 0 THEN p_brand END, 'UNKNOWN') AS category FROM part) GROUP BY 1""")
def dataset_stats(spark, d):
    n = F.col("p_size").cast("int")
    keys = F.transform(F.slice(F.array(*[F.lit(i) for i in range(3)]), F.lit(1), n % 3), lambda i: F.concat(F.lit("f"), i.cast("string")))
    a = table(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") % 10 > 0, F.col("p_brand")).alias("category"),
        F.array_repeat(F.lit("FRONT"), n % 4).alias("views"), F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit("v"))).alias("fields"),
    )
    return lookups.dataset_counts(a, "category")


@query("""SELECT p_partkey AS inspection_id, unnest([
            {'field_name': 'mrp', 'value': printf('%.2f', p_retailprice)}, {'field_name': 'net_quantity', 'value': p_size || ' g'},
            {'field_name': 'batch_lot', 'value': 'B' || p_partkey || 'X7'}, {'field_name': 'date_manufacturing', 'value': printf('2026-%02d-%02d', p_size % 12 + 1, p_size % 15 + 13)},
            {'field_name': 'date_expiry', 'value': (p_size % 30 + 1) || ' months'}, {'field_name': 'fssai_license', 'value': printf('1%013d', p_partkey)},
            {'field_name': 'unit_sale_price', 'value': printf('Rs. %.2f/g', p_retailprice)}, {'field_name': 'consumer_care_email', 'value': 'care' || p_partkey || '@example.com'},
            {'field_name': 'consumer_care_phone', 'value': printf('98%08d', p_partkey)}, {'field_name': 'website', 'value': 'https://www.site' || p_partkey || '.example.com/'},
            {'field_name': 'country_of_origin', 'value': 'India'}, {'field_name': 'manufacturer', 'value': 'Acme ' || p_partkey || ' Foods Pvt Ltd'}], recursive := true) FROM part""")
def declared_readings(spark, d):
    """A pack's lines made up from each part, one declaration a line, and what the extractors read from them."""
    p = dealt(table(spark, d, "part"), "p_partkey")
    two = lambda pattern, *c: F.format_string(pattern, *c)
    texts = F.array(
        two("MRP Rs. %.2f (incl. of all taxes)", F.col("p_retailprice")), two("Net Wt. %d grams", F.col("p_size")), two("Batch No: B%dX7", F.col("p_partkey")),
        two("Mfg Date %02d/%02d/2026", F.col("p_size") % 15 + 13, F.col("p_size") % 12 + 1), two("Use by %d months", F.col("p_size") % 30 + 1), two("FSSAI Lic. No. 1%013d", F.col("p_partkey")),
        two("Rs. %.2f/g", F.col("p_retailprice")), two("Care%d@example.com", F.col("p_partkey")), two("Customer care 98%08d", F.col("p_partkey")), two("https://www.site%d.example.com/", F.col("p_partkey")),
        F.lit("Country of Origin: India"), two("Acme %d Foods Pvt Ltd", F.col("p_partkey")), F.lit("Nutrition facts"), F.lit("Energy 450 kcal"), F.lit("12.5"), F.lit("Protein 3 g"),
    )
    lines = p.select(F.col("p_partkey").alias("inspection_id"), F.lit(1).alias("image_id"), F.lit(0.9).alias("confidence"), F.posexplode(texts).alias("line_index", "text"))
    return extract.candidates(lines.select("inspection_id", "image_id", "line_index", "text", "confidence")).select("inspection_id", "field_name", "value")


@query("""WITH p AS (SELECT * FROM part WHERE p_partkey % 7 > 0), n AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 3 = 0) AS third, count(*) FILTER (p_partkey % 2 = 0) AS half FROM p)
          SELECT 'brand' AS field, n AS exact, 0 AS same, 0 AS wrong, 0 AS missing, 1.0::DOUBLE AS accuracy, 0.9::DOUBLE AS mean_confidence FROM n
          UNION ALL SELECT 'mrp', 0, third, n - third, 0, round_even(third / n::DOUBLE, 4), 0.8 FROM n
          UNION ALL SELECT 'net_quantity_value', half, 0, 0, n - half, round_even(half / n::DOUBLE, 4), 0.7 FROM n UNION ALL SELECT 'net_quantity_unit', 0, 0, 0, n, 0.0, NULL FROM n""")
def ground_truth_evaluation(spark, d):
    """Annotated products against what two views of each gave; a seventh of them has no view."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    spec = lambda value, unit=None: F.struct(value.alias("value"), F.lit(unit).cast("string").alias("unit"))
    price = F.format_string("%.2f", "p_retailprice")
    annotations = p.select(k.alias("product_id"), F.create_map(F.lit("mrp"), spec(price), F.lit("brand"), spec(F.col("p_brand")), F.lit("net_quantity"), spec(F.col("p_size").cast("string"), "g")).alias("fields"))
    read = lambda when, view, field, value, sure: F.when(when, F.struct(F.lit(view).alias("view_index"), F.lit(field).alias("field"), value.alias("value"), F.lit(sure).alias("confidence")))
    every = F.lit(True)
    views = F.array_compact(F.array(
        read(every, 0, "mrp", F.lit("0.00"), 0.5), read(every, 0, "brand", F.lower("p_brand"), 0.9), read(k % 2 == 0, 0, "net_quantity_value", F.col("p_size").cast("string"), 0.7),
        read(k % 3 == 0, 1, "mrp", F.concat(F.lit("Rs. "), price), 0.8), read(every, 1, "brand", F.lit("other"), 0.4),
    ))
    return quality.evaluated(annotations, p.filter(k % 7 > 0).select(k.alias("product_id"), F.inline(views)))
