"""Queries over scores, scans and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelkite.operators import repository, scoring
from labelkite.session import table
from labelkite.sources import domain
from labelkite.sources.domain import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


@query("""SELECT v.inspection_id, organization_id, n_name AS organization, score, coverage, decided_weight, applicable_weight, n_failed, verdict
          FROM verdicts v JOIN inspections i ON v.inspection_id = i.inspection_id JOIN nation ON organization_id = n_nationkey""")
def flagship_inspection_scores(spark, d):
    v = scoring.with_verdicts(scoring.scores(domain.evaluations(spark, d)))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("organization"))
    joined = v.join(domain.inspections(spark, d).select("inspection_id", "organization_id"), "inspection_id").join(names, "organization_id")
    return joined.select("inspection_id", "organization_id", "organization", "score", "coverage", "decided_weight", "applicable_weight", "n_failed", "verdict")


@query("""SELECT inspection_id, CASE WHEN bool_or(status = 'FAIL') THEN 'NON_COMPLIANT'
            WHEN bool_or(status = 'UNCERTAIN' AND check_type <> 'manual_only') OR bool_or(status = 'NOT_APPLICABLE' AND applicability_kind = 'EVIDENCE_MISSING') THEN 'NEEDS_MANUAL_REVIEW'
            WHEN bool_or(status <> 'NOT_APPLICABLE') THEN 'COMPLIANT' ELSE 'NEEDS_MANUAL_REVIEW' END AS decision
          FROM evaluations GROUP BY 1""")
def inspection_decisions(spark, d):
    return scoring.decisions(domain.evaluations(spark, d))


@query("SELECT inspection_id, rule_number, status, severity FROM violations")
def rule_violations(spark, d):
    return scoring.violations(domain.evaluations(spark, d))


@query("""SELECT inspection_id, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail,
            count(*) FILTER (status = 'UNCERTAIN' AND check_type <> 'manual_only') AS n_uncertain, count(*) FILTER (status = 'NOT_APPLICABLE') AS n_not_applicable,
            round(avg(CASE WHEN status <> 'NOT_APPLICABLE' THEN confidence END), 6) AS mean_confidence
          FROM evaluations GROUP BY 1""")
def review_counts(spark, d):
    return scoring.review_counts(domain.evaluations(spark, d), digits=6)


@query("""SELECT facet, value, count(*) AS n FROM (
            SELECT 'review_status' AS facet, review_status AS value FROM scans UNION ALL SELECT 'verdict', verdict FROM scans
            UNION ALL SELECT 'category', nullif(category, '') FROM scans UNION ALL SELECT 'coverage', CASE WHEN coalesce(coverage, 0) < 70 THEN 'below_floor' END FROM scans)
          WHERE value IS NOT NULL GROUP BY 1, 2""")
def scan_facets(spark, d):
    return repository.facets(repository.scans(spark, d))


@query("SELECT * FROM scans WHERE organization_id = 3")
def scans_in_scope(spark, d):
    return repository.scope(repository.scans(spark, d), "REGULATED_ENTITY", 3)


@query("SELECT v.* FROM violations v WHERE inspection_id IN (SELECT inspection_id FROM inspections WHERE organization_id = 3)")
def violations_in_scope(spark, d):
    return repository.scope_through(scoring.violations(domain.evaluations(spark, d)), domain.inspections(spark, d), "INTERNAL_COMPLIANCE", 3)


@query("SELECT scan_id, product_name, score FROM scans WHERE (product_name ILIKE '%a_e%' OR brand ILIKE '%a_e%') AND score >= 50 AND score <= 90 AND review_status = 'FINALIZED'")
def scans_searched(spark, d):
    found = repository.search(repository.scans(spark, d), "a_e", ("product_name", "brand"))
    return repository.filtered(found, review_status="finalized", min_score=50, max_score=90).select("scan_id", "product_name", "score")


@query("SELECT scan_id, score, product_name FROM scans ORDER BY score DESC, scan_id DESC LIMIT 20 OFFSET 20")
def scan_page(spark, d):
    return repository.page(repository.scans(spark, d), sort="score_desc", page=2).select("scan_id", "score", "product_name")


@query("""SELECT product_id, count(*) AS n_scans, min(scanned_at) AS first_scanned_at, max(scanned_at) AS last_scanned_at,
            arg_max(score, (scanned_at, scan_id)) AS last_score, arg_max(verdict, (scanned_at, scan_id)) AS last_verdict,
            arg_max(review_status, (scanned_at, scan_id)) AS last_status, count(*) FILTER (review_status <> 'FINALIZED') AS n_pending
          FROM scans GROUP BY 1""")
def product_rollup(spark, d):
    return repository.rollup(repository.scans(spark, d))


@query("""SELECT product_id, scan_id, score, (row_number() OVER w)::INT AS n, round_even(score - lag(score) OVER w, 1) AS change
          FROM scans WHERE score IS NOT NULL WINDOW w AS (PARTITION BY product_id ORDER BY scanned_at, scan_id)""")
def product_history(spark, d):
    return repository.history(repository.scans(spark, d))


@query("""SELECT scan_id, CASE WHEN review_status = 'FINALIZED' THEN 'FINALIZED' WHEN i.status = 'PROCESSING' THEN 'PROCESSING' WHEN review_status = 'AI_PRELIMINARY' THEN 'AI_ANALYSIS_COMPLETE'
            WHEN verdict = 'NEEDS_MANUAL_REVIEW' OR coalesce(n, 0) > 0 THEN 'NEEDS_MANUAL_REVIEW' ELSE 'PENDING_FINALIZATION' END AS report_status
          FROM scans JOIN inspections i ON scan_id = i.inspection_id LEFT JOIN (SELECT inspection_id AS v, count(*) AS n FROM violations GROUP BY 1) ON scan_id = v""")
def scan_report_status(spark, d):
    n = scoring.violations(domain.evaluations(spark, d)).groupBy(F.col("inspection_id").alias("scan_id")).agg(F.count("*").alias("n"))
    i = domain.inspections(spark, d).select(F.col("inspection_id").alias("scan_id"), "status")
    s = repository.scans(spark, d).join(i, "scan_id").join(n, "scan_id", "left")
    return s.select("scan_id", repository.report_status(F.col("status"), F.col("review_status"), F.col("verdict"), F.coalesce("n", F.lit(0))).alias("report_status"))


@query("""SELECT count(*) AS n_scans, count(*) FILTER (verdict = 'COMPLIANT') AS n_compliant, count(*) FILTER (verdict = 'NON_COMPLIANT') AS n_non_compliant,
            count(*) FILTER (verdict = 'NEEDS_MANUAL_REVIEW') AS n_review, round(avg(score), 1) AS mean_score, round(avg(coverage), 1) AS mean_coverage,
            count(*) FILTER (score < 85) AS n_below_threshold, count(*) FILTER (coalesce(coverage, 0) < 70) AS n_below_floor, count(DISTINCT nullif(product_id, 0)) AS n_products,
            count(*) FILTER (review_status <> 'FINALIZED') AS n_not_final, count(*) FILTER (review_status = 'PENDING_FINALIZATION') AS n_pending FROM scans""")
def dashboard_counts(spark, d):
    v, r = F.col("verdict"), F.col("review_status")
    return repository.scans(spark, d).agg(
        F.count("*").alias("n_scans"), F.count_if(v == "COMPLIANT").alias("n_compliant"), F.count_if(v == "NON_COMPLIANT").alias("n_non_compliant"), F.count_if(v == "NEEDS_MANUAL_REVIEW").alias("n_review"),
        F.round(F.avg("score"), 1).alias("mean_score"), F.round(F.avg("coverage"), 1).alias("mean_coverage"), F.count_if(F.col("score") < 85).alias("n_below_threshold"),
        F.count_if(F.coalesce("coverage", F.lit(0.0)) < 70).alias("n_below_floor"), F.countDistinct(F.nullif("product_id", F.lit(0))).alias("n_products"),
        F.count_if(r != "FINALIZED").alias("n_not_final"), F.count_if(r == "PENDING_FINALIZATION").alias("n_pending"),
    )


@query("SELECT coalesce(nullif(rule_number, ''), 'Other') AS title, count(*) AS n FROM violations GROUP BY 1 ORDER BY n DESC, min(inspection_id), title LIMIT 6")
def top_violation_types(spark, d):
    v = scoring.violations(domain.evaluations(spark, d)).withColumn("title", F.coalesce(F.nullif("rule_number", F.lit("")), F.lit("Other")))
    return v.groupBy("title").agg(F.count("*").alias("n"), F.min("inspection_id").alias("first")).orderBy(F.desc("n"), "first", "title").limit(6).select("title", "n")


@query("SELECT * FROM (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM inspections GROUP BY 1 ORDER BY 1 DESC LIMIT 14) ORDER BY day")
def daily_trend(spark, d):
    days = domain.inspections(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.orderBy(F.desc("day")).limit(14).orderBy("day")


@query("""SELECT product_id, left(string_agg(brand_price, '; ' ORDER BY first), 300) AS mrp_values FROM (
            SELECT product_id, mrp || '' AS brand_price, min(bill_id) AS first FROM bills GROUP BY 1, 2) GROUP BY 1""")
def product_mrp_values(spark, d):
    """Distinct printed prices of a product in the order of their first bill, as one string of at most 300 characters."""
    firsts = domain.bills(spark, d).groupBy("product_id", F.col("mrp").cast("string").alias("v")).agg(F.min("bill_id").alias("first"))
    joined = F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda x: x["v"]))
    return firsts.groupBy("product_id").agg(F.substring(joined, 1, 300).alias("mrp_values"))


@query("SELECT inspection_id, string_agg(DISTINCT rule_number, '; ' ORDER BY rule_number) AS rules FROM violations GROUP BY 1")
def legal_references(spark, d):
    v = scoring.violations(domain.evaluations(spark, d))
    return v.groupBy("inspection_id").agg(F.concat_ws("; ", F.array_sort(F.collect_set("rule_number"))).alias("rules"))


@query("""SELECT scan_id, product_id, coalesce(n, 0) AS n_violations FROM scans LEFT JOIN (SELECT inspection_id, count(*) AS n FROM violations GROUP BY 1) ON scan_id = inspection_id""")
def scan_violation_counts(spark, d):
    n = scoring.violations(domain.evaluations(spark, d)).groupBy("inspection_id").agg(F.count("*").alias("n"))
    s = repository.scans(spark, d)
    return s.join(n, s.scan_id == n.inspection_id, "left").select("scan_id", "product_id", F.coalesce("n", F.lit(0)).alias("n_violations"))


@query("""SELECT inspection_id, string_agg(DISTINCT rule_number, ', ' ORDER BY rule_number) AS open_rules FROM violations WHERE severity = 'HIGH' GROUP BY 1 ORDER BY 1 LIMIT 8""")
def conflict_queue(spark, d):
    v = scoring.violations(domain.evaluations(spark, d)).filter("severity = 'HIGH'")
    return v.groupBy("inspection_id").agg(F.concat_ws(", ", F.array_sort(F.collect_set("rule_number"))).alias("open_rules")).orderBy("inspection_id").limit(8)


@query("""SELECT v.inspection_id, rule_number, coalesce(product_name, '') AS product_name FROM violations v LEFT JOIN scans ON v.inspection_id = scan_id WHERE v.severity = 'HIGH'""")
def violations_with_products(spark, d):
    v = scoring.violations(domain.evaluations(spark, d)).filter("severity = 'HIGH'")
    s = repository.scans(spark, d).select("scan_id", "product_name")
    return v.join(s, v.inspection_id == s.scan_id, "left").select("inspection_id", "rule_number", F.coalesce("product_name", F.lit("")).alias("product_name"))


@query("SELECT a.scan_id, b.scan_id AS sibling_id, b.score FROM scans a JOIN scans b ON a.product_id = b.product_id AND a.scan_id <> b.scan_id WHERE a.review_status = 'AI_PRELIMINARY'")
def scan_siblings(spark, d):
    s = repository.scans(spark, d)
    a = s.filter("review_status = 'AI_PRELIMINARY'").select(F.col("scan_id"), "product_id")
    b = s.select(F.col("scan_id").alias("sibling_id"), F.col("product_id").alias("p"), "score")
    return a.join(b, (F.col("product_id") == F.col("p")) & (F.col("scan_id") != F.col("sibling_id"))).select("scan_id", "sibling_id", "score")


@query("SELECT i.inspection_id FROM inspections i WHERE NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.inspection_id = i.inspection_id)")
def inspections_without_evaluations(spark, d):
    return domain.inspections(spark, d).join(domain.evaluations(spark, d), "inspection_id", "left_anti").select("inspection_id")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_actors, min(o_orderkey) AS oldest, count(*) FILTER (o_orderpriority IS DISTINCT FROM '1-URGENT') AS n_legacy FROM orders")
def legacy_preview(spark, d):
    """How many records are not of the current version, where none counts as another."""
    o = table(spark, d, "orders")
    return o.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_actors"), F.min("o_orderkey").alias("oldest"), F.count_if(~F.col("o_orderpriority").eqNullSafe("1-URGENT")).alias("n_legacy"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 50 OFFSET 10")
def audit_page(spark, d):
    return table(spark, d, "events").filter("event_type = 'click'").orderBy(F.desc("event_id")).offset(10).limit(50).select("event_id", "user_id", "event_type")


@query("SELECT DISTINCT event_type AS action FROM events WHERE event_type <> ''")
def audit_actions(spark, d):
    return table(spark, d, "events").filter("event_type <> ''").select(F.col("event_type").alias("action")).distinct()


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS hits FROM events")
def hits_in_window(spark, d):
    """For each event the hits of its user in the hour before."""
    e = table(spark, d, "events")
    micros = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count("*").over(micros).alias("hits"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def audit_details(spark, d):
    """A number out of a JSON column; text that isn't JSON gives null."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
