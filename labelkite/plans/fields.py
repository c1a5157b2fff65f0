"""Queries over candidate readings, rules, reviews, datasets and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelkite.operators import assistant, extract, history, listings, quality, ranking, repository, rules, scoring
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


def fields(spark, d):
    return ranking.states(ranking.winners(domain.candidates(spark, d)))


@query("SELECT inspection_id, field_name, value, score, state FROM fields")
def winning_fields(spark, d):
    return fields(spark, d).select("inspection_id", "field_name", "value", "score", "state")


@query("""SELECT inspection_id, field_name, value, bbox, min(seq) AS seq FROM (
            SELECT *, bool_or(corrected) OVER (PARTITION BY inspection_id, field_name, bbox) AS any_corrected FROM candidates)
          WHERE corrected OR NOT any_corrected GROUP BY 1, 2, 3, 4""")
def deduplicated_candidates(spark, d):
    return ranking.deduplicated(domain.candidates(spark, d)).select("inspection_id", "field_name", "value", "bbox", "seq")


@query("""SELECT i.inspection_id, t.field_name, f.value, coalesce(f.state, 'MISSING') AS state FROM inspections i
          CROSS JOIN (SELECT unnest(['product_name', 'brand', 'manufacturer', 'net_quantity', 'mrp', 'batch_lot', 'marketer']) AS field_name) t
          LEFT JOIN fields f ON f.inspection_id = i.inspection_id AND f.field_name = t.field_name""")
def dense_fields(spark, d):
    return ranking.with_missing(fields(spark, d), domain.inspections(spark, d), domain.FIELD_NAMES).select("inspection_id", "field_name", "value", "state")


@query("""SELECT inspection_id, field_name, value, round_even(confidence, 3) AS confidence FROM fields UNION ALL
          SELECT inspection_id, 'manufacturer', value, round_even(confidence * 0.8, 3) FROM fields f WHERE field_name = 'marketer'
            AND NOT EXISTS (SELECT 1 FROM fields g WHERE g.inspection_id = f.inspection_id AND g.field_name IN ('manufacturer', 'packer', 'importer'))""")
def marketers_promoted(spark, d):
    out = ranking.promoted_marketer(fields(spark, d))
    return out.select("inspection_id", "field_name", "value", F.bround("confidence", 3).alias("confidence"))


@query("""SELECT inspection_id, coalesce(max(value) FILTER (field_name = 'product_name'), '') AS product_name, coalesce(max(value) FILTER (field_name = 'brand'), '') AS brand,
            coalesce(max(value) FILTER (field_name = 'manufacturer'), max(value) FILTER (field_name = 'marketer'), '') AS manufacturer,
            coalesce(max(value) FILTER (field_name = 'net_quantity'), '') AS net_quantity, coalesce(max(value) FILTER (field_name = 'mrp'), '') AS mrp FROM fields GROUP BY 1""")
def identities(spark, d):
    return ranking.identity(fields(spark, d))


@query("""SELECT c.inspection_id, c.field_name, c.value, c.seq FROM candidates c WHERE NOT (field_name = 'product_name' AND EXISTS (
            SELECT 1 FROM winners w WHERE w.inspection_id = c.inspection_id AND w.field_name = 'brand' AND w.value = c.value))""")
def names_without_brands(spark, d):
    c = domain.candidates(spark, d)
    return ranking.without_brand_names(c, ranking.winners(c)).select("inspection_id", "field_name", "value", "seq")


_CONTEXT = """(SELECT inspection_id, ['FOOD', 'COSMETIC', 'GARMENT', 'OTHER'][inspection_id % 4 + 1] AS category, ['DETECTED', 'UNCERTAIN', 'CONFLICTING'][inspection_id % 3 + 1] AS category_state,
               inspection_id % 5 = 0 AS is_import, CASE WHEN inspection_id % 7 = 0 THEN 'wholesale_package' ELSE 'retail_package' END AS packaging FROM inspections)"""


def contexts(spark, d):
    i = F.col("inspection_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    return domain.inspections(spark, d).select(
        i, pick(("FOOD", "COSMETIC", "GARMENT", "OTHER"), 4).alias("category"), pick(("DETECTED", "UNCERTAIN", "CONFLICTING"), 3).alias("category_state"),
        (i % 5 == 0).alias("is_import"), F.when(i % 7 == 0, "wholesale_package").otherwise("retail_package").alias("packaging"),
    )


_RULES = "(VALUES " + ", ".join(f"('{r[0]}', '{r[2]}', '{r[5]}', {list(r[6])}::VARCHAR[], {list(r[7])}::VARCHAR[])" for r in rules.LIBRARY) + ") r(rule_id, check_type, scope, categories, wanted)"
_APPLIED = f"""SELECT c.inspection_id, r.rule_id, r.check_type, r.wanted, CASE WHEN scope = 'import_only' THEN CASE WHEN is_import THEN 'APPLIES' ELSE 'EVIDENCE_MISSING' END
    WHEN scope <> 'any' AND packaging <> scope THEN 'INAPPLICABLE' WHEN len(categories) > 0 AND category_state IN ('UNCERTAIN', 'CONFLICTING') THEN 'EVIDENCE_MISSING'
    WHEN len(categories) > 0 AND NOT list_contains(categories, category) THEN 'INAPPLICABLE' ELSE 'APPLIES' END AS applicability_kind FROM {_CONTEXT} c CROSS JOIN {_RULES}"""


@query(f"SELECT inspection_id, rule_id, applicability_kind FROM ({_APPLIED})")
def rule_applicability(spark, d):
    return rules.applicability(rules.library(spark), contexts(spark, d)).select("inspection_id", "rule_id", "applicability_kind")


@query(f"""SELECT a.inspection_id, a.rule_id, CASE WHEN any_value(applicability_kind) <> 'APPLIES' THEN 'NOT_APPLICABLE' WHEN coalesce(bool_or(state = 'DETECTED'), false) THEN 'PASS' ELSE 'UNCERTAIN' END AS status
           FROM (SELECT *, unnest(wanted) AS field_name FROM ({_APPLIED}) WHERE check_type IN ('declaration_present', 'net_quantity', 'mrp_declaration')) a
           LEFT JOIN fields f ON f.inspection_id = a.inspection_id AND f.field_name = a.field_name GROUP BY 1, 2""")
def declaration_outcomes(spark, d):
    applied = rules.applicability(rules.library(spark), contexts(spark, d))
    return rules.declarations(applied, fields(spark, d).withColumn("human_absent", F.lit(False))).select("inspection_id", "rule_id", "status")


@query("""SELECT p_partkey, CASE WHEN p_size > 20 THEN CASE WHEN a <= 50 THEN 1.0 WHEN a <= 100 THEN 1.5 WHEN a <= 500 THEN 2.5 WHEN a <= 2500 THEN 4.0 ELSE 6.0 END
            ELSE CASE WHEN a <= 100 THEN 1.0 WHEN a <= 500 THEN 2.0 WHEN a <= 2500 THEN 4.0 ELSE 6.0 END END::DOUBLE AS required_mm FROM (SELECT *, floor(p_retailprice) AS a FROM part)""")
def letter_heights(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.floor("p_retailprice").cast("double").alias("area_cm2"), F.when(F.col("p_size") > 20, "MASS").otherwise("NUMBER").alias("family"), F.lit(False).alias("moulded"))
    return rules.required_heights(p).select("p_partkey", "required_mm")


@query("""SELECT v.inspection_id, v.rule_number, v.status, CASE WHEN v.status = 'FAIL' AND decision IS NOT NULL THEN decision WHEN v.status = 'FAIL' THEN 'OPEN' ELSE 'NEEDS_REVIEW' END AS violation_state
          FROM violations v LEFT JOIN (SELECT o_orderkey AS inspection_id, 'LM-1' AS rule_number, CASE WHEN o_orderkey % 2 = 0 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS decision FROM orders WHERE o_orderkey % 3 = 0) USING (inspection_id, rule_number)""")
def violations_reapplied(spark, d):
    o = F.col("o_orderkey")
    decided = table(spark, d, "orders").filter(o % 3 == 0).select(o.alias("inspection_id"), F.lit("LM-1").alias("rule_number"), F.when(o % 2 == 0, "CONFIRMED").otherwise("DISMISSED").alias("decision"))
    return rules.reapplied(scoring.violations(domain.evaluations(spark, d)), decided).select("inspection_id", "rule_number", "status", "violation_state")


_ACTIONS = """(SELECT l_orderkey AS inspection_id, ['product_name', 'brand', 'manufacturer', 'net_quantity', 'mrp', 'batch_lot', 'marketer'][l_linenumber % 7 + 1] AS field_name,
    max(l_partkey) AS action_id FROM lineitem WHERE l_tax >= 0.06 GROUP BY 1, 2)"""


@query(f"""SELECT inspection_id, field_name, CASE action_id % 4 WHEN 0 THEN 'edited' WHEN 1 THEN '' WHEN 2 THEN '' ELSE value END AS value,
             CASE action_id % 4 WHEN 0 THEN 'MANUALLY_CORRECTED' WHEN 1 THEN 'CONFIRMED_ABSENT' WHEN 2 THEN 'MISSING' WHEN 3 THEN 'DETECTED' ELSE state END AS state, coalesce(action_id % 4 = 1, false) AS human_absent
           FROM fields FULL JOIN {_ACTIONS} USING (inspection_id, field_name)""")
def reviewed_fields(spark, d):
    l = table(spark, d, "lineitem").filter("l_tax >= 0.06")
    name = F.element_at(F.array(*[F.lit(n) for n in domain.FIELD_NAMES]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(a) for a in ("EDIT", "CONFIRM_ABSENT", "REJECT", "ACCEPT")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    actions = l.select(F.col("l_orderkey").alias("inspection_id"), name.alias("field_name"), F.col("l_partkey").alias("action_id"), kind.alias("action"), F.lit("edited").alias("value"))
    return history.overlaid(fields(spark, d).select("inspection_id", "field_name", "value", "state"), actions)


@query("""SELECT inspection_id, b.value AS before, a.value AS after, CASE WHEN b.inspection_id IS NULL THEN 'ADDED' WHEN a.inspection_id IS NULL THEN 'REMOVED' WHEN b.value IS NOT DISTINCT FROM a.value THEN 'SAME' ELSE 'CHANGED' END AS change
          FROM (SELECT * FROM fields WHERE field_name = 'brand') b FULL JOIN (SELECT * FROM fields WHERE field_name = 'product_name') a USING (inspection_id)""")
def field_changes(spark, d):
    f = fields(spark, d)
    return history.field_changes(f.filter("field_name = 'brand'"), f.filter("field_name = 'product_name'"), ["inspection_id"], "value")


@query("""SELECT inspection_id, coalesce(string_agg(DISTINCT rule_number, ', ' ORDER BY rule_number) FILTER (low AND NOT high), '') AS newly_flagged,
            coalesce(string_agg(DISTINCT rule_number, ', ' ORDER BY rule_number) FILTER (high AND NOT low), '') AS no_longer_flagged
          FROM (SELECT inspection_id, rule_number, bool_or(status = 'FAIL') AS high, bool_or(status = 'UNCERTAIN') AS low FROM violations GROUP BY 1, 2) GROUP BY 1""")
def flag_changes(spark, d):
    v = scoring.violations(domain.evaluations(spark, d))
    return history.flag_changes(v.filter("status = 'FAIL'"), v.filter("status = 'UNCERTAIN'"))


@query("""SELECT scan_id, CASE WHEN scan_id % 5 = 0 THEN 'COMPLIANT' ELSE official_decision END AS official_decision, CASE WHEN scan_id % 5 = 0 THEN 'FINALIZED' ELSE review_status END AS review_status FROM scans""")
def finalised_scans(spark, d):
    s = repository.scans(spark, d)
    final = table(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("scan_id"), F.lit("COMPLIANT").alias("decision"))
    return history.finalised(s, final).select("scan_id", "official_decision", "review_status")


@query("""SELECT l_partkey AS product_id, string_agg(DISTINCT l_shipmode, ', ' ORDER BY l_shipmode) AS splits FROM (SELECT l_partkey, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1 HAVING count(DISTINCT l_shipmode) > 1""")
def split_leakage(spark, d):
    return quality.leaked(table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("split")))


@query("""SELECT p_partkey, CASE WHEN place < 700 THEN 'train' WHEN place < 850 THEN 'validation' ELSE 'test' END AS split FROM (SELECT p_partkey, ('0x' || left(md5('7:' || p_partkey), 8))::BIGINT % 1000 AS place FROM part)""")
def product_splits(spark, d):
    return quality.split(table(spark, d, "part").select("p_partkey"), "p_partkey")


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS first FROM documents QUALIFY n > 1")
def duplicate_contents(spark, d):
    return quality.duplicates(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT event_type AS field, count(*) FILTER (ok AND exact) AS exact, count(*) FILTER (ok AND NOT exact) AS same, count(*) FILTER (NOT ok AND NOT missing) AS wrong, count(*) FILTER (missing) AS missing FROM (
            SELECT *, value = '' AS missing, lower(truth) = lower(value) AS exact, value <> '' AND (lower(truth) = lower(value) OR regexp_replace(truth, '[^0-9]', '', 'g') = regexp_replace(value, '[^0-9]', '', 'g')) AS ok FROM (
              SELECT event_type, 'X ' || user_id AS truth, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'x ' || user_id WHEN event_id % 5 = 2 THEN 'No. ' || user_id ELSE 'y' END AS value FROM events)) GROUP BY 1""")
def field_accuracy(spark, d):
    n = F.col("event_id") % 5
    u = F.col("user_id").cast("string")
    v = F.when(n == 0, "").when(n == 1, F.concat(F.lit("x "), u)).when(n == 2, F.concat(F.lit("No. "), u)).otherwise("y")
    rows = table(spark, d, "events").select(F.col("event_type").alias("field"), F.concat(F.lit("X "), u).alias("truth"), v.alias("value"), F.lit(0.5).alias("confidence"))
    return quality.field_accuracy(rows).select("field", "exact", "same", "wrong", "missing")


_HITS = " + ".join("CASE WHEN regexp_matches(t, '(^|[^a-z0-9]){}([^a-z0-9]|$)') THEN 1 ELSE 0 END".format("{}") for _ in (0,))


SPACED = r"[\x20\x09-\x0D]*"


def _category_sql() -> str:
    scores = ", ".join(f"{' + '.join(_HITS.format(w.replace(' ', SPACED)) for w in words)} AS c{i}" for i, words in enumerate(extract.CATEGORIES.values()))
    names = ", ".join(f"{{'n': c{i}, 'o': {-i}, 'c': '{c}'}}" for i, c in enumerate(extract.CATEGORIES))
    return f"""SELECT doc_id, CASE WHEN top = 0 THEN 'OTHER' ELSE r[1].c END AS category, CASE WHEN top = 0 THEN 'UNCERTAIN' WHEN second >= greatest(1, top - 1) AND top < 4 THEN 'CONFLICTING' ELSE 'DETECTED' END AS state
               FROM (SELECT doc_id, r, r[1].n AS top, r[2].n AS second FROM (SELECT doc_id, list_sort([{names}], 'DESC') AS r FROM (SELECT doc_id, {scores} FROM (SELECT doc_id, lower(text) AS t FROM documents))))"""


@query(_category_sql())
def document_categories(spark, d):
    return extract.classified(table(spark, d, "documents"), "doc_id").select("doc_id", "category", "state")


@query(None)
def document_candidates(spark, d):
    """All extractors over the lines of the documents."""
    l = domain.lines(spark, d).select(F.col("image_id").alias("inspection_id"), F.lit(1).cast("bigint").alias("image_id"), F.col("line_index").cast("bigint").alias("line_index"), "text", F.lit(0.95).alias("confidence"))
    return extract.candidates(l)


@query("""SELECT doc_id AS listing_id, ratio, CASE WHEN ratio >= 0.6 THEN 'PASS' ELSE 'UNCERTAIN' END AS status FROM (
            SELECT doc_id, ((text <> '')::INT + (lang <> 'en')::INT + (source IN ('src0', 'src1'))::INT) / 3.0::DOUBLE AS ratio FROM documents)""")
def listing_declarations(spark, d):
    rows = F.array(F.struct(F.lit("title").alias("field"), F.col("text").alias("value")), F.struct(F.lit("language").alias("field"), F.when(F.col("lang") != "en", F.col("lang")).alias("value")), F.struct(F.lit("seller").alias("field"), F.when(F.col("source").isin("src0", "src1"), F.col("source")).alias("value")))
    listed = table(spark, d, "documents").select(F.col("doc_id").alias("listing_id"), F.explode(rows).alias("x")).select("listing_id", "x.*")
    return listings.declaration_check(listed, ("title", "language", "seller")).select("listing_id", "ratio", "status")


@query(None)
def listing_comparison(spark, d):
    """Names and prices of parts against those of the parts after them."""
    p = table(spark, d, "part")
    q = p.select((F.col("p_partkey") - 1).alias("listing_id"), F.col("p_name").alias("n2"), F.col("p_retailprice").cast("string").alias("m2"))
    both = p.join(q, F.col("p_partkey") == F.col("listing_id"))
    pairs = both.select("listing_id", F.explode(F.array(F.struct(F.lit("product_name").alias("field"), F.col("p_name").alias("package"), F.col("n2").alias("listing")), F.struct(F.lit("mrp").alias("field"), F.col("p_retailprice").cast("string").alias("package"), F.col("m2").alias("listing")))).alias("x"))
    return listings.compared(pairs.select("listing_id", "x.*", F.lit("DETECTED").alias("package_state")))


@query("""SELECT conv_id, turn, CASE WHEN list_contains(w, 'net') AND list_contains(w, 'quantity') THEN 'net_quantity' WHEN list_contains(w, 'mrp') THEN 'mrp' WHEN list_contains(w, 'brand') THEN 'brand' END AS field
          FROM (SELECT conv_id, turn, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM conversations)""")
def named_fields(spark, d):
    q = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("question_id"), "text")
    return assistant.named_field(q, ("net_quantity", "mrp", "brand")).select("question_id.conv_id", "question_id.turn", "field")
