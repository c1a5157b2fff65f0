"""Queries over what is put right and what changes: lost spaces, misread digits, two results of an inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelkite.operators import identity, needles, ranking, repair, snapshots
from labelkite.plans.layout import _LINED, lined
from labelkite.session import dealt, table
from labelkite.sources.domain import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return register


@query(r"""WITH RECURSIVE vocabulary AS (SELECT DISTINCT unnest(string_split(p_name, ' ') || ['pack']) AS word FROM part),
     texts AS (SELECT p_partkey, p_partkey % 4 AS k, upper(replace(p_name, ' ', '')) AS fused, upper(p_name) AS name, p_size FROM part),
     given AS (SELECT p_partkey, CASE k WHEN 0 THEN fused || p_size || 'PACK' WHEN 1 THEN '(' || fused || 'PACK),  Mfd.By' WHEN 2 THEN name ELSE fused || 'X' || p_size END AS text FROM texts),
     runs AS (SELECT DISTINCT unnest([fused, fused || 'PACK', fused || 'X', 'PACK']) AS run FROM texts),
     asked AS (SELECT run FROM runs WHERE len(run) >= 7 AND lower(run) NOT IN (SELECT word FROM vocabulary)),
     steps AS (SELECT run, i, i + len(word) AS j FROM (SELECT run, unnest(range(len(run))) AS i FROM asked) JOIN vocabulary ON lower(substr(run, i + 1, len(word))) = word AND len(word) >= 2),
     reached AS (SELECT run, 0::BIGINT AS place FROM asked UNION SELECT s.run, s.j FROM reached r JOIN steps s ON s.run = r.run AND s.i = r.place),
     first AS (SELECT s.run, s.j, min(s.i) AS i FROM steps s JOIN reached r ON s.run = r.run AND s.i = r.place GROUP BY 1, 2),
     walked AS (SELECT run, len(run)::BIGINT AS place, '' AS pieces FROM asked UNION ALL SELECT w.run, f.i, substr(w.run, f.i + 1, (f.j - f.i)::INT) || CASE WHEN pieces = '' THEN '' ELSE ' ' || pieces END FROM walked w JOIN first f ON f.run = w.run AND f.j = w.place),
     apart AS (SELECT run, pieces FROM walked WHERE place = 0 AND pieces <> ''),
     whole AS (SELECT r.run, coalesce(pieces, r.run) AS pieces FROM runs r LEFT JOIN apart a ON a.run = r.run)
     SELECT t.p_partkey, g.text AS raw_value,
            CASE k WHEN 0 THEN a.pieces || ' ' || p_size || ' PACK' WHEN 1 THEN '(' || b.pieces || '), Mfd. By' WHEN 2 THEN name ELSE c.pieces || ' ' || p_size END AS value
     FROM texts t JOIN given g ON g.p_partkey = t.p_partkey JOIN whole a ON a.run = fused JOIN whole b ON b.run = fused || 'PACK' JOIN whole c ON c.run = fused || 'X'""")
def respaced_names(spark, d):
    """Names without their spaces come back; whole words and runs with a foreign letter stay."""
    p = table(spark, d, "part")
    words = p.select(F.explode(F.concat(F.split("p_name", " "), F.array(F.lit("pack")))).alias("word")).distinct()
    fused, k, size = F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(fused, size, F.lit("PACK"))).when(k == 1, F.concat(F.lit("("), fused, F.lit("PACK),  Mfd.By"))).when(k == 2, F.upper("p_name")).otherwise(F.concat(fused, F.lit("X"), size))
    named = p.select("p_partkey", F.lit("product_name").alias("field_name"), text.alias("value"))
    return repair.shown(named, words).select("p_partkey", "raw_value", "value")


@query("""SELECT p_partkey AS inspection_id, unnest([
            {'field_name': 'mrp', 'value': printf('%.2f', p_retailprice), 'corrected': regexp_matches(printf('%.2f', p_retailprice), '[015]')},
            {'field_name': 'fssai_license', 'value': printf('1%013d', p_partkey), 'corrected': true},
            {'field_name': 'batch_lot', 'value': 'AO1' || p_partkey || 'X7', 'corrected': false}], recursive := true) FROM part""")
def second_run_readings(spark, d):
    """Prices and licences whose digits were read as letters; the batch code beside them stays as it is."""
    p = dealt(table(spark, d, "part"), "p_partkey")
    price = F.translate(F.format_string("%.2f", "p_retailprice"), "015", "OIS")
    texts = F.array(F.concat(F.lit("MRP Rs. "), price), F.concat(F.lit("FSSAI Lic. No. "), F.translate(F.format_string("1%013d", "p_partkey"), "0", "O")), F.format_string("Batch No: AO1%dX7", "p_partkey"))
    lines = p.select(F.col("p_partkey").alias("inspection_id"), F.lit(1).alias("image_id"), F.lit(0.9).alias("confidence"), F.posexplode(texts).alias("line_index", "text"))
    read = repair.second_run(lines).withColumn("bbox", F.col("line_index").cast("string"))
    return ranking.deduplicated(read).select("inspection_id", "field_name", "value", "corrected")


_NAMES = ("product_name", "brand", "net_quantity", "mrp", "batch_lot", "date_packing", "manufacturer")


def _snapshot(spark, d, run: int):
    """A run's result of each order: a field and a rule for each line; the second run reads some lines otherwise."""
    l = lined(spark, d).filter("l_linenumber <= 7")  # noqa: E741
    k, n, p = F.col("l_orderkey").alias("inspection_id"), F.col("l_linenumber"), F.col("l_partkey")
    again = F.lit(run == 1)
    value = F.when(p % 5 == 0, F.when(again, F.concat(F.lit("new "), p.cast("string"))).otherwise("")).when(p % 5 == 1, F.when(again, "").otherwise(F.concat(F.lit("old "), p.cast("string")))).when((p % 5 == 2) & again, F.lit("other")).otherwise(F.concat(F.lit("v"), p.cast("string")))
    state = F.when(value == "", "MISSING").when((p % 5 == 3) & again, "UNCERTAIN").otherwise("DETECTED")
    status = F.when((p % 6 == 0) & again, "PASS").when(p % 3 == 0, "FAIL").otherwise("PASS")
    number = F.concat(F.lit("R"), n.cast("string"))
    fields = l.select(k, F.get(F.array(*[F.lit(x) for x in _NAMES]), (n - 1).cast("int")).alias("field_name"), value.alias("value"), state.alias("state"), (p % 2 == 0).alias("manually_corrected"))
    rules = l.select(k, number.alias("rule_number"), F.lit("t").alias("title"), status.alias("status"), F.lit("").alias("observed"), (n == 1).alias("critical"))
    violations = l.select(k, number.alias("rule_number"), F.when(status == "FAIL", "OPEN").otherwise("RESOLVED").alias("status"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("inspection_id"), F.col("o_custkey").alias("c"))
    inspections = o.select("inspection_id", F.when((F.col("c") % 4 == 0) & again, "FOOD").when(F.col("c") % 4 == 0, "").otherwise("OTHER").alias("category"))
    score = F.when((F.col("c") % 3 == 0) & again, 90.5).otherwise(80.25)
    scans = o.filter("c % 7 > 0").select("inspection_id", score.alias("compliance_score"), F.lit(70.0).alias("coverage_score"), F.when(score > 85, "PASS").otherwise("REVIEW").alias("ai_verdict"), F.lit("PENDING").alias("review_status"))
    return snapshots.snapshots(inspections, fields, rules, violations, scans)


@query(f"""WITH {_LINED},
     rows AS (SELECT l_orderkey AS inspection_id, l_linenumber AS n, l_partkey % 5 AS k, l_partkey AS p, {list(_NAMES)}[l_linenumber] AS name FROM lined WHERE l_linenumber <= 7),
     parts AS (SELECT *, replace(name, '_', ' ') AS label, CASE k WHEN 0 THEN '' WHEN 1 THEN 'old ' || p ELSE 'v' || p END AS bv, CASE k WHEN 0 THEN 'new ' || p WHEN 1 THEN '' WHEN 2 THEN 'other' ELSE 'v' || p END AS av FROM rows),
     kinds AS (SELECT inspection_id, count(*) FILTER (k < 4) AS fields_changed, count(*) FILTER (p % 6 = 0) AS rules_changed, coalesce(string_agg('R' || n, ',' ORDER BY n) FILTER (p % 6 = 0), '') AS no_longer_flagged,
               coalesce(list(label || ': not detected → ' || av ORDER BY name) FILTER (k = 0), []) AS fresh, coalesce(list(label || ': ' || bv || ' → not detected' ORDER BY name) FILTER (k = 1), []) AS lost,
               coalesce(list(label || ': ' || bv || ' → ' || av ORDER BY name) FILTER (k IN (2, 3)), []) AS other, count(*) FILTER (k = 0) AS unresolved_before, count(*) FILTER (k IN (1, 3)) AS unresolved_after FROM parts GROUP BY 1),
     o AS (SELECT o_orderkey AS inspection_id, o_custkey % 4 = 0 AS food, o_custkey % 3 = 0 AND o_custkey % 7 > 0 AS scored FROM orders)
     SELECT o.inspection_id, coalesce(fields_changed, 0)::INT AS fields_changed, coalesce(rules_changed, 0)::INT AS rules_changed, scored AS score_changed, food AS classification_changed, (coalesce(fields_changed, 0) + coalesce(rules_changed, 0)) > 0 OR scored OR food AS any_change,
            array_to_string(CASE WHEN food THEN ['category: — → FOOD'] ELSE [] END || coalesce(fresh[1:6], []) || coalesce(lost[1:4], []) || coalesce(other[1:6], []) || CASE WHEN scored THEN ['compliance: 80.25% → 90.5%', 'AI verdict: REVIEW → PASS'] ELSE [] END, ' | ') AS headline,
            '' AS newly_flagged, coalesce(no_longer_flagged, '') AS no_longer_flagged, coalesce(unresolved_before, 0)::INT AS unresolved_before, coalesce(unresolved_after, 0)::INT AS unresolved_after
     FROM o LEFT JOIN kinds USING (inspection_id)""")
def snapshot_differences(spark, d):
    c = F.col("changed")
    return snapshots.differences(_snapshot(spark, d, 0), _snapshot(spark, d, 1)).select(
        "inspection_id", c["fields_changed"].alias("fields_changed"), c["rules_changed"].alias("rules_changed"), c["score_changed"].alias("score_changed"), c["classification_changed"].alias("classification_changed"), c["any"].alias("any_change"),
        F.array_join("headline", " | ").alias("headline"), F.array_join("newly_flagged", ",").alias("newly_flagged"), F.array_join("no_longer_flagged", ",").alias("no_longer_flagged"), "unresolved_before", "unresolved_after",
    )


def _panels(spark, d):
    """Two images of a pack, from parts: a front with a mark and a title, a side with declarations."""
    k = F.col("p_partkey")
    mark = F.concat(F.lit("Z"), F.upper(F.substring_index("p_name", " ", 1)))
    box = F.struct(*[F.lit(v).alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 100), ("y2", 20))])
    line = lambda image, n, text: F.struct(F.lit(image).alias("image_id"), F.lit(n).alias("line_index"), text.alias("text"))
    side = F.when(k % 3 == 0, F.concat(mark, F.lit("X on shelf"))).when(k % 3 == 1, F.concat(mark, F.lit("X and "), mark, F.lit("QQ"))).otherwise(F.lit("nothing here"))
    lines = F.array(
        line(1, 0, mark), line(1, 1, F.concat(F.lit("Common name: "), F.col("p_name"))), line(2, 0, F.concat(F.lit("Brand: B"), k.cast("string"))), line(2, 1, F.lit("Packed by:")),
        line(2, 2, F.concat(F.lit("Acme "), k.cast("string"), F.lit(" Foods Pvt Ltd"))), line(2, 3, side),
    )
    return dealt(table(spark, d, "part"), "p_partkey").select(k.alias("inspection_id"), F.lit(0.9).alias("confidence"), box.alias("bbox"), F.inline(lines))


@query("""WITH p AS (SELECT p_partkey AS k, p_name, 'Z' || upper(string_split(p_name, ' ')[1]) AS mark FROM part)
          SELECT k AS inspection_id, 'brand' AS field_name, 'B' || k AS value, false AS inferred FROM p UNION ALL SELECT k, 'common_name', p_name, false FROM p UNION ALL SELECT k, 'packer', 'Acme ' || k || ' Foods Pvt Ltd', false FROM p
          UNION ALL SELECT k, 'brand', mark, true FROM p WHERE k % 3 < 2""")
def identity_readings(spark, d):
    """Brands, common names and companies of two panels in one run; a mark that another panel bears out is inferred."""
    return identity.candidates(_panels(spark, d)).filter("field_name in ('brand', 'common_name', 'packer')").select("inspection_id", "field_name", "value", "inferred")


@query("""SELECT p_partkey AS inspection_id, 'Z' || upper(string_split(p_name, ' ')[1]) AS value, CASE WHEN p_partkey % 3 = 0 AND length(string_split(p_name, ' ')[1]) > 2 THEN 'Z' || upper(string_split(p_name, ' ')[1]) || 'X' END AS completed FROM part""")
def completed_marks(spark, d):
    """Marks cut at their end, which another panel prints in full; where its words disagree they stay."""
    lines = _panels(spark, d)
    marks = lines.filter("image_id = 1 and line_index = 0").select("inspection_id", F.lit(0).alias("mark_id"), F.col("text").alias("value"))
    return identity.completed_marks(marks, lines).select("inspection_id", "value", "completed")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity, CASE p_partkey % 3 WHEN 2 THEN 0.62 ELSE 0.97 END::DOUBLE AS confidence, p_partkey % 3 = 2 AS inferred FROM part""")
def readings_borne_out(spark, d):
    """Names against the recognised text of their picture: in it, in it with other spaces and marks, and not a letter of it."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("12 "), F.upper("p_name"), F.lit(" 34"))).when(k % 3 == 1, F.concat(F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("-\n")))).otherwise("0123456789")
    read = p.select("p_partkey", F.col("p_name").alias("value"), F.lit(0.99).alias("confidence"))
    return needles.corroborated(read, p.select("p_partkey", text.alias("text")), ["p_partkey"]).select("p_partkey", "similarity", "confidence", "inferred")
