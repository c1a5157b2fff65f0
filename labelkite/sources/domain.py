"""The driver's tables as views of the inspection domain.

Each view is a deterministic projection, given twice: as a DataFrame and as DuckDB text with the same columns, so that
queries over them can be compared row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.session import dealt, table

#: Rules that are critical unless they say otherwise, and the weight of critical and other rules.
CRITICAL_WEIGHT = 2.0
DEFAULT_WEIGHT = 1.0


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Rule evaluations from order lines: one for each line."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    status = F.when(flag == "A", "PASS").when(flag == "R", "FAIL").when(F.col("l_linestatus") == "O", "UNCERTAIN").otherwise("NOT_APPLICABLE")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("inspection_id"),
        F.concat(F.lit("LM-"), line).alias("rule_number"),
        status.alias("status"),
        F.when(F.col("l_suppkey") % 2 == 0, "EVIDENCE_MISSING").otherwise("INAPPLICABLE").alias("applicability_kind"),
        F.when(line.isin(3, 5), 2.0).when(line != 7, 1.0).alias("weight"),
        line.isin(3, 5).alias("critical"),
        F.when(line == 6, "manual_only").otherwise("declaration_present").alias("check_type"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


def inspections(spark: SparkSession, d: str) -> DataFrame:
    """Inspections from orders, with the organisation of the customer."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    state = F.col("o_orderstatus")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("inspection_id"),
        F.col("c_nationkey").alias("organization_id"),
        F.when(state == "F", "COMPLETED").when(state == "O", "AWAITING_REVIEW").otherwise("PROCESSING").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.substring("o_orderpriority", 1, 1).alias("severity"),
    )


def products_of(spark: SparkSession, d: str) -> DataFrame:
    """(inspection_id, product_id): the smallest part of each order."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("inspection_id")).agg(F.min("l_partkey").alias("product_id"))


def bills(spark: SparkSession, d: str) -> DataFrame:
    """Billed and printed prices of order lines."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_retailprice")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).alias("billed"), F.round(5 * F.col("p_retailprice"), 2).alias("mrp"),
    )


FIELD_NAMES = ("product_name", "brand", "manufacturer", "net_quantity", "mrp", "batch_lot", "marketer")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate readings from order lines; ``seq`` is unique within a field."""
    l = table(spark, d, "lineitem")
    name = F.element_at(F.array(*[F.lit(n) for n in FIELD_NAMES]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return l.groupBy(F.col("l_orderkey").alias("inspection_id"), name.alias("field_name"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("seq")).agg(
        F.concat(F.lit("v"), F.min(F.col("l_partkey") % 4)).alias("value"), (F.max("l_quantity") / 50).alias("score"), (F.min(F.col("l_suppkey") % 3) == 0).alias("corrected"), F.min(F.col("l_suppkey") % 2).alias("bbox")
    ).withColumn("confidence", F.col("score"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text of the documents: ``image_id line_index text`` of those that aren't blank, in reading order."""
    found = dealt(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("line_index", "raw"))
    return found.filter(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select("image_id", "line_index", "raw", strip(F.col("raw")).alias("text"))


def strip(c):
    """Without the ASCII white space at both ends."""
    return F.regexp_replace(c, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


#: DuckDB text of the views, by name; ``with_views`` puts those that a statement names before it.
SQL = {
    "evaluations": """
        SELECT l_orderkey AS inspection_id, 'LM-' || l_linenumber AS rule_number,
               CASE WHEN l_returnflag = 'A' THEN 'PASS' WHEN l_returnflag = 'R' THEN 'FAIL'
                    WHEN l_linestatus = 'O' THEN 'UNCERTAIN' ELSE 'NOT_APPLICABLE' END AS status,
               CASE WHEN l_suppkey % 2 = 0 THEN 'EVIDENCE_MISSING' ELSE 'INAPPLICABLE' END AS applicability_kind,
               CASE WHEN l_linenumber IN (3, 5) THEN 2.0::DOUBLE WHEN l_linenumber <> 7 THEN 1.0::DOUBLE END AS weight,
               l_linenumber IN (3, 5) AS critical,
               CASE WHEN l_linenumber = 6 THEN 'manual_only' ELSE 'declaration_present' END AS check_type,
               1 - l_discount AS confidence
        FROM lineitem""",
    "inspections": """
        SELECT o_orderkey AS inspection_id, c_nationkey AS organization_id,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'AWAITING_REVIEW' ELSE 'PROCESSING' END AS status,
               o_orderdate AS created_at, substr(o_orderpriority, 1, 1) AS severity
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "products_of": "SELECT l_orderkey AS inspection_id, min(l_partkey) AS product_id FROM lineitem GROUP BY 1",
    "bills": """
        SELECT l_orderkey AS bill_id, l_linenumber AS line, l_partkey AS product_id,
               floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS billed, round(5 * p_retailprice, 2) AS mrp
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "candidates": """
        SELECT l_orderkey AS inspection_id, ['product_name', 'brand', 'manufacturer', 'net_quantity', 'mrp', 'batch_lot', 'marketer'][l_linenumber % 7 + 1] AS field_name,
               l_partkey * 100000 + l_suppkey AS seq, 'v' || min(l_partkey % 4) AS value, max(l_quantity) / 50 AS score, min(l_suppkey % 3) = 0 AS corrected,
               min(l_suppkey % 2) AS bbox, max(l_quantity) / 50 AS confidence
        FROM lineitem GROUP BY 1, 2, 3""",
    "winners": """
        SELECT inspection_id, field_name, arg_max(value, (score, -seq)) AS value, max(score) AS score, max(score) AS confidence FROM candidates GROUP BY 1, 2""",
    "fields": """
        SELECT w.*, CASE WHEN bool_or(c.value <> w.value AND c.score >= 0.85 * w.score AND c.score > 0.3) THEN 'CONFLICTING' ELSE 'DETECTED' END AS state
        FROM winners w JOIN candidates c ON w.inspection_id = c.inspection_id AND w.field_name = c.field_name GROUP BY ALL""",
    "lines": r"""
        SELECT doc_id AS image_id, i - 1 AS line_index, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents)
        WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')""",
    "scored": """
        SELECT inspection_id,
               sum(CASE WHEN scored AND status IN ('PASS', 'FAIL') THEN w ELSE 0 END) AS decided_weight,
               sum(CASE WHEN scored THEN w ELSE 0 END) AS applicable_weight,
               sum(CASE WHEN scored AND status = 'PASS' THEN w ELSE 0 END) AS earned,
               count(CASE WHEN scored AND status = 'FAIL' THEN 1 END) AS n_failed
        FROM (SELECT *, coalesce(CASE WHEN weight > 0 THEN weight END, CASE WHEN critical THEN 2.0 ELSE 1.0 END) AS w,
                     check_type <> 'manual_only' AND NOT (status = 'NOT_APPLICABLE' AND applicability_kind <> 'EVIDENCE_MISSING') AS scored
              FROM evaluations)
        GROUP BY 1""",
    "scores": """
        SELECT inspection_id, decided_weight, applicable_weight,
               CASE WHEN decided_weight > 0 THEN round_even(100 * earned / decided_weight, 1) ELSE 0 END::DOUBLE AS score,
               CASE WHEN applicable_weight > 0 THEN round_even(100 * decided_weight / applicable_weight, 1) ELSE 0 END::DOUBLE AS coverage,
               n_failed
        FROM scored""",
    "verdicts": """
        SELECT *, CASE WHEN n_failed > 0 THEN 'NON_COMPLIANT' WHEN decided_weight <= 0 THEN 'NEEDS_MANUAL_REVIEW'
                       WHEN score < 85 THEN 'NEEDS_MANUAL_REVIEW' WHEN coverage < 70 THEN 'NEEDS_MANUAL_REVIEW' ELSE 'COMPLIANT' END AS verdict
        FROM scores""",
    "scans": """
        SELECT v.inspection_id AS scan_id, organization_id, created_at AS scanned_at, product_id, p_name AS product_name, p_brand AS brand,
               p_type AS category, score, coverage, verdict,
               CASE status WHEN 'COMPLETED' THEN 'FINALIZED' WHEN 'AWAITING_REVIEW' THEN 'PENDING_FINALIZATION' ELSE 'AI_PRELIMINARY' END AS review_status,
               CASE WHEN status = 'COMPLETED' THEN verdict END AS official_decision
        FROM verdicts v JOIN inspections i ON v.inspection_id = i.inspection_id JOIN products_of p ON v.inspection_id = p.inspection_id
        JOIN part ON product_id = p_partkey""",
    "violations": """
        SELECT inspection_id, rule_number, status, CASE WHEN status = 'UNCERTAIN' THEN 'LOW' WHEN critical THEN 'HIGH' ELSE 'MEDIUM' END AS severity
        FROM evaluations WHERE status = 'FAIL' OR status = 'UNCERTAIN' AND check_type <> 'manual_only'""",
}


def with_views(sql: str) -> str:
    """``sql`` behind the views that it needs."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(SQL[name])
                need.append(name)

    visit(sql)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    if not head:
        return sql
    return f"WITH {head}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {head} {sql}"
