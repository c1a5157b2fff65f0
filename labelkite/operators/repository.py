"""Scans of products: scope, search, pages, facets, roll-ups and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelkite.operators import scoring
from labelkite.session import table
from labelkite.sources import domain

#: Roles that see their own organisation only.
SCOPED_ROLES = ("REGULATED_ENTITY", "INTERNAL_COMPLIANCE")
SORTS = ("recent", "oldest", "score_desc", "score_asc", "name")


def scope(df: DataFrame, role: str, organization_id: int | None) -> DataFrame:
    """Rows that a user may see. A scoped user without an organisation sees none; tables without one pass."""
    if role not in SCOPED_ROLES or "organization_id" not in df.columns:
        return df
    return df.filter(F.col("organization_id") == (-1 if organization_id is None else organization_id))


def scope_through(df: DataFrame, inspections: DataFrame, role: str, organization_id: int | None) -> DataFrame:
    """Rows of inspections that a user may see."""
    return df.join(scope(inspections, role, organization_id).select("inspection_id"), "inspection_id", "left_semi")


def scans(spark: SparkSession, d: str) -> DataFrame:
    """The wide fact: one row for each inspection that has evaluations."""
    v = scoring.with_verdicts(scoring.scores(domain.evaluations(spark, d)))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    review = F.when(F.col("status") == "COMPLETED", "FINALIZED").when(F.col("status") == "AWAITING_REVIEW", "PENDING_FINALIZATION").otherwise("AI_PRELIMINARY")
    return (
        v.join(domain.inspections(spark, d), "inspection_id")
        .join(domain.products_of(spark, d), "inspection_id")
        .join(part, "product_id")
        .select(
            F.col("inspection_id").alias("scan_id"), "organization_id", F.col("created_at").alias("scanned_at"), "product_id", "product_name", "brand", "category",
            "score", "coverage", "verdict", review.alias("review_status"), F.when(F.col("status") == "COMPLETED", F.col("verdict")).alias("official_decision"),
        )
    )


def search(df: DataFrame, needle: str, columns: tuple[str, ...] = ("product_name", "brand", "category", "verdict")) -> DataFrame:
    """Rows with the needle in any of the columns, whatever its case; ``%`` and ``_`` in it are wild cards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return df.filter(hit)


def filtered(df: DataFrame, *, review_status=None, verdict=None, category=None, min_score=None, max_score=None, below_floor: bool = False) -> DataFrame:
    """Equality filters (arguments upper-cased), an inclusive range of scores, and coverage below the floor."""
    for name, value in (("review_status", review_status), ("verdict", verdict), ("category", category)):
        if value is not None:
            df = df.filter(F.col(name) == F.upper(F.lit(value)))
    if min_score is not None:
        df = df.filter(F.col("score") >= min_score)
    if max_score is not None:
        df = df.filter(F.col("score") <= max_score)
    return df.filter(F.coalesce("coverage", F.lit(0.0)) < scoring.COVERAGE_FLOOR) if below_floor else df


def page(df: DataFrame, *, sort: str = "recent", page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of scans, newest key first among equal ones."""
    if page < 1 or not 1 <= page_size <= 100 or sort not in SORTS:
        raise ValueError("page from 1, page_size from 1 to 100, sort one of " + ", ".join(SORTS))
    key = {"recent": F.col("scanned_at").desc(), "oldest": F.col("scanned_at").asc(), "score_desc": F.col("score").desc(), "score_asc": F.col("score").asc(), "name": F.col("product_name").asc()}[sort]
    return df.orderBy(key, F.col("scan_id").desc()).offset((page - 1) * page_size).limit(page_size)


def facets(df: DataFrame) -> DataFrame:
    """(facet, value, n): counts by review status, verdict and category, and of scans below the coverage floor, in one pass."""
    below = F.when(F.coalesce("coverage", F.lit(0.0)) < scoring.COVERAGE_FLOOR, "below_floor")
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in (("review_status", F.col("review_status")), ("verdict", F.col("verdict")), ("category", F.nullif(F.col("category"), F.lit(""))), ("coverage", below))])
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def redacted(df: DataFrame, reviewer: bool) -> DataFrame:
    """The official decision is for reviewers, and for all once final."""
    return df if reviewer else df.withColumn("official_decision", F.when(F.col("review_status") == "FINALIZED", F.col("official_decision")))


def rollup(df: DataFrame) -> DataFrame:
    """One row for each product: number of scans, first and last, what the last one says, and how many are pending."""
    last = F.max(F.struct("scanned_at", "scan_id", "score", "verdict", "review_status"))
    return df.groupBy("product_id").agg(
        F.count("*").alias("n_scans"), F.min("scanned_at").alias("first_scanned_at"), last.alias("_last"), F.count_if(F.col("review_status") != "FINALIZED").alias("n_pending")
    ).select("product_id", "n_scans", "first_scanned_at", F.col("_last.scanned_at").alias("last_scanned_at"), F.col("_last.score").alias("last_score"), F.col("_last.verdict").alias("last_verdict"), F.col("_last.review_status").alias("last_status"), "n_pending")


def history(df: DataFrame) -> DataFrame:
    """Scans of products from old to new with the change of the score from the scan before; scans without a score are left out."""
    w = Window.partitionBy("product_id").orderBy("scanned_at", "scan_id")
    return df.filter("score is not null").select("product_id", "scan_id", "score", F.row_number().over(w).alias("n"), F.bround(F.col("score") - F.lag("score").over(w), 1).alias("change"))


def report_status(pipeline: Column, review: Column, verdict: Column, n_violations: Column) -> Column:
    """What a report says of a scan: its official state first, then the pipeline's, then the review's."""
    return (
        F.when(review == "FINALIZED", "FINALIZED")
        .when(F.coalesce(pipeline, F.lit("")).isin("", "CREATED"), "DRAFT")
        .when(pipeline == "PROCESSING", "PROCESSING")
        .when(pipeline == "FAILED", "ERROR")
        .when(review == "AI_PRELIMINARY", "AI_ANALYSIS_COMPLETE")
        .when((verdict == "NEEDS_MANUAL_REVIEW") | (n_violations > 0), "NEEDS_MANUAL_REVIEW")
        .otherwise("PENDING_FINALIZATION")
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def dedupe_key(name: Column, brand: Column, maker: Column, inspection_id: Column) -> Column:
    """Products are told apart by name, brand and maker; one without a name is its own."""
    key = F.substring(F.concat_ws("|", slug(name), slug(brand), slug(maker)), 1, 200)
    return F.when(slug(name) == "", F.concat(F.lit("unnamed-"), inspection_id)).otherwise(key)
