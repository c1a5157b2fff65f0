"""Latest rows, joins by version, unique numbers, and reports over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Image qualities, the best first.
QUALITIES = ("GOOD", "ACCEPTABLE", "POOR", "UNUSABLE")
#: States of a check that ask for work.
UNRESOLVED = ("UNCERTAIN", "FAIL", "NEEDS_MANUAL_REVIEW")


def numbered(rows: DataFrame, period: Column, day: Column, key: str, prefix: str, width: int = 6) -> DataFrame:
    """``rows`` with ``number``: ``prefix-period-000001`` and so on within a period by day and key, each number once.

    Rows are ranked within a day only; the days before are summed up from one row a day, so no window holds a period.
    """
    marked = rows.withColumn("_period", period).withColumn("_day", day)
    days = marked.groupBy("_period", "_day").count()
    before = F.sum("count").over(Window.partitionBy("_period").orderBy("_day")) - F.col("count")
    days = days.select(F.col("_period").alias("_p"), F.col("_day").alias("_d"), before.alias("_before"))
    ranked = marked.withColumn("_n", F.row_number().over(Window.partitionBy("_period", "_day").orderBy(key)))
    out = ranked.join(days, (F.col("_period") == F.col("_p")) & (F.col("_day") == F.col("_d")))
    return out.select(*rows.columns, F.format_string(f"{prefix}-%s-%0{width}d", "_period", F.col("_n") + F.col("_before")).alias("number"))


def newest(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the greatest ``order``, and their ``place`` from 1."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def latest(rows: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of the row with the greatest ``order`` of each group, summed up before the shuffle."""
    return rows.groupBy(*by).agg(F.max(F.struct(order, *values)).alias("_last")).select(*by, *[F.col(f"_last.{v}").alias(v) for v in (order, *values)])


def analyses_of_scans(scans: DataFrame, analyses: DataFrame, n: int = 5) -> DataFrame:
    """(scan_id, analysis_id, place): the newest analyses of a scan's organisation, where none is like none. The ``n`` of each
    organisation are taken first, so a scan meets at most ``n`` rows."""
    few = newest(analyses, ["organization_id"], "analysis_id", n).select(F.col("organization_id").alias("o"), "analysis_id", "place")
    return scans.join(few, F.col("organization_id").eqNullSafe(F.col("o"))).select("scan_id", "analysis_id", "place")


def listings_of(listings: DataFrame, inspection_id: int, organization_id: int | None = None) -> DataFrame:
    """The listings of one inspection, newest first, within the organisation if one is given."""
    out = listings.filter(F.col("inspection_id") == inspection_id)
    if organization_id is not None:
        out = out.filter(F.col("organization_id") == organization_id)
    return out.orderBy(F.col("listing_id").desc())


def with_current(rules: DataFrame, versions: DataFrame) -> DataFrame:
    """Rules with the title of their current version (null where it is missing)."""
    v = versions.select(F.col("rule_id").alias("r"), F.col("version").alias("v"), "title")
    return rules.join(v, (F.col("rule_id") == F.col("r")) & (F.col("current_version") == F.col("v")), "left").drop("r", "v")


def overall_quality(inspections: DataFrame, images: DataFrame) -> DataFrame:
    """(inspection_id, score, quality): the mean score and the worst quality of its images; 0 and UNUSABLE without any."""
    rank = F.array_position(F.array(*[F.lit(q) for q in QUALITIES]), F.col("quality"))
    by = images.groupBy(F.col("inspection_id").alias("i")).agg(F.avg("score").alias("score"), F.max(rank).alias("worst"))
    worst = F.element_at(F.array(*[F.lit(q) for q in QUALITIES]), F.coalesce("worst", F.lit(len(QUALITIES))).cast("int"))
    return inspections.join(by, F.col("inspection_id") == F.col("i"), "left").select("inspection_id", F.coalesce(F.bround("score", 3), F.lit(0.0)).alias("score"), worst.alias("quality"))


def unresolved(checks: Column) -> Column:
    """The checks of a snapshot (array of structs with ``status``) that ask for work, in their order."""
    return F.filter(checks, lambda c: c["status"].isin(*UNRESOLVED))


def rescored(stored: DataFrame, computed: DataFrame, key: str = "scan_id", tolerance: float = 0.05) -> DataFrame:
    """(key, stored, score, change): scans whose stored score isn't what is computed now; no score is unlike any."""
    both = stored.select(key, F.col("score").alias("stored")).join(computed.select(F.col(key).alias("k"), "score"), F.col(key) == F.col("k"))
    same = F.coalesce(F.abs(F.col("stored") - F.col("score")) < tolerance, F.col("stored").eqNullSafe(F.col("score")))
    return both.filter(~same).select(key, "stored", "score", F.bround(F.col("score") - F.col("stored"), 1).alias("change"))


def dataset_counts(annotations: DataFrame, by: str) -> DataFrame:
    """(by, products, views, fields) of annotations (product_id, views array, fields map), without value as UNKNOWN."""
    return annotations.groupBy(F.coalesce(by, F.lit("UNKNOWN")).alias(by)).agg(
        F.countDistinct("product_id").alias("products"), F.sum(F.coalesce(F.size("views"), F.lit(0))).alias("views"), F.sum(F.coalesce(F.size(F.map_keys("fields")), F.lit(0))).alias("fields")
    )
