"""From candidate readings to one field of an inspection: winners, conflicts, states and gaps.

Candidates: ``inspection_id field_name value score confidence seq`` and, where known, ``bbox corrected multilingual
inferred ambiguous role_uncertain``. ``seq`` is the order in which they were read; it settles ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelkite.functions.text import agree

CONFLICT_RATIO = 0.85
CONFLICT_SCORE = 0.3
#: The fields that every inspection has a row for.
TRACKED = (
    "product_name", "common_name", "brand", "manufacturer", "manufacturer_address", "packer", "packer_address", "importer", "importer_address",
    "marketer", "net_quantity", "mrp", "unit_sale_price", "date_manufacturing", "date_packing", "date_import", "date_best_before", "date_expiry",
    "consumer_care_phone", "consumer_care_email", "batch_lot", "country_of_origin", "fssai_license",
)


def deduplicated(candidates: DataFrame) -> DataFrame:
    """One candidate for each field, value and box: the first. A corrected reading replaces the raw one of its box."""
    box = Window.partitionBy("inspection_id", "field_name", "bbox")
    kept = candidates.withColumn("_any", F.max(F.col("corrected").cast("int")).over(box)).filter((F.col("_any") == 0) | F.col("corrected"))
    same = Window.partitionBy("inspection_id", "field_name", "bbox", "value").orderBy("seq")
    return kept.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_any", "_n")


def winners(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest score (the first one on a tie), and whether another one contradicts it.

    A conflict is a different value with at least 85 % of the winner's score and more than 0.3; readings in another script
    are no conflict. One shuffle: winner and conflict both come from a window over the field.
    """
    field = Window.partitionBy("inspection_id", "field_name")
    best = F.row_number().over(field.orderBy(F.desc("score"), "seq"))
    top = F.first(F.struct("value", "score")).over(field.orderBy(F.desc("score"), "seq"))
    other = ~agree(F.col("value"), F.col("_top.value")) & (F.col("score") >= CONFLICT_RATIO * F.col("_top.score")) & (F.col("score") > CONFLICT_SCORE)
    if "multilingual" in candidates.columns:
        other = other & ~F.coalesce("multilingual", F.lit(False))
    marked = candidates.withColumn("_n", best).withColumn("_top", top)
    return marked.withColumn("conflict", F.max(F.coalesce(other, F.lit(False)).cast("int")).over(field) == 1).filter("_n = 1").drop("_n", "_top")


def states(won: DataFrame) -> DataFrame:
    """The state of each field: empty, in conflict, unsure for one of several reasons, or detected."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in won.columns else F.lit(False)
    empty = F.trim(F.coalesce("value", F.lit(""))) == ""
    unsure = flag("ambiguous") | (flag("inferred") & (F.col("confidence") < 0.7)) | flag("role_uncertain")
    state = F.when(empty, "UNCERTAIN").when(F.col("conflict"), "CONFLICTING").when(unsure, "UNCERTAIN").otherwise("DETECTED")
    return won.withColumn("state", state).withColumn("confidence", F.when(empty, 0.0).otherwise(F.col("confidence")))


def with_missing(fields: DataFrame, inspections: DataFrame, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """A row for each tracked field of each inspection: MISSING where nothing was read."""
    wanted = inspections.select("inspection_id", F.explode(F.array(*[F.lit(f) for f in tracked])).alias("field_name"))
    out = wanted.join(fields.select("inspection_id", "field_name", "value", "state", "confidence"), ["inspection_id", "field_name"], "left")
    return out.withColumn("state", F.coalesce("state", F.lit("MISSING"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def promoted_marketer(fields: DataFrame) -> DataFrame:
    """Where only a marketer was read it stands for the manufacturer, with less confidence."""
    makers = fields.filter(F.col("field_name").isin("manufacturer", "packer", "importer")).select("inspection_id")
    alone = fields.filter("field_name = 'marketer'").join(makers, "inspection_id", "left_anti")
    return fields.unionByName(alone.withColumn("field_name", F.lit("manufacturer")).withColumn("confidence", F.bround(F.col("confidence") * 0.8, 3)))


def without_brand_names(candidates: DataFrame, won: DataFrame) -> DataFrame:
    """Candidates but for product names that are the winning brand."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    brands = won.filter("field_name = 'brand'").select("inspection_id", key(F.col("value")).alias("_key"), F.lit("product_name").alias("field_name"))
    return candidates.withColumn("_key", key(F.col("value"))).join(brands, ["inspection_id", "field_name", "_key"], "left_anti").drop("_key")


def identity(fields: DataFrame) -> DataFrame:
    """One row for each inspection: who made what, by the first field that says so."""
    value = lambda f: F.nullif(F.trim(F.max(F.when(F.col("field_name") == f, F.col("value")))), F.lit(""))
    first = lambda *names: F.coalesce(*[value(n) for n in names], F.lit(""))
    return fields.groupBy("inspection_id").agg(
        first("product_name", "common_name").alias("product_name"), first("brand").alias("brand"), first("manufacturer", "packer", "importer", "marketer").alias("manufacturer"),
        first("net_quantity").alias("net_quantity"), first("mrp").alias("mrp"),
    )
