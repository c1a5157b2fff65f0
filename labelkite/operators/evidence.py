"""Which pictures show what a rule speaks of, and whose a stored file is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelkite.functions import geometry


def for_evaluations(evaluations: DataFrame, crops: DataFrame, most: int = 6) -> DataFrame:
    """The first ``most`` crops (evidence_id, inspection_id, field_name) of each evaluation, in the order in which it names
    its fields (``fields`` array); a crop counts once."""
    cited = evaluations.select("inspection_id", "rule_number", F.posexplode("fields").alias("pos", "field_name"))
    hit = cited.join(crops, ["inspection_id", "field_name"]).groupBy("inspection_id", "rule_number", "evidence_id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("inspection_id", "rule_number").orderBy("pos", "evidence_id")
    return hit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)


def owners(files: DataFrame, *sources: DataFrame) -> DataFrame:
    """The inspection of each file by the first source (file, inspection_id) that knows it."""
    known = None
    for k, s in enumerate(sources):
        one = s.select("file", "inspection_id", F.lit(k).alias("k"))
        known = one if known is None else known.unionByName(one)
    first = known.groupBy("file").agg(F.min(F.struct("k", "inspection_id")).alias("o"))
    return files.join(first, "file", "left").select("file", F.col("o.inspection_id").alias("inspection_id"))


def associated(lines: DataFrame, label: str = r"(?i)^\s*(?:mrp|net\s*(?:wt|weight|qty|quantity)|batch\s*no|lot\s*no|mfg|pkd|use\s*by|exp)\.?\s*:?\s*$") -> DataFrame:
    """A label alone on its line with the nearest value to its right or under it: (inspection_id, image_id, line_index, text).

    Only labels are joined with the lines of their own image. A value below counts half a row further away; the first line
    wins a tie.
    """
    keys = ["inspection_id", "image_id"]
    labels = lines.filter(F.col("text").rlike(label)).select(*keys, "line_index", F.col("text").alias("label"), F.col("bbox").alias("a"))
    values = lines.filter(~F.col("text").rlike(label) & F.col("text").rlike("[0-9]")).select(*keys, F.col("line_index").alias("value_index"), F.col("text").alias("value"), F.col("bbox").alias("b"))
    a, b = F.col("a"), F.col("b")
    right, under = geometry.same_row_right(a, b), geometry.below(a, b)
    distance = F.when(right, F.greatest(F.lit(0.0), (b["x1"] - a["x2"]).cast("double"))).otherwise(geometry.y_center(b) - geometry.y_center(a) + 0.5 * geometry.height(a))
    w = Window.partitionBy(*keys, "line_index").orderBy("distance", "value_index")
    near = labels.join(values, keys).filter(right | under).withColumn("distance", distance).withColumn("n", F.row_number().over(w)).filter("n = 1")
    return near.select(*keys, "line_index", F.concat_ws(" ", "label", "value").alias("text"), geometry.union(a, b).alias("bbox"))
