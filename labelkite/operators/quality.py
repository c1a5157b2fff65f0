"""Checks and measures of annotated datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaked(splits: DataFrame) -> DataFrame:
    """Products that stand in more than one split."""
    found = splits.groupBy("product_id").agg(F.countDistinct("split").alias("n"), F.array_join(F.array_sort(F.collect_set("split")), ", ").alias("splits"))
    return found.filter("n > 1").select("product_id", "splits")


def split(products: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """A product's split from a hash of its key and the seed: 70, 15 and 15 per cent, the same wherever it is computed."""
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 8), 16, 10).cast("bigint"), F.lit(1000))
    return products.withColumn("split", F.when(place < 700, "train").when(place < 850, "validation").otherwise("test"))


def duplicates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n, first): rows whose content others have as well."""
    w = Window.partitionBy(F.sha2(content, 256))
    return rows.select(key, F.count("*").over(w).alias("n"), F.min(key).over(w).alias("first")).filter("n > 1")


def same_value(truth: Column, got: Column) -> Column:
    """Equal but for case, as numbers, in digits, or the truth within what was read, with or without spaces."""
    t, g = F.lower(F.trim(truth)), F.lower(F.trim(got))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    bare = lambda c: F.regexp_replace(c, r"[\x20\x09-\x0D]+", "")
    numbers = t.try_cast("double") == g.try_cast("double")
    return (g != "") & ((t == g) | F.coalesce(numbers, F.lit(False)) | ((digits(t) != "") & (digits(t) == digits(g))) | F.contains(bare(g), bare(t)))


def field_accuracy(rows: DataFrame) -> DataFrame:
    """Rows (field, truth, value, confidence) to counts of exact, same, wrong and missing readings, and accuracy."""
    covered = rows.filter(F.trim(F.coalesce("truth", F.lit(""))) != "")
    missing = F.trim(F.coalesce("value", F.lit(""))) == ""
    right = ~missing & F.coalesce(same_value(F.col("truth"), F.col("value")), F.lit(False))
    exact = right & (F.lower(F.trim("truth")) == F.lower(F.trim("value")))
    return covered.groupBy("field").agg(
        F.count_if(exact).alias("exact"), F.count_if(right & ~exact).alias("same"), F.count_if(~right & ~missing).alias("wrong"), F.count_if(missing).alias("missing"),
        F.bround(F.count_if(right) / F.count("*"), 4).alias("accuracy"), F.bround(F.avg(F.when(right, F.col("confidence"))), 4).alias("mean_confidence"),
    )


def annotation_problems(products: DataFrame) -> DataFrame:
    """(product_id, problem) of annotations (product_id, file, views array<struct<file, view, quality>>, fields map<string, string>)."""
    views = F.col("views")
    roles = ("FRONT", "BACK", "LEFT_SIDE", "RIGHT_SIDE", "TOP", "BOTTOM", "CLOSE_UP", "ADDITIONAL_EVIDENCE")
    found = F.array_compact(
        F.array(
            F.when(F.col("product_id") != F.regexp_replace("file", r"\.json$", ""), "id differs from the file's name"),
            F.when(F.coalesce(F.size(views), F.lit(0)) <= 0, "no views"),
            F.when(F.exists(views, lambda v: ~v["view"].isin(*roles)), "unknown view"),
            F.when(F.exists(views, lambda v: ~F.lower(v["file"]).rlike(r"\.(jpe?g|png|webp)$")), "unsupported image"),
            F.when(F.exists(F.map_values("fields"), lambda v: F.trim(v) == ""), "empty value"),
            F.when(F.col("_times") > 1, "id occurs more than once"),
        )
    )
    products = products.withColumn("_times", F.count("*").over(Window.partitionBy("product_id")))
    return products.select("product_id", F.explode(found).alias("problem"))


def best_views(readings: DataFrame) -> DataFrame:
    """The most confident reading of each field over a product's views; the first view on a tie."""
    w = Window.partitionBy("product_id", "field").orderBy(F.desc("confidence"), "view_index")
    return readings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: Metrics of an image with their weights in tenths, and where a value is good and acceptable; the first four are
#: better the larger they are, the others the smaller.
IMAGE_METRICS = {
    "resolution": (15, 1400, 700), "blur": (20, 120, 30), "brightness": (12, 80, 45), "contrast": (12, 40, 22),
    "glare": (15, 0.02, 0.08), "overexposure": (8, 0.05, 0.15), "underexposure": (8, 0.15, 0.35), "orientation": (10, 2, 7), "compression": (10, 2.5, 6),
}
LARGER = ("resolution", "blur", "brightness", "contrast")
#: Tenths that a band counts, and the share of all points from which an image is good and acceptable.
BAND_TENTHS = {"GOOD": 10, "ACCEPTABLE": 6, "POOR": 0}
GOOD_FROM, ACCEPTABLE_FROM = 0.75, 0.45


def image_quality(images: DataFrame) -> DataFrame:
    """``images`` with a band for each metric (array of structs), ``score`` and ``status``.

    ``images``: width, height, laplacian_variance, mean_brightness, rms_contrast, glare, overexposure, underexposure, skew, blockiness.
    Blur is judged for the size of the image. An image that is small and blurred is unusable; a good one has one poor metric at
    most. A metric that is null is poor.
    """
    long, short = F.greatest("width", "height"), F.least("width", "height")
    value = {
        "resolution": short, "blur": F.col("laplacian_variance") / F.greatest(long / 1000.0, F.lit(0.4)), "brightness": F.col("mean_brightness"), "contrast": F.col("rms_contrast"),
        "glare": F.col("glare"), "overexposure": F.col("overexposure"), "underexposure": F.col("underexposure"), "orientation": F.abs("skew"), "compression": F.col("blockiness"),
    }

    def band(name: str) -> Column:
        _, good, fair = IMAGE_METRICS[name]
        v = value[name]
        if name in ("resolution", "brightness", "contrast"):
            return F.when(v >= good, "GOOD").when(v >= fair, "ACCEPTABLE").otherwise("POOR")
        if name == "blur":
            return F.when(v > good, "GOOD").when(v > fair, "ACCEPTABLE").otherwise("POOR")
        if name in ("glare", "compression"):
            return F.when(v < good, "GOOD").when(v < fair, "ACCEPTABLE").otherwise("POOR")
        return F.when(v <= good, "GOOD").when(v <= fair, "ACCEPTABLE").otherwise("POOR")

    one = lambda n: F.struct(F.lit(n).alias("metric"), band(n).alias("band"), F.lit(IMAGE_METRICS[n][0]).alias("weight"))
    rows = images.withColumn("bands", F.array(*[one(n) for n in IMAGE_METRICS]))
    tenths = lambda b: F.when(b["band"] == "GOOD", BAND_TENTHS["GOOD"]).when(b["band"] == "ACCEPTABLE", BAND_TENTHS["ACCEPTABLE"]).otherwise(BAND_TENTHS["POOR"])
    points = F.aggregate("bands", F.lit(0), lambda s, b: s + tenths(b) * b["weight"])
    most = 10 * sum(w for w, *_ in IMAGE_METRICS.values())
    poor = F.size(F.filter("bands", lambda b: b["band"] == "POOR"))
    useless = F.forall(F.filter("bands", lambda b: b["metric"].isin("resolution", "blur")), lambda b: b["band"] == "POOR")
    status = F.when(useless, "UNUSABLE").when((points >= GOOD_FROM * most) & (poor <= 1), "GOOD").when(points >= ACCEPTABLE_FROM * most, "ACCEPTABLE").otherwise("POOR")
    return rows.select(*images.columns, F.transform("bands", lambda b: F.struct(b["metric"].alias("metric"), b["band"].alias("band"))).alias("bands"), F.bround(points / most, 3).alias("score"), status.alias("status"))


def ground_truth(annotations: DataFrame) -> DataFrame:
    """(product_id, field, truth) from annotations with ``fields`` (map of name to struct(value, unit)); a net quantity gives its value and
    its unit as fields of their own, empty values none."""
    told = annotations.select("product_id", F.explode("fields").alias("name", "spec")).filter(F.trim(F.coalesce("spec.value", F.lit(""))) != "")
    quantity = F.col("name") == "net_quantity"
    one = lambda field, truth: F.struct(field.alias("field"), truth.alias("truth"))
    parts = F.when(quantity, F.array(one(F.lit("net_quantity_value"), F.col("spec.value")), one(F.lit("net_quantity_unit"), F.col("spec.unit")))).otherwise(F.array(one(F.col("name"), F.col("spec.value"))))
    return told.select("product_id", F.inline(parts)).filter(F.trim(F.coalesce("truth", F.lit(""))) != "")


def evaluated(annotations: DataFrame, readings: DataFrame) -> DataFrame:
    """``field_accuracy`` of annotated products against the most confident reading of each field over their views.

    ``readings``: product_id, view_index, field, value, confidence. Products without any view aren't evaluated; a field that no view
    gave, or only without a value, is missing and not wrong.
    """
    seen = readings.select("product_id").distinct()
    truth = ground_truth(annotations).join(seen, "product_id", "left_semi")
    return field_accuracy(truth.join(best_views(readings).select("product_id", "field", "value", "confidence"), ["product_id", "field"], "left"))
