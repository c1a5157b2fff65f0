"""Label lines made from a seed, with what they say, to measure extraction by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of fields and the form of their values ('#' is a digit).
FORMS = (
    ("mrp", "MRP ₹ ###.##"), ("mrp", "M.R.P. Rs. ####"), ("net_quantity", "Net Wt. ### g"), ("net_quantity", "Net Quantity: # kg"), ("batch_lot", "Batch No: QX####"),
    ("fssai_license", "FSSAI Lic. No. 1#############"), ("consumer_care_phone", "Customer Care 9#########"), ("date_manufacturing", "Mfg Date 1#/0#/202#"),
)
#: Letters that recognition mistakes for others.
MISTAKES = (("", ""), ("O", "0"), ("I", "1"), (".", ","))


def samples(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """``sample_id field_name clean_text text expected`` of ``n`` samples, the same for a seed in any partitions."""
    h = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1_000_003))
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (h(k) % len(values) + 1).cast("int"))
    rows = spark.range(n).withColumn("form", F.element_at(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("t")) for f, t in FORMS]), (h(0) % len(FORMS) + 1).cast("int")))
    letters = F.split("form.t", "")
    digits = F.transform(letters, lambda c, i: F.when(c == "#", (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), i), F.lit(9)) + 1).cast("string")).otherwise(c))
    clean = F.array_join(digits, "")
    expected = F.regexp_extract(clean, r"([0-9][0-9./]*[0-9]|[A-Z]{2}[0-9]+|[0-9])[^0-9]*$", 1)
    mistake = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in MISTAKES]), (h(99) % len(MISTAKES) + 1).cast("int"))
    wrong = F.when(F.col("m.a") == "", F.col("clean_text")).otherwise(F.replace(F.col("clean_text"), F.col("m.a"), F.col("m.b")))
    return rows.select(F.col("id").alias("sample_id"), "form.field_name", clean.alias("clean_text"), mistake.alias("m"), expected.alias("expected")).select("sample_id", "field_name", "clean_text", wrong.alias("text"), "expected")
