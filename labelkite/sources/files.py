"""Readers of the files that come with the engine's data: rule definitions, listing checks, annotations, manifests, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = (
    "rule_id string, rule_number string, title string, check_type string, weight double, critical boolean, effective_from string,"
    " applicability struct<packaging:string, category_any_of:array<string>, conditional:boolean, import_only:boolean>, params struct<fields:array<string>>"
)
ANNOTATION = (
    "product_id string, category string, package_type string, views array<struct<file:string, view:string, quality:string>>,"
    " fields map<string, struct<value:string, unit:string, raw_text:string, image:string, bbox:array<int>, confidence:double>>"
)
#: What a legal reference of a listing check may be called; others need to be looked up.
LEGAL = ("CONFIRMED", "LEGAL_REFERENCE_REQUIRES_VERIFICATION", "NOT_A_LEGAL_REQUIREMENT")


def rule_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Rules, automatic and manual, of all definition files in a folder, not those in folders below; broken files count as empty."""
    raw = spark.read.schema(f"rules array<struct<{_struct(RULE)}>>, manual_only_rules array<struct<{_struct(RULE)}>>").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").option("recursiveFileLookup", False).json(folder)
    both = F.concat(F.coalesce("rules", F.array()), F.coalesce("manual_only_rules", F.array()))
    return raw.select(F.explode(both).alias("r"), F.col("_metadata.file_name").alias("file")).select("r.*", "file")


def _struct(ddl: str) -> str:
    """Columns of a DDL string as fields of a struct: ``a int`` to ``a: int``."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ", ".join(out)


def listing_checks(spark: SparkSession, path: str) -> DataFrame:
    """Checks of online listings; an unknown legal status asks for verification."""
    raw = spark.read.schema("checks array<struct<check_id:string, legal_status:string, fields:array<string>, minimum_ratio:double>>").option("multiLine", True).json(path)
    status = F.when(F.col("legal_status").isin(*LEGAL), F.col("legal_status")).otherwise("LEGAL_REFERENCE_REQUIRES_VERIFICATION")
    return raw.select(F.explode("checks").alias("c")).select("c.*").withColumn("legal_status", status)


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth of products; files whose name begins with an underscore are none."""
    raw = spark.read.schema(ANNOTATION).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return raw.select("*", F.col("_metadata.file_name").alias("file")).filter(~F.col("file").startswith("_"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and ``#`` comments."""
    return spark.read.schema(schema).csv(path, header=True, comment="#")


def observations(reply: Column, allowed: tuple[str, ...]) -> Column:
    """Readings out of the JSON text of a vision service: array<struct<field, value, confidence, bbox>>.

    A code fence around it and text before and after the braces are taken off. Fields that aren't allowed go, a confidence
    is held between 0 and 1, ``marketed_by`` is the marketer, and a box must have four numbers and a size.
    """
    text = F.regexp_extract(F.regexp_replace(F.coalesce(reply, F.lit("")), "```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(text, "fields array<struct<field:string, value:string, confidence:double, bbox:array<double>>>")["fields"]
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    box = lambda b: F.when((F.size(b) == 4) & (F.get(b, 2) > 0) & (F.get(b, 3) > 0) & (F.array_max(b) <= 1.5), b)
    named = F.transform(F.coalesce(parsed, F.array()), lambda o: F.struct(F.when(o["field"] == "marketed_by", "marketer").otherwise(o["field"]).alias("field"), F.trim(o["value"]).alias("value"), clamp(o["confidence"]).alias("confidence"), box(o["bbox"]).alias("bbox")))
    return F.filter(named, lambda o: o["field"].isin(*allowed) & (F.coalesce(o["value"], F.lit("")) != ""))


def recognised(images: DataFrame, recognise, schema: str = "path string, line_index int, text string, confidence double, bbox array<int>") -> DataFrame:
    """Lines of images (``binaryFile`` rows) by a recogniser: a function from an iterator of pandas frames to one of lines.

    Where a recogniser fails on an image it should give no lines for it. None is part of this package.
    """
    return images.select("path", "content").mapInPandas(recognise, schema)
