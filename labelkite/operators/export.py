"""What is written: upserts, audit rows, exports and reports, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(before: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key has none."""
    return before.join(new.select(*keys), keys, "left_anti").unionByName(new)


def append_audit(rows: DataFrame, path: str) -> None:
    """Add to a log that nothing rewrites."""
    rows.write.mode("append").parquet(path)


def export_fields(fields: DataFrame) -> DataFrame:
    """Fields as they are exported: no confidence for an empty value."""
    return fields.select("inspection_id", "field_name", "value", "state", F.when(F.trim(F.coalesce("value", F.lit(""))) != "", F.col("confidence")).alias("confidence"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def document(inspections: DataFrame, **children: DataFrame) -> DataFrame:
    """One row for each inspection with its children as sorted arrays; each child is gathered before it is joined."""
    out = inspections
    for name, child in children.items():
        rest = [c for c in child.columns if c != "inspection_id"]
        out = out.join(child.groupBy("inspection_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), "inspection_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array()))
    return out


def stage_latency(runs: DataFrame) -> DataFrame:
    """(stage, n, mean_ms, max_ms) of runs with a map of stage to milliseconds."""
    return runs.select(F.explode("timings").alias("stage", "ms")).groupBy("stage").agg(F.count("*").alias("n"), F.bround(F.avg("ms"), 1).alias("mean_ms"), F.max("ms").alias("max_ms"))


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a small report as lines of a Markdown table."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit(r"\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
