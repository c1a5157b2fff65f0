"""What people change, and what changes between two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaid(fields: DataFrame, actions: DataFrame) -> DataFrame:
    """Fields under the latest action of a reviewer, which survives any new run.

    ``actions``: inspection_id, field_name, action_id, action, value.
    """
    last = actions.groupBy("inspection_id", "field_name").agg(F.max(F.struct("action_id", "action", F.col("value").alias("new"))).alias("a")).select("inspection_id", "field_name", "a.action", "a.new")
    a = F.col("action")
    joined = fields.join(last, ["inspection_id", "field_name"], "full_outer")
    value = F.when(a.isin("EDIT", "ADD"), F.col("new")).when(a.isin("CONFIRM_ABSENT", "REJECT"), F.lit("")).otherwise(F.col("value"))
    state = F.when(a.isin("EDIT", "ADD"), "MANUALLY_CORRECTED").when(a == "ACCEPT", "DETECTED").when(a == "CONFIRM_ABSENT", "CONFIRMED_ABSENT").when(a == "REJECT", "MISSING").otherwise(F.col("state"))
    return joined.select("inspection_id", "field_name", value.alias("value"), state.alias("state"), F.coalesce(a == "CONFIRM_ABSENT", F.lit(False)).alias("human_absent"))


def replaced(machine: DataFrame, human: DataFrame, keys: list[str]) -> DataFrame:
    """All human rows, and the machine's rows for keys without one."""
    return machine.join(human.select(*keys).distinct(), keys, "left_anti").unionByName(human)


def finalised(scans: DataFrame, final: DataFrame) -> DataFrame:
    """Scans with official decisions, which are never reset."""
    f = final.select("scan_id", F.col("decision").alias("_decision"))
    is_final = F.col("_decision").isNotNull()
    out = scans.join(f, "scan_id", "left")
    return out.withColumn("official_decision", F.coalesce("_decision", "official_decision")).withColumn("review_status", F.when(is_final, "FINALIZED").otherwise(F.col("review_status"))).drop("_decision")


def field_changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """ADDED, REMOVED, CHANGED or SAME for each key of two versions."""
    b, a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_b")), after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_a"))
    kind = F.when(F.col("_b").isNull(), "ADDED").when(F.col("_a").isNull(), "REMOVED").when(F.col("before").eqNullSafe(F.col("after")), "SAME").otherwise("CHANGED")
    return b.join(a, keys, "full_outer").select(*keys, "before", "after", kind.alias("change"))


def flag_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules newly flagged and no longer flagged, by inspection; both sides hold (inspection_id, rule_number)."""
    both = before.select("inspection_id", "rule_number", F.lit(0).alias("side")).unionByName(after.select("inspection_id", "rule_number", F.lit(1).alias("side")))
    sides = both.groupBy("inspection_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("side") == i, F.col("rule_number")))).alias(n) for i, n in ((0, "b"), (1, "a"))])
    return sides.select("inspection_id", F.concat_ws(", ", F.array_except("a", "b")).alias("newly_flagged"), F.concat_ws(", ", F.array_except("b", "a")).alias("no_longer_flagged"))
