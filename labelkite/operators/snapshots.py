"""An inspection's whole result in one row, and what differs between two of them, with a headline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a headline, at most: fields newly detected, lost, otherwise changed.
NEW, LOST, OTHER = 6, 4, 6
UNRESOLVED = ("MISSING", "UNCERTAIN", "CONFLICTING")
OPEN = ("OPEN", "NEEDS_REVIEW")


def snapshots(inspections: DataFrame, fields: DataFrame, rules: DataFrame, violations: DataFrame, scans: DataFrame) -> DataFrame:
    """``inspection_id category fields rules violations scan``: arrays sorted by their names, ``scan`` null without one.

    ``inspections``: inspection_id, category; ``fields``: field_name, value, state, manually_corrected; ``rules``: rule_number, title,
    status, observed, critical; ``violations``: rule_number, status; ``scans``: compliance_score, coverage_score, ai_verdict,
    review_status, each with inspection_id. Nulls are empty texts. Of rows that share a name the last one in order counts.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)

    def gathered(df: DataFrame, name: str, row: Column) -> DataFrame:
        return df.groupBy("inspection_id").agg(F.sort_array(F.collect_list(row)).alias(name))

    one = lambda df, key: df.filter(F.coalesce(key, F.lit("")) != "") if key in df.columns else df
    f = gathered(fields, "fields", F.struct("field_name", F.trim(F.coalesce("value", F.lit(""))).alias("value"), text("state"), flag("manually_corrected")))
    r = gathered(one(rules, "rule_number"), "rules", F.struct("rule_number", text("title"), text("status"), text("observed"), flag("critical")))
    v = gathered(one(violations, "rule_number"), "violations", F.struct("rule_number", text("status")))
    score = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 2).alias(c)
    s = scans.groupBy("inspection_id").agg(F.min(F.struct(score("compliance_score"), score("coverage_score"), text("ai_verdict"), text("review_status"))).alias("scan"))
    out = inspections.select("inspection_id", text("category"))
    for part in (f, r, v, s):
        out = out.join(part, "inspection_id", "left")
    for name, part in (("fields", f), ("rules", r), ("violations", v)):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def _paired(before: Column, after: Column, key: str) -> Column:
    """array<struct<name, b, a>> of two sorted arrays' entries by ``key``; entries that one side lacks are null."""
    names = F.array_sort(F.array_union(F.transform(before, lambda x: x[key]), F.transform(after, lambda x: x[key])))
    last = lambda rows, n: F.try_element_at(F.filter(rows, lambda x: x[key] == n), F.lit(-1))
    return F.transform(names, lambda n: F.struct(n.alias("name"), last(before, n).alias("b"), last(after, n).alias("a")))


def _or(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """``inspection_id changed headline fields rules newly_flagged no_longer_flagged unresolved_before unresolved_after``: two snapshots of
    each inspection that both sides have.

    A field is ``newly_detected``, ``no_longer_detected``, ``value_changed`` or ``state_changed``. The headline is made from what
    differs: the category, at most six new, four lost and six changed fields, scores and verdict. One join; a snapshot's
    arrays are compared within its row.
    """
    side = lambda df, x: df.select("inspection_id", F.struct(*[c for c in df.columns if c != "inspection_id"]).alias(x))
    both = side(before, "b").join(side(after, "a"), "inspection_id")
    b, a = F.col("b"), F.col("a")

    def field_row(x: Column) -> Column:
        bv, av, bs, as_ = _or(x["b"]["value"]), _or(x["a"]["value"]), _or(x["b"]["state"]), _or(x["a"]["state"])
        kind = F.when((bv == "") & (av != ""), "newly_detected").when((bv != "") & (av == ""), "no_longer_detected").when(bv != av, "value_changed").when(bs != as_, "state_changed")
        label = F.replace(x["name"], F.lit("_"), F.lit(" "))
        return F.struct(x["name"].alias("field_name"), label.alias("label"), kind.alias("kind"), bv.alias("before_value"), av.alias("after_value"), bs.alias("before_state"), as_.alias("after_state"), F.coalesce(x["a"]["manually_corrected"], F.lit(False)).alias("manually_corrected"))

    def rule_row(x: Column) -> Column:
        title = F.when(_or(x["a"]["title"]) != "", x["a"]["title"]).otherwise(_or(x["b"]["title"]))
        status = lambda y: F.when(_or(y["status"]) != "", y["status"]).otherwise("NOT_EVALUATED")
        same = (_or(x["b"]["status"]) == _or(x["a"]["status"])) & (_or(x["b"]["observed"]) == _or(x["a"]["observed"]))
        critical = F.coalesce(x["a"]["critical"], F.lit(False)) | F.coalesce(x["b"]["critical"], F.lit(False))
        return F.struct(x["name"].alias("rule_number"), title.alias("title"), status(x["b"]).alias("before_status"), status(x["a"]).alias("after_status"), _or(x["b"]["observed"]).alias("before_observed"), _or(x["a"]["observed"]).alias("after_observed"), critical.alias("critical"), same.alias("same"))

    fields = F.filter(F.transform(_paired(b["fields"], a["fields"], "field_name"), field_row), lambda x: x["kind"].isNotNull())
    rules = F.filter(F.transform(_paired(b["rules"], a["rules"], "rule_number"), rule_row), lambda x: ~x["same"])
    open_ = lambda s: F.array_sort(F.array_distinct(F.transform(F.filter(s["violations"], lambda v: v["status"].isin(*OPEN)), lambda v: v["rule_number"])))
    unresolved = lambda s: F.size(F.filter(s["fields"], lambda f: f["state"].isin(*UNRESOLVED)))
    differs = lambda c: ~b["scan"][c].eqNullSafe(a["scan"][c])
    said = lambda c: _or(b["scan"][c]) != _or(a["scan"][c])
    out = both.withColumns({"fields": fields, "rules": rules})
    changed = F.struct(
        F.size("fields").alias("fields_changed"), F.size("rules").alias("rules_changed"), differs("compliance_score").alias("score_changed"), differs("coverage_score").alias("coverage_changed"),
        said("ai_verdict").alias("verdict_changed"), said("review_status").alias("review_status_changed"), (b["category"] != a["category"]).alias("classification_changed"),
    )
    out = out.withColumn("changed", changed)
    c = F.col("changed")
    any_ = (c["fields_changed"] > 0) | (c["rules_changed"] > 0)
    for name in ("score_changed", "coverage_changed", "verdict_changed", "review_status_changed", "classification_changed"):
        any_ = any_ | c[name]
    shown = lambda x, s: F.when(x[f"{s}_value"] != "", x[f"{s}_value"]).otherwise(x[f"{s}_state"])

    def told(kinds: tuple[str, ...], most: int, line) -> Column:
        return F.slice(F.transform(F.filter("fields", lambda x: x["kind"].isin(*kinds)), line), 1, most)

    arrow = lambda label, old, new: F.concat(label, F.lit(": "), old, F.lit(" → "), new)
    dash = lambda x: F.when(_or(x) != "", x).otherwise("—")
    lost = F.lit("not detected")
    when = lambda cond, line: F.when(cond, F.array(line)).otherwise(F.array().cast("array<string>"))
    percent = lambda s, x: F.concat(s["scan"][x].cast("string"), F.lit("%"))
    scored = b["scan"].isNotNull() & a["scan"].isNotNull()
    headline = F.concat(
        when(c["classification_changed"], arrow(F.lit("category"), dash(b["category"]), dash(a["category"]))),
        told(("newly_detected",), NEW, lambda x: arrow(x["label"], lost, shown(x, "after"))),
        told(("no_longer_detected",), LOST, lambda x: arrow(x["label"], shown(x, "before"), lost)),
        told(("value_changed", "state_changed"), OTHER, lambda x: arrow(x["label"], shown(x, "before"), shown(x, "after"))),
        when(c["score_changed"] & scored, arrow(F.lit("compliance"), percent(b, "compliance_score"), percent(a, "compliance_score"))),
        when(c["coverage_changed"] & scored, arrow(F.lit("evidence coverage"), percent(b, "coverage_score"), percent(a, "coverage_score"))),
        when(c["verdict_changed"], arrow(F.lit("AI verdict"), dash(b["scan"]["ai_verdict"]), dash(a["scan"]["ai_verdict"]))),
    )
    return out.select(
        "inspection_id", F.struct("changed.*", any_.alias("any")).alias("changed"), headline.alias("headline"), "fields", F.transform("rules", lambda x: x.dropFields("same")).alias("rules"),
        F.array_except(open_(a), open_(b)).alias("newly_flagged"), F.array_except(open_(b), open_(a)).alias("no_longer_flagged"), unresolved(b).alias("unresolved_before"), unresolved(a).alias("unresolved_after"),
    )
