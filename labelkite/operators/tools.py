"""Consumer tools: billed against printed prices, shelf life, complaints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.functions.text import duration_days, parsed_date

TOLERANCE = 0.005
WARN_DAYS = 7
#: Steps of a complaint, in order.
STEPS = ("DRAFT", "SUBMITTED", "UNDER_REVIEW", "RESOLVED", "CLOSED")


def price_check(billed: Column, mrp: Column, tolerance: float = TOLERANCE) -> Column:
    """struct(difference, percent, status); no printed price, or none above zero, says nothing."""
    usable = billed.isNotNull() & (mrp > 0)
    diff = F.round(billed - mrp, 2)
    status = F.when(~F.coalesce(usable, F.lit(False)), "INSUFFICIENT_DATA").when(diff <= mrp * tolerance, "PRICE_AT_OR_BELOW_MRP").otherwise("POTENTIAL_PRICE_DIFFERENCE")
    return F.struct(F.when(usable, diff).alias("difference"), F.when(usable, F.round(diff / mrp * 100, 2)).alias("percent"), status.alias("status"))


def expiry(printed: Column, best_before: Column, made: Column, bought: Column) -> Column:
    """struct(expiry, basis): a printed date, else a duration from the date of manufacture, never from the purchase."""
    date, days, from_ = parsed_date(printed), duration_days(best_before), parsed_date(made)
    basis = (
        F.when(date.isNotNull(), "PRINTED_ON_PACKAGE")
        .when(days.isNotNull() & from_.isNotNull(), "DURATION_FROM_MANUFACTURING_DATE")
        .when(days.isNotNull(), "DURATION_ONLY_NO_ANCHOR")
        .when(F.coalesce(bought, F.lit("")) != "", "NOT_DECLARED")
        .otherwise("NOT_PROVIDED")
    )
    return F.struct(F.coalesce(date, F.date_add(from_, days)).alias("expiry"), basis.alias("basis"))


def alert(expires: Column, as_of: Column, warn_days: int = WARN_DAYS) -> Column:
    """How an expiry date stands on a given day."""
    left = F.datediff(expires, as_of)
    return F.when(expires.isNull(), "NO_EXPIRY_DATA").when(left < 0, "EXPIRED").when(left <= warn_days, "EXPIRING_SOON").otherwise("FRESH")


def complaint_states(events: DataFrame) -> DataFrame:
    """(complaint_id, status, n_events, all_forward) from a log of (complaint_id, event_id, status).

    Any known status may follow any other; ``all_forward`` tells whether they went forward only.
    """
    step = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("status"))
    log = F.col("log")
    back = F.exists(F.transform(log, lambda x, i: F.coalesce(F.get(log, i - 1)["step"] > x["step"], F.lit(False))), lambda b: b)
    stepped = events.select("complaint_id", "event_id", F.col("status").alias("_status"), step.alias("_step"))
    states = stepped.groupBy("complaint_id").agg(F.max_by("_status", "event_id").alias("status"), F.count("*").alias("n_events"), F.array_sort(F.collect_list(F.struct("event_id", F.col("_step").alias("step")))).alias("log"))
    return states.select("complaint_id", "status", "n_events", (~back).alias("all_forward"))
