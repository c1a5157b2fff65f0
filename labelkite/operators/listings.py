"""What an online listing says against what the package says."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from labelkite.functions.text import money, to_base

MINIMUM_RATIO = 0.6


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two short texts are, by their longest common blocks (0 to 1); null where one is missing."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def clean(c):
    """Lower case, words and digits only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def compared(pairs: DataFrame) -> DataFrame:
    """``pairs`` (field, package, package_state, listing) with ``verdict``.

    Amounts are equal within a hundredth, quantities in their base unit, text by its likeness; a package value in conflict
    can't be compared.
    """
    p, l = F.col("package"), F.col("listing")
    p_blank, l_blank = F.trim(F.coalesce(p, F.lit(""))) == "", F.trim(F.coalesce(l, F.lit(""))) == ""
    amount = F.col("field").isin("mrp", "price", "unit_sale_price")
    quantity = lambda c: to_base(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.regexp_extract(F.lower(c), r"[0-9]\s*([a-z]+)", 1))
    close = F.when(amount, F.abs(money(p) - money(l)) < 0.01).when(F.col("field") == "net_quantity", F.abs(quantity(p) - quantity(l)) < 0.01)
    s = F.col("_alike")
    high, low = F.when(F.col("field") == "brand", 0.86).otherwise(0.72), F.when(F.col("field") == "brand", 0.6).otherwise(0.45)
    textual = F.when(s >= high, "MATCH").when(s >= low, "UNCLEAR").otherwise("INCONSISTENT")
    measured = F.when(close.isNull(), "NOT_COMPARABLE").when(close, "MATCH").otherwise("INCONSISTENT")
    verdict = (
        F.when(F.col("package_state") == "CONFLICTING", "NOT_COMPARABLE").when(p_blank & l_blank, "NOT_DECLARED").when(p_blank, "LISTING_ONLY").when(l_blank, "PACKAGE_ONLY")
        .when(amount | (F.col("field") == "net_quantity"), measured).otherwise(textual)
    )
    return pairs.withColumn("_alike", similarity(clean(p), clean(l))).withColumn("verdict", verdict).drop("_alike")


def agreement(compared_pairs: DataFrame, key: str = "listing_id") -> DataFrame:
    """Counts of verdicts and the share of matches among what could be compared; null where nothing could."""
    v = F.col("verdict")
    match, not_ = F.count_if(v == "MATCH"), F.count_if(v == "INCONSISTENT")
    return compared_pairs.groupBy(key).agg(match.alias("matched"), not_.alias("inconsistent"), F.count_if(v.isin("LISTING_ONLY", "PACKAGE_ONLY")).alias("one_sided"), F.count_if(v.isin("NOT_COMPARABLE", "UNCLEAR")).alias("not_comparable"), F.bround(F.try_divide(match, match + not_), 4).alias("agreement"))


def declaration_check(listed: DataFrame, watched: tuple[str, ...], *, minimum: float = MINIMUM_RATIO) -> DataFrame:
    """Whether a listing (listing_id, field, value) declares enough of the watched fields."""
    ids = listed.select("listing_id").distinct()
    wanted = ids.select("listing_id", F.explode(F.array(*[F.lit(w) for w in watched])).alias("field"))
    present = wanted.join(listed.groupBy("listing_id", "field").agg(F.bool_or(F.trim(F.coalesce("value", F.lit(""))) != "").alias("has")), ["listing_id", "field"], "left")
    ratio = F.avg(F.coalesce(F.col("has"), F.lit(False)).cast("double"))
    return present.groupBy("listing_id").agg(ratio.alias("ratio")).select("listing_id", "ratio", F.when(F.col("ratio") >= minimum, "PASS").otherwise("UNCERTAIN").alias("status"), F.bround(F.least(F.lit(0.9), 0.4 + 0.5 * F.col("ratio")), 3).alias("confidence"))
