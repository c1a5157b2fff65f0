"""Finding topics, rules and fields that a question names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tokens(c):
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def topics(questions: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best topics of each question (question_id, text): a phrase counts 3, a word 2, a beginning of at least four
    letters 1, a word of the title a half. Topics (topic, title, keyword) are a small list."""
    q = questions.select("question_id", F.lower("text").alias("t"), tokens(F.col("text")).alias("words"))
    word = F.lower(F.col("keyword"))
    phrase = word.contains(" ")
    hit = (
        F.when(phrase & F.contains(F.col("t"), word), 3.0).when(~phrase & F.array_contains(F.col("words"), word), 2.0)
        .when(~phrase & (F.length(word) >= 4) & F.exists("words", lambda w: (F.length(w) >= 4) & (w.startswith(word) | word.startswith(w))), 1.0).otherwise(0.0)
    )
    title = 0.5 * F.size(F.array_intersect(F.col("words"), tokens(F.col("title"))))
    scored = q.crossJoin(F.broadcast(known)).groupBy("question_id", "topic").agg((F.sum(hit) + F.max(title)).alias("score")).filter("score > 0")
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "topic")
    strength = F.when(F.col("score") >= 3, "strong").when(F.col("score") >= 2, "weak").otherwise("none")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("question_id", "topic", "score", "rank", strength.alias("strength"))


def resolved(references: DataFrame, rules: DataFrame) -> DataFrame:
    """(reference, rule_number): the rule of that number, else the one with the longest common beginning. Rules are a small list."""
    a, b = F.col("reference"), F.col("rule_number")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    scored = references.crossJoin(F.broadcast(rules)).withColumn("n", F.when(a == b, 1000).otherwise(F.least(shared, F.length(b))))
    return scored.groupBy("reference").agg(F.max(F.struct("n", F.col("rule_number").alias("r"))).alias("best")).select("reference", F.when(F.col("best.n") > 0, F.col("best.r")).alias("rule_number"))


def named_field(questions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The field with the most words of which all stand in the question."""
    options = F.array(*[F.struct(F.lit(f.count("_") + 1).alias("n"), F.lit(f).alias("field")) for f in fields])
    words = tokens(F.col("text"))
    found = F.filter(options, lambda o: F.size(F.array_except(F.split(o["field"], "_"), words)) == 0)
    return questions.select("question_id", F.array_max(found)["field"].alias("field"))
