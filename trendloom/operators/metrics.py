"""Class weights, scaling and classification quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.joins import broadcast_if_small


def min_max_scaled(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale a margin to [0, 1] by its range over the whole table."""
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    return df.withColumn(name, (F.col(column) - span["lo"]) / (span["hi"] - span["lo"] + 1e-9))


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weight rows / (classes * rows of the class), one row per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.struct(F.sum("_n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.select(label, (whole["rows"] / (whole["classes"] * F.col("_n"))).alias(name))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    return df.join(broadcast_if_small(class_weights(df, label, name)), label)


def class_tallies(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """True positives, rows and predictions per label seen on either side.

    Built on the confusion counts, so only label pairs are shuffled.
    """
    confusion = df.groupBy(
        F.col(truth).cast("string").alias("y"), F.col(guess).cast("string").alias("p")
    ).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("hits"),
                 F.col("n").alias("support"), zero.alias("guessed")),
        F.struct(F.col("p").alias("label"), zero.alias("hits"), zero.alias("support"), F.col("n").alias("guessed")),
    )
    return (
        confusion.select(F.explode(sides).alias("s")).filter("s.label IS NOT NULL").groupBy("s.label")
        .agg(F.sum("s.hits").alias("hits"), F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"))
    )


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a denominator is 0."""

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    tallies = class_tallies(df, truth, guess)
    return tallies.select(
        "label",
        ratio(F.col("hits"), F.col("guessed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("guessed")).alias("f1_score"),
        "support", "hits",
    )


def classification_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per-label scores followed by accuracy, macro and weighted averages."""
    scores = class_scores(df, truth, guess)
    measures = ("precision", "recall", "f1_score")
    support = F.sum("support")
    macro = scores.agg(*[F.avg(m).alias(m) for m in measures], support.alias("support"))
    weighted = scores.agg(
        *[(F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in measures], support.alias("support")
    )
    accuracy = scores.agg(*[(F.sum("hits") / support).alias(m) for m in measures], support.alias("support"))
    out = scores.select("label", *measures, "support")
    for name, row in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(row.select(F.lit(name).alias("label"), *measures, "support"))
    return out


def binary_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """F1 of the positive class."""
    hits = F.count_if(F.col(truth) & F.col(guess))
    both = F.count_if(F.col(truth)) + F.count_if(F.col(guess))
    return df.agg(F.when(both > 0, 2 * hits / both).otherwise(0.0).alias("f1"))


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 over the labels that occur in truth or prediction; 0 for an empty table."""
    return class_scores(df, truth, guess).agg(F.coalesce(F.avg("f1_score"), F.lit(0.0)).alias("f1"))
