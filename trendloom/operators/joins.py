"""Gold labels, taxonomy membership, label lookup, share alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom import fixed_values as fv

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after checking the size; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- gold labels ---------------------------------------------------------------------------

def with_gold(df: DataFrame, gold: DataFrame | None, key: str = "row_id") -> DataFrame:
    """Reviewer columns by row id, null where there is none; several verdicts give several rows."""
    if gold is None:
        return df.withColumns(
            {"is_complaint_gold": F.lit(None).cast("string"), "category_gold": F.lit(None).cast("string")}
        )
    return df.join(gold.select(key, "is_complaint_gold", "category_gold"), key, "left")


def override(gold: Column, weak: Column) -> Column:
    """Gold text where present and not blank, else the weak label."""
    return F.coalesce(F.nullif(gold, F.lit("")), weak)


def override_flag(gold: Column, weak: Column) -> Column:
    """Gold verdict where it reads as a boolean, else the weak one."""
    return F.coalesce(gold.try_cast("boolean"), weak)


def with_targets(df: DataFrame) -> DataFrame:
    """Training targets ``y_bin`` and ``y_cat`` after the gold override."""
    return df.withColumns(
        {
            "y_bin": override_flag(F.col("is_complaint_gold"), F.col("is_complaint_llm")),
            "y_cat": override(F.col("category_gold"), F.col("complaint_category_llm")),
        }
    )


# --- taxonomy ------------------------------------------------------------------------------

def _with_membership(df: DataFrame, subcategories: DataFrame, category: str, sub: str) -> DataFrame:
    allowed = subcategories.select(
        F.col("category").alias("_cat"), F.col("code").alias("_sub"), F.lit(True).alias("_allowed")
    ).distinct()
    matches = (df[category] == allowed["_cat"]) & (df[sub] == allowed["_sub"])
    return df.join(broadcast_if_small(allowed), matches, "left").drop("_cat", "_sub")


def keep_allowed(
    df: DataFrame, subcategories: DataFrame, category: str, sub: str, passing: tuple[str, ...] = ()
) -> DataFrame:
    """Replace a subcategory the taxonomy does not list under its category by ``UNKNOWN``.

    Values in ``passing`` stay as they are.
    """
    joined = _with_membership(df, subcategories, category, sub)
    ok = F.col("_allowed").isNotNull()
    if passing:
        ok = ok | F.col(sub).isin(*passing)
    return joined.withColumn(sub, F.when(ok, F.col(sub)).otherwise(fv.UNKNOWN)).drop("_allowed")


def training_subcategories(df: DataFrame, subcategories: DataFrame, category: str, sub: str) -> DataFrame:
    return keep_allowed(df, subcategories, category, sub)


def scored_subcategories(df: DataFrame, subcategories: DataFrame, category: str, sub: str) -> DataFrame:
    return keep_allowed(df, subcategories, category, sub, (fv.NOT_COMPLAINT, fv.UNKNOWN))


def with_code_label(df: DataFrame, labels: DataFrame, code: str, name: str) -> DataFrame:
    """Label of a code, the code itself where the taxonomy has none."""
    lookup = labels.select(F.col("code").alias("_code"), F.col("label").alias("_taxonomy_label"))
    joined = df.join(broadcast_if_small(lookup), df[code] == F.col("_code"), "left")
    return joined.withColumn(name, F.coalesce("_taxonomy_label", F.col(code))).drop("_code", "_taxonomy_label")


def with_subcategory_label(
    df: DataFrame, subcategories: DataFrame, category: str, sub: str, name: str
) -> DataFrame:
    """Label of a subcategory within its category, the code itself where there is none."""
    lookup = subcategories.select(
        F.col("category").alias("_cat"), F.col("code").alias("_sub"), F.col("label").alias("_taxonomy_label")
    )
    matches = (df[category] == F.col("_cat")) & (df[sub] == F.col("_sub"))
    joined = df.join(broadcast_if_small(lookup), matches, "left")
    return joined.withColumn(name, F.coalesce("_taxonomy_label", F.col(sub))).drop("_cat", "_sub", "_taxonomy_label")
