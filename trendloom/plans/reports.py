"""Report tables.  Each report is a dictionary of small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.operators import joins, prepare, trends
from trendloom.sources.taxonomy import Taxonomy
from trendloom.sources.tickets import PLACE


def _in_file_order(df: DataFrame, n: int) -> DataFrame:
    order = [c for c in PLACE if c in df.columns] or ["row_id"]
    return prepare.pilot_rows(df, n, order)


def top_labelled(counts: DataFrame, labels: DataFrame, code: str) -> DataFrame:
    """Counts with ``code (label)`` next to the code."""
    named = joins.with_code_label(counts, labels, code, "_label")
    return named.select(F.col(code).alias("code"), X.decorate(F.col(code), F.col("_label")).alias("shown"), "count")


def top_subcategories(bad: DataFrame, taxonomy: DataFrame, k: int, position: str) -> DataFrame:
    """Top subcategories, labelled through the category in which each is seen first."""
    sub, category = "complaint_subcategory_llm", "complaint_category_llm"
    top = trends.top_values(bad, sub, k)
    seen = trends.first_category(bad, category, sub, position)
    named = joins.with_subcategory_label(top.join(seen, sub), taxonomy, category, sub, "_label")
    return named.select(F.col(sub).alias("code"), X.decorate(F.col(sub), F.col("_label")).alias("shown"), "count")


def pilot(df: DataFrame, taxonomy: Taxonomy) -> dict[str, DataFrame]:
    spark = df.sparkSession
    df = prepare.with_default_labels(df)
    bad = prepare.complaints(df)
    place = F.struct(*[c for c in PLACE if c in df.columns] or ["row_id"])
    out = {
        "totals": trends.totals(df, "is_complaint_llm"),
        "top_categories": top_labelled(
            trends.top_values(bad, "complaint_category_llm", 10), taxonomy.category_table(spark), "complaint_category_llm"
        ),
        "complaint_examples": _in_file_order(bad, 30),
        "other_examples": _in_file_order(prepare.non_complaints(df), 30),
        "warning": prepare.summary_is_contaminated(df),
    }
    if "complaint_subcategory_llm" in df.columns:
        out["top_subcategories"] = top_subcategories(
            bad.withColumn("_place", place), taxonomy.subcategory_table(spark), 10, "_place"
        )
    if "loan_product_llm" in df.columns:
        out["top_loan_products"] = top_labelled(
            trends.top_values(bad, "loan_product_llm", 10), taxonomy.loan_product_table(spark), "loan_product_llm"
        )
    return out


def month(scored: DataFrame) -> dict[str, DataFrame]:
    bad = prepare.complaints(scored, "is_complaint_pred")
    return {
        "totals": trends.totals(scored, "is_complaint_pred"),
        "quality": trends.blank_shares(scored),
        "categories": trends.value_counts(bad, "category_pred"),
        "subcategories": trends.value_counts(bad, "subcategory_pred"),
        "top_categories": trends.top_values(bad, "category_pred", 20),
        "top_subcategories": trends.top_values(bad, "subcategory_pred", 25),
        "examples": _in_file_order(bad, 50),
    }


def trend(prepared: DataFrame) -> dict[str, DataFrame]:
    """Monthly rate with its change, and month by category."""
    monthly = trends.monthly_rates(prepared)
    return {
        "monthly": trends.month_over_month(monthly, "complaint_rate").orderBy("month"),
        "by_category": trends.month_category_counts(prepared).orderBy("month", "complaint_category_llm"),
        "first_by_category": trends.month_category_counts(prepared)
        .orderBy("month", "complaint_category_llm").limit(100),
    }


def comparison(base: DataFrame, new: DataFrame, min_cluster_size: int = 0) -> dict[str, DataFrame]:
    """Category share changes, novel examples and novel topic sizes."""
    return {
        "share_deltas": trends.share_deltas(base, "complaint_category_llm", new, "category_pred"),
        "novel_examples": _in_file_order(new.filter("is_novel"), 100),
        "topics": trends.topic_sizes(new, min_cluster_size),
    }


def training(
    val: DataFrame, complaints_val: DataFrame, lo: str | None = None, hi: str | None = None
) -> dict[str, DataFrame]:
    """Distributions shown next to the training metrics."""
    sub = F.coalesce(F.nullif(F.col("complaint_subcategory_llm"), F.lit("")), F.lit("UNKNOWN"))
    return {
        "predicted_complaints": trends.value_counts(val, "pred"),
        "categories": trends.top_values(complaints_val, "y_cat", 20),
        "subcategories": trends.top_values(complaints_val.withColumn("_sub", sub), "_sub", 25),
        "daily": trends.daily_variety(
            complaints_val, "complaint_category_llm", "complaint_subcategory_llm", lo, hi
        ).orderBy("day"),
    }


def write_all(report: dict[str, DataFrame], path: str) -> None:
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
