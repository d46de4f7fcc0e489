"""Counts, shares, rates and series over labelled tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.functions import text as X
from trendloom.operators.prepare import complaints


def share(flag: Column) -> Column:
    """Mean of a flag over the rows where it is known."""
    return F.avg(flag.cast("int"))


def monthly_rates(df: DataFrame, flag: str = "is_complaint_llm", row_id: str = "row_id") -> DataFrame:
    """Complaint rate and ticket count per month."""
    known = df.filter(F.col("month").isNotNull())
    return known.groupBy("month").agg(
        share(F.col(flag)).alias("complaint_rate"), F.count(row_id).alias("n")
    )


def month_category_counts(
    df: DataFrame, category: str = "complaint_category_llm", flag: str = "is_complaint_llm"
) -> DataFrame:
    known = complaints(df, flag).filter(F.col("month").isNotNull() & F.col(category).isNotNull())
    return known.groupBy("month", category).agg(F.count("*").alias("count"))


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))


def top_values(df: DataFrame, column: str, k: int, name: str = "count") -> DataFrame:
    """The ``k`` most frequent values; ties in the order of the value."""
    return value_counts(df, column, name).orderBy(F.desc(name), column).limit(k)


def value_shares(df: DataFrame, column: str, name: str) -> DataFrame:
    """Share of each value among the non-null ones."""
    counts = value_counts(df, column, "_n")
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select(column, (F.col("_n") / total).alias(name))


def share_deltas(base: DataFrame, base_column: str, new: DataFrame, new_column: str) -> DataFrame:
    """Category shares in both tables, an absent one being 0, and their change in points."""
    left = value_shares(base, base_column, "baseline_share").withColumnRenamed(base_column, "category")
    right = value_shares(new, new_column, "new_share").withColumnRenamed(new_column, "category")
    aligned = left.join(right, "category", "full_outer").select(
        "category",
        F.coalesce("baseline_share", F.lit(0.0)).alias("baseline_share"),
        F.coalesce("new_share", F.lit(0.0)).alias("new_share"),
    )
    return aligned.withColumn("delta_pp", (F.col("new_share") - F.col("baseline_share")) * 100)


def totals(df: DataFrame, flag: str) -> DataFrame:
    """Rows, complaints and complaint share; 0 for an empty table."""
    return df.agg(
        F.count("*").alias("rows_total"),
        F.count_if(F.col(flag)).alias("rows_complaints"),
        F.coalesce(share(F.col(flag)), F.lit(0.0)).alias("complaint_share"),
    )


def blank_shares(df: DataFrame, dialog: str = "raw_dialog", client: str = "client_first_message") -> DataFrame:
    """Share of rows without a dialog and without a client message."""
    return df.agg(
        F.coalesce(share(X.blank(F.col(dialog))), F.lit(0.0)).alias("empty_dialog_share"),
        F.coalesce(share(X.blank(F.col(client))), F.lit(0.0)).alias("empty_client_message_share"),
    )


def unknown_share(df: DataFrame, sub: str = "complaint_subcategory_llm") -> DataFrame:
    unknown = F.coalesce(F.col(sub) == fv.UNKNOWN, F.lit(False))
    return df.agg(F.coalesce(share(unknown), F.lit(0.0)).alias("subcategory_unknown_share"))


def daily_variety(
    df: DataFrame, category: str, sub: str | None, lo: str | None = None, hi: str | None = None,
    event_time: str = "event_time",
) -> DataFrame:
    """Distinct categories and subcategories per day inside an inclusive window."""
    at = F.col(event_time).try_cast("timestamp_ntz")
    known = df.withColumn(event_time, at).filter(F.col(event_time).isNotNull())
    if lo:
        known = known.filter(F.col(event_time) >= F.lit(lo).cast("timestamp_ntz"))
    if hi:
        known = known.filter(F.col(event_time) <= F.lit(hi).cast("timestamp_ntz"))
    day = F.date_trunc("day", F.col(event_time)).cast("timestamp_ntz")
    subs = F.count_distinct(sub) if sub else F.lit(0).cast("bigint")
    return known.groupBy(day.alias("day")).agg(
        F.count_distinct(category).alias("category_count"), subs.alias("subcategory_count")
    )


def first_category(df: DataFrame, category: str, sub: str, position: str) -> DataFrame:
    """Category in which each subcategory is seen first."""
    return df.filter(F.col(sub).isNotNull()).groupBy(sub).agg(F.min_by(category, position).alias(category))


def topic_sizes(df: DataFrame, min_size: int = 0) -> DataFrame:
    """Novel rows per cluster, small clusters left out."""
    sizes = df.filter("is_novel").groupBy("cluster_id").agg(F.count("row_id").alias("count"))
    return sizes.filter(F.col("count") >= min_size)


def every_month(monthly: DataFrame, value: str, by: str | None, absent: int) -> DataFrame:
    """(month, by, value) for every calendar month from the first to the last; rows without a month stay as they are."""
    start = lambda m: F.to_date(F.concat(m, F.lit("-01")))
    ends = monthly.agg(F.sequence(start(F.min("month")), start(F.max("month")), F.expr("interval 1 month"))).scalar()
    dated = monthly.filter("month IS NOT NULL")
    values = dated.select(by).distinct() if by else dated.groupBy().agg(F.count("*").alias("_n")).filter("_n > 0").drop("_n")
    grid = values.select("*", F.explode(ends).alias("_first")).withColumn("month", F.date_format("_first", "yyyy-MM")).drop("_first")
    known = monthly.select(F.col("month").alias("_m"), *([F.col(by).alias("_b")] if by else []), value)
    same = F.col("month") == F.col("_m")
    if by:
        same &= F.col(by).eqNullSafe(F.col("_b"))
    names = ["month", *([by] if by else [])]
    dense = grid.join(known, same, "left").select(*names, F.coalesce(value, F.lit(absent)).alias(value))
    return dense.unionByName(monthly.filter("month IS NULL").select(*names, value))


def month_over_month(monthly: DataFrame, value: str, by: str | None = None, absent: int | None = None) -> DataFrame:
    """Change of a monthly value against the calendar month before, on the aggregated table.

    With ``absent``, every calendar month from the first to the last has a row (for each value of
    ``by``), and ``absent`` stands for what the table does not have: what vanishes shows its fall.
    """
    if absent is not None:
        monthly = every_month(monthly, value, by, absent)
    following = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")
    keys = ["_month", *(["_by"] if by else [])]
    before = monthly.select(following.alias("_month"), *([F.col(by).alias("_by")] if by else []), F.col(value).alias("_before"))
    same = F.col("month") == F.col("_month")
    if by:
        same &= F.col(by).eqNullSafe(F.col("_by"))
    joined = monthly.join(before, same, "left").withColumn("_before", F.coalesce("_before", F.lit(absent))).drop(*keys)
    return joined.withColumnRenamed("_before", f"previous_{value}").withColumn(
        f"{value}_change", F.col(value) - F.col(f"previous_{value}")
    )
