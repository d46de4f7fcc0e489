"""Prepared table and gold labels to a saved cascade and its metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators.models import TrainConfig
from trendloom.functions import text as X
from trendloom.operators import joins, metrics, models, splits, trends
from trendloom.operators.features import Vectorizer
from trendloom.operators.ordering import union_all
from trendloom.plans import reports
from trendloom.session import cut_lineage
from trendloom.sources import tables
from trendloom.sources.taxonomy import Taxonomy, deny_tokens


@dataclass
class Training:
    cascade: models.Cascade
    metrics: DataFrame
    reports: dict[str, DataFrame]
    path: str | None = None


def training_table(prepared: DataFrame, gold: DataFrame | None, taxonomy: Taxonomy, cfg: TrainConfig) -> DataFrame:
    """Targets after gold override and taxonomy check, cleaned text, and the split flag."""
    df = joins.with_targets(joins.with_gold(prepared, gold))
    if "complaint_subcategory_llm" in df.columns:
        df = joins.training_subcategories(
            df, taxonomy.subcategory_table(df.sparkSession), "complaint_category_llm", "complaint_subcategory_llm"
        )
    deny = deny_tokens(df.sparkSession, cfg)
    df = df.withColumn("text_clean", X.clean_for_model(F.col(cfg.text_field), deny))
    keep = ["row_id", "event_time", "text_clean", "y_bin", "y_cat", "complaint_category_llm", "complaint_subcategory_llm"]
    table = cut_lineage(df.select(*[c for c in keep if c in df.columns]))
    return splits.with_split(table, cfg.split)


def _long(name: str, table: DataFrame) -> DataFrame:
    return table.select(F.lit(name).alias("model"), F.lit("").alias("label"), F.lit("f1").alias("metric"), F.col("f1").alias("value"))


def train(
    spark: SparkSession, prepared: DataFrame, gold: DataFrame | None = None, taxonomy: Taxonomy | None = None,
    cfg: TrainConfig = TrainConfig(), out: str | None = None,
) -> Training:
    """Fit the cascade on the training side, measure it on the validation side, save both."""
    rows = training_table(prepared, gold, taxonomy or Taxonomy.default(), cfg)
    has_sub = "complaint_subcategory_llm" in rows.columns
    counted = Vectorizer.counted(rows, "text_clean", cfg.vectorizer)
    vectorizer = Vectorizer.fit(splits.training_rows(counted), "text_clean", cfg.vectorizer)
    featured = vectorizer.transform(counted, "text_clean").drop("text_clean")
    featured = cut_lineage(featured.withColumn("y", F.col("y_bin").cast("double")).filter(F.col("y").isNotNull()))
    fit_rows, val = splits.training_rows(featured), splits.validation_rows(featured)
    bad_fit, bad_val = fit_rows.filter("y_bin"), val.filter("y_bin")

    complaint = models.fit_complaint(fit_rows, cfg)
    category = models.fit_category(bad_fit, "y_cat", cfg)
    sub = models.fit_subcategory(bad_fit, "complaint_subcategory_llm", cfg) if has_sub else None
    cascade = models.Cascade(vectorizer, complaint, category, sub)

    judged = complaint.score(val, "score").withColumn("pred", models.predicted(F.col("score"), cfg.complaint_threshold))
    judged = judged.select("row_id", "y_bin", "pred")
    categories = category.predict(bad_val, "guess").select("y_cat", "guess")
    report = metrics.classification_report(judged, "y_bin", "pred")
    rows_out = [
        report.select(
            F.lit("complaint").alias("model"), "label",
            F.explode(F.create_map(*[x for m in ("precision", "recall", "f1_score") for x in (F.lit(m), F.col(m))]))
            .alias("metric", "value"),
        ),
        _long("complaint", metrics.binary_f1(judged, "y_bin", "pred")),
        _long("category", metrics.macro_f1(categories, "y_cat", "guess")),
    ]
    if has_sub:
        filled = F.coalesce(F.nullif(F.col("complaint_subcategory_llm"), F.lit("")), F.lit("UNKNOWN"))
        truth = bad_val.withColumn("_truth", filled)
        subs = sub.predict(truth, "guess") if sub else truth.filter("false").withColumn("guess", F.col("_truth"))
        rows_out.append(_long("subcategory", metrics.macro_f1(subs.select("_truth", "guess"), "_truth", "guess")))
        share = trends.unknown_share(featured)
        rows_out.append(
            share.select(
                F.lit("subcategory").alias("model"), F.lit("").alias("label"), F.lit("unknown_share").alias("metric"),
                F.col("subcategory_unknown_share").alias("value"),
            )
        )
    table = union_all(rows_out)
    shown = reports.training(judged, bad_val, cfg.split.val_from, cfg.split.val_to) if has_sub else {}
    result = Training(cascade, table, shown)
    if out:
        result.path = cascade.save(spark, f"{out}/models")
        result.metrics = cut_lineage(table)
        tables.write_metrics(result.metrics, f"{result.path}/metrics")
        reports.write_all(shown, f"{out}/reports/training")
    return result
