"""Score a new month, and compare a scored month with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.text import DialogConfig
from trendloom.operators.models import TrainConfig
from trendloom.operators.novelty import NoveltyConfig
from trendloom.sources.tickets import DropConfig
from trendloom.functions import text as X
from trendloom.operators import joins, novelty, prepare, projection
from trendloom.operators.models import Cascade
from trendloom.plans import reports
from trendloom.session import cut_lineage
from trendloom.sources import tables
from trendloom.sources import tickets as src
from trendloom.sources.taxonomy import Taxonomy, deny_tokens


def month_rows(
    spark: SparkSession, drops: DropConfig, month: str, dialog: DialogConfig, cfg: TrainConfig, schema=None
) -> DataFrame:
    """Rows of the new drop with dialog, first message and cleaned text; the month is the given one."""
    raw = src.with_event_time(src.scan_drops(spark, drops, schema), drops).withColumn("month", F.lit(month))
    rows = src.with_row_id(raw, DropConfig(drops.input_dir, file_format=drops.file_format), "new_").drop("row_no")
    column = prepare.scoring_dialog_column(rows, drops)
    rows = rows.withColumn("raw_dialog", X.text_or_empty(F.col(column)))
    rows = rows.withColumn("client_first_message", X.client_first_message(F.col("raw_dialog"), dialog))
    return rows.withColumn("text_clean", X.clean_for_model(F.col("client_first_message"), deny_tokens(spark, cfg)))


def score_rows(rows: DataFrame, cascade: Cascade, taxonomy: Taxonomy, threshold: float) -> DataFrame:
    """Cascade prediction with the subcategory held to the taxonomy."""
    featured = cascade.vectorizer.transform(rows, "text_clean")
    scored = cascade.score(featured, threshold).drop("features")
    subs = taxonomy.subcategory_table(rows.sparkSession)
    return joins.scored_subcategories(scored, subs, "category_pred", "subcategory_pred")


def infer_month(
    spark: SparkSession, drops: DropConfig, month: str, cascade: Cascade, out: str, *, taxonomy: Taxonomy | None = None,
    dialog: DialogConfig = DialogConfig(), cfg: TrainConfig = TrainConfig(), schema=None,
) -> DataFrame:
    """Score one month, store it under its month folder, and write its report tables."""
    rows = month_rows(spark, drops, month, dialog, cfg, schema)
    scored = cut_lineage(score_rows(rows, cascade, taxonomy or Taxonomy.default(), cfg.complaint_threshold))
    tables.write_scored(scored, f"{out}/scored")
    reports.write_all(reports.month(scored), f"{out}/reports/month/{month}")
    return scored


def compare_months(
    prepared: DataFrame, scored: DataFrame, cascade: Cascade, baseline: str, cfg: NoveltyConfig = NoveltyConfig(),
    train_cfg: TrainConfig = TrainConfig(), out: str | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """New complaints with novelty score, flag and cluster, and the comparison tables.

    ``baseline`` is ``first..last`` month.  With no baseline or no new complaints the
    result is empty but typed.
    """
    base = prepare.complaints(prepare.month_range(prepared, baseline))
    new = prepare.complaints(scored, "is_complaint_pred")
    clean = X.clean_for_model(F.col("client_first_message"), deny_tokens(prepared.sparkSession, train_cfg))

    def featured(df: DataFrame) -> DataFrame:
        return cascade.vectorizer.transform(df.withColumn("text_clean", clean), "text_clean").select("row_id", "features")

    base_rows = cut_lineage(featured(base))
    if base_rows.isEmpty() or new.isEmpty():
        empty = new.filter("false").withColumns(
            {"novelty_score": F.lit(0.0), "is_novel": F.lit(False), "cluster_id": F.lit(-1)}
        )
        return empty, reports.comparison(base, empty, cfg.min_cluster_size)
    basis = projection.principal_directions(base_rows, "features", cfg.svd_components, cfg.seed)
    base_z = cut_lineage(projection.projected(base_rows, "features", basis))
    new_z = cut_lineage(projection.projected(cut_lineage(featured(new)), "features", basis))
    scores = cut_lineage(novelty.novel_rows(novelty.novelty_scores(base_z, new_z, cfg), cfg))
    clustered = novelty.with_clusters(scores.join(new_z, "row_id"), "z", cfg.seed).drop("z")
    result = cut_lineage(new.join(clustered, "row_id"))
    shown = reports.comparison(base, result, cfg.min_cluster_size)
    if out:
        tables.write_topics(result, f"{out}/new_topics")
        reports.write_all(shown, f"{out}/reports/compare")
    return result, shown
