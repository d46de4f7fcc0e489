"""Classifiers and cascade scoring over embeddings, and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.catalog.bindings import WEAK, sql_list, table, tickets, weak_labels
from trendloom.catalog.registry import query
from trendloom.operators.models import TrainConfig
from trendloom.operators import models
from trendloom.plans import reports
from trendloom.session import cut_lineage
from trendloom.sources.taxonomy import Taxonomy


def embedded(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_id"), (F.col("label") < 4).cast("double").alias("y"),
        F.concat(F.lit("topic_"), F.col("label").cast("string")).alias("topic"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


@query("complaint_scores")
def complaint_scores(spark, sf_dir):
    rows = cut_lineage(embedded(spark, sf_dir))
    scored = models.fit_complaint(rows, TrainConfig()).score(rows, "complaint_score")
    return scored.select(
        "row_id", "complaint_score", models.predicted(F.col("complaint_score"), 0.5).alias("is_complaint_pred")
    )


@query("calibrated_complaint_scores")
def calibrated_complaint_scores(spark, sf_dir):
    rows = cut_lineage(embedded(spark, sf_dir))
    model = models.fit_complaint(rows, TrainConfig(complaint_classifier="linearsvc"))
    return model.score(rows, "complaint_score").select("row_id", "complaint_score")


@query("category_predictions")
def category_predictions(spark, sf_dir):
    rows = cut_lineage(embedded(spark, sf_dir))
    bad = rows.filter("y = 1")
    return models.fit_category(bad, "topic", TrainConfig()).predict(rows, "category_pred").select("row_id", "topic", "category_pred")


@query("subcategory_predictions")
def subcategory_predictions(spark, sf_dir):
    rows = cut_lineage(embedded(spark, sf_dir))
    model = models.fit_subcategory(rows, "topic", TrainConfig())
    return model.predict(rows, "subcategory_pred").select("row_id", "topic", "subcategory_pred")


@query("cascade_scores")
def cascade_scores(spark, sf_dir):
    rows = cut_lineage(embedded(spark, sf_dir).withColumn("sub", F.concat(F.lit("s"), F.substring("topic", 7, 1))))
    cfg = TrainConfig(category_classifier="logreg")
    bad = rows.filter("y = 1")
    cascade = models.Cascade(
        None, models.fit_complaint(rows, cfg), models.fit_category(bad, "topic", cfg), models.fit_subcategory(bad, "sub", cfg)
    )
    return cascade.score(rows, cfg.complaint_threshold).select(
        "row_id", "is_complaint_pred", "category_pred", "subcategory_pred"
    )


# --- models with a known answer ---------------------------------------------------------------------
# One feature per event type and labels that follow from it: any sound model separates them.

KINDS = ("click", "error", "login", "purchase", "search", "signup", "view")


def event_features(spark, sf_dir):
    """Events with one 0/1 feature per type, a type seen nowhere being a zero column."""
    from pyspark.ml.functions import array_to_vector

    cells = F.array(*[F.when(F.col("event_type") == k, 1.0).otherwise(0.0) for k in KINDS])
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("row_id"), "event_type",
        F.col("event_type").isin("error", "view").cast("double").alias("y"),
        F.concat(F.lit("about_"), "event_type").alias("topic"), F.concat(F.lit("sub_"), "event_type").alias("sub"),
        array_to_vector(cells).alias("features"),
    )
    return cut_lineage(rows)


BAD_EVENT = "event_type IN ('error', 'view')"


@query("separable_complaints", f"SELECT CAST(event_id AS VARCHAR) AS row_id, {BAD_EVENT} AS is_complaint_pred FROM events")
def separable_complaints(spark, sf_dir):
    rows = event_features(spark, sf_dir)
    scored = models.fit_complaint(rows, TrainConfig()).score(rows, "s")
    return scored.select("row_id", models.predicted(F.col("s"), 0.5).alias("is_complaint_pred"))


@query("separable_calibrated_complaints", f"SELECT CAST(event_id AS VARCHAR) AS row_id, {BAD_EVENT} AS is_complaint_pred FROM events")
def separable_calibrated_complaints(spark, sf_dir):
    rows = event_features(spark, sf_dir)
    scored = models.fit_complaint(rows, TrainConfig(complaint_classifier="linearsvc")).score(rows, "s")
    return scored.select("row_id", models.predicted(F.col("s"), 0.5).alias("is_complaint_pred"))


TOPICS = "SELECT CAST(event_id AS VARCHAR) AS row_id, 'about_' || event_type AS category_pred FROM events"


@query("separable_categories", TOPICS)
def separable_categories(spark, sf_dir):
    rows = event_features(spark, sf_dir)
    return models.fit_category(rows, "topic", TrainConfig()).predict(rows, "category_pred").select("row_id", "category_pred")


@query("separable_categories_logistic", TOPICS)
def separable_categories_logistic(spark, sf_dir):
    rows = event_features(spark, sf_dir)
    model = models.fit_category(rows, "topic", TrainConfig(category_classifier="logreg"))
    return model.predict(rows, "category_pred").select("row_id", "category_pred")


@query("separable_subcategories", "SELECT CAST(event_id AS VARCHAR) AS row_id, 'sub_' || event_type AS subcategory_pred FROM events")
def separable_subcategories(spark, sf_dir):
    rows = event_features(spark, sf_dir)
    return models.fit_subcategory(rows, "sub", TrainConfig()).predict(rows, "subcategory_pred").select("row_id", "subcategory_pred")


@query(
    "constant_category",
    """
SELECT CAST(event_id AS VARCHAR) AS row_id, 'ONE' AS category_pred, false AS has_subcategories FROM events""",
)
def constant_category(spark, sf_dir):
    rows = event_features(spark, sf_dir).withColumn("one", F.lit("ONE"))
    model = models.fit_category(rows, "one", TrainConfig())
    none = models.fit_subcategory(rows, "one", TrainConfig())
    return model.predict(rows, "category_pred").select("row_id", "category_pred", F.lit(none is not None).alias("has_subcategories"))


def event_cascade(rows):
    cfg = TrainConfig(category_classifier="logreg")
    bad = rows.filter("y = 1")
    return models.Cascade(
        None, models.fit_complaint(rows, cfg), models.fit_category(bad, "topic", cfg), models.fit_subcategory(bad, "sub", cfg)
    )


@query(
    "routed_cascade",
    f"""
SELECT CAST(event_id AS VARCHAR) AS row_id, {BAD_EVENT} AS is_complaint_pred,
       CASE WHEN {BAD_EVENT} THEN 'about_' || event_type ELSE 'OTHER' END AS category_pred,
       CASE WHEN {BAD_EVENT} THEN 'sub_' || event_type ELSE 'NOT_COMPLAINT' END AS subcategory_pred FROM events""",
)
def routed_cascade(spark, sf_dir):
    rows = event_features(spark, sf_dir)
    return event_cascade(rows).score(rows, 0.5).select("row_id", "is_complaint_pred", "category_pred", "subcategory_pred")


@query(
    "stratified_folds",
    """
WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, CAST(f AS INTEGER) AS fold, n // 5 + CAST(f < n % 5 AS BIGINT) AS n FROM n, range(5) AS r(f)""",
)
def stratified_folds(spark, sf_dir):
    folds = models.with_folds(table(spark, sf_dir, "events"), "event_type", "event_id", 5, "fold")
    return folds.groupBy("event_type", "fold").agg(F.count("*").alias("n"))


# --- report tables --------------------------------------------------------------------------------

@query(
    "pilot_top_subcategories",
    f"""
WITH t AS (SELECT * FROM (VALUES {", ".join("(" + sql_list(r) + ")" for r in Taxonomy.default().subcategories)}) AS v(category, code, label)),
n AS (SELECT *, row_number() OVER (ORDER BY category, code) - 1 AS i FROM t),
rows AS (
  SELECT e.event_id, n.category, CASE WHEN user_id % 10 = 3 THEN 'unlisted' ELSE n.code END AS code
  FROM events e JOIN n ON e.user_id % (SELECT count(*) FROM t) = n.i WHERE event_type = 'error'
), top AS (
  SELECT code, count(*) AS "count", arg_min(category, event_id) AS category FROM rows GROUP BY code ORDER BY 2 DESC, 1 LIMIT 10)
SELECT top.code, top.code || ' (' || coalesce(t.label, top.code) || ')' AS shown, "count"
FROM top LEFT JOIN t ON top.code = t.code AND top.category = t.category""",
)
def pilot_top_subcategories(spark, sf_dir):
    taxonomy = Taxonomy.default()
    coded = spark.createDataFrame(
        [(i, c, s) for i, (c, s, _) in enumerate(sorted(taxonomy.subcategories))],
        "i long, complaint_category_llm string, code string",
    )
    events = table(spark, sf_dir, "events").filter("event_type = 'error'")
    rows = events.withColumn("i", F.col("user_id") % len(taxonomy.subcategories)).join(coded, "i").withColumn(
        "complaint_subcategory_llm", F.when(F.col("user_id") % 10 == 3, "unlisted").otherwise(F.col("code"))
    )
    return reports.top_subcategories(rows, taxonomy.subcategory_table(spark), 10, "event_id")


@query(
    "pilot_top_loan_products",
    f"""
WITH t AS (SELECT * FROM (VALUES {", ".join("(" + sql_list(r) + ")" for r in Taxonomy.default().loan_products)}) AS v(code, label)),
n AS (SELECT *, row_number() OVER (ORDER BY code) - 1 AS i FROM t),
rows AS (SELECT n.code FROM events JOIN n ON user_id % (SELECT count(*) FROM t) = n.i WHERE event_type = 'error'),
top AS (SELECT code, count(*) AS "count" FROM rows GROUP BY code ORDER BY 2 DESC, 1 LIMIT 10)
SELECT code, code || ' (' || label || ')' AS shown, "count" FROM top JOIN t USING (code)""",
)
def pilot_top_loan_products(spark, sf_dir):
    from trendloom.operators import trends

    taxonomy = Taxonomy.default()
    coded = spark.createDataFrame(
        [(i, c) for i, (c, _) in enumerate(sorted(taxonomy.loan_products))], "i long, loan_product_llm string"
    )
    events = table(spark, sf_dir, "events").filter("event_type = 'error'")
    rows = events.withColumn("i", F.col("user_id") % len(taxonomy.loan_products)).join(coded, "i")
    return reports.top_labelled(
        trends.top_values(rows, "loan_product_llm", 10), taxonomy.loan_product_table(spark), "loan_product_llm"
    )


@query(
    "trend_report",
    "WITH " + WEAK + """, m AS (
  SELECT month, avg(CAST(is_complaint_llm AS INTEGER)) AS r, count(*) AS n FROM weak GROUP BY month)
SELECT month, n, round(r, 9) AS complaint_rate, round(r - lag(r) OVER (ORDER BY month), 9) AS complaint_rate_change FROM m""",
)
def trend_report(spark, sf_dir):
    monthly = reports.trend(weak_labels(tickets(spark, sf_dir)))["monthly"]
    return monthly.select(
        "month", "n", F.round("complaint_rate", 9).alias("complaint_rate"),
        F.round("complaint_rate_change", 9).alias("complaint_rate_change"),
    )


@query(
    "month_report_categories",
    "WITH " + WEAK + """
SELECT lang AS category_pred, count(*) AS "count" FROM weak WHERE is_complaint_llm GROUP BY lang""",
)
def month_report_categories(spark, sf_dir):
    scored = weak_labels(tickets(spark, sf_dir)).select(
        "row_id", F.col("is_complaint_llm").alias("is_complaint_pred"), F.col("lang").alias("category_pred"),
        F.col("complaint_subcategory_llm").alias("subcategory_pred"), F.col("dialog_text").alias("raw_dialog"),
        F.col("dialog_text").alias("client_first_message"),
    )
    return reports.month(scored)["categories"]
