"""Sinks and scans over the benchmark tables: written as a job writes them, and read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.catalog.bindings import TICKETS, WEAK, table, tickets, weak_labels
from trendloom.catalog.label_queries import RULES, _any
from trendloom.catalog.model_queries import event_cascade, event_features
from trendloom.catalog.registry import query
from trendloom.catalog.text_queries import document_key, sql_key
from trendloom.sources.tickets import DropConfig
from trendloom.functions import labels as L
from trendloom.operators import models, prepare, trends
from trendloom.session import checkpoint_dir
from trendloom.sources import tables, taxonomy
from trendloom.sources import tickets as src


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"


@query(
    "discovered_drops",
    "WITH " + TICKETS + """
SELECT month || '.parquet' AS file_name, count(*) AS n FROM tickets WHERE month < '1998-01' GROUP BY month""",
)
def discovered_drops(spark, sf_dir):
    """One folder a month, found by a pattern and read with the name of the drop."""
    folder = scratch(spark)
    rows = tickets(spark, sf_dir).select("row_id", "event_time", F.concat("month", F.lit(".parquet")).alias("drop"))
    rows.write.partitionBy("drop").parquet(folder)
    cfg = DropConfig(folder, "drop=199[0-7]-*.parquet", datetime_column="event_time")
    found = src.discover_drops(spark, cfg)
    names = found.select("path", F.regexp_extract("path", "drop=([^/]+)", 1).alias("file_name")).distinct()
    rows = src.scan_drops(spark, cfg).select(F.col("_file").alias("path"))
    return names.join(rows, "path").groupBy("file_name").agg(F.count("*").alias("n"))


@query("prepared_round_trip", "WITH " + WEAK + " SELECT row_id, month, is_complaint_llm FROM weak WHERE month >= '1997-06'")
def prepared_round_trip(spark, sf_dir):
    rows = weak_labels(tickets(spark, sf_dir)).select("row_id", "month", "is_complaint_llm")
    path = scratch(spark)
    tables.write_prepared(rows.filter("false"), path)
    tables.write_prepared(rows, path)
    return tables.read_by_month(spark, path, rows.schema).filter("month >= '1997-06'")


@query(
    "scored_round_trip",
    "WITH " + TICKETS + """
SELECT row_id, month, CASE WHEN month >= '1998-01' THEN 2 ELSE 1 END AS run FROM tickets""",
)
def scored_round_trip(spark, sf_dir):
    """A second run replaces the months it has and leaves the others."""
    rows = tickets(spark, sf_dir).select("row_id", "month", F.lit(1).alias("run"))
    path = scratch(spark)
    tables.write_scored(rows, path)
    tables.write_scored(rows.filter("month >= '1998-01'").withColumn("run", F.lit(2)), path)
    return tables.read_by_month(spark, path, "row_id string, run int, month string")


REVIEWED = """
SELECT row_id, CASE WHEN n % 3 = 0 THEN 'true' ELSE '' END AS is_complaint_gold, '' AS category_gold
FROM (SELECT row_id, doc_id AS n FROM tickets)"""


@query("gold_round_trip", "WITH " + TICKETS + REVIEWED)
def gold_round_trip(spark, sf_dir):
    """The review sheet, filled in by a reviewer and read as gold labels; blank cells stay blank."""
    path = scratch(spark)
    tables.write_review_sheet(weak_labels(tickets(spark, sf_dir)), path)
    sheet = tables.read_sheet(spark, path)
    verdict = F.when(F.col("row_id").cast("bigint") % 3 == 0, "true").otherwise("")
    filled = sheet.withColumns({"is_complaint_gold": verdict, "category_gold": F.lit("")})
    filled.write.options(header=True, quoteAll=True, escape='"').csv(f"{path}/filled")
    gold = tables.read_gold(spark, f"{path}/filled")
    return gold.select("row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("is_complaint_gold", "category_gold")])


@query("topic_export", "SELECT CAST(event_id AS VARCHAR) AS row_id, 'error ' || user_id AS topic FROM events WHERE event_type = 'error'")
def topic_export(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("row_id"), F.concat(F.lit("error "), F.col("user_id").cast("string")).alias("topic"), F.array("user_id").alias("dropped")
    )
    path = scratch(spark)
    tables.write_topics(rows, path)
    return tables.read_sheet(spark, path).select("row_id", "topic")


@query(
    "label_error_letters",
    "WITH " + TICKETS + " SELECT row_id, 'no answer for ' || product AS error FROM tickets WHERE status = 'P'",
)
def label_error_letters(spark, sf_dir):
    message = F.concat(F.lit(f"{fv.ERROR_PREFIX} no answer for "), "product")
    rows = tickets(spark, sf_dir).withColumn("llm_error", F.when(F.col("status") == "P", message).otherwise(""))
    path = scratch(spark)
    tables.write_errors(rows, path)
    return tables.read_errors(spark, path)


@query(
    "metrics_round_trip",
    "SELECT 'events' AS model, event_type AS label, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type",
)
def metrics_round_trip(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").cast("double").alias("value"))
    path = scratch(spark)
    tables.write_metrics(counts.select(F.lit("events").alias("model"), "label", F.lit("rows").alias("metric"), "value"), path)
    return tables.read_metrics(spark, path)


@query("loaded_tokens", "SELECT DISTINCT lower(c_mktsegment) AS token FROM customer")
def loaded_tokens(spark, sf_dir):
    """A list with blanks, capitals and repeats; a file that is not there adds nothing."""
    path = scratch(spark)
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("value"))
    lines.union(spark.range(3).select(F.lit(" ").alias("value"))).write.text(f"{path}/segments.txt")
    return taxonomy.token_union(taxonomy.load_tokens(spark, path, "segments.txt"), taxonomy.load_tokens(spark, path, "gone.txt"))


BAD_EVENT = "event_type IN ('error', 'view')"


@query(
    "loaded_cascade",
    f"""
SELECT CAST(event_id AS VARCHAR) AS row_id, {BAD_EVENT} AS is_complaint_pred,
       CASE WHEN {BAD_EVENT} THEN 'about_' || event_type ELSE 'OTHER' END AS category_pred,
       CASE WHEN {BAD_EVENT} THEN 'sub_' || event_type ELSE 'NOT_COMPLAINT' END AS subcategory_pred FROM events""",
)
def loaded_cascade(spark, sf_dir):
    """Models saved, loaded and applied."""
    from trendloom.operators.features import VectorizerConfig
    from trendloom.operators.features import TermBlock, Vectorizer

    rows = event_features(spark, sf_dir)
    cascade = event_cascade(rows)
    none = TermBlock([], [])
    cascade.vectorizer = Vectorizer(VectorizerConfig(), none, none)
    path = cascade.save(spark, scratch(spark))
    loaded = models.Cascade.load(spark, path, VectorizerConfig())
    return loaded.score(rows, 0.5).select("row_id", "is_complaint_pred", "category_pred", "subcategory_pred")


@query(
    "cache_written_and_probed",
    f"""
WITH keyed AS (SELECT *, {sql_key()} AS k FROM documents),
judged AS (
  SELECT k, {_any('text', RULES.complaint_triggers)} AS bad, coalesce(toxic, 0) = 1 AS raised
  FROM keyed LEFT JOIN labels USING (doc_id))
SELECT k, CASE WHEN bool_or(raised) THEN 'high' WHEN bool_or(bad) THEN 'medium' ELSE 'low' END AS severity FROM judged GROUP BY k""",
)
def cache_written_and_probed(spark, sf_dir):
    """Labels of all contents, a later write for some of them, compaction, and a probe by key."""
    docs = table(spark, sf_dir, "documents").withColumn("k", document_key())
    once = docs.groupBy("k").agg(F.first("text").alias("text"))
    label = L.rule_label(F.col("text"), F.lit(None), RULES)
    toxic = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")
    path = scratch(spark)
    tables.append_cache(once.select("k", label.alias("label")), path)
    raised = toxic.groupBy("k").agg(F.first("text").alias("text"))  # equal keys have equal texts
    raised = raised.select("k", label.withField("severity", F.lit("high")).alias("label"))
    tables.append_cache(raised, path)
    tables.compact_cache(spark, path, files_per_bucket=1)
    return tables.probe_cache(docs, path).select("k", "label.severity")


# --- column choice, decided while a plan is made ------------------------------------------------------

@query(
    "resolved_dialog_columns",
    "WITH " + TICKETS + " SELECT row_id, 'product,dialog_text' AS prepared, 'product' AS scored, 'dialog_text,product,lang' AS names FROM tickets",
)
def resolved_dialog_columns(spark, sf_dir):
    """Configured columns that exist, in order and once; scoring takes the first of them."""
    rows = tickets(spark, sf_dir)
    cfg = DropConfig("", dialog_column="dialog_text", dialog_columns=("product", "missing", "dialog_text", "product"))
    chosen, scored = prepare.dialog_columns(rows, cfg), prepare.scoring_dialog_column(rows, cfg)
    names = prepare.distinct_names(["dialog_text", "product"], ["product", "lang"], ["dialog_text"])
    return rows.select(
        "row_id", F.lit(",".join(chosen)).alias("prepared"), F.lit(scored).alias("scored"), F.lit(",".join(names)).alias("names")
    )


@query(
    "taxonomy_from_a_file",
    """
SELECT DISTINCT n_name AS code, coalesce(r_name, 'none') AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def taxonomy_from_a_file(spark, sf_dir):
    """A taxonomy file written from two tables and loaded: nations as categories, labelled by their region."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "n_name", F.struct(F.coalesce("r_name", F.lit("none")).alias(taxonomy.LABEL_KEY), F.array(F.lit("a")).alias("subcategories"))
    ))))
    path = f"{scratch(spark)}/taxonomy.json"
    rows.agg(F.concat(F.lit('{"categories": '), body, F.lit("}")).alias("value")).coalesce(1).write.text(path)
    return taxonomy.Taxonomy.load(spark, path).category_table(spark)
