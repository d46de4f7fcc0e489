"""Scans, event time, row ids, filters and payload columns over tickets and dialogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.catalog.bindings import (
    DIALOGS, TICKETS, WEAK, dialogs, sql_non_empty, sql_strip, table, tickets, weak_labels,
)
from trendloom.catalog.registry import query
from trendloom.catalog.text_queries import sql_redact
from trendloom.functions.text import RedactionConfig
from trendloom.operators.labelling import LabelConfig
from trendloom.sources.tickets import DropConfig
from trendloom.functions import text as X
from trendloom.operators import ordering, prepare
from trendloom.sources import tickets as src

# --- scans -------------------------------------------------------------------------------


@query(
    "union_of_drops",
    """
SELECT 'documents.parquet' AS source_file, doc_id, text, lang, NULL AS conv_id, NULL AS role FROM documents
UNION ALL
SELECT 'conversations.parquet', NULL, text, NULL, conv_id, role FROM conversations""",
)
def union_of_drops(spark, sf_dir):
    cfg = DropConfig(sf_dir, file_names=("documents.parquet", "conversations.parquet", "absent.parquet"))
    return src.scan_drops(spark, cfg).select("source_file", "doc_id", "text", "lang", "conv_id", "role")


@query(
    "rows_per_source_file",
    """
SELECT 'orders.parquet' AS source_file, count(*) AS n FROM orders
UNION ALL SELECT 'lineitem.parquet', count(*) FROM lineitem
UNION ALL SELECT 'events.parquet', count(*) FROM events""",
)
def rows_per_source_file(spark, sf_dir):
    names = ("orders.parquet", "lineitem.parquet", "events.parquet")
    scan = src.scan_drops(spark, DropConfig(sf_dir, file_names=names))
    return scan.groupBy("source_file").agg(F.count("*").alias("n"))


def raw_times(spark, sf_dir):
    """Orders with their date as text; pending orders carry an unreadable one."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    scan = src.scan_drops(spark, DropConfig(sf_dir, file_names=("orders.parquet",)))
    return scan.withColumn(
        "created_at", F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("on "), text)).otherwise(text)
    )


RAW_TIMES = """
raw AS (
  SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'on ' ELSE '' END
            || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM orders
), timed AS (
  SELECT *, try_strptime(created_at, '%Y-%m-%d %H:%M:%S') AS event_time FROM raw
)"""


@query("parsed_event_times", "WITH " + RAW_TIMES + " SELECT o_orderkey, created_at, event_time FROM timed")
def parsed_event_times(spark, sf_dir):
    pattern = src.spark_pattern("%Y-%m-%d %H:%M:%S")
    return raw_times(spark, sf_dir).select(
        "o_orderkey", "created_at", src.parse_event_time(F.col("created_at"), pattern).alias("event_time")
    )


@query(
    "unparsable_time_counts",
    "WITH " + RAW_TIMES
    + " SELECT 'orders.parquet' AS source_file, count(*) AS bad FROM timed WHERE event_time IS NULL HAVING count(*) > 0",
)
def unparsable_time_counts(spark, sf_dir):
    parsed = raw_times(spark, sf_dir).withColumn("event_time", src.parse_event_time(F.col("created_at")))
    return src.unparsable_counts(parsed)


@query("month_buckets", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_buckets(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", src.month_of(F.col("o_orderdate")).alias("month"))


@query(
    "row_ids_by_position",
    """
SELECT row_id, conv_id, turn, doc_id FROM (
  SELECT 'row_' || (row_number() OVER (ORDER BY conv_id, turn) - 1) AS row_id,
         conv_id, turn, NULL::BIGINT AS doc_id FROM conversations
  UNION ALL
  SELECT 'row_' || ((SELECT count(*) FROM conversations) + doc_id), NULL, NULL, doc_id FROM documents)""",
)
def row_ids_by_position(spark, sf_dir):
    cfg = DropConfig(sf_dir, file_names=("conversations.parquet", "documents.parquet"))
    return src.with_row_id(src.scan_drops(spark, cfg), cfg).select("row_id", "conv_id", "turn", "doc_id")


@query("row_ids_from_column", "SELECT CAST(o_orderkey AS VARCHAR) AS row_id, o_totalprice FROM orders")
def row_ids_from_column(spark, sf_dir):
    cfg = DropConfig(sf_dir, file_names=("orders.parquet",), id_column="o_orderkey")
    return src.with_row_id(src.scan_drops(spark, cfg), cfg).select("row_id", "o_totalprice")


# --- filters -------------------------------------------------------------------------------

@query(
    "time_range",
    """
SELECT o_orderkey, o_orderdate AS event_time FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31 00:00:00'""",
)
def time_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("event_time"))
    return prepare.time_range(orders, "1996-01-01", "1997-12-31")


@query(
    "pilot_rows",
    "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5000",
)
def pilot_rows(spark, sf_dir):
    scan = src.scan_drops(spark, DropConfig(sf_dir, file_names=("orders.parquet",)))
    return prepare.pilot_rows(scan, 5000, src.PLACE).select("o_orderkey", "o_orderpriority")


@query(
    "month_range",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders "
    "WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1996-11' AND '1997-02'",
)
def month_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", src.month_of(F.col("o_orderdate")).alias("month"))
    return prepare.month_range(orders, "1996-11..1997-02")


@query(
    "complaint_partition",
    """
SELECT event_id, CASE WHEN flag THEN 'complaint' ELSE 'other' END AS side
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN true WHEN event_type <> 'view' THEN false END AS flag
      FROM events) WHERE flag IS NOT NULL""",
)
def complaint_partition(spark, sf_dir):
    flag = F.when(F.col("event_type") == "error", True).when(F.col("event_type") != "view", False)
    events = table(spark, sf_dir, "events").select("event_id", flag.alias("flag"))
    sides = [
        prepare.complaints(events, "flag").select("event_id", F.lit("complaint").alias("side")),
        prepare.non_complaints(events, "flag").select("event_id", F.lit("other").alias("side")),
    ]
    return ordering.union_all(sides)


@query(
    "score_threshold",
    "SELECT event_id, value / 100 >= 0.5 AS is_complaint_pred FROM events",
)
def score_threshold(spark, sf_dir):
    from trendloom.operators.models import predicted

    events = table(spark, sf_dir, "events")
    return events.select("event_id", predicted(F.col("value") / 100, 0.5).alias("is_complaint_pred"))


# --- column shaping -----------------------------------------------------------------------

@query("kept_columns", "WITH " + TICKETS + " SELECT channel, status, dialog_text, month, row_id FROM tickets")
def kept_columns(spark, sf_dir):
    return prepare.keep_columns(
        tickets(spark, sf_dir), ["subject", "channel", "status", "dialog_text"], ["dialog_text", "call_text"],
        ["month", "row_id"],
    )


@query(
    "text_columns_as_strings",
    """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, coalesce(o_orderstatus, '') AS o_orderstatus,
       coalesce(CAST(o_orderkey AS VARCHAR), '') AS o_orderkey
FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def text_columns_as_strings(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    joined = customer.join(orders, customer.c_custkey == orders.o_custkey, "left")
    return prepare.as_text(
        joined.select("c_custkey", "c_nationkey", "o_orderstatus", "o_orderkey"),
        ["c_nationkey", "o_orderstatus", "o_orderkey"],
    )


@query(
    "all_objects_as_strings",
    "WITH " + TICKETS + """
SELECT row_id, event_time, CASE WHEN status = 'P' THEN '' ELSE channel END AS channel,
       CAST(to_json([product, lang]) AS VARCHAR) AS tags, amount FROM tickets""",
)
def all_objects_as_strings(spark, sf_dir):
    rows = tickets(spark, sf_dir).select(
        "row_id", "event_time", F.when(F.col("status") != "P", F.col("channel")).alias("channel"),
        F.array("product", "lang").alias("tags"), "amount",
    )
    return prepare.all_objects_as_text(rows)


# --- dialog columns ---------------------------------------------------------------------------
# Four dialog columns per row: three consecutive turns, and a fourth holding
# spelled-out missing values.

DIALOG_COLUMNS = ["dialog_text", "call_text", "comment_text", "summary_text"]
SIGNALS = ["dialog_text", "call_text", "subject", "channel", "status"]


def wide_dialogs(spark, sf_dir):
    d = dialogs(spark, sf_dir)
    return d.select(
        "conv_id", "turn",
        F.concat(F.lit("  "), F.col("line"), F.lit(" ")).alias("dialog_text"),
        F.col("line2").alias("call_text"),
        F.when(F.col("line3").isNull(), F.lit(" NaN ")).otherwise(F.col("line3")).alias("comment_text"),
        F.when(F.col("turn") == 0, F.lit("None")).alias("summary_text"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("subject"),
        F.when(F.col("turn") > 0, F.lit(" chat\t")).alias("channel"),
        F.lit("null").alias("status"),
    )


WIDE = (
    DIALOGS
    + """, wide AS (
  SELECT conv_id, turn, chr(160) || ' ' || line || ' ' AS dialog_text, line2 AS call_text,
         coalesce(line3, ' NaN ') AS comment_text, CASE WHEN turn = 0 THEN 'None' END AS summary_text,
         'conversation ' || conv_id AS subject, CASE WHEN turn > 0 THEN ' chat' || chr(9) END AS channel,
         'null' AS status
  FROM dialogs
)"""
)
LONG = "\nUNION ALL\n".join(
    f"SELECT conv_id, turn, {i} AS place, '{c}' AS field, {sql_strip(c)} AS said FROM wide WHERE {sql_non_empty(c)}"
    for i, c in enumerate(DIALOG_COLUMNS)
)


@query(
    "non_empty_texts",
    "WITH " + WIDE + f"""
SELECT conv_id, turn, {sql_non_empty('call_text')} AS has_call, {sql_non_empty('comment_text')} AS has_comment,
       {sql_non_empty('summary_text')} AS has_summary FROM wide""",
)
def non_empty_texts(spark, sf_dir):
    return wide_dialogs(spark, sf_dir).select(
        "conv_id", "turn", X.non_empty(F.col("call_text")).alias("has_call"),
        X.non_empty(F.col("comment_text")).alias("has_comment"),
        X.non_empty(F.col("summary_text")).alias("has_summary"),
    )


@query(
    "primary_dialog",
    "WITH " + WIDE + f""", long AS ({LONG}),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(said) DESC, place) AS rn FROM long)
SELECT w.conv_id, w.turn, coalesce(field, 'dialog_text') AS dialog_source_field, coalesce(said, '') AS raw_dialog
FROM wide w LEFT JOIN best b ON w.conv_id = b.conv_id AND w.turn = b.turn AND rn = 1""",
)
def primary_dialog(spark, sf_dir):
    picked = wide_dialogs(spark, sf_dir).select(
        "conv_id", "turn", prepare.primary_dialog(DIALOG_COLUMNS).alias("p")
    )
    return picked.select(
        "conv_id", "turn", F.col("p.field").alias("dialog_source_field"), F.col("p.text").alias("raw_dialog")
    )


@query(
    "dialog_context",
    "WITH " + WIDE + f", long AS ({LONG}) SELECT conv_id, turn, field, said FROM long",
)
def dialog_context(spark, sf_dir):
    return wide_dialogs(spark, sf_dir).select(
        "conv_id", "turn", F.explode(prepare.filled_map(DIALOG_COLUMNS)).alias("field", "said")
    )


@query(
    "signal_fields",
    "WITH " + WIDE + f"""
SELECT conv_id, turn, 'subject' AS field, {sql_strip('subject')} AS signal FROM wide WHERE {sql_non_empty('subject')}
UNION ALL
SELECT conv_id, turn, 'channel', {sql_strip('channel')} FROM wide WHERE {sql_non_empty('channel')}
UNION ALL
SELECT conv_id, turn, 'status', {sql_strip('status')} FROM wide WHERE {sql_non_empty('status')}""",
)
def signal_fields(spark, sf_dir):
    return wide_dialogs(spark, sf_dir).select(
        "conv_id", "turn", F.explode(prepare.signal_map(SIGNALS, DIALOG_COLUMNS)).alias("field", "signal")
    )


FULL_TEXT = """, full_text AS (
  SELECT conv_id, turn, string_agg(field || ': ' || said, chr(10) ORDER BY place) AS body
  FROM long GROUP BY conv_id, turn
)"""


@query(
    "full_dialog_text",
    "WITH " + WIDE + f", long AS ({LONG})" + FULL_TEXT
    + " SELECT w.conv_id, w.turn, substr(coalesce(body, ''), 1, 3600) AS full_dialog_text "
    "FROM wide w LEFT JOIN full_text f ON w.conv_id = f.conv_id AND w.turn = f.turn",
)
def full_dialog_text(spark, sf_dir):
    return wide_dialogs(spark, sf_dir).select(
        "conv_id", "turn",
        prepare.full_dialog_text(prepare.filled_map(DIALOG_COLUMNS), 1200).alias("full_dialog_text"),
    )


def _sql_json(pairs: list[tuple[str, str]]) -> str:
    parts = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in pairs)
    return f"'{{' || {parts} || '}}'"


@query(
    "labeler_payload",
    "WITH " + TICKETS + f""", p AS (
  SELECT row_id, {sql_strip('dialog_text')} AS raw, {sql_redact(sql_strip('dialog_text'))} AS red, channel, status, product
  FROM tickets
)
SELECT row_id, """
    + "CASE WHEN " + sql_non_empty("raw") + " THEN substr('dialog_text: ' || red, 1, 3600) ELSE '' END AS full_dialog_text, "
    + "'dialog_text' AS dialog_source_field, "
    + _sql_json([(k, f"CAST(to_json({k}) AS VARCHAR)") for k in ("channel", "product", "status")])
    + " AS signals, product, channel, status, NULL::VARCHAR AS subject FROM p",
)
def labeler_payload(spark, sf_dir):
    from trendloom.functions.text import DialogConfig

    signals = ["dialog_text", "subject", "channel", "product", "status"]
    # A configured column that is absent from the data is dropped when columns are resolved.
    rows = tickets(spark, sf_dir)
    present = [c for c in signals if c in rows.columns]
    rows = prepare.with_dialog_columns(rows, ["dialog_text"], DialogConfig(), RedactionConfig())
    built = rows.select(
        "row_id", prepare.payload(present, ["dialog_text"], RedactionConfig(), LabelConfig()).alias("payload")
    ).withColumn("payload", prepare.labeler_input(F.col("payload")))
    return built.select(
        "row_id", "payload.full_dialog_text", "payload.dialog_source_field",
        F.to_json(X.sorted_map(F.col("payload.signal_fields"))).alias("signals"),
        "payload.product", "payload.channel", "payload.status", "payload.subject",
    )


@query(
    "review_sheet",
    "WITH " + WEAK + """
SELECT row_id, month, is_complaint_llm, complaint_category_llm, complaint_subcategory_llm,
       '' AS is_complaint_gold, '' AS category_gold, '' AS subcategory_gold, '' AS comment FROM weak""",
)
def review_sheet(spark, sf_dir):
    return prepare.review_sheet(weak_labels(tickets(spark, sf_dir)))


@query(
    "summary_contamination",
    "SELECT bool_or(regexp_matches(text, '(?i)CLIENT|OPERATOR|CHATBOT')) AS warning FROM documents",
)
def summary_contamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("short_summary_llm"))
    return prepare.summary_is_contaminated(docs)


@query(
    "default_label_columns",
    "WITH " + TICKETS + " SELECT row_id, false AS is_complaint_llm, 'OTHER' AS complaint_category_llm, "
    "'' AS short_summary_llm FROM tickets",
)
def default_label_columns(spark, sf_dir):
    return prepare.with_default_labels(tickets(spark, sf_dir).select("row_id"))
