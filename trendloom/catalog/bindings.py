"""The benchmark tables seen as tickets and dialogs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A bare scan over all cores: the benchmark tables have one row group a file.

    The number of shuffle partitions, which adaptive execution lowers for small tables, so that the
    tasks of a large table do not grow with it; never fewer than the cores.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(key) if int(spark.conf.get("spark.sql.shuffle.partitions")) >= cores else scan.repartition(cores, key)


def tickets(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """One ticket per document, dated and routed by the order of the same number."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    orders = table(spark, sf_dir, "orders")
    return docs.join(orders, docs.doc_id == orders.o_orderkey).select(
        docs.doc_id.cast("string").alias("row_id"),
        orders.o_orderdate.alias("event_time"),
        F.date_format(orders.o_orderdate, "yyyy-MM").alias("month"),
        docs.text.alias("dialog_text"),
        orders.o_orderpriority.alias("channel"),
        orders.o_orderstatus.alias("status"),
        docs.source.alias("product"),
        docs.lang.alias("lang"),
        docs.doc_id,
        docs.n_chars,
        orders.o_totalprice.alias("amount"),
    )


TICKETS = """
tickets AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS row_id, o.o_orderdate AS event_time,
         strftime(o.o_orderdate, '%Y-%m') AS month, d.text AS dialog_text,
         o.o_orderpriority AS channel, o.o_orderstatus AS status, d.source AS product,
         d.lang, d.doc_id, d.n_chars, o.o_totalprice AS amount
  FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey
)"""


def weak_labels(df: DataFrame) -> DataFrame:
    """Tickets with a weak label derived from their routing columns."""
    sub = F.concat(F.lit("sub_"), F.lower(F.col("status")))
    return df.select(
        "*",
        (F.col("status") == "F").alias("is_complaint_llm"),
        F.col("channel").alias("complaint_category_llm"),
        F.when(F.col("status") == "F", sub).alias("complaint_subcategory_llm"),
    )


WEAK = (
    TICKETS
    + """, weak AS (
  SELECT *, status = 'F' AS is_complaint_llm, channel AS complaint_category_llm,
         CASE WHEN status = 'F' THEN 'sub_' || lower(status) END AS complaint_subcategory_llm
  FROM tickets
)"""
)


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the two turns after it, one speaker line each.

    Joining neighbouring turns on the unique key (conv_id, turn) gives
    several-speaker dialogs without gathering a conversation into one group.
    """
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.upper("role"), F.lit(": "), "text").alias("line"), "text"
    )
    second = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("line").alias("line2"))
    third = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("line").alias("line3"))
    return (
        turns.join(second, ["conv_id", "turn"], "left")
        .join(third, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "text", "line", "line2", "line3",
            F.concat_ws("\n", "line", "line2", "line3").alias("dialog_text"),
        )
    )


DIALOGS = """
turns AS (
  SELECT conv_id, turn, upper(role) || ': ' || text AS line, text FROM conversations
),
dialogs AS (
  SELECT a.conv_id, a.turn, a.text, a.line, b.line AS line2, c.line AS line3,
         concat_ws(chr(10), a.line, b.line, c.line) AS dialog_text
  FROM turns a
  LEFT JOIN turns b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
  LEFT JOIN turns c ON a.conv_id = c.conv_id AND a.turn + 2 = c.turn
)"""

# --- SQL spellings of the shared text rules ------------------------------------------
SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_non_empty(expr: str) -> str:
    text = sql_strip(f"coalesce(CAST({expr} AS VARCHAR), '')")
    return f"({text} <> '' AND lower({text}) NOT IN ('nan', 'none', 'null'))"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
