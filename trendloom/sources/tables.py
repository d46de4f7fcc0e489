"""Sinks and scans of the tables the jobs hand to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.functions.labels import LABEL_TYPE
from trendloom.operators.labelling import latest_labels
from trendloom.operators.prepare import all_objects_as_text, review_sheet
from trendloom.operators.ordering import union_all
from trendloom.session import delete, exists
from trendloom.sources import versions
from trendloom.sources.tickets import exists_or_none


NO_MONTH = "no-month"
MARK_WHOLE = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def _months(spark: SparkSession, version: str) -> list[str]:
    """Months of a written version; null months are one part of their own."""
    months = spark.read.option("inferSchema", False).schema("month string").parquet(version).select("month").distinct()
    return [NO_MONTH if r["month"] is None else r["month"] for r in months.collect()]


def _by_month(df: DataFrame, path: str) -> None:
    """The rebalance hint gives a large month several files and a small one a single file."""
    df.hint("rebalance", "month").write.option(MARK_WHOLE, "true").partitionBy("month").parquet(path)


def write_by_month(df: DataFrame, path: str) -> None:
    """Replace the months present in ``df``; the others stay.  A reader sees each month old or new, never in between."""
    spark = df.sparkSession
    versions.publish(spark, path, lambda v: _by_month(df, v), lambda v: _months(spark, v))


def write_prepared(df: DataFrame, path: str) -> None:
    """Replace the whole table: it holds the months of this run and no others."""
    versions.publish(df.sparkSession, path, lambda v: _by_month(df, v))


def read_by_month(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read with the written schema, so months stay text; a month predicate prunes folders."""
    parts = versions.current(spark, path)
    if not parts:
        raise ValueError(f"there is no published table at {path}")
    by_version: dict[str, list[str]] = {}
    for part, version in parts.items():
        by_version.setdefault(version, []).append(part)
    frames = []
    for version, months in by_version.items():
        rows = spark.read.schema(schema).parquet(version)
        if months != [versions.ALL]:
            inside = F.col("month").isin(*[m for m in months if m != NO_MONTH])
            rows = rows.filter((inside | F.col("month").isNull()) if NO_MONTH in months else inside)
        frames.append(rows)
    return union_all(frames)


def write_scored(df: DataFrame, path: str) -> None:
    write_by_month(all_objects_as_text(df), path)


# --- review and gold ------------------------------------------------------------------------

def write_review_sheet(df: DataFrame, path: str) -> None:
    sheet = review_sheet(df)
    nested = {f.name: F.to_json(f.name) for f in sheet.schema.fields if f.dataType.typeName() == "array"}
    _publish_csv(sheet.withColumns(nested) if nested else sheet, path)


def _publish_csv(df: DataFrame, path: str) -> None:
    versions.publish(
        df.sparkSession, path, lambda v: df.write.option(MARK_WHOLE, "true").options(header=True, quoteAll=True, escape='"').csv(v)
    )


def _publish_json(df: DataFrame, path: str) -> None:
    versions.publish(df.sparkSession, path, lambda v: df.write.option(MARK_WHOLE, "true").json(v))


def _folder(spark: SparkSession, path: str) -> str:
    """Where the current version of ``path`` lies; ``path`` itself if it is a plain folder or file."""
    return versions.current(spark, path).get(versions.ALL, path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame | None:
    """A written sheet as text columns, or None if there is none."""
    reader = spark.read.options(header=True, escape='"', multiLine=True)
    return exists_or_none(lambda: reader.csv(_folder(spark, path)))


def read_gold(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame | None:
    """Reviewer verdicts, or None if there is no review file."""
    if file_format == "csv":
        sheet = read_sheet(spark, path)
    else:
        sheet = exists_or_none(lambda: spark.read.format(file_format).load(_folder(spark, path)))
    if sheet is None:
        return None
    return sheet.select(*[F.col(c).cast("string").alias(c) for c in ("row_id", "is_complaint_gold", "category_gold")])


# --- errors, topics, metrics --------------------------------------------------------------------

ERROR_TYPE, METRIC_TYPE = "row_id string, error string", "model string, label string, metric string, value double"


def label_errors(df: DataFrame) -> DataFrame:
    """Rows whose labelling failed: id and message without the prefix."""
    message = F.substring("llm_error", len(fv.ERROR_PREFIX) + 2, 1 << 30)
    return df.filter(F.col("llm_error") != "").select("row_id", message.alias("error"))


def write_errors(df: DataFrame, path: str) -> None:
    _publish_json(label_errors(df), path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ERROR_TYPE).json(_folder(spark, path))


def write_topics(df: DataFrame, path: str) -> None:
    flat = all_objects_as_text(df)
    keep = [f.name for f in flat.schema.fields if f.dataType.typeName() not in ("array", "udt", "struct")]
    _publish_csv(flat.select(*keep), path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    _publish_json(metrics, path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_TYPE).json(_folder(spark, path))


# --- label cache ------------------------------------------------------------------------------------
# Folders by the first digits of a hash of the key: a run reads the folders of its own keys only.

CACHE_TYPE = "k string, v string, created_at timestamp, seq bigint, bucket string"
BUCKET_DIGITS = 2  # 256 folders
FILES_PER_BUCKET = 8


def cache_bucket(key: Column) -> Column:
    return F.substring(F.md5(key.cast("binary")), 1, BUCKET_DIGITS)


def cache_rows(spark: SparkSession, path: str, buckets: Sequence[str] | None = None) -> DataFrame:
    """All writes to the cache, or those of some folders."""
    writes = exists_or_none(lambda: spark.read.schema(CACHE_TYPE).parquet(path))
    if writes is None:
        return spark.createDataFrame([], CACHE_TYPE)
    return writes if buckets is None else writes.filter(F.col("bucket").isin(*buckets))


def _as_labels(writes: DataFrame) -> DataFrame:
    return latest_labels(writes).select("k", F.from_json("v", LABEL_TYPE).alias("label"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(k, label): the last label written per key; empty if nothing was cached yet."""
    return _as_labels(cache_rows(spark, path))


def probe_cache(rows: DataFrame, path: str, key: str = "k") -> DataFrame:
    """(k, label) of the keys of ``rows`` that the cache holds, from the folders of these keys only."""
    keys = rows.select(F.col(key).alias("k")).distinct()
    buckets = [r["b"] for r in keys.select(cache_bucket(F.col("k")).alias("b")).distinct().collect()]  # 256 at most
    return _as_labels(cache_rows(rows.sparkSession, path, buckets).join(keys, "k", "left_semi"))


def _append_writes(writes: DataFrame, path: str) -> None:
    """One file a folder; sorted, so that files skip row groups by key."""
    placed = writes.withColumn("bucket", cache_bucket(F.col("k"))).repartition("bucket").sortWithinPartitions("bucket", "k")
    placed.select("k", "v", "created_at", "seq", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def append_cache(labels: DataFrame, path: str) -> None:
    """Append (k, label).  A repeated write of a key changes nothing: the last one wins on read."""
    now, none = F.current_timestamp().alias("created_at"), F.lit(0).cast("bigint").alias("seq")
    _append_writes(labels.select("k", F.to_json("label").alias("v"), now, none), path)


def compact_cache(spark: SparkSession, path: str, files_per_bucket: int = FILES_PER_BUCKET) -> int:
    """Rewrite the folders of more than ``files_per_bucket`` files to the last write per key; returns their number.

    The new file is added before the old ones are deleted.  As the last write per key counts, a reader
    in between and a job that breaks off there see the same labels.
    """
    if not exists(spark, path):
        return 0
    by_bucket: dict[str, list[str]] = {}
    for file in cache_rows(spark, path).inputFiles():
        by_bucket.setdefault(file.rsplit("/", 2)[-2], []).append(file)
    old = [f for files in by_bucket.values() if len(files) > files_per_bucket for f in files]
    if not old:
        return 0
    writes = spark.read.schema(CACHE_TYPE).option("basePath", path).parquet(*old)
    # A key's writes lie in one folder, so the rows go once to the task that writes it and are reduced and sorted there.
    last = F.max_by(F.struct("v", "created_at", "seq"), F.struct("created_at", "seq")).alias("w")
    kept = writes.repartition("bucket").groupBy("bucket", "k").agg(last).sortWithinPartitions("bucket", "k")
    kept.select("k", "w.v", "w.created_at", "w.seq", "bucket").write.mode("append").partitionBy("bucket").parquet(path)
    for file in old:
        delete(spark, file)
    return sum(len(files) > files_per_bucket for files in by_bucket.values())
