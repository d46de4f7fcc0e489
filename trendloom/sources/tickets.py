"""Ticket drops: discovery, scan, event time, row ids."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.operators.ordering import number_rows, union_all


@dataclass(frozen=True)
class DropConfig:
    """Where ticket drops lie and how their columns are read.

    Drops are the files that ``file_glob`` matches, or exactly ``file_names`` in that order.  Event times
    are parsed by ``datetime_format`` (strptime letters), or as written without one.
    """

    input_dir: str
    file_glob: str = "*"
    file_names: tuple[str, ...] | None = None
    file_format: str = "parquet"
    id_column: str | None = None
    datetime_column: str = fv.TIME_COLUMN
    datetime_format: str | None = None
    dialog_columns: tuple[str, ...] | None = None
    dialog_column: str | None = fv.DIALOG_COLUMNS[0]
    signal_columns: tuple[str, ...] = fv.SIGNAL_COLUMNS

PLACE = ("_file", "_block", "_row")

# --- fixed values: strptime directives and their Spark datetime letters --------------
DIRECTIVES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM",
    "%B": "MMMM", "%I": "hh", "%p": "a", "%j": "DDD",
}


def spark_pattern(strptime_format: str) -> str:
    """Spark datetime pattern for a strptime format: every other character is quoted.

    A directive without a counterpart is refused here, before anything is read.
    """
    out, literal = [], ""
    for token in re.findall(r"(?s)%.|.", strptime_format):
        if token == "%%" or not token.startswith("%") or token == "%":
            literal += "%" if token == "%%" else token
            continue
        if token not in DIRECTIVES:
            raise ValueError(f"time format {strptime_format!r}: {token} is not supported")
        out += [_quoted(literal), DIRECTIVES[token]]
        literal = ""
    return "".join([*out, _quoted(literal)])


def _quoted(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", literal) else literal


def drop_path(cfg: DropConfig) -> str:
    """Path pattern of the configured drops; listed names that do not exist match nothing."""
    names = "{" + ",".join(cfg.file_names) + "}" if cfg.file_names else cfg.file_glob
    return f"{cfg.input_dir.rstrip('/')}/{names}"


def exists_or_none(read) -> DataFrame | None:
    """The table ``read()`` returns, or None if its path does not exist; other errors stay errors."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def discover_drops(spark: SparkSession, cfg: DropConfig) -> DataFrame:
    """Paths of the drops, sorted; only the listing is read."""
    files = exists_or_none(lambda: spark.read.format("binaryFile").load(drop_path(cfg)))
    if files is None:
        return spark.createDataFrame([], "path string, file_name string")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name")).orderBy("path")


def _drop_name(spark: SparkSession, cfg: DropConfig) -> Column:
    """Name of the drop of a row: of its file, or of the folder of files that was matched as one drop."""
    path = spark._jvm.org.apache.hadoop.fs.Path(drop_path(cfg))
    matched = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    folders: dict[int, list[Column]] = {}
    for status in matched:
        if status.isDirectory():
            where = status.getPath().toUri().toString().rstrip("/")
            folders.setdefault(where.count("/") + 1, []).extend((F.lit(where), F.lit(status.getPath().getName())))
    parts = F.split("_metadata.file_path", "/")
    names = [F.try_element_at(F.create_map(*f), F.array_join(F.slice(parts, 1, n), "/")) for n, f in sorted(folders.items())]
    return F.coalesce(*names, F.col("_metadata.file_name"))


def _with_place(df: DataFrame, cfg: DropConfig, dense: bool) -> DataFrame:
    """Rows with their place: the file by its whole path, in the order of an explicit list."""
    name = _drop_name(df.sparkSession, cfg)
    row = F.col("_metadata.row_index") if dense else F.monotonically_increasing_id()
    path = F.col("_metadata.file_path")
    if cfg.file_names:
        listed = F.array_position(F.array(*[F.lit(n) for n in cfg.file_names]), name)
        path = F.concat(F.lpad(listed.cast("string"), 9, "0"), F.lit(" "), path)
    return df.select(
        "*",
        name.alias("source_file"),
        path.alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        row.alias("_row"),
    )


def _scan_csv(spark: SparkSession, cfg: DropConfig, schema) -> DataFrame | None:
    # A dialog has a line per speaker inside its quotes, so a file is read whole, by one task.
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        df = exists_or_none(lambda: reader.schema(schema).option("enforceSchema", False).csv(drop_path(cfg)))
        return None if df is None else _with_place(df, cfg, dense=False)
    # Headers may differ from drop to drop: one scan per distinct header.
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in (r["path"] for r in discover_drops(spark, cfg).collect()):
        by_header.setdefault(tuple(reader.csv(path).columns), []).append(path)
    frames = [_with_place(reader.csv(paths), cfg, dense=False) for paths in by_header.values()]
    return union_all(frames) if frames else None


def _scan_by_type(spark: SparkSession, cfg: DropConfig) -> DataFrame:
    """Parquet drops that disagree on the type of a column: such a column becomes text."""
    by_schema: dict[str, list[str]] = {}
    kinds: dict[str, set[str]] = {}
    for path in (r["path"] for r in discover_drops(spark, cfg).collect()):
        schema = spark.read.parquet(path).schema
        by_schema.setdefault(schema.simpleString(), []).append(path)
        for f in schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    frames = []
    for paths in by_schema.values():
        df = _with_place(spark.read.parquet(*paths), cfg, dense=True)
        mixed = {c: F.col(c).cast("string") for c in df.columns if len(kinds.get(c, ())) > 1}
        frames.append(df.withColumns(mixed) if mixed else df)
    return union_all(frames)


def scan_drops(spark: SparkSession, cfg: DropConfig, schema=None) -> DataFrame:
    """Union of all drops with ``source_file`` and the place of each row."""
    if cfg.file_format == "csv":
        df = _scan_csv(spark, cfg, schema)
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        if cfg.file_format == "parquet":
            reader = reader.option("mergeSchema", True)
        try:
            df = exists_or_none(lambda: reader.format(cfg.file_format).load(drop_path(cfg)))
        except (Py4JJavaError, PySparkException) as e:
            if "CANNOT_MERGE" not in str(e):
                raise
            return _scan_by_type(spark, cfg)
        if df is not None:
            df = _with_place(df, cfg, dense=cfg.file_format == "parquet")
    if df is None:
        raise ValueError("No input files found")
    return df


def parse_event_time(c: Column, pattern: str | None = None) -> Column:
    """Zone-free timestamp, null where the text does not parse."""
    if pattern is None:
        return c.try_cast("timestamp_ntz")
    return F.try_to_timestamp(c.cast("string"), F.lit(pattern)).cast("timestamp_ntz")


def month_of(event_time: Column) -> Column:
    return F.date_format(event_time, "yyyy-MM")


def unparsable_counts(df: DataFrame, event_time: str = "event_time") -> DataFrame:
    """Rows per drop whose event time is missing; only drops that have any."""
    counts = df.groupBy("source_file").agg(F.count_if(F.col(event_time).isNull()).alias("bad"))
    return counts.filter(F.col("bad") > 0)


def with_event_time(df: DataFrame, cfg: DropConfig, check: bool = True) -> DataFrame:
    """Add ``event_time`` and ``month``; fail if any value cannot be parsed.

    The check reads the time column only and runs before anything is written.
    """
    if cfg.datetime_column not in df.columns:
        raise ValueError(f"the drops have no time column {cfg.datetime_column!r}; they have {', '.join(df.columns)}")
    pattern = spark_pattern(cfg.datetime_format) if cfg.datetime_format else None
    parsed = df.withColumn("event_time", parse_event_time(F.col(cfg.datetime_column), pattern))
    if check:
        worst = unparsable_counts(parsed).orderBy(F.desc("bad"), "source_file").limit(1).collect()
        if worst:
            raise ValueError(
                f"{worst[0]['source_file']}: {worst[0]['bad']} rows whose {cfg.datetime_column!r} is no time in the "
                f"expected format"
            )
    return parsed.withColumn("month", month_of(F.col("event_time")))


def with_row_id(df: DataFrame, cfg: DropConfig, prefix: str = "row_") -> DataFrame:
    """``row_id`` from the id column, else from the dense position in the drops."""
    if cfg.id_column and cfg.id_column in df.columns:
        return df.withColumn("row_id", F.col(cfg.id_column).cast("string"))
    dense = cfg.file_format == "parquet"
    numbered = number_rows(df, "_file", None if dense else "_block", "_row")
    return numbered.withColumn("row_id", F.concat(F.lit(prefix), F.col("row_no").cast("string")))


def read_tickets(spark: SparkSession, cfg: DropConfig, schema=None, check: bool = True) -> DataFrame:
    """Scan, event time, month, source file and row id of all configured drops."""
    return with_row_id(with_event_time(scan_drops(spark, cfg, schema), cfg, check), cfg)
