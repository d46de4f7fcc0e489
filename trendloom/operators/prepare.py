"""Projections and filters that turn raw tickets into labeler input and prepared rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom import fixed_values as fv
from trendloom.functions.text import DialogConfig, RedactionConfig
from trendloom.operators.labelling import LabelConfig
from trendloom.sources.tickets import DropConfig
from trendloom.functions import text as X


def distinct_names(*groups: Iterable[str]) -> list[str]:
    """Names in order of first appearance."""
    return list(dict.fromkeys(name for group in groups for name in group))


# --- columns ---------------------------------------------------------------------------

def dialog_columns(df: DataFrame, cfg: DropConfig) -> list[str]:
    """Configured dialog columns that exist, the legacy single one last."""
    legacy = [cfg.dialog_column] if cfg.dialog_column else []
    found = [c for c in distinct_names(cfg.dialog_columns or (), legacy) if c in df.columns]
    if not found:
        raise ValueError(f"none of the dialog columns {[*(cfg.dialog_columns or ()), *legacy]} is in the drops")
    return found


def scoring_dialog_column(df: DataFrame, cfg: DropConfig) -> str:
    """First configured dialog column that exists, else the first well-known one."""
    legacy = [cfg.dialog_column] if cfg.dialog_column else []
    for name in distinct_names(cfg.dialog_columns or (), legacy, fv.DIALOG_COLUMNS):
        if name in df.columns:
            return name
    raise KeyError("No dialog column found: configure dialog_column or dialog_columns")


def keep_columns(df: DataFrame, *groups: Iterable[str]) -> DataFrame:
    """Project to the named columns that exist, each once."""
    return df.select(*[c for c in distinct_names(*groups) if c in df.columns])


def as_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast the named columns to strings, null becoming empty."""
    return df.withColumns({c: X.text_or_empty(F.col(c)) for c in columns if c in df.columns})


def all_objects_as_text(df: DataFrame) -> DataFrame:
    """Every string or nested column as a string without nulls; scalars stay as they are."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, nested):
            changed[field.name] = F.coalesce(F.to_json(field.name), F.lit(""))
        elif isinstance(field.dataType, T.StringType):
            changed[field.name] = X.text_or_empty(F.col(field.name))
    return df.withColumns(changed) if changed else df


# --- rows ------------------------------------------------------------------------------

def time_range(df: DataFrame, lo: str | None = None, hi: str | None = None, column: str = "event_time") -> DataFrame:
    """Rows between two instants, both included; a bare date means its midnight."""
    if lo:
        df = df.filter(F.col(column) >= F.lit(lo).cast("timestamp_ntz"))
    if hi:
        df = df.filter(F.col(column) <= F.lit(hi).cast("timestamp_ntz"))
    return df


def month_range(df: DataFrame, span: str, column: str = "month") -> DataFrame:
    """Rows whose month lies in ``first..last``; prunes partitions of a month-partitioned table."""
    first, last = span.split("..")
    return df.filter(F.col(column).between(first, last))


def pilot_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def complaints(df: DataFrame, flag: str = "is_complaint_llm") -> DataFrame:
    return df.filter(F.col(flag))


def non_complaints(df: DataFrame, flag: str = "is_complaint_llm") -> DataFrame:
    return df.filter(~F.col(flag))


# --- dialogs and payload ------------------------------------------------------------------

def primary_dialog(columns: Sequence[str]) -> Column:
    """``struct<field,text>`` of the longest non-empty dialog text, the earliest on ties."""

    def candidate(place: int, name: str) -> Column:
        said = X.strip(X.text_or_empty(F.col(name)))
        entry = F.struct(
            F.length(said).alias("size"), F.lit(-place).alias("place"), F.lit(name).alias("field"),
            said.alias("text"),
        )
        return F.when(X.non_empty(F.col(name)), entry)

    candidates = [candidate(i, name) for i, name in enumerate(columns)]
    best = F.array_max(F.array(*candidates))
    return F.struct(
        F.coalesce(best["field"], F.lit(columns[0])).alias("field"),
        F.coalesce(best["text"], F.lit("")).alias("text"),
    )


def filled_map(columns: Sequence[str]) -> Column:
    """Map of column name to stripped text, for the non-empty columns in order."""
    entries = [
        F.when(
            X.non_empty(F.col(c)),
            F.struct(F.lit(c).alias("k"), X.strip(X.text_or_empty(F.col(c))).alias("v")),
        )
        for c in columns
    ]
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def signal_map(columns: Sequence[str], dialogs: Sequence[str]) -> Column:
    return filled_map([c for c in columns if c not in set(dialogs)])


def full_dialog_text(context: Column, max_chars: int) -> Column:
    """``name: text`` lines of the context, cut at three times ``max_chars``."""
    lines = F.transform(F.map_entries(context), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.substring(F.array_join(lines, "\n"), 1, 3 * max_chars)


def with_dialog_columns(
    df: DataFrame, columns: Sequence[str], dialog: DialogConfig, redaction: RedactionConfig
) -> DataFrame:
    """Primary dialog, context map, first client message, and their redacted forms."""
    picked = df.withColumn("_primary", primary_dialog(columns)).withColumn(
        "dialog_context_map", filled_map(columns)
    )
    said = picked.select(
        *[c for c in picked.columns if c != "_primary"],
        F.col("_primary.field").alias("dialog_source_field"),
        F.col("_primary.text").alias("raw_dialog"),
    ).withColumn("client_first_message", X.client_first_message(F.col("raw_dialog"), dialog))
    return said.withColumns(
        {
            "client_first_message_redacted": X.redact(F.col("client_first_message"), redaction),
            "dialog_context_map_redacted": X.redact_values(F.col("dialog_context_map"), redaction),
        }
    )


def payload(
    signals: Sequence[str], dialogs: Sequence[str], redaction: RedactionConfig, cfg: LabelConfig
) -> Column:
    """Labeler input.  The client message is carried along but not part of the input."""
    signal = X.redact_values(signal_map(signals, dialogs), redaction)
    context = F.col("dialog_context_map_redacted")
    return F.struct(
        F.substring("client_first_message_redacted", 1, cfg.max_text_chars).alias("client_first_message"),
        full_dialog_text(context, cfg.max_text_chars).alias("full_dialog_text"),
        F.col("dialog_source_field"),
        context.alias("dialog_context"),
        signal.alias("signal_fields"),
        *[F.try_element_at(signal, F.lit(n)).alias(n) for n in ("subject", "product", "channel", "status")],
    )


def labeler_input(c: Column) -> Column:
    return c.dropFields("client_first_message")


# --- label columns and review ---------------------------------------------------------------

def expand_label(df: DataFrame, label: str = "label", suffix: str = "_llm") -> DataFrame:
    """One suffixed column per field of the label record, and the error text."""
    fields = [f.name for f in df.schema[label].dataType.fields]
    out = df.select(
        *[c for c in df.columns if c != label], *[F.col(f"{label}.{f}").alias(f + suffix) for f in fields]
    )
    return out.withColumn("llm_error", error_text(F.col("notes" + suffix)))


def error_text(notes: Column) -> Column:
    return F.when(F.startswith(notes, F.lit(fv.ERROR_PREFIX)), notes).otherwise("")


def with_default_labels(df: DataFrame) -> DataFrame:
    """Label columns a report needs, added with neutral values where absent."""
    defaults = {
        "is_complaint_llm": F.lit(False), "complaint_category_llm": F.lit(fv.OTHER),
        "short_summary_llm": F.lit(""),
    }
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def review_sheet(df: DataFrame) -> DataFrame:
    """Columns a reviewer sees, with blank columns for the verdict."""
    shown = [c for c in fv.REVIEW_COLUMNS if c in df.columns]
    return df.select(*shown, *[F.lit("").alias(c) for c in fv.GOLD_COLUMNS])


def summary_is_contaminated(df: DataFrame, summary: str = "short_summary_llm") -> DataFrame:
    """Whether any summary repeats a speaker marker."""
    hit = F.rlike(F.col(summary), F.lit(fv.ROLE_WORDS_IN_SUMMARY))
    return df.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("warning"))
