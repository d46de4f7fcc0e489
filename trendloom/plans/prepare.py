"""Drops to prepared table: dialogs, redaction, weak labels, review sheet, pilot report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.labels import RuleSet
from trendloom.functions.text import DialogConfig, RedactionConfig
from trendloom.operators.labelling import LabelConfig
from trendloom.sources.tickets import DropConfig
from trendloom.functions import labels as L
from trendloom.functions import text as X
from trendloom.operators import labelling, ordering, prepare
from trendloom.plans import reports
from trendloom.session import cut_lineage, delete
from trendloom.sources import tables
from trendloom.sources import tickets as src
from trendloom.sources.taxonomy import Taxonomy


def dialog_rows(
    spark: SparkSession, drops: DropConfig, dialog: DialogConfig = DialogConfig(),
    redaction: RedactionConfig = RedactionConfig(), labels: LabelConfig = LabelConfig(),
    date_from: str | None = None, date_to: str | None = None, limit: int | None = None, schema=None,
) -> DataFrame:
    """Tickets in the time range with dialog columns and labeler payload, ready to label."""
    rows = prepare.time_range(src.read_tickets(spark, drops, schema), date_from, date_to)
    if limit:
        rows = prepare.pilot_rows(rows, limit, src.PLACE)
    dialogs = prepare.dialog_columns(rows, drops)
    signals = [c for c in drops.signal_columns if c in rows.columns]
    rows = prepare.keep_columns(rows, signals, dialogs, ["event_time", "month", "source_file", "row_id"], src.PLACE)
    rows = prepare.as_text(rows, prepare.distinct_names(signals, dialogs))
    rows = prepare.with_dialog_columns(rows, dialogs, dialog, redaction)
    return rows.withColumn("payload", prepare.payload(signals, dialogs, redaction, labels))


def rule_labelled(rows: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """Label by rules, as one expression."""
    label = L.rule_label(F.col("payload.full_dialog_text"), F.col("payload.product"), rules)
    return rows.withColumn("label", label).drop("payload")


def function_labelled(
    rows: DataFrame, labeler: labelling.Labeler, repair=None, cfg: LabelConfig = LabelConfig(), cache: str | None = None,
    calls: str | None = None,
) -> DataFrame:
    """Label by a user-supplied function, asking only for payloads the cache does not hold.

    Payloads are asked for in the order of the tickets.  ``calls`` is a folder for the calls, so that a
    job that broke off does not repeat them.
    """
    body = F.col("payload")
    fields = {name: body[name] for name in rows.schema["payload"].dataType.names if name not in ("dialog_context", "signal_fields")}
    fields |= {name: X.sorted_map(body[name]) for name in ("dialog_context", "signal_fields")}
    keyed = rows.withColumn("k", X.content_key(fields, cfg.version)).withColumn(
        "payload", F.to_json(prepare.labeler_input(body))
    )
    place = [c for c in src.PLACE if c in rows.columns]
    if cache is None:
        todo = labelling.distinct_payloads(keyed, place)
        labels = labelling.label_payloads(todo, labeler, repair, cfg, calls).select("k", "label")
    else:
        hits = cut_lineage(tables.probe_cache(keyed, cache))
        todo = labelling.distinct_payloads(keyed.join(hits.select("k"), "k", "left_anti"), place)
        fresh = cut_lineage(labelling.label_payloads(todo, labeler, repair, cfg, calls))
        tables.append_cache(fresh.filter(F.col("error").isNull()), cache)
        tables.compact_cache(rows.sparkSession, cache)
        labels = ordering.union_all([hits, fresh.select("k", "label")])
    return labelling.attach_labels(keyed, labels).drop("k", "payload")


def prepare_tickets(
    spark: SparkSession, drops: DropConfig, out: str, *, dialog: DialogConfig = DialogConfig(),
    redaction: RedactionConfig = RedactionConfig(), labels: LabelConfig = LabelConfig(), rules: RuleSet = RuleSet(),
    labeler: labelling.Labeler | None = None, repair=None, cache: str | None = None, taxonomy: Taxonomy | None = None,
    pilot: bool = False, limit: int | None = None, date_from: str | None = None, date_to: str | None = None, schema=None,
) -> DataFrame:
    """Write the prepared table (and in pilot mode the review sheet) under ``out`` and return it."""
    rows = dialog_rows(
        spark, drops, dialog, redaction, labels, date_from, date_to, limit if pilot else None, schema
    )
    calls = f"{out}/label_calls"
    labelled = rule_labelled(rows, rules) if labeler is None else function_labelled(rows, labeler, repair, labels, cache, calls)
    wide = prepare.expand_label(labelled)
    path = f"{out}/pilot_prepared" if pilot else f"{out}/prepared"
    tables.write_prepared(wide, path)
    delete(spark, calls)  # only a job that broke off leaves its calls for the next one
    stored = tables.read_by_month(spark, path, wide.schema)
    tables.write_errors(stored, f"{out}/label_errors")
    if pilot:
        tables.write_review_sheet(stored, f"{out}/pilot_review")
        for name, df in reports.pilot(stored, taxonomy or Taxonomy.default()).items():
            df.write.mode("overwrite").json(f"{out}/reports/pilot/{name}")
    return stored
