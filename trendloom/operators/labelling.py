"""Labelling jobs: batching, calling a user-supplied labeler, retries, cache.

The labeler is a Python callable ``labeler(payloads: list[dict]) -> str`` that
returns the text of a JSON list of answers.  Spark partitions the work; unwrapping,
pairing, coercion and validation of the answers are expressions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.functions import labels as L
from trendloom.functions import text as X
from trendloom.operators.ordering import number_in_order, union_all
from trendloom.session import checkpoint_dir, cut_lineage, delete, exists


@dataclass(frozen=True)
class LabelConfig:
    """Size of a request, of a batch and of a wave of calls; ``version`` is part of the cache key."""

    version: str = "v1"
    max_text_chars: int = fv.MAX_TEXT_CHARS
    token_budget: int = fv.TOKEN_BUDGET
    max_attempts: int = fv.MAX_ATTEMPTS
    run_rows: int = 10_000  # rows whose batches one task forms
    parallelism: int | None = None  # calls in flight; None: one for each core
    calls_per_task: int = 16

Labeler = Callable[[list[dict]], str]

ASKED_TYPE = (
    "requests array<struct<idx:int,k:string,payload:string,row_no:bigint>>, response string, error string"
)
WAVES = 32  # a job has about as many waves at most, so their fixed cost does not grow with the input
TASKS_PER_CORE = 8  # in a wave
MARK_WHOLE = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
STORED = {"compression": "zstd"}


# --- batching -------------------------------------------------------------------------

def batch_numbers(tokens: list[int], budget: int, start: tuple[int, int] = (0, 0)) -> tuple[list[int], tuple[int, int]]:
    """Batch number per row: a new batch opens when the sum would pass the budget.

    ``start`` is the open batch and its sum, so a stream can be cut anywhere.
    """
    limit = max(1, int(budget))
    number, total = start
    out = []
    for t in tokens:
        if total and total + t > limit:
            number, total = number + 1, 0
        total += t
        out.append(number)
    return out, (number, total)


def _run_map(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """What a run of rows does to each possible sum 0..limit of the batch that is open before it.

    Returns the batches it opens and the sum of the one it leaves open.  A sum above the limit
    behaves like the limit, as every row has at least one token.
    """
    n = len(tokens)
    sums = np.concatenate(([0], np.cumsum(tokens)))
    # first row of the batch behind the one that starts at each row
    behind = np.maximum(np.searchsorted(sums, sums[:-1] + limit, "right") - 1, np.arange(1, n + 1)).tolist()
    opened, left = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = behind[i]
        opened[i] = 1 if j == n else opened[j] + 1
        left[i] = min(int(sums[n] - sums[i]), limit) if j == n else left[j]
    before = np.arange(limit + 1)
    first = np.searchsorted(sums, limit - before, "right") - 1  # row that opens a batch; n: none does
    opens = np.array([*opened, 0])[first]
    sum_after = np.where(first < n, np.array([*left, 0])[first], np.minimum(before + sums[n], limit))
    if n:  # nothing is open: the first row's batch counts as open already
        opens[0], sum_after[0] = opened[0] - 1, left[0]
    return opens.astype(np.int64), sum_after.astype(np.int32)


def _pieces(opens: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A map of ``_run_map`` as rows (first sum, opened, sum after, step of the sum after), one for each stretch.

    Either all sums of a stretch lead to the same, or no batch opens and the sum after grows with the sum before.
    So a run of n rows has about n stretches at most, however large the budget is.
    """
    kind = np.where(np.diff(opens) != 0, 2, np.minimum(np.abs(np.diff(after)), 2))
    kind[np.diff(after) < 0] = 2
    change = np.flatnonzero((kind == 2) | (np.diff(kind, prepend=kind[:1]) != 0) & (np.append(2, kind[:-1]) != 2)) + 1
    low = np.append(0, change)
    long = np.diff(np.append(low, len(opens))) > 1
    step = np.where(long, np.append(kind, 0)[low], 0)
    return np.array([low, opens[low], after[low], step], np.int64)


def _behind(pieces: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Batches opened, sum after, and its step, for sums ``total`` before."""
    low, opens, after, step = pieces
    at = np.searchsorted(low, total, "right") - 1
    return opens[at], after[at] + step[at] * (total - low[at]), step[at]


def _chained(first: np.ndarray, then: np.ndarray, limit: int) -> np.ndarray:
    """The map of two neighbouring stretches of rows, of no more pieces than both have."""
    low, opens, after, step = first
    more, total, grows = _behind(then, after)
    out = [np.array([low, opens + more, total, step * grows])]
    ends = np.append(low[1:], limit + 1)
    for k in np.flatnonzero(step):
        inside = then[:, (then[0] > after[k]) & (then[0] < after[k] + ends[k] - low[k])]
        out.append(inside + np.array([[low[k] - after[k]], [opens[k]], [0], [0]]))
    joined = np.concatenate(out, axis=1)
    joined = joined[:, np.argsort(joined[0])]
    same = (np.diff(joined[1:], axis=1) == 0).all(axis=0) & (joined[3, 1:] == 0)
    return joined[:, np.append(True, ~same)]


def _run_starts(maps: DataFrame, fan: int, limit: int) -> DataFrame:
    """(run, first_batch, first_sum): the open batch and its sum before each run.

    ``fan`` neighbouring maps are chained into one until a single group is left; its starts then
    go down level by level.  A task holds ``fan`` maps, whatever the number of runs.
    """
    last = maps.agg(F.max("run")).first()[0]
    groups = maps.withColumn("grp", F.floor(F.col("run") / fan).cast("bigint"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(lambda a, b: _chained(a, b, limit), _ordered_maps(pdf))
        return pd.DataFrame({"run": [pdf["grp"].iloc[0]], "pieces": [whole.tobytes()]})

    def unfold(pdf: pd.DataFrame) -> pd.DataFrame:
        batch, total = int(pdf["first_batch"].iloc[0]), int(pdf["first_sum"].iloc[0])
        starts = []
        for pieces in _ordered_maps(pdf):
            starts.append((batch, total))
            opened, after, _ = _behind(pieces, np.array([total]))
            batch, total = batch + int(opened[0]), int(after[0])
        runs = sorted(pdf["run"])
        return pd.DataFrame([(r, *s) for r, s in zip(runs, starts)], columns=["run", "first_batch", "first_sum"])

    if last is None or last < fan:
        begun = groups.withColumns({"first_batch": F.lit(0).cast("bigint"), "first_sum": F.lit(0).cast("bigint")})
    else:
        up = cut_lineage(groups.groupBy("grp").applyInPandas(chain, "run long, pieces binary"))
        begun = groups.join(_run_starts(up, fan, limit).withColumnRenamed("run", "grp"), "grp")
    return begun.groupBy("grp").applyInPandas(unfold, "run long, first_batch long, first_sum long")


def _ordered_maps(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64).reshape(4, -1) for x in pdf.sort_values("run")["pieces"]]


def assign_batches(df: DataFrame, row_no: str, tokens: str, budget: int, run_rows: int, fan: int = 64) -> DataFrame:
    """Add ``batch``: greedy batches in the order of ``row_no`` (unique, from 0) over all rows.

    Counts that are null or below 1 count as 1.  ``run_rows`` rows are numbered in one task; it
    does not change the result.  Each run is first reduced to a map of the sums before it (see
    ``_pieces``), so where a batch starts is known without reading all rows in one task.
    """
    limit = max(1, int(budget))
    runs = df.withColumn("_run", F.floor(F.col(row_no) / run_rows).cast("bigint"))

    def counts(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[tokens].fillna(1).clip(lower=1).to_numpy(np.int64)

    def reduce_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = _pieces(*_run_map(counts(pdf.sort_values(row_no)), limit))
        return pd.DataFrame({"run": [pdf["_run"].iloc[0]], "pieces": [pieces.tobytes()]})

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_no)
        start = (int(pdf["_batch"].iloc[0]), int(pdf["_sum"].iloc[0]))
        return pdf.assign(batch=batch_numbers(counts(pdf).tolist(), limit, start)[0])[names]

    narrow = runs.select(row_no, tokens, "_run")
    maps = cut_lineage(narrow.groupBy("_run").applyInPandas(reduce_run, "run long, pieces binary"))
    starts = _run_starts(maps, fan, limit).toDF("_run", "_batch", "_sum")
    schema = df.withColumn("batch", F.lit(0).cast("bigint")).schema
    names = schema.names
    return runs.join(starts, "_run").groupBy("_run").applyInPandas(number, schema)


# --- calling the labeler -----------------------------------------------------------------

def row_batches(work: DataFrame, budget: int, run_rows: int) -> DataFrame:
    """(batch, requests): the rows of (row_no, k, payload, tokens) in greedy batches in row order."""
    numbers = assign_batches(work.select("row_no", "tokens"), "row_no", "tokens", budget, run_rows).select("row_no", "batch")
    request = F.struct("row_no", "k", "payload")
    # a batch has a token a row at least, so its rows are bounded by the budget
    placed = work.join(numbers, "row_no").repartitionByRange("batch")  # grouped and written as they lie
    rows = placed.groupBy("batch").agg(F.sort_array(F.collect_list(request)).alias("rows"))
    numbered = F.transform(
        "rows", lambda r, i: F.struct(i.cast("int").alias("idx"), r["k"].alias("k"), r["payload"].alias("payload"), r["row_no"].alias("row_no"))
    )
    return rows.select("batch", numbered.alias("requests"))


def wave_size(batches: int, cores: int, cfg: LabelConfig) -> tuple[int, int]:
    """Calls of a wave and its tasks.

    With a ``parallelism`` a wave is that many tasks, as no more calls may be in flight.  Else as many calls are in
    flight as there are cores, and a wave of a large job has several tasks a core, of ``calls_per_task`` calls or more:
    results are stored when a task ends, so a job that breaks off still loses its running tasks only.
    """
    tasks = cfg.parallelism or cores
    wave = tasks * cfg.calls_per_task
    if cfg.parallelism or batches <= wave * WAVES:
        return wave, tasks
    wave = -(-batches // WAVES)
    return wave, min(-(-wave // cfg.calls_per_task), tasks * TASKS_PER_CORE)


def run_calls(batches: DataFrame, call: Callable[[list[dict]], str], folder: str, cfg: LabelConfig) -> DataFrame:
    """One call per batch of (batch, requests), dealt out by ranges of ``batch``; returns ASKED_TYPE with the batch.

    ``folder`` keeps the written batches, a claim for every batch before it is asked, and its result
    as soon as the task that asked ends.  A job that starts again with the same folder asks only
    for batches without a result; a batch with a claim but no result may have been asked in vain.
    Batches go in waves (see ``wave_size``), in row order, so that many calls are in flight at once and few are
    lost with a job.  A call that fails costs its batch, not the job.
    """
    spark = batches.sparkSession
    if not exists(spark, f"{folder}/batches/_SUCCESS"):
        ordered = batches.sortWithinPartitions("batch")
        ordered.write.mode("overwrite").options(**STORED).option(MARK_WHOLE, "true").parquet(f"{folder}/batches")
    stored = spark.read.schema(batches.schema).parquet(f"{folder}/batches")
    schema = f"batch bigint, {ASKED_TYPE}"

    def results() -> DataFrame:
        if not exists(spark, f"{folder}/results"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{folder}/results")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for batch, requests in zip(pdf["batch"], pdf["requests"]):
                requests = [dict(r) for r in requests]
                response = error = None
                try:
                    response = call(requests)
                except Exception as e:
                    error = str(e) or type(e).__name__
                yield pd.DataFrame([{"batch": batch, "requests": requests, "response": response, "error": error}])

    last = stored.agg(F.max("batch")).first()[0]
    wave, tasks = wave_size(0 if last is None else last + 1, spark.sparkContext.defaultParallelism, cfg)
    due = {r["wave"]: r["n"] for r in stored.groupBy(F.floor(F.col("batch") / wave).alias("wave")).agg(F.count("*").alias("n")).collect()}
    have = results().groupBy(F.floor(F.col("batch") / wave).alias("wave")).agg(F.count_distinct("batch").alias("n"))
    have = {r["wave"]: r["n"] for r in have.collect()}
    for number in sorted(w for w, n in due.items() if have.get(w, 0) < n):
        inside = F.col("batch").between(number * wave, (number + 1) * wave - 1)
        todo = stored.filter(inside)
        if have.get(number, 0):
            todo = todo.join(results().filter(inside).select("batch"), "batch", "left_anti")
        claim = todo.select("batch", F.lit(spark.sparkContext.applicationId).alias("job"), F.current_timestamp().alias("claimed_at"))
        claim.write.mode("append").parquet(f"{folder}/claims")
        # results of a task become visible when it ends, also if the job does not end
        asked = todo.repartition(tasks).mapInPandas(run, schema)
        asked.write.mode("append").options(**STORED).option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{folder}/results")
    once = results().select("batch", "requests", "response", "error")
    if once.groupBy("batch").count().filter("count > 1").isEmpty():
        return once
    # a task that ran twice left two results of a batch: one of them counts, without an error if there is one
    fields = F.struct(F.col("error").isNotNull().alias("failed"), "response", "error", "requests")
    best = results().groupBy("batch").agg(F.min(fields).alias("r"))
    return best.select("batch", "r.requests", "r.response", "r.error")


def ask(work: DataFrame, labeler: Labeler, cfg: LabelConfig, folder: str, budget: int | None = None) -> DataFrame:
    """Batches of (row_no, k, payload, tokens) in row order, each with the labeler's response or error."""

    def call(requests: list[dict]) -> str:
        return labeler([json.loads(r["payload"]) for r in requests])

    return run_calls(row_batches(work, budget or cfg.token_budget, cfg.run_rows), call, folder, cfg)


def content_folder(rows: DataFrame, folder: str, cfg: LabelConfig) -> str:
    """A folder below ``folder`` named by the content to label: the same input finds its own results again."""
    parts = F.xxhash64("row_no", "k", "payload", F.lit(cfg.version), F.lit(cfg.token_budget)).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(parts), F.lit(0))).first()
    return f"{folder.rstrip('/')}/{n}-{int(total) & ((1 << 64) - 1):016x}"


def answered(asked: DataFrame) -> DataFrame:
    """One row per request: k, payload, row_no, its answer ``item`` (null if none), the call's ``error``.

    A batch row carries all its requests, so pairing needs no shuffle.
    """
    numbers = F.transform("requests", lambda r: r["idx"])
    paired = asked.select(
        "requests", "error", L.reconcile(numbers, L.unwrap_answers(F.col("response"))).alias("pairs")
    )
    by_number = F.map_from_arrays(
        F.transform("pairs", lambda p: p["idx"]), F.transform("pairs", lambda p: p["item"])
    )
    together = X.bind(
        by_number,
        lambda found: F.transform(
            "requests",
            lambda r: F.struct(
                r["k"].alias("k"), r["payload"].alias("payload"), r["row_no"].alias("row_no"),
                F.try_element_at(found, r["idx"]).alias("item"),
            ),
        ),
    )
    rows = paired.select(together.alias("rows"), "error").select(F.explode("rows").alias("r"), "error")
    return rows.select("r.k", "r.payload", "r.row_no", "r.item", "error")


def with_label(rows: DataFrame) -> DataFrame:
    """Coerced ``label`` (null without an answer) and the contract rules it breaks."""
    dialog = F.coalesce(F.get_json_object("payload", "$.full_dialog_text"), F.lit(""))
    answer = L.parse_answer(F.col("item"))
    labelled = rows.withColumn("_answer", answer).withColumn(
        "label", F.when(F.col("_answer").isNotNull(), L.coerce_answer(F.col("_answer"), dialog))
    )
    return labelled.drop("_answer").withColumn(
        "violations", F.when(F.col("label").isNotNull(), L.violations(F.col("label")))
    )


def _accepted(rows: DataFrame) -> Column:
    return F.col("label").isNotNull() & (F.size("violations") == 0)


def _judged(rows: DataFrame) -> DataFrame:
    """``with_label``, written once; a text is kept in the label that is accepted, else in the payload, not in both."""
    judged, good = with_label(rows), F.coalesce(_accepted(rows), F.lit(False))
    return cut_lineage(judged.withColumns({"payload": F.when(~good, F.col("payload")), "label": F.when(good, F.col("label"))}))


def label_payloads(
    payloads: DataFrame, labeler: Labeler, repair: Callable[[str], str] | None = None, cfg: LabelConfig = LabelConfig(),
    folder: str | None = None,
) -> DataFrame:
    """Label every (k, payload): batches, retries of what is missing, single calls, repair, fallback.

    Batches form in the order of ``row_no`` if there is such a column (unique), else of ``k``.  Every
    call is claimed before it is made and stored when its task ends (see ``run_calls``).  With a
    ``folder`` a job that broke off goes on where it was when it is started again with the same payloads; without
    one the calls are kept in the shared checkpoint folder for this job alone, until their answers are written.
    """
    spark, private = payloads.sparkSession, folder is None
    columns = ["row_no", "k", "payload", X.estimate_tokens(F.col("payload")).alias("tokens")]
    if "row_no" in payloads.columns:
        rows = cut_lineage(payloads.select(*columns))
    else:
        rows = number_in_order(payloads.select("k", "payload"), ["k"], "row_no").select(*columns)  # written there
    if private:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/labels-{uuid.uuid4().hex}"
    else:
        folder = content_folder(rows, folder, cfg)
    pending, done, single = rows, [], []
    for attempt in range(cfg.max_attempts):
        asked = ask(pending, labeler, cfg, f"{folder}/attempt-{attempt}")
        if private:
            delete(spark, f"{folder}/attempt-{attempt}/batches")  # the results hold the requests
        rows = _judged(answered(asked))
        if private:
            delete(spark, f"{folder}/attempt-{attempt}")
        done.append(rows.filter(_accepted(rows)).select("k", "label", F.lit(None).cast("string").alias("error")))
        failed = F.col("error").isNotNull() | (F.col("item").isNotNull() & ~F.coalesce(_accepted(rows), F.lit(False)))
        single.append(rows.filter(failed).select("row_no", "k", "payload"))
        pending = rows.filter(F.col("error").isNull() & F.col("item").isNull()).select(
            "row_no", "k", "payload", X.estimate_tokens(F.col("payload")).alias("tokens")
        )
        if pending.isEmpty():
            break
    single.append(pending.select("row_no", "k", "payload"))
    rest = union_all(single)
    if not rest.isEmpty():
        done.append(label_singly(rest, labeler, repair, cfg, folder))
    if private:
        delete(spark, folder)
    return union_all(done)


def label_singly(
    payloads: DataFrame, labeler: Labeler, repair: Callable[[str], str] | None, cfg: LabelConfig, folder: str
) -> DataFrame:
    """One call per row, one repair call for an invalid answer, else the fallback record."""
    one = payloads.withColumn("tokens", F.lit(1))
    rows = _judged(_alone(ask(one, labeler, cfg, f"{folder}/single", budget=1)))
    good = rows.filter(_accepted(rows)).select("k", "label", F.lit(None).cast("string").alias("error"))
    bad = rows.filter(~F.coalesce(_accepted(rows), F.lit(False)))
    reason = F.coalesce(
        F.col("error"), F.concat(F.lit("invalid answer: "), F.array_join("violations", ",")), F.lit("no answer")
    )
    if repair is None:
        return good.unionByName(_with_fallback(bad.withColumn("error", reason)))
    called = bad.filter(F.col("error").isNull())
    fixed = _judged(_repair(called, repair, cfg, f"{folder}/repair"))
    return union_all([
        good,
        fixed.filter(_accepted(fixed)).select("k", "label", F.lit(None).cast("string").alias("error")),
        _with_fallback(fixed.filter(~F.coalesce(_accepted(fixed), F.lit(False))).withColumn("error", reason)),
        _with_fallback(bad.filter(F.col("error").isNotNull())),
    ])


def _alone(asked: DataFrame) -> DataFrame:
    """Answers to one-row calls: an object, or the first object of a list."""
    first = F.get(L.unwrap_answers(F.col("response")), F.lit(0))["item"]
    whole = F.when(F.rlike("response", F.lit(r"(?s)^\s*\{")), F.col("response"))
    one = F.get("requests", F.lit(0))
    return asked.select(
        one["k"].alias("k"), one["payload"].alias("payload"), one["row_no"].alias("row_no"),
        F.coalesce(first, whole, F.col("response")).alias("item"), "error",
    )


def _repair(rows: DataFrame, repair: Callable[[str], str], cfg: LabelConfig, folder: str) -> DataFrame:
    """Each row's invalid ``item`` after one repair call."""
    text = F.coalesce("item", F.lit(""))
    request = F.struct(F.lit(0).alias("idx"), "k", text.alias("payload"), "row_no")
    batches = rows.select(F.col("row_no").alias("batch"), F.array(request).alias("requests")).repartitionByRange("batch")
    calls = run_calls(batches, lambda requests: repair(requests[0]["payload"]), folder, cfg)
    fixed = calls.select(F.col("batch").alias("row_no"), F.col("response").alias("item"), "error")
    return rows.select("k", "payload", "row_no").join(fixed, "row_no")


def _with_fallback(rows: DataFrame) -> DataFrame:
    dialog = F.coalesce(F.get_json_object("payload", "$.full_dialog_text"), F.lit(""))
    product = F.get_json_object("payload", "$.product")
    return rows.select("k", L.fallback_label(dialog, product, F.col("error")).alias("label"), "error")


# --- cache -----------------------------------------------------------------------------

def latest_labels(writes: DataFrame, key: str = "k", value: str = "v", order=("created_at", "seq")) -> DataFrame:
    """Last write per key.  An aggregate, so writes to a hot key combine before the shuffle."""
    return writes.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def cache_hits(rows: DataFrame, cache: DataFrame) -> DataFrame:
    return rows.join(cache, "k")


def cache_misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct payloads without a cached label, each to be labelled once."""
    return distinct_payloads(rows.join(cache.select("k"), "k", "left_anti"))


def distinct_payloads(rows: DataFrame, place: Sequence[str] = ()) -> DataFrame:
    """(k, payload) once per key; with ``place`` also ``row_no``, the dense order of the keys' first places."""
    first = [F.min(F.struct(*place)).alias("_place")] if place else []
    one = rows.groupBy("k").agg(F.first("payload").alias("payload"), *first)
    return number_in_order(one, ["_place", "k"], "row_no").drop("_place") if place else one


def attach_labels(rows: DataFrame, labels: DataFrame, product: Column | None = None) -> DataFrame:
    """Labels back onto rows by key; a row without one gets the fallback record."""
    dialog = F.coalesce(F.get_json_object("payload", "$.full_dialog_text"), F.lit(""))
    area = F.get_json_object("payload", "$.product") if product is None else product
    gap = L.fallback_label(dialog, area, F.lit("empty llm row"))
    return rows.join(labels, "k", "left").withColumn("label", F.coalesce("label", gap))
