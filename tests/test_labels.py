import json
import os
import sys
from functools import reduce

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trendloom.operators.labelling import LabelConfig
from trendloom.functions import labels as L
from trendloom.operators import labelling, ordering
from trendloom.sources import tables

# Labelers defined here run in workers that cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def payloads(spark, texts):
    rows = [(f"k{i}", json.dumps({"full_dialog_text": t, "product": "app"}, ensure_ascii=False)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "k string, payload string").coalesce(1)


def answer(**extra):
    return {"category": "OTHER", "is_complaint": False, "keywords": ["а", "б", "в"], "confidence": 0.9, **extra}


def test_batches_follow_the_budget(spark):
    assert labelling.batch_numbers([10, 20, 15], 30)[0] == [0, 0, 1]
    assert labelling.batch_numbers([50, 1, 1], 30)[0] == [0, 1, 1]


def test_batches_do_not_depend_on_runs(spark):
    tokens = [10, 20, 15, 30, 1, 1, 1, 90, 2, 28, 31, 30, 5, None, 0, 29, 7, 7, 7, 7, 7, 7, 40, 3]
    counted = [max(t or 1, 1) for t in tokens]
    df = spark.createDataFrame(list(enumerate(tokens)), "n long, tokens int")
    for budget, run_rows, fan in ((30, 3, 2), (30, 1, 3), (30, 100, 2), (1, 4, 64)):
        out = labelling.assign_batches(df, "n", "tokens", budget, run_rows, fan).orderBy("n").collect()
        assert [r["batch"] for r in out] == labelling.batch_numbers(counted, budget)[0]
    none = labelling.assign_batches(df.limit(0), "n", "tokens", 30, 3)
    assert none.columns == ["n", "tokens", "batch"] and none.count() == 0


def test_run_maps_chain_like_rows():
    rng = np.random.default_rng(3)
    for _ in range(200):
        limit = int(rng.integers(1, 12))
        rows = rng.integers(1, 15, int(rng.integers(0, 12)))
        opens, after = labelling._run_map(rows, limit)
        for start in range(limit + 1):
            number, total = labelling.batch_numbers(rows.tolist(), limit, (0, start))[1]
            assert (opens[start], after[start]) == (number, min(total, limit))


def test_short_runs_have_short_maps_that_chain():
    rng = np.random.default_rng(4)
    for _ in range(300):
        limit = int(rng.integers(1, 40))
        runs = [rng.integers(1, 15, int(rng.integers(1, 6))) for _ in range(4)]
        whole = labelling._run_map(np.concatenate(runs), limit)
        pieces = [labelling._pieces(*labelling._run_map(r, limit)) for r in runs]
        chained = reduce(lambda a, b: labelling._chained(a, b, limit), pieces)
        for start in range(limit + 1):
            opened, after, _ = labelling._behind(chained, np.array([start]))
            assert (opened[0], after[0]) == (whole[0][start], whole[1][start])
    tokens = rng.integers(1, 900, 7)
    assert labelling._pieces(*labelling._run_map(tokens, 12_000)).nbytes < 32 * 12 < 144_000  # dense: 12 bytes for each sum


def test_rule_labels(spark):
    df = spark.createDataFrame([("У меня ОШИБКА по кредиту",), ("Подскажите график",)], "t string")
    rows = [r["l"] for r in df.select(L.rule_label(F.col("t"), F.lit("app")).alias("l")).collect()]
    assert rows[0]["is_complaint"] and rows[0]["loan_product"] == "CONSUMER_LOAN" and rows[0]["complaint_category"] == "TECHNICAL"
    assert not rows[1]["is_complaint"] and rows[1]["keywords"] == ["вопрос", "инфо", "уточнение"] and rows[1]["confidence"] == 0.8


def test_answers_without_index_pair_by_position(spark):
    text = json.dumps([answer(confidence=0.9), answer(confidence=0.8)], ensure_ascii=False)
    df = spark.createDataFrame([(text,)], "r string")
    pairs = df.select(L.reconcile(F.array(F.lit(0), F.lit(1)), L.unwrap_answers(F.col("r"))).alias("p")).first()["p"]
    assert [(p["idx"], json.loads(p["item"])["confidence"]) for p in pairs] == [(0, 0.9), (1, 0.8)]


def test_unwrap_skips_non_objects_and_bad_json(spark):
    values = ['{"items": [], "results": [1, "x", {"a": 1}]}', "not json", '{"items": {"a": 1}}', "[]", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, r string")
    got = [len(r["u"]) for r in df.select("i", L.unwrap_answers(F.col("r")).alias("u")).orderBy("i").collect()]
    assert got == [1, 0, 0, 0, 0]


def test_contract_rejects_forbidden_keyword(spark):
    item = json.dumps(answer(keywords=["Client", "a", "b"]))
    row = spark.createDataFrame([(item,)], "i string").select(
        L.violations(L.coerce_answer(L.parse_answer(F.col("i")), F.lit("text"))).alias("v")).first()
    assert row["v"] == ["forbidden_keyword"]


def test_missing_rows_are_asked_again_and_one_bad_row_is_isolated(spark):
    def labeler(batch):
        if any("boom" in p["full_dialog_text"] for p in batch):
            raise RuntimeError("refused")
        kept = batch[:-1] if len(batch) > 1 else batch
        return json.dumps([answer(_batch_index=i, summary=p["full_dialog_text"]) for i, p in enumerate(kept)])

    texts = [f"msg {i}" for i in range(6)] + ["boom"]
    out = {r["k"]: r for r in labelling.label_payloads(payloads(spark, texts), labeler).collect()}
    assert len(out) == 7
    assert all(out[f"k{i}"]["label"]["short_summary"] == f"msg {i}" for i in range(6))
    assert out["k6"]["label"]["notes"] == "LLM_ERROR: refused" and out["k6"]["error"] == "refused"


def test_repair_then_fallback(spark):
    def labeler(batch):
        return json.dumps([answer(keywords=["agent", "x", "y"], summary=p["full_dialog_text"]) for p in batch])

    def repair(text):
        fixed = json.loads(text)
        if fixed["summary"] != "hopeless":
            fixed["keywords"] = ["ok", "x", "y"]
        return json.dumps(fixed)

    out = {r["k"]: r["label"] for r in labelling.label_payloads(payloads(spark, ["fine", "hopeless"]), labeler, repair).collect()}
    assert out["k0"]["keywords"] == ["ok", "x", "y"] and out["k0"]["notes"] is None
    assert out["k1"]["notes"].startswith("LLM_ERROR: invalid answer")


def counting_labeler(folder, stop_at=None):
    """Answers everything and leaves a file for each call; the worker dies at call ``stop_at``."""

    def labeler(batch):
        import os
        import uuid

        if stop_at is not None and len(os.listdir(folder)) >= stop_at:
            os._exit(1)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(" ".join(p["full_dialog_text"] for p in batch))
        return json.dumps([answer(_batch_index=i, summary=p["full_dialog_text"]) for i, p in enumerate(batch)])

    return labeler


def test_the_number_of_waves_does_not_grow_with_the_job():
    usual = LabelConfig()
    assert labelling.wave_size(100, 12, usual) == (192, 12)
    for batches in (10_000, 768_000):
        wave, tasks = labelling.wave_size(batches, 12, usual)
        assert -(-batches // wave) <= 32 and tasks <= 96 and wave / tasks >= usual.calls_per_task - 1
    assert labelling.wave_size(768_000, 12, LabelConfig(parallelism=5)) == (80, 5)  # never more calls in flight than asked for


def test_a_job_that_broke_off_asks_only_for_batches_without_a_result(spark, tmp_path):
    log, folder = tmp_path / "calls", str(tmp_path / "job")
    log.mkdir()
    texts = [f"m{i:02d}" for i in range(24)]
    rows = payloads(spark, texts).withColumn("row_no", F.substring("k", 2, 9).cast("bigint"))
    cost = len(json.dumps({"full_dialog_text": "m00", "product": "app"})) // 4
    cfg = LabelConfig(token_budget=2 * cost, parallelism=2, calls_per_task=2)  # twelve batches of two, in waves of four
    with pytest.raises(Exception):
        labelling.label_payloads(rows, counting_labeler(str(log), stop_at=7), None, cfg, folder)
    first = {p.read_text() for p in log.iterdir()}
    kept = spark.read.parquet(f"{folder}/*/attempt-0/results")
    stored = {" ".join(json.loads(q["payload"])["full_dialog_text"] for q in r["requests"]) for r in kept.collect()}
    claimed = spark.read.parquet(f"{folder}/*/attempt-0/claims").count()
    assert 4 <= len(stored) <= len(first) == 7 and claimed == 8
    out = labelling.label_payloads(rows, counting_labeler(str(log)), None, cfg, folder).collect()
    assert {r["label"]["short_summary"] for r in out} == set(texts) and len(out) == 24
    calls = [p.read_text() for p in log.iterdir()]
    assert len(calls) == 7 + 12 - len(stored)  # stored batches were not asked for again
    assert set(calls) == {f"m{i:02d} m{i + 1:02d}" for i in range(0, 24, 2)}  # batches of neighbouring rows
    labelling.label_payloads(rows, counting_labeler(str(log), stop_at=0), None, cfg, folder).collect()
    assert len(list(log.iterdir())) == len(calls)
    other = rows.withColumn("payload", F.replace("payload", F.lit("m0"), F.lit("n0")))
    labelling.label_payloads(other, counting_labeler(str(log)), None, cfg, folder).collect()
    assert len(list(log.iterdir())) == len(calls) + 12  # other content, other calls


@pytest.mark.parametrize("parallelism", [1, 3])
def test_batches_follow_rows_and_not_partitions(spark, tmp_path, parallelism):
    """Token counts 10, 20, 15 with a budget of 30 are two calls, whatever the partitions."""
    tokens = [10, 20, 15]
    rows = spark.createDataFrame([(i, f"k{i}", json.dumps({"full_dialog_text": str(i)}), t) for i, t in enumerate(tokens)],
                                 "row_no long, k string, payload string, tokens int").repartition(3)
    cfg = LabelConfig(parallelism=parallelism)
    asked = labelling.ask(rows, lambda b: json.dumps([answer() for _ in b]), cfg, str(tmp_path / "a"), budget=30)
    assert [[q["row_no"] for q in r["requests"]] for r in asked.orderBy("batch").collect()] == [[0, 1], [2]]


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)], "n long, t string").repartition(7)
    out = ordering.number_in_order(df, ["n", "t"]).collect()
    assert sorted(r["row_no"] for r in out) == list(range(50)) and all(r["row_no"] == r["n"] for r in out)
    assert ordering.number_in_order(df.limit(0), ["n"]).collect() == []


def test_cache_is_read_by_folder_and_compacted(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert tables.compact_cache(spark, path) == 0
    keys = spark.range(600).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").cast("string").alias("t"))
    labelled = keys.select("k", L.rule_label(F.col("t"), F.lit(None)).alias("label"))
    assert tables.probe_cache(keys, path).isEmpty()
    for severity in ("low", "medium", "high"):
        tables.append_cache(labelled.withColumn("label", F.col("label").withField("severity", F.lit(severity))), path)
    asked = keys.limit(2)
    found = tables.probe_cache(asked, path)
    assert [r["label"]["severity"] for r in found.collect()] == ["high", "high"]
    buckets = [r[0] for r in asked.select(tables.cache_bucket(F.col("k"))).collect()]
    read = tables.cache_rows(spark, path, buckets).count()
    assert 6 <= read < 60  # of 1,800 rows
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().toString()
    before = {r["k"]: r["label"] for r in tables.read_cache(spark, path).collect()}
    assert tables.compact_cache(spark, path, files_per_bucket=2) > 200
    assert {r["k"]: r["label"] for r in tables.read_cache(spark, path).collect()} == before
    assert tables.cache_rows(spark, path).count() == 600
    assert tables.compact_cache(spark, path, files_per_bucket=2) == 0


def test_compaction_sends_the_labels_once(spark, tmp_path):
    """The rows go to the task that writes their folder; nothing is written beside the cache."""
    from trendloom.session import checkpoint_dir

    path, scratch = str(tmp_path / "cache"), checkpoint_dir(spark)
    label = F.lit(None).cast(L.LABEL_TYPE).alias("label")
    for n in range(3):
        tables.append_cache(spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), label), path)
    before = sorted(os.listdir(scratch))
    assert tables.compact_cache(spark, path, files_per_bucket=1) > 100
    assert sorted(os.listdir(scratch)) == before
    assert tables.cache_rows(spark, path).count() == 300
    assert tables.compact_cache(spark, path, files_per_bucket=1) == 0


def test_cache_keeps_the_last_write(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert tables.read_cache(spark, path).isEmpty()
    labelled = spark.createDataFrame([("k1", "a")], "k string, t string").select(
        "k", L.rule_label(F.col("t"), F.lit(None)).alias("label"))
    tables.append_cache(labelled, path)
    tables.append_cache(labelled.withColumn("label", F.col("label").withField("severity", F.lit("high"))), path)
    rows = tables.read_cache(spark, path).collect()
    assert len(rows) == 1 and rows[0]["label"]["severity"] == "high"


def test_empty_input(spark):
    none = payloads(spark, ["x"]).filter("false")
    assert labelling.label_payloads(none, lambda b: "[]", cfg=LabelConfig()).count() == 0


def test_an_empty_dialog_is_labelled_like_any_other(spark):
    out = labelling.label_payloads(payloads(spark, ["", "text"]), lambda b: json.dumps([answer(_batch_index=i) for i, _ in enumerate(b)])).collect()
    assert {(r["k"], r["label"]["short_summary"], r["label"]["confidence"], r["error"]) for r in out} == {("k0", "", 0.9, None), ("k1", "text", 0.9, None)}


def test_labels_of_null_and_empty_columns(spark, tmp_path):
    from trendloom.catalog.label_queries import labels_after_repair, labels_from_function

    rows = [(1, "", "src1", "en"), (2, None, "src1", "en"), (3, "schü", None, "de"), (4, "schü", "src1", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (labels_from_function, labels_after_repair):
        out = {r["k"]: r for r in query(spark, str(tmp_path)).collect()}
        assert [(out[k]["short_summary"], out[k]["is_complaint"], out[k]["confidence"], out[k]["notes"]) for k in "1234"] == [
            ("", False, 0.75, None), ("", False, 0.75, None), ("schü", True, 0.75, None), ("schü", True, 0.75, None)]


def test_a_job_without_a_folder_leaves_a_text_once(spark, tmp_path, monkeypatch):
    """Calls of a private job go when their answers are written, and an accepted text is in the label alone."""
    for module in (labelling, sys.modules["trendloom.session"]):
        monkeypatch.setattr(module, "checkpoint_dir", lambda _: str(tmp_path))

    def labeler(batch):
        if any("boom" in p["full_dialog_text"] for p in batch):
            raise RuntimeError("refused")
        return json.dumps([answer(_batch_index=i) for i, _ in enumerate(batch)])

    out = labelling.label_payloads(payloads(spark, [f"m{i}" for i in range(4)] + ["boom"]), labeler).collect()
    assert len(out) == 5 and sum(r["error"] == "refused" for r in out) == 1
    assert not [d for d, _, files in os.walk(tmp_path) if "/labels-" in d and files]
    tables_left = [spark.read.parquet(str(p)) for p in tmp_path.iterdir() if p.name.startswith("trendloom-")]
    judged = [x for x in tables_left if "violations" in x.columns]
    assert judged and all((r["payload"] is None) != (r["label"] is None) for x in judged for r in x.collect())
