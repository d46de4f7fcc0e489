import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from trendloom.operators.features import VectorizerConfig
from trendloom.operators.models import TrainConfig
from trendloom.operators.novelty import NoveltyConfig
from trendloom.sources.tickets import DropConfig
from trendloom.operators import metrics, models
from trendloom.plans import prepare as prepare_plan
from trendloom.plans import reports, score, train
from trendloom.sources.taxonomy import Taxonomy

BAD = "CLIENT: Терминал списал сумму дважды, не работает возврат, это ошибка.\nOPERATOR: Уточню у коллег"
ASK = "CLIENT: Где посмотреть лимиты по новой карте?\nOPERATOR: В разделе настроек"
QUICK = TrainConfig(vectorizer=VectorizerConfig(min_df=1, max_df=1.0, char_ngram=(3, 3)), complaint_iterations=15,
                    category_iterations=15, category_classifier="logreg")


MONTHS = {"2024-03": 20, "2024-04": 16, "2024-05": 12}  # rows; one in four is a complaint


def drops(tmp_path):
    for month, n in MONTHS.items():
        year, number = month.split("-")
        lines = []
        for i in range(n):
            lines.append(json.dumps({
                "dialog_text": (ASK, BAD, ASK, ASK)[i % 4], "created_at": f"{1 + i:02d}.{number}.{year} {8 + i % 10:02d}:{i:02d}",
                "product": ("cards", "app")[i % 2], "channel": "phone", "note": None,
            }, ensure_ascii=False))
        (tmp_path / f"{month}.json").write_text("\n".join(lines), encoding="utf-8")
    return str(tmp_path)


TIMES = "%d.%m.%Y %H:%M"


def test_months_from_drops_to_comparison(spark, tmp_path):
    folder, out = drops(tmp_path), str(tmp_path / "out")
    cfg = DropConfig(folder, "2024-0[34].json", file_format="json", datetime_format=TIMES)
    pilot = prepare_plan.prepare_tickets(spark, cfg, out, pilot=True, limit=10, date_from="2024-03-01", date_to="2024-03-31")
    assert pilot.count() == 10
    prepared = prepare_plan.prepare_tickets(spark, cfg, out)
    assert prepared.count() == 36 and prepared.filter("is_complaint_llm").count() == 9
    assert prepared.filter("llm_error <> ''").isEmpty()

    trend = reports.trend(prepared)["monthly"].collect()
    assert [(r["month"], r["n"], r["complaint_rate"]) for r in trend] == [("2024-03", 20, 0.25), ("2024-04", 16, 0.25)]

    result = train.train(spark, prepared, cfg=QUICK, out=out)
    values = {(r["model"], r["label"], r["metric"]): r["value"] for r in result.metrics.collect()}
    assert values["complaint", "", "f1"] == 1.0 and values["category", "", "f1"] == 1.0
    # The rule labeler's subcategory is not listed under its category.
    assert values["subcategory", "", "unknown_share"] == 1.0 and result.cascade.subcategory is None

    loaded = models.Cascade.load(spark, result.path, QUICK.vectorizer)
    new = DropConfig(folder, "2024-05.json", file_format="json", datetime_format=TIMES)
    scored = score.infer_month(spark, new, "2024-05", loaded, out, cfg=QUICK)
    rows = scored.collect()
    assert len(rows) == 12 and sorted(r["row_id"] for r in rows)[0] == "new_0"
    assert all(r["is_complaint_pred"] == (r["raw_dialog"] == BAD) for r in rows)
    assert {r["category_pred"] for r in rows} == {"TECHNICAL", "OTHER"} and {r["subcategory_pred"] for r in rows} == {"NOT_COMPLAINT"}
    again = result.cascade.score(result.cascade.vectorizer.transform(scored.select("row_id", "text_clean"), "text_clean"), 0.5)
    assert {r["row_id"]: round(r["complaint_score"], 9) for r in again.collect()} == {
        r["row_id"]: round(r["complaint_score"], 9) for r in rows}

    novelty = NoveltyConfig(svd_components=3, kmeans_k=2)
    fresh, report = score.compare_months(prepared, scored, loaded, "2024-03..2024-04", novelty, QUICK, out)
    assert fresh.count() == 3 and fresh.filter("is_novel").isEmpty()
    deltas = report["share_deltas"].collect()
    assert [(r["category"], r["delta_pp"]) for r in deltas] == [("TECHNICAL", 0.0)]
    empty, _ = score.compare_months(prepared, scored, loaded, "2020-01..2020-02", novelty, QUICK)
    assert empty.isEmpty() and {"novelty_score", "is_novel", "cluster_id"} <= set(empty.columns)


def test_labels_come_from_a_function_once_per_content(spark, tmp_path):
    folder, out, cache = drops(tmp_path), str(tmp_path / "out"), str(tmp_path / "cache")
    cfg = DropConfig(folder, "2024-05.json", file_format="json", datetime_format=TIMES, signal_columns=("channel", "product"))
    log = tmp_path / "calls"
    log.mkdir()

    def labeler(batch, log=str(log)):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(batch)))
        return json.dumps([{"_batch_index": i, "category": "BILLING", "product": p["product"]} for i, p in enumerate(batch)])

    first = prepare_plan.prepare_tickets(spark, cfg, out, labeler=labeler, cache=cache)
    asked = sum(int(p.read_text()) for p in log.iterdir())
    assert asked == 3  # twelve tickets, three different contents
    assert first.count() == 12 and first.filter("complaint_category_llm = 'BILLING'").count() == 12
    assert first.filter("product_area_llm = 'app'").count() == 6
    second = prepare_plan.prepare_tickets(spark, cfg, out, labeler=labeler, cache=cache)
    assert second.count() == 12 and sum(int(p.read_text()) for p in log.iterdir()) == asked


def test_empty_range_gives_an_empty_typed_table(spark, tmp_path):
    cfg = DropConfig(drops(tmp_path), "*.json", file_format="json", datetime_format=TIMES)
    none = prepare_plan.prepare_tickets(spark, cfg, str(tmp_path / "out"), pilot=True, limit=5, date_from="2030-01-01")
    assert none.isEmpty() and "is_complaint_llm" in none.columns
    totals = reports.pilot(none, Taxonomy.default())["totals"].first()
    assert (totals["rows_total"], totals["complaint_share"]) == (0, 0.0)


def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6)) + np.repeat(np.arange(3), 40)[:, None]
    rows = [(f"r{i}", [float(v) for v in x[i]], float(i >= 70), f"c{i // 40}") for i in range(120)]
    df = spark.createDataFrame(rows, "row_id string, v array<double>, y double, label string")
    return df.withColumn("features", array_to_vector("v")), x


def test_logistic_optimum_zeroes_the_gradient(spark, monkeypatch):
    monkeypatch.setattr(models, "TOLERANCE", 1e-10)
    df, x = points(spark)
    model = models.fit_complaint(df, TrainConfig())
    w, b = model.model.coefficients.toArray(), model.model.intercept
    y = np.array([r["y"] for r in df.orderBy(F.substring("row_id", 2, 9).cast("int")).collect()])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + x.T @ (weight * (p - y))).max() < 1e-3 and abs((weight * (p - y)).sum()) < 1e-3


def test_equal_rows_are_counted_and_keep_the_optimum(spark, monkeypatch):
    monkeypatch.setattr(models, "TOLERANCE", 1e-10)
    sizes, packed = [], models._packed
    monkeypatch.setattr(models, "_packed", lambda df, rows: (sizes.append(df.count()), packed(df, rows))[1])
    df, x = points(spark)
    many = df.crossJoin(spark.range(10)).withColumn("row_id", F.concat_ws("-", "row_id", "id")).drop("id")
    model = models.fit_complaint(many, TrainConfig())
    w, b = model.model.coefficients.toArray(), model.model.intercept
    y = np.array([r["y"] for r in df.orderBy(F.substring("row_id", 2, 9).cast("int")).collect()])
    weight = 10 * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + x.T @ (weight * (p - y))).max() < 1e-2 and abs((weight * (p - y)).sum()) < 1e-2
    assert sizes == [120]


def test_calibrated_and_one_class_models(spark):
    df, _ = points(spark)
    model = models.fit_complaint(df, TrainConfig(complaint_classifier="linearsvc"))
    scored = model.score(df, "s").select("y", "s", (F.col("s") >= 0.5).alias("p"), (F.col("y") == 1).alias("t"))
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    assert 0 <= low < high <= 1 and metrics.binary_f1(scored, "t", "p").first()[0] > 0.7
    constant = models.fit_category(df.withColumn("label", F.lit("ONE")), "label", TrainConfig())
    assert constant.model is None and {r["g"] for r in constant.predict(df, "g").collect()} == {"ONE"}
    assert models.fit_subcategory(df.withColumn("label", F.lit("")), "label", TrainConfig()) is None


def test_tfidf_matches_plain_statement(spark):
    from trendloom.operators.features import Vectorizer

    texts = ["aa bb aa", "bb cc", "", "cc cc dd aa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    v = Vectorizer.fit(df, "t", VectorizerConfig(word_ngram=(1, 1), min_df=1, max_df=1.0))
    assert v.word.terms == ["aa", "bb", "cc", "dd"]
    rows = v.word.transform(df.withColumn("w", F.split("t", " ")), "w", "x").select("i", vector_to_array("x").alias("x")).orderBy("i").collect()
    tf = np.array([[t.split().count(w) for w in v.word.terms] for t in texts], dtype=float)
    idf = np.log((1 + 4) / (1 + (tf > 0).sum(0))) + 1
    want = np.where(tf > 0, 1 + np.log(np.where(tf > 0, tf, 1)), 0) * idf
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.array([r["x"] for r in rows]), want / np.where(norm > 0, norm, 1))


@pytest.mark.parametrize("truth,guess,f1", [([], [], 0.0), (["a", "a", "b"], ["a", "b", "c"], (2 / 3 + 0 + 0) / 3)])
def test_macro_f1(spark, truth, guess, f1):
    df = spark.createDataFrame(list(zip(truth, guess)), "y string, p string")
    assert metrics.macro_f1(df, "y", "p").first()[0] == pytest.approx(f1)


def test_folds_hold_every_class(spark):
    rows = [(f"r{i}", "rare" if i < 5 else "common" if i < 40 else None) for i in range(53)]
    df = spark.createDataFrame(rows, "row_id string, y string").repartition(4)
    folds = models.with_folds(df, "y", "row_id", 5)
    assert folds.columns == ["row_id", "y", "_fold"] and folds.count() == 53
    sizes = {(r["y"], r["_fold"]): r["count"] for r in folds.groupBy("y", "_fold").count().collect()}
    assert all(sizes["rare", f] == 1 and sizes["common", f] == 7 and sizes[None, f] in (2, 3) for f in range(5))
    again = {r["row_id"]: r["_fold"] for r in models.with_folds(df.coalesce(1), "y", "row_id", 5).collect()}
    assert again == {r["row_id"]: r["_fold"] for r in folds.collect()}


def test_the_cascade_scores_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def count(x):
        seen.add(1)
        return x

    class Given:
        def score(self, df, name):
            return df.withColumn(name, count("y"))

    df, _ = points(spark)
    one = models.fit_category(df.withColumn("label", F.lit("ONE")), "label", TrainConfig())
    scored = models.Cascade(None, Given(), one, None).score(df, 0.5)
    assert scored.filter("category_pred = 'ONE'").count() == 50 and scored.filter("category_pred = 'OTHER'").count() == 70
    assert seen.value == 120


def test_a_vanished_category_shows_its_fall(spark):
    from trendloom.operators import trends

    df = spark.createDataFrame([("2025-01", "a", 5), ("2025-01", "b", 7), ("2025-03", "a", 4)], "month string, cat string, n long")
    got = {(r["month"], r["cat"]): (r["n"], r["previous_n"], r["n_change"]) for r in trends.month_over_month(df, "n", "cat", 0).collect()}
    assert got == {
        ("2025-01", "a"): (5, 0, 5), ("2025-01", "b"): (7, 0, 7), ("2025-02", "a"): (0, 5, -5), ("2025-02", "b"): (0, 7, -7),
        ("2025-03", "a"): (4, 0, 4), ("2025-03", "b"): (0, 0, 0),
    }
    assert trends.month_over_month(df.limit(0), "n", "cat", 0).collect() == []
