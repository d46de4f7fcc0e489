import json

import pytest
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.functions.text import DialogConfig
from trendloom.operators.models import TrainConfig
from trendloom.sources.tickets import DropConfig
from trendloom.operators import joins, prepare
from trendloom.plans import score
from trendloom.sources import tables, versions
from trendloom.sources import tickets as src
from trendloom.sources.taxonomy import Taxonomy, deny_tokens, load_tokens, token_union


def drop(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")


def test_csv_drops_with_different_headers(spark, tmp_path):
    drop(tmp_path, "b.csv", "created_at,dialog_text,subject\n2025-02-01 10:00:00,CLIENT: вопрос,s\n")
    drop(tmp_path, "a.csv", "dialog_text,created_at\nCLIENT: раз,2025-01-09 12:55:29\nCLIENT: два,2025-01-10 00:00:00\n")
    cfg = DropConfig(str(tmp_path), "*.csv", file_format="csv", datetime_format="%Y-%m-%d %H:%M:%S")
    rows = {r["row_id"]: r for r in src.read_tickets(spark, cfg).collect()}
    assert [rows[f"row_{i}"]["dialog_text"] for i in range(3)] == ["CLIENT: раз", "CLIENT: два", "CLIENT: вопрос"]
    assert rows["row_0"]["month"] == "2025-01" and rows["row_2"]["source_file"] == "b.csv"
    assert rows["row_0"]["subject"] is None
    listed = DropConfig(str(tmp_path), file_names=("b.csv", "gone.csv"), file_format="csv")
    assert [r["file_name"] for r in src.discover_drops(spark, listed).collect()] == ["b.csv"]


def test_bad_times_and_missing_input_are_reported(spark, tmp_path):
    drop(tmp_path, "x.json", json.dumps({"created_at": "soon", "dialog_text": "a"}) + "\n")
    cfg = DropConfig(str(tmp_path), "*.json", file_format="json")
    with pytest.raises(ValueError, match="is no time in the expected format"):
        src.read_tickets(spark, cfg)
    with pytest.raises(ValueError, match="no time column"):
        src.read_tickets(spark, DropConfig(str(tmp_path), "*.json", file_format="json", datetime_column="at"))
    with pytest.raises(ValueError, match="No input files found"):
        src.read_tickets(spark, DropConfig(str(tmp_path), "*.parquet"))


def test_parquet_row_ids_follow_files(spark, tmp_path):
    for name, n in (("p1", 3), ("p2", 2)):
        spark.range(n).select(F.lit("2025-01-01").alias("created_at"), F.lit(name).alias("v"), "id").coalesce(1).write.parquet(
            str(tmp_path / name))
    cfg = DropConfig(str(tmp_path / "p*"), "*.parquet")
    ids = sorted(int(r["row_id"][4:]) for r in src.read_tickets(spark, cfg).collect())
    assert ids == list(range(5))


def test_time_range_bounds_are_inclusive(spark):
    df = spark.createDataFrame([("2025-01-01 00:00:00",), ("2025-01-31 00:00:00",), ("2025-01-31 10:00:00",)], "t string")
    df = df.select(F.col("t").cast("timestamp_ntz").alias("event_time"))
    assert prepare.time_range(df, "2025-01-01", "2025-01-31").count() == 2
    assert prepare.time_range(df, "2030-01-01").count() == 0


def test_primary_dialog_and_maps(spark):
    columns = ["dialog_text", "call_text", "comment_text", "summary_text"]
    df = spark.createDataFrame(
        [("", "CLIENT: Не могу войти в приложение\nOPERATOR: ок", "коротко", None, "Тема", " null "), ("", None, " ", "nan", None, None),
         ("ab", "cd", None, None, None, "x")],
        ", ".join(f"{c} string" for c in [*columns, "subject", "channel"]),
    )
    rows = df.select(
        prepare.primary_dialog(columns).alias("p"), prepare.filled_map(columns).alias("m"),
        prepare.signal_map([*columns, "subject", "channel"], columns).alias("s"),
    ).collect()
    assert rows[0]["p"]["field"] == "call_text" and list(rows[0]["m"]) == ["call_text", "comment_text"]
    assert rows[0]["s"] == {"subject": "Тема"}
    assert tuple(rows[1]["p"]) == ("dialog_text", "") and rows[1]["m"] == {}
    assert tuple(rows[2]["p"]) == ("dialog_text", "ab")


def test_column_resolution(spark):
    df = spark.createDataFrame([("a", "b")], "call_text string, x string")
    assert prepare.dialog_columns(df, DropConfig("", dialog_columns=("x", "call_text", "x"), dialog_column="gone")) == ["x", "call_text"]
    with pytest.raises(ValueError):
        prepare.dialog_columns(df, DropConfig("", dialog_column="gone"))
    assert prepare.scoring_dialog_column(df, DropConfig("", dialog_column=None)) == "call_text"
    with pytest.raises(KeyError):
        prepare.scoring_dialog_column(df.select("x"), DropConfig("", dialog_column=None))


def test_mixed_columns_become_text(spark):
    df = spark.createDataFrame([(123, None, ["a"]), (None, "текст", None)], "n int, t string, l array<string>")
    assert [tuple(r) for r in prepare.as_text(df, ["n", "t"]).select("n", "t").collect()] == [("123", ""), ("", "текст")]
    assert [tuple(r) for r in prepare.all_objects_as_text(df).collect()] == [(123, "", '["a"]'), (None, "текст", "")]


def test_taxonomy_forms_and_membership(spark, tmp_path):
    raw = {
        "categories": {
            "TECHNICAL": {"label_ru": "Техника", "subcategories": {"login_issue": {"label_ru": "Вход"}, "app_crash": "Сбой"}},
            "LISTED": {"subcategories": ["one", 2]}, "BARE": None,
        },
        "loan_products": {"NONE": {"label_ru": "нет"}},
    }
    (tmp_path / "t.json").write_text(json.dumps(raw), encoding="utf-8")
    t = Taxonomy.load(spark, str(tmp_path / "t.json"))
    assert t.categories == [("TECHNICAL", "Техника"), ("LISTED", "LISTED"), ("BARE", "BARE")]
    assert t.subcategories[:2] == [("TECHNICAL", "login_issue", "Вход"), ("TECHNICAL", "app_crash", "Сбой")]
    assert t.subcategories[2:] == [("LISTED", "one", "one"), ("LISTED", "2", "2")]
    assert len(Taxonomy.default().categories) == 10 and len(Taxonomy.default().loan_products) == 9
    df = spark.createDataFrame(
        [(1, "TECHNICAL", "login_issue"), (2, "TECHNICAL", "inheritance"), (3, "OTHER", "NOT_COMPLAINT"), (4, "OTHER", None)],
        "i int, c string, s string",
    )
    subs = t.subcategory_table(spark)
    assert [r["s"] for r in joins.training_subcategories(df, subs, "c", "s").orderBy("i").collect()] == [
        "login_issue", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [r["s"] for r in joins.scored_subcategories(df, subs, "c", "s").orderBy("i").collect()] == [
        "login_issue", "UNKNOWN", "NOT_COMPLAINT", "UNKNOWN"]


def test_token_lists(spark, tmp_path):
    drop(tmp_path, "deny.txt", " Client \n\nбот\nбот\n")
    both = token_union(load_tokens(spark, str(tmp_path), "deny.txt"), load_tokens(spark, str(tmp_path), "gone.txt"))
    assert sorted(r["token"] for r in both.collect()) == ["client", "бот"]


def test_scoring_cleans_with_the_token_files(spark, tmp_path):
    folder = tmp_path / "lists"
    folder.mkdir()
    drop(folder, "deny_tokens.txt", "Карта\nlost\n")
    cfg = TrainConfig(token_dir=str(folder))
    assert deny_tokens(spark, cfg) == ("lost", "карта")
    assert deny_tokens(spark, TrainConfig()) == TrainConfig().deny_tokens
    drop(tmp_path, "new.json", json.dumps({"created_at": "2025-12-01", "dialog_text": "CLIENT: карта lost вчера вечером и клиент ждёт"}) + "\n")
    drops = DropConfig(str(tmp_path), "new.json", file_format="json")
    cleaned = score.month_rows(spark, drops, "2025-12", DialogConfig(), cfg).first()["text_clean"].split()
    assert "вчера" in cleaned and "клиент" in cleaned and not {"карта", "lost"} & set(cleaned)


def test_month_sink_replaces_only_its_months(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "v string, month string"
    read = lambda: sorted((r["v"], r["month"]) for r in tables.read_by_month(spark, path, schema).collect())
    with pytest.raises(ValueError):
        read()
    tables.write_by_month(spark.createDataFrame([("a", "2025-01"), ("b", "2025-02")], schema), path)
    tables.write_by_month(spark.createDataFrame([("c", "2025-02"), ("d", None)], schema), path)
    assert read() == [("a", "2025-01"), ("c", "2025-02"), ("d", None)]
    tables.write_by_month(spark.createDataFrame([("e", "2025-01")], schema), path)
    assert {r["v"] for r in tables.read_by_month(spark, path, schema).collect()} == {"c", "d", "e"}
    plan = tables.read_by_month(spark, path, schema).filter("month = '2025-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan


def test_readers_meet_whole_versions_only(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "v long, month string"
    frame = lambda lo, hi: spark.range(lo, hi).selectExpr("id AS v", "'2025-01' AS month")
    tables.write_prepared(frame(0, 5), path)
    opened = tables.read_by_month(spark, path, schema)

    @F.udf("long")
    def fails(v):
        if v > 7:
            raise RuntimeError("the job breaks off")
        return v

    with pytest.raises(Exception, match="breaks off"):
        tables.write_prepared(frame(0, 10).withColumn("v", fails("v")), path)
    assert tables.read_by_month(spark, path, schema).count() == 5  # the broken version is not current
    tables.write_prepared(frame(0, 9), path)
    assert tables.read_by_month(spark, path, schema).count() == 9
    assert opened.count() == 5  # an open reader still has its version
    tables.write_prepared(frame(0, 3), path)
    whole = [v for v in (tmp_path / "t").iterdir() if (v / "_SUCCESS").exists()]
    assert len(whole) == 2 and tables.read_by_month(spark, path, schema).count() == 3
    assert list(versions.current(spark, path)) == ["all"]


def test_review_round_trip_and_missing_gold(spark, tmp_path):
    assert tables.read_gold(spark, str(tmp_path / "gone")) is None
    df = spark.createDataFrame([("r1", 'CLIENT: "x",\ny', ["a", "b"])], "row_id string, raw_dialog string, keywords_llm array<string>")
    tables.write_review_sheet(df, str(tmp_path / "review"))
    gold = tables.read_gold(spark, str(tmp_path / "review")).collect()
    assert [r["row_id"] for r in gold] == ["r1"] and not gold[0]["is_complaint_gold"]
    weak = spark.createDataFrame([("r1", True, "A"), ("r2", False, "B")], "row_id string, is_complaint_llm boolean, complaint_category_llm string")
    verdict = spark.createDataFrame([("r1", "false", "")], "row_id string, is_complaint_gold string, category_gold string")
    rows = joins.with_targets(joins.with_gold(weak, verdict)).orderBy("row_id").collect()
    assert [(r["y_bin"], r["y_cat"]) for r in rows] == [(False, "A"), (False, "B")]
    assert fv.UNKNOWN == "UNKNOWN"


def _csv(path, rows):
    import csv

    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        csv.writer(f, quoting=csv.QUOTE_ALL).writerows([["created_at", "dialog_text", "channel"], *rows])


def test_csv_rows_with_line_breaks_stay_whole(spark, tmp_path):
    _csv(tmp_path / "a.csv", [["2025-01-01 10:00:00", 'CLIENT: one\nOPERATOR: "two"', "chat"], ["2025-01-02 10:00:00", "CLIENT: three", "mail"]])
    rows = src.read_tickets(spark, DropConfig(str(tmp_path), "*.csv", file_format="csv")).orderBy("row_id").collect()
    assert [(r.dialog_text, r.channel, r.row_id) for r in rows] == [
        ('CLIENT: one\nOPERATOR: "two"', "chat", "row_0"), ("CLIENT: three", "mail", "row_1")]


def test_files_of_one_name_in_two_folders_get_their_own_ids(spark, tmp_path):
    for folder, n in (("2025-01", 3), ("2025-02", 2)):
        days = [(f"{folder}-0{i + 1} 00:00:00", "x") for i in range(n)]
        spark.createDataFrame(days, "created_at string, dialog_text string").coalesce(1).write.parquet(str(tmp_path / folder))
    for folder in ("2025-01", "2025-02"):
        for f in (tmp_path / folder).glob("part-*"):
            f.rename(tmp_path / folder / "tickets.parquet")
    rows = src.read_tickets(spark, DropConfig(str(tmp_path), "*/tickets.parquet")).collect()
    assert sorted(r.row_id for r in rows) == [f"row_{i}" for i in range(5)]
    assert {r.source_file for r in rows} == {"tickets.parquet"}


def test_an_explicit_list_keeps_its_order(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.json").write_text('{"created_at": "2025-01-01 00:00:00", "dialog_text": "%s"}\n' % name)
    cfg = DropConfig(str(tmp_path), file_names=("b.json", "a.json"), file_format="json")
    rows = src.read_tickets(spark, cfg).collect()
    assert {r.row_id: r.dialog_text for r in rows} == {"row_0": "b", "row_1": "a"}


def test_a_column_of_two_types_becomes_text(spark, tmp_path):
    spark.createDataFrame([("2025-01-01", 123)], "created_at string, subject bigint").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("2025-01-02", "text")], "created_at string, subject string").write.parquet(str(tmp_path / "b"))
    rows = src.scan_drops(spark, DropConfig(str(tmp_path), "*/*.parquet")).orderBy("created_at").collect()
    assert [r.subject for r in rows] == ["123", "text"]


@pytest.mark.parametrize("given, text", [
    ("%Y-%m-%dT%H:%M:%S", "2025-03-04T05:06:07"), ("%d %b %Y at %I:%M:%S %p", "04 Mar 2025 at 05:06:07 AM"),
    ("%Y%%%j %H:%M:%S", "2025%063 05:06:07"), ("[%Y] it's %m/%d %H:%M:%S", "[2025] it's 03/04 05:06:07"),
])
def test_time_formats_with_literals(spark, given, text):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(src.parse_event_time(F.col("t"), src.spark_pattern(given)).cast("string").alias("t")).first()
    assert found.t == "2025-03-04 05:06:07"


def test_an_unknown_directive_is_refused():
    with pytest.raises(ValueError, match="%U"):
        src.spark_pattern("%Y %U")


def test_months_are_compared_with_the_calendar_month_before(spark):
    from trendloom.operators import trends

    df = spark.createDataFrame([("2025-01", 5), ("2025-04", 7), ("2025-05", 9), (None, 1)], "month string, n int")
    out = {r.month: (r.previous_n, r.n_change) for r in trends.month_over_month(df, "n", absent=0).collect()}
    assert out == {
        "2025-01": (0, 5), "2025-02": (5, -5), "2025-03": (0, 0), "2025-04": (0, 7), "2025-05": (7, 2), None: (0, 1)}
    assert {r.month: r.previous_n for r in trends.month_over_month(df, "n").collect()}["2025-04"] is None


def _nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.length()):
        yield from _nodes(children.apply(k))


@pytest.mark.parametrize("file_format", ["json", "parquet", "csv"])
def test_row_numbers_move_no_row(spark, tmp_path, file_format):
    """Several files, some in several splits and several files in one partition; ids follow files and lines."""
    for k, n in enumerate((40, 3, 0, 900, 1, 77)):
        rows = spark.range(n).selectExpr("'2025-01-01 00:00:00' AS created_at", f"concat('f{k}-', lpad(id, 4, '0')) AS dialog_text", "repeat('x', 50) AS pad")
        writer = rows.coalesce(1).write.mode("append")
        writer = writer.option("header", True) if file_format == "csv" else writer
        writer.format(file_format).save(str(tmp_path / f"d{k}"))
    cfg = DropConfig(str(tmp_path), f"d*/*.{file_format}", file_format=file_format)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = src.with_row_id(src.scan_drops(spark, cfg), cfg)
        got = sorted((int(r["row_id"][4:]), r["dialog_text"]) for r in df.collect())
        assert [n for n, _ in got] == list(range(1021))
        assert [t for _, t in got] == [f"f{k}-{i:04d}" for k, n in enumerate((40, 3, 0, 900, 1, 77)) for i in range(n)]
        join = next(n for n in _nodes(df._jdf.queryExecution().sparkPlan()) if "BroadcastHashJoin" in n.nodeName())
        wide = [n.nodeName() for n in _nodes(join.children().apply(0))]
        assert any("Scan" in n for n in wide) and not any("Exchange" in n or "Window" in n or "Aggregate" in n for n in wide)
        assert not any("SortMergeJoin" in n.nodeName() for n in _nodes(df._jdf.queryExecution().sparkPlan()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_the_prepared_table_holds_one_run(spark, tmp_path):
    from trendloom.sources import tables

    full = spark.createDataFrame([("a", "2025-10"), ("b", "2025-11")], "row_id string, month string")
    tables.write_prepared(full, str(tmp_path / "t"))
    tables.write_prepared(full.filter("month = '2025-11'"), str(tmp_path / "t"))
    assert [r.row_id for r in tables.read_by_month(spark, str(tmp_path / "t"), full.schema).collect()] == ["b"]


def test_no_query_runs_while_the_flagship_is_built(spark):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("benchmark tables are not here")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        entry.queries()["monthly_complaint_rate"](spark, "/root/testdata/sf0.001")
        assert len(tracker.getJobIdsForGroup("building")) <= 2  # reading the two schemas
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_folder_of_files_is_one_drop(spark, tmp_path):
    part = lambda lo, hi: spark.range(lo, hi).select("id", F.col("id").cast("string").alias("t"))
    part(0, 6).repartition(3).write.parquet(str(tmp_path / "b drop.parquet"))
    part(6, 9).coalesce(1).write.parquet(str(tmp_path / "c"))
    next((tmp_path / "c").glob("*.parquet")).rename(tmp_path / "a.parquet")
    listed = DropConfig(str(tmp_path), file_names=("b drop.parquet", "a.parquet", "absent.parquet"))
    for cfg in (listed, DropConfig(str(tmp_path), file_glob="*.parquet")):
        found = {r["source_file"]: r["count"] for r in src.scan_drops(spark, cfg).groupBy("source_file").count().collect()}
        assert found == {"a.parquet": 3, "b drop.parquet": 6}
    rows = src.with_row_id(src.scan_drops(spark, listed), listed).select("id", "row_id").collect()
    assert {r["row_id"] for r in rows if r["id"] < 6} == {f"row_{i}" for i in range(6)}  # in the order of the list
