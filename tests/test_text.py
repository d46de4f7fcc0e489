import re

import pytest
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.functions.text import DialogConfig, RedactionConfig
from trendloom.functions import text as X

ODD = [
    "", " ", "a", " \tx ", "one\ntwo\r\nthree\n", "a\n\n", "\x1cb\x1d\x85c d ", "nan", " None ",
    "Заявка 12 номер <b>ABC</b> x 4111 1111 1111 1111 9",
    "2025-01-09 12:55:29 +7 (999) 000-11-22 12345678901234567890",
    "e-mail é.a@b.example, http://x.example/a?b=1 www.y.example end", "CLIENT: привет", "[КЛИЕНТ] - да",
]


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def test_strip_and_lines_match_python(spark):
    assert one(spark, ODD, X.strip) == [v.strip() for v in ODD]
    assert one(spark, ODD, X.split_lines) == [v.splitlines() for v in ODD]


def test_non_empty(spark):
    got = one(spark, [None, *ODD], X.non_empty)
    assert got == [False] + [bool(v.strip()) and v.strip().lower() not in ("nan", "none", "null") for v in ODD]


@pytest.mark.parametrize(
    "dialog,expected",
    [
        ("CHATBOT: Здравствуйте\nCLIENT: Не проходит оплата картой\nOPERATOR: Смотрим", "Не проходит оплата картой"),
        ("CLIENT: да\nOPERATOR: слушаю\nCLIENT: перевод завис второй день", "перевод завис второй день"),
        ("CLIENT: да", "да"),
        ("просто текст\n\nвторой абзац", "просто текст"),
        ("   ", ""),
        (None, ""),
    ],
)
def test_client_first_message(spark, dialog, expected):
    assert one(spark, [dialog], lambda c: X.client_first_message(c, DialogConfig())) == [expected]


def test_redaction_order_and_switch(spark):
    text = "mail a@b.example tel +79990001122 site https://x.example"
    out = one(spark, [text], X.redact)[0]
    assert out == "mail <EMAIL> tel <PHONE> site <URL>"
    assert one(spark, ["2025-01-09 12:55:29"], X.redact) == ["<PHONE>:55:29"]
    assert one(spark, [text], lambda c: X.redact(c, RedactionConfig(enabled=False))) == [text]
    assert one(spark, ["n 12345678901234567890 n"], X.redact_account) == ["n <ACCOUNT> n"]
    assert one(spark, ["4111-1111 1111 1111"], X.redact_card) == ["<CARD>"]


def test_clean_matches_python(spark):
    deny = set(fv.DENY_TOKENS + fv.EXTRA_STOPWORDS)

    def plain(v):
        v = re.sub(r"\b\d+\b", " ", re.sub(r"<[^>]+>", " ", v.lower()))
        return " ".join(w for w in re.findall(r"\w+", v) if len(w) > 1 and w not in deny)

    assert one(spark, ODD, lambda c: X.clean_for_model(c, deny)) == [plain(v) for v in ODD]


def test_ngrams_match_plain_statement(spark):
    texts = ["", "a", "ab cde fghijk", "да нет  да", "one two three four"]

    def chars(t):
        out = []
        for n in (3, 4, 5):
            for w in t.split():
                w = f" {w} "
                if n == 3 or len(w) >= n:
                    out += [w[i:i + n] for i in range(max(1, len(w) - n + 1))]
        return out

    def words(t):
        w = re.findall(r"\w\w+", t)
        return w + [" ".join(p) for p in zip(w, w[1:])] + [" ".join(p) for p in zip(w, w[1:], w[2:])]

    assert one(spark, texts, lambda c: X.char_ngrams(c, 3, 5)) == [chars(t) for t in texts]
    assert one(spark, texts, lambda c: X.word_ngrams(X.feature_words(c), 1, 3)) == [words(t) for t in texts]


def test_content_key_ignores_field_and_map_order(spark):
    df = spark.range(1).select(
        F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")).alias("m"),
        F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1")).alias("n"),
    )
    left = X.content_key({"x": F.lit("v"), "m": X.sorted_map(F.col("m"))}, "v1")
    right = X.content_key({"m": X.sorted_map(F.col("n")), "x": F.lit("v")}, "v1")
    other = X.content_key({"m": X.sorted_map(F.col("n")), "x": F.lit("v")}, "v2")
    row = df.select(left.alias("a"), right.alias("b"), other.alias("c")).first()
    assert row["a"] == row["b"] != row["c"]


def test_markers_as_first_word_only(spark):
    said = ["CLIENT: x", "[client] x", "  (Client) x", "it said CLIENT: x", "CLIENTS: x", "OPERATOR the CLIENT", "Робот: x", "РАБОТАЕТ", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    role = lambda cfg: [r[0] for r in df.select("i", X.line_role(F.col("t"), cfg).alias("r")).orderBy("i").select("r").collect()]
    assert role(DialogConfig(match="prefix")) == ["client", "client", "client", None, None, "operator", None, None, None]
    assert role(DialogConfig())[3:6] == ["client", "client", "client"]
    with pytest.raises(ValueError):
        role(DialogConfig(match="suffix"))


def test_specific_patterns_first(spark):
    rows = [("4111 1111 1111 1111",), ("40817810099910004312",), ("+7 (912) 345-67-89",), ("a@b.io 4111111111111111",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(X.redact(F.col("t"), RedactionConfig(order="specific_first"))).collect()]
    assert got == ["<CARD>", "<ACCOUNT>", "<PHONE>", "<EMAIL> <CARD>", ""]
    assert [r[0] for r in df.select(X.redact(F.col("t"))).collect()][:2] == ["<PHONE>", "<PHONE>"]
