"""Text operators over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.catalog.bindings import (
    DIALOGS, LINE_END, SPACE, dialogs, sql_list, sql_non_empty, sql_strip, table,
)
from trendloom.catalog.registry import query
from trendloom.functions.text import DialogConfig
from trendloom.functions import text as X
from trendloom.catalog.bindings import spread

DIALOG = DialogConfig()
DENY = fv.DENY_TOKENS + fv.EXTRA_STOPWORDS
W = r"\p{L}\p{N}_"


def texts(spark, sf_dir, name="documents", key="doc_id"):
    """A text table with at least one partition per core."""
    return spread(table(spark, sf_dir, name), key)


# --- dialogs ---------------------------------------------------------------------------

def sql_lines(key: str, col: str, src: str) -> str:
    """CTE ``numbered``: one row per line, without the empty piece after a final line end."""
    return f"""
parts AS (SELECT {key}, regexp_split_to_array({col}, '{LINE_END}') AS parts FROM {src}),
lines AS (
  SELECT {key}, CASE WHEN parts[len(parts)] = '' THEN parts[:len(parts) - 1] ELSE parts END AS parts FROM parts
),
numbered AS (
  SELECT {key}, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM lines
)"""


def _sql_role(line: str) -> str:
    def any_of(markers):
        return " OR ".join(f"contains(upper({line}), '{m}')" for m in markers)

    return (
        f"CASE WHEN {any_of(fv.CLIENT_MARKERS)} THEN 'client'"
        f" WHEN {any_of(fv.OPERATOR_MARKERS)} THEN 'operator'"
        f" WHEN {any_of(fv.CHATBOT_MARKERS)} THEN 'chatbot' END"
    )


def _sql_marker(line: str) -> str:
    return (
        f"regexp_replace({sql_strip(line)}, "
        rf"'(?i)^[\[\({SPACE}]*[A-ZА-Я_ ]{{2,20}}[:\-][{SPACE}]*', '')"
    )


@query(
    "dialog_lines",
    "WITH " + sql_lines(key="doc_id", col="text", src="documents")
    + " SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM numbered",
)
def dialog_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("line_no", "line"))


@query(
    "line_roles",
    "WITH " + DIALOGS + ", " + sql_lines(key="conv_id, turn", col="dialog_text", src="dialogs")
    + f" SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, {_sql_role('line')} AS role FROM numbered",
)
def line_roles(spark, sf_dir):
    lines = dialogs(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(X.split_lines(F.col("dialog_text"))).alias("line_no", "line")
    )
    return lines.select("conv_id", "turn", "line_no", X.line_role(F.col("line"), DIALOG).alias("role"))


def _sql_first_word_role(line: str) -> str:
    def first(markers):
        return rf"regexp_matches(upper({line}), '^[\[(\s]*({'|'.join(markers)})([^\p{{L}}\p{{N}}_]|$)')"

    return (
        f"CASE WHEN {first(fv.CLIENT_MARKERS)} THEN 'client' WHEN {first(fv.OPERATOR_MARKERS)} THEN 'operator'"
        f" WHEN {first(fv.CHATBOT_MARKERS)} THEN 'chatbot' END"
    )


@query(
    "line_roles_by_first_word",
    "WITH " + DIALOGS + ", " + sql_lines(key="conv_id, turn", col="dialog_text", src="dialogs")
    + f" SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, {_sql_first_word_role('line')} AS role FROM numbered",
)
def line_roles_by_first_word(spark, sf_dir):
    lines = dialogs(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(X.split_lines(F.col("dialog_text"))).alias("line_no", "line")
    )
    return lines.select("conv_id", "turn", "line_no", X.line_role(F.col("line"), X.DialogConfig(match="prefix")).alias("role"))


@query(
    "strip_markers",
    "WITH " + DIALOGS + ", " + sql_lines(key="conv_id, turn", col="dialog_text", src="dialogs")
    + f" SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, {_sql_marker('line')} AS said FROM numbered",
)
def strip_markers(spark, sf_dir):
    lines = dialogs(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(X.split_lines(F.col("dialog_text"))).alias("line_no", "line")
    )
    return lines.select("conv_id", "turn", "line_no", X.strip_marker(F.col("line")).alias("said"))


SEGMENTS = (
    DIALOGS + ", " + sql_lines(key="conv_id, turn", col="dialog_text", src="dialogs")
    + f""", roles AS (
  SELECT conv_id, turn, line_no, {_sql_role('line')} AS role, {_sql_marker('line')} AS said FROM numbered
), segments AS (
  SELECT conv_id, turn, role, said,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS seg
  FROM roles WHERE role IS NOT NULL
)"""
)


@query(
    "dialog_segments",
    "WITH " + SEGMENTS + " SELECT conv_id, turn, CAST(seg AS INTEGER) AS seg, role, said FROM segments",
)
def dialog_segments(spark, sf_dir):
    return dialogs(spark, sf_dir).select(
        "conv_id", "turn",
        F.posexplode(X.dialog_segments(F.col("dialog_text"), DIALOG)).alias("pos", "s"),
    ).select(
        "conv_id", "turn", (F.col("pos") + 1).alias("seg"), F.col("s.role").alias("role"),
        F.col("s.text").alias("said"),
    )


def _sql_fallback(c: str) -> str:
    return sql_strip(f"substr(split_part({c}, chr(10) || chr(10), 1), 1, 600)")


@query(
    "client_first_message",
    "WITH " + SEGMENTS + f""", said AS (
  SELECT conv_id, turn, said, row_number() OVER (PARTITION BY conv_id, turn ORDER BY seg) AS nth
  FROM segments WHERE role = 'client' AND {sql_strip('said')} <> ''
), firsts AS (
  SELECT conv_id, turn, max(said) FILTER (nth = 1) AS m1, max(said) FILTER (nth = 2) AS m2
  FROM said GROUP BY conv_id, turn
)
SELECT d.conv_id, d.turn,
       CASE WHEN m1 IS NULL THEN {_sql_fallback(sql_strip('d.dialog_text'))}
            WHEN length(m1) < 20 AND m2 IS NOT NULL THEN {sql_strip('m2')}
            ELSE {sql_strip('m1')} END AS client_first_message
FROM dialogs d LEFT JOIN firsts f ON d.conv_id = f.conv_id AND d.turn = f.turn""",
)
def client_first(spark, sf_dir):
    return dialogs(spark, sf_dir).select(
        "conv_id", "turn",
        X.client_first_message(F.col("dialog_text"), DIALOG).alias("client_first_message"),
    )


@query(
    "client_fallback_message",
    f"SELECT doc_id, {_sql_fallback(sql_strip('text'))} AS first_paragraph, "
    f"{sql_strip('substr(' + sql_strip('text') + ', 1, 600)')} AS first_chars FROM documents",
)
def client_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stripped = X.strip(F.col("text"))
    return docs.select(
        "doc_id",
        X.fallback_message(stripped, DIALOG).alias("first_paragraph"),
        X.fallback_message(stripped, DialogConfig(fallback_mode="first_n_chars")).alias("first_chars"),
    )


# --- redaction ---------------------------------------------------------------------------

SQL_EMAIL = rf"\b[{W}.%+-]+@[{W}.-]+\.[A-Za-z]{{2,}}\b"
SQL_PHONE = r"\+?\d[\d\-() ]{8,}\d"
SQL_URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
SQL_CARD = r"\b(?:\d[ -]*?){13,19}\b"
SQL_ACCOUNT = r"\b\d{20}\b"


def _sub(expr: str, pattern: str, token: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{token}', 'g')"


def sql_redact(expr: str, order: str = "email phone url card account") -> str:
    steps = {
        "email": (SQL_EMAIL, fv.EMAIL_TOKEN), "phone": (SQL_PHONE, fv.PHONE_TOKEN), "url": (SQL_URL, fv.URL_TOKEN),
        "card": (SQL_CARD, fv.CARD_TOKEN), "account": (SQL_ACCOUNT, fv.ACCOUNT_TOKEN),
    }
    for name in order.split():
        expr = _sub(expr, *steps[name])
    return expr


def _redaction(name, source, key, column, fn, pattern, token):
    @query(
        name,
        f"SELECT {key}, {_sub(column, pattern, token)} AS redacted, "
        f"{_sub(column, pattern, token)} <> {column} AS changed FROM {source}",
    )
    def run(spark, sf_dir):
        df = texts(spark, sf_dir, source, key).select(key, column, fn(F.col(column)).alias("redacted"))
        return df.select(key, "redacted", (F.col("redacted") != F.col(column)).alias("changed"))


_redaction("redact_email", "documents", "doc_id", "text", X.redact_email, SQL_EMAIL, fv.EMAIL_TOKEN)
_redaction("redact_phone", "documents", "doc_id", "text", X.redact_phone, SQL_PHONE, fv.PHONE_TOKEN)
_redaction("redact_url", "pages", "page_id", "html", X.redact_url, SQL_URL, fv.URL_TOKEN)
_redaction("redact_card", "documents", "doc_id", "text", X.redact_card, SQL_CARD, fv.CARD_TOKEN)
_redaction("redact_account", "documents", "doc_id", "text", X.redact_account, SQL_ACCOUNT, fv.ACCOUNT_TOKEN)


@query("redact_personal_data", f"SELECT doc_id, {sql_redact('text')} AS redacted FROM documents")
def redact_personal_data(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", X.redact(F.col("text")).alias("redacted"))


@query(
    "redact_specific_first",
    f"SELECT doc_id, {sql_redact('text', 'email account card phone url')} AS redacted FROM documents",
)
def redact_specific_first(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", X.redact(F.col("text"), X.RedactionConfig(order="specific_first")).alias("redacted"))


@query(
    "redact_context_values",
    "WITH " + DIALOGS + f"""
SELECT conv_id, turn, {sql_redact('line')} AS dialog_text,
       coalesce({sql_redact('line2')}, '') AS call_text FROM dialogs""",
)
def redact_context_values(spark, sf_dir):
    context = F.create_map(
        F.lit("dialog_text"), F.col("line"), F.lit("call_text"), X.text_or_empty(F.col("line2"))
    )
    redacted = dialogs(spark, sf_dir).select("conv_id", "turn", X.redact_values(context).alias("m"))
    return redacted.select(
        "conv_id", "turn", F.col("m")["dialog_text"].alias("dialog_text"),
        F.col("m")["call_text"].alias("call_text"),
    )


# --- cleaning and n-grams ------------------------------------------------------------------

def sql_clean(expr: str) -> str:
    """RE2 has no look-around: all-digit tokens are dropped after tokenising instead."""
    words = f"regexp_extract_all(regexp_replace(lower({expr}), '<[^>]+>', ' ', 'g'), '[{W}]+')"
    return (
        f"list_filter({words}, lambda w: NOT regexp_full_match(w, '[\\p{{Nd}}]+')"
        f" AND length(w) > 1 AND w NOT IN ({sql_list(DENY)}))"
    )


@query(
    "clean_for_model",
    f"SELECT doc_id, array_to_string({sql_clean('text')}, ' ') AS text_clean FROM documents",
)
def clean_for_model(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", X.clean_for_model(F.col("text"), DENY).alias("text_clean")
    )


@query(
    "word_ngram_counts",
    f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[{W}]{{2,}}') AS words FROM documents),
grams AS (
  SELECT doc_id, unnest(words) AS term FROM w
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w
)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM grams GROUP BY term""",
)
def word_ngram_counts(spark, sf_dir):
    from trendloom.operators.features import word_ngram_statistics

    docs = texts(spark, sf_dir).select(X.feature_words(F.col("text")).alias("terms"))
    return word_ngram_statistics(docs, "terms", 1, 2)


@query(
    "char_ngram_counts",
    f"""
WITH words AS (
  SELECT doc_id, ' ' || word || ' ' AS w FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[{SPACE}]+')) AS word FROM documents)
  WHERE word <> ''
), sized AS (
  SELECT doc_id, w, length(w) AS len, unnest([3, 4, 5]) AS n FROM words
), grams AS (
  SELECT doc_id, substr(w, i, n) AS term
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len - n + 1) + 1)) AS i
        FROM sized WHERE n = 3 OR n <= len)
)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM grams GROUP BY term""",
)
def char_ngram_counts(spark, sf_dir):
    from trendloom.operators.features import char_ngram_statistics

    docs = texts(spark, sf_dir).select(X.spaced_words(F.col("text")).alias("terms"))
    return char_ngram_statistics(docs, "terms", 3, 5)


# --- keys, sizes, JSON -----------------------------------------------------------------------

@query(
    "token_estimate",
    "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents",
)
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


def sql_key(doc: str = "") -> str:
    p = f"{doc}." if doc else ""
    return (
        f"sha256('{{\"lang\":' || CAST(to_json({p}lang) AS VARCHAR) || ',\"source\":' || "
        f"CAST(to_json({p}source) AS VARCHAR) || ',\"text\":' || CAST(to_json({p}text) AS VARCHAR) || '}}v1')"
    )


def document_key():
    return X.content_key({c: F.col(c) for c in ("text", "source", "lang")}, "v1")


@query("content_key", f"SELECT doc_id, {sql_key()} AS k FROM documents")
def content_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", document_key().alias("k"))


@query(
    "map_json_round_trip",
    "WITH " + DIALOGS + """
SELECT conv_id, turn, '{"call_text":' || CAST(to_json(coalesce(line2, '')) AS VARCHAR) || ',"dialog_text":'
       || CAST(to_json(line) AS VARCHAR) || '}' AS encoded, line AS decoded
FROM dialogs""",
)
def map_json_round_trip(spark, sf_dir):
    context = F.create_map(
        F.lit("dialog_text"), F.col("line"), F.lit("call_text"), X.text_or_empty(F.col("line2"))
    )
    encoded = dialogs(spark, sf_dir).select(
        "conv_id", "turn", F.to_json(X.sorted_map(context)).alias("encoded")
    )
    decoded = F.from_json("encoded", "map<string,string>")["dialog_text"]
    return encoded.select("conv_id", "turn", "encoded", decoded.alias("decoded"))


@query(
    "blank_texts",
    "WITH " + DIALOGS + f"""
SELECT conv_id, turn, {sql_strip('coalesce(line2, chr(160) || chr(9))')} = '' AS is_blank,
       {sql_non_empty('line3')} AS has_third
FROM dialogs""",
)
def blank_texts(spark, sf_dir):
    second = F.coalesce(F.col("line2"), F.lit(" \t"))
    return dialogs(spark, sf_dir).select(
        "conv_id", "turn", X.blank(second).alias("is_blank"), X.non_empty(F.col("line3")).alias("has_third")
    )


@query(
    "decorated_labels",
    """
SELECT n_nationkey, n_name || ' (' || coalesce(r_name, n_name) || ')' AS shown
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def decorated_labels(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", X.decorate(F.col("n_name"), F.col("r_name")).alias("shown")
    )
