"""Weak labels: rules, cache, batches, answers, contract, pluggable labelers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.catalog.bindings import TICKETS, sql_list, table, tickets
from trendloom.catalog.registry import query
from trendloom.catalog.text_queries import document_key, sql_key
from trendloom.functions.labels import RuleSet
from trendloom.operators.labelling import LabelConfig
from trendloom.functions import labels as L
from trendloom.functions import text as X
from trendloom.operators import labelling

RULES = RuleSet(complaint_triggers=("schü", "éeau", "onesen"), loan_triggers=("und",))


def _any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in parts) + ")"


def flat(df, keys, label="label"):
    """Label record as plain columns, keywords joined."""
    return df.select(
        *keys, f"{label}.short_summary", f"{label}.is_complaint", f"{label}.complaint_category",
        f"{label}.complaint_subcategory", f"{label}.product_area", f"{label}.loan_product", f"{label}.severity",
        F.array_join(f"{label}.keywords", "|").alias("keywords"), f"{label}.confidence", f"{label}.notes",
    )


SQL_RULES = f"""
SELECT row_id, substr(dialog_text, 1, 120) AS short_summary, bad AS is_complaint,
       CASE WHEN bad THEN 'TECHNICAL' ELSE 'OTHER' END AS complaint_category,
       CASE WHEN bad THEN 'payment_error' END AS complaint_subcategory, product AS product_area,
       CASE WHEN loan THEN 'CONSUMER_LOAN' ELSE 'NONE' END AS loan_product,
       CASE WHEN bad THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN bad THEN 'ошибка|оплата|приложение' ELSE 'вопрос|инфо|уточнение' END AS keywords,
       0.8::DOUBLE AS confidence, NULL::VARCHAR AS notes
FROM (SELECT *, {_any('dialog_text', RULES.complaint_triggers)} AS bad,
             {_any('dialog_text', RULES.loan_triggers)} AS loan FROM tickets)"""


@query("rule_labels", "WITH " + TICKETS + SQL_RULES)
def rule_labels(spark, sf_dir):
    labelled = tickets(spark, sf_dir).select(
        "row_id", L.rule_label(F.col("dialog_text"), F.col("product"), RULES).alias("label")
    )
    return flat(labelled, ["row_id"])


@query(
    "expanded_label_columns",
    "WITH " + TICKETS + f", labelled AS ({SQL_RULES})"
    + """ SELECT row_id, short_summary AS short_summary_llm, is_complaint AS is_complaint_llm,
    severity AS severity_llm, '' AS llm_error FROM labelled""",
)
def expanded_label_columns(spark, sf_dir):
    from trendloom.operators.prepare import expand_label

    labelled = tickets(spark, sf_dir).select(
        "row_id", L.rule_label(F.col("dialog_text"), F.col("product"), RULES).alias("label")
    )
    wide = expand_label(labelled)
    return wide.select(
        "row_id", "short_summary_llm", "is_complaint_llm", "severity_llm", F.coalesce("llm_error", F.lit("")).alias("llm_error")
    )


@query(
    "label_error_column",
    "WITH " + TICKETS + """, noted AS (
  SELECT row_id, CASE WHEN status = 'P' THEN 'LLM_ERROR: timeout ' || channel WHEN status = 'F' THEN channel END AS notes
  FROM tickets)
SELECT row_id, CASE WHEN starts_with(notes, 'LLM_ERROR:') THEN notes ELSE '' END AS llm_error FROM noted""",
)
def label_error_column(spark, sf_dir):
    from trendloom.operators.prepare import error_text

    notes = F.when(F.col("status") == "P", F.concat(F.lit("LLM_ERROR: timeout "), "channel")).when(
        F.col("status") == "F", F.col("channel")
    )
    return tickets(spark, sf_dir).select("row_id", error_text(notes).alias("llm_error"))


# --- batches -------------------------------------------------------------------------------

TOKEN_BATCHES = """
WITH RECURSIVE rows AS (
  SELECT doc_id, greatest(1, length(text) // 4) AS t FROM documents
), greedy(doc_id, batch, total) AS (
  SELECT doc_id, 0, t FROM rows WHERE doc_id = 0
  UNION ALL
  SELECT r.doc_id, CASE WHEN g.total + r.t > 12000 THEN g.batch + 1 ELSE g.batch END,
         CASE WHEN g.total + r.t > 12000 THEN r.t ELSE g.total + r.t END
  FROM greedy g JOIN rows r ON r.doc_id = g.doc_id + 1
)
SELECT doc_id, CAST(batch AS BIGINT) AS batch FROM greedy"""


def _token_batches(spark, sf_dir, run_rows: int):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))
    budget = LabelConfig().token_budget
    return labelling.assign_batches(docs, "doc_id", "tokens", budget, run_rows).select("doc_id", "batch")


@query("token_budget_batches", TOKEN_BATCHES)
def token_budget_batches(spark, sf_dir):
    return _token_batches(spark, sf_dir, LabelConfig().run_rows)


@query("token_batches_over_short_runs", TOKEN_BATCHES)
def token_batches_over_short_runs(spark, sf_dir):
    """Runs shorter than a batch: the same batches."""
    return _token_batches(spark, sf_dir, 7)


# --- answers to a batch -----------------------------------------------------------------------
# Eight consecutive events make one batch.  The response leaves out every "view",
# names some requests wrongly, twice or not at all, and is wrapped in four ways.

def responses(spark, sf_dir):
    answer = F.when(
        F.col("event_type") != "view",
        F.struct(
            F.nullif(F.col("user_id") % 11, F.lit(10)).alias("_batch_index"),
            F.col("event_type").alias("category"),
            F.col("event_id").alias("answer_id"),
        ),
    )
    events = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 8).alias("batch"), (F.col("event_id") % 8).cast("int").alias("idx"), answer.alias("a")
    )
    batches = events.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("idx", "a"))).alias("rows"))
    answers = F.transform(F.filter("rows", lambda r: r["a"].isNotNull()), lambda r: r["a"])
    text = F.to_json(answers)
    wrap = F.col("batch") % 4
    response = (
        F.when(wrap == 0, text)
        .when(wrap == 1, F.concat(F.lit('{"items":'), text, F.lit("}")))
        .when(wrap == 2, F.concat(F.lit('{"results":'), text, F.lit("}")))
        .otherwise(F.concat(F.lit('{"items":[],"tickets":[7,"x",'), F.substr(text, F.lit(2)), F.lit("}")))
    )
    # Splicing into an empty list would leave a trailing comma, so that case stays a plain list.
    response = F.when(F.size(answers) == 0, text).otherwise(response)
    return batches.select(
        "batch", F.transform("rows", lambda r: r["idx"]).alias("requested"), response.alias("response")
    )


ANSWERS = """
answers AS (
  SELECT event_id // 8 AS batch, event_id, nullif(user_id % 11, 10) AS raw_idx, event_type AS category,
         row_number() OVER (PARTITION BY event_id // 8 ORDER BY event_id) AS pos
  FROM events WHERE event_type <> 'view'
)"""


@query(
    "unwrapped_answers",
    "WITH " + ANSWERS
    + " SELECT batch, CAST(pos - 1 AS INTEGER) AS pos, CAST(raw_idx AS INTEGER) AS raw_idx, category FROM answers",
)
def unwrapped_answers(spark, sf_dir):
    items = responses(spark, sf_dir).select(
        "batch", F.posexplode(L.unwrap_answers(F.col("response"))).alias("pos", "a")
    )
    return items.select(
        "batch", "pos", F.col("a.idx").alias("raw_idx"), F.get_json_object("a.item", "$.category").alias("category")
    )


@query(
    "reconciled_answers",
    "WITH " + ANSWERS + """, marked AS (
  SELECT a.*, r.event_id IS NOT NULL AND row_number() OVER (PARTITION BY a.batch, a.raw_idx ORDER BY a.pos) = 1 AS takes
  FROM answers a LEFT JOIN events r ON r.event_id = a.batch * 8 + a.raw_idx AND a.raw_idx < 8
), taken AS (SELECT batch, raw_idx AS idx, event_id AS answer_id FROM marked WHERE takes),
rest AS (SELECT batch, event_id AS answer_id, row_number() OVER (PARTITION BY batch ORDER BY pos) AS nth
         FROM marked WHERE NOT takes),
open AS (SELECT r.batch, r.idx, row_number() OVER (PARTITION BY r.batch ORDER BY r.idx) AS nth
         FROM (SELECT event_id // 8 AS batch, event_id % 8 AS idx FROM events) r
         LEFT JOIN taken t ON r.batch = t.batch AND r.idx = t.idx WHERE t.idx IS NULL)
SELECT batch, CAST(idx AS INTEGER) AS idx, answer_id, true AS matched FROM taken
UNION ALL
SELECT o.batch, CAST(o.idx AS INTEGER), r.answer_id, false FROM open o JOIN rest r ON o.batch = r.batch AND o.nth = r.nth""",
)
def reconciled_answers(spark, sf_dir):
    pairs = responses(spark, sf_dir).select(
        "batch", F.explode(L.reconcile(F.col("requested"), L.unwrap_answers(F.col("response")))).alias("p")
    )
    return pairs.select(
        "batch", "p.idx", F.get_json_object("p.item", "$.answer_id").cast("bigint").alias("answer_id"), "p.matched"
    )


@query(
    "pending_requests",
    """
WITH requested AS (SELECT doc_id FROM documents), assigned AS (SELECT doc_id FROM labels)
SELECT doc_id FROM requested EXCEPT SELECT doc_id FROM assigned""",
)
def pending_requests(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")


# --- coercion and contract --------------------------------------------------------------------

def loose_answers(spark, sf_dir):
    """Answers as JSON with synonyms, gaps, bad enums and out-of-range numbers."""
    status, channel = F.col("status"), F.col("channel")
    words = F.slice(X.feature_words(F.col("dialog_text")), F.lit(1), (F.col("doc_id") % 11).cast("int"))
    answer = F.struct(
        F.when(status == "F", channel).when(status == "P", "").alias("complaint_category"),
        F.when(status != "O", F.col("lang")).alias("category"),
        F.when(channel == "2-HIGH", "late").alias("complaint_subcategory"),
        F.when(channel != "5-LOW", F.col("lang")).alias("subcategory"),
        F.col("product"),
        F.when(channel == "1-URGENT", "MORTGAGE").when(channel == "2-HIGH", "").alias("loan_product"),
        F.when(channel == "1-URGENT", True).when(channel == "3-MEDIUM", False).alias("is_complaint"),
        F.when(channel == "1-URGENT", "high").when(channel == "3-MEDIUM", "urgent").alias("severity"),
        F.when(F.col("doc_id") % 11 > 0, words).alias("keywords"),
        F.when(status == "F", (F.col("amount") / 250000).cast("string")).when(status == "P", "n/a").alias("confidence"),
        F.when(status == "F", "").alias("short_summary"),
        F.when(channel == "2-HIGH", "short").alias("summary"),
        F.when(status == "P", "seen").alias("notes"),
    )
    return tickets(spark, sf_dir).select("row_id", "dialog_text", F.to_json(answer).alias("item"))


@query(
    "coerced_answers",
    "WITH " + TICKETS + rf""", loose AS (
  SELECT *, coalesce(CASE WHEN status = 'F' THEN channel END, CASE WHEN status <> 'O' THEN lang END, 'OTHER') AS cat,
         regexp_extract_all(lower(dialog_text), '[\p{{L}}\p{{N}}_]{{{{2,}}}}')[1:doc_id % 11] AS words
  FROM tickets
), judged AS (
  SELECT *, CASE WHEN channel = '1-URGENT' THEN true WHEN channel = '3-MEDIUM' THEN false
                 ELSE upper(cat) NOT IN ('OTHER', 'NONE', 'NON_COMPLAINT') END AS bad FROM loose
)
SELECT row_id,
       CASE WHEN channel = '2-HIGH' THEN 'short' ELSE substr(dialog_text, 1, 120) END AS short_summary,
       bad AS is_complaint, cat AS complaint_category,
       CASE WHEN channel = '2-HIGH' THEN 'late' WHEN channel <> '5-LOW' THEN lang END AS complaint_subcategory,
       product AS product_area,
       CASE WHEN channel = '1-URGENT' THEN 'MORTGAGE' ELSE product END AS loan_product,
       CASE WHEN channel = '1-URGENT' THEN 'high' WHEN bad THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN len(words) = 0 THEN CASE WHEN bad THEN 'жалоба|обращение|сервис' ELSE 'вопрос|инфо|уточнение' END
            ELSE array_to_string(words[1:8], '|') || repeat('|уточнение', greatest(0, 3 - len(words))) END AS keywords,
       CASE WHEN status = 'F' THEN least(1.0, amount / 250000) WHEN bad THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence,
       CASE WHEN status = 'P' THEN 'seen' END AS notes
FROM judged""".replace("{{", "{").replace("}}", "}"),
)
def coerced_answers(spark, sf_dir):
    labelled = loose_answers(spark, sf_dir).select(
        "row_id", L.coerce_answer(L.parse_answer(F.col("item")), F.col("dialog_text")).alias("label")
    )
    return flat(labelled, ["row_id"])


@query(
    "contract_violations",
    "WITH " + TICKETS + f""", judged AS (
  SELECT row_id, lower(substr(channel, 3)) AS severity, amount / 300000 AS confidence,
         list_concat(string_split(repeat('w,', CAST(doc_id % 10 AS INTEGER)), ','),
                     CASE WHEN status = 'P' THEN ['Agent'] WHEN status = 'F' THEN ['<PHONE>'] ELSE ['ok'] END) AS keywords
  FROM tickets
)
SELECT row_id, array_to_string(list_filter([
    CASE WHEN severity NOT IN ('low', 'medium', 'high') THEN 'severity' END,
    CASE WHEN len(keywords) NOT BETWEEN 3 AND 8 THEN 'keyword_count' END,
    CASE WHEN len(list_filter(keywords, lambda k: lower(k) IN ({sql_list(fv.FORBIDDEN_KEYWORDS)}))) > 0
         THEN 'forbidden_keyword' END,
    CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END], lambda v: v IS NOT NULL), ',') AS broken
FROM judged""",
)
def contract_violations(spark, sf_dir):
    last = F.when(F.col("status") == "P", "Agent").when(F.col("status") == "F", "<PHONE>").otherwise("ok")
    words = F.concat(
        F.split(F.repeat(F.lit("w,"), (F.col("doc_id") % 10).cast("int")), ","), F.array(last)
    )
    label = F.struct(
        F.col("dialog_text").alias("client_first_message"), F.lit("").alias("short_summary"),
        F.lit(True).alias("is_complaint"), F.col("channel").alias("complaint_category"),
        F.lit(None).cast("string").alias("complaint_subcategory"), F.col("product").alias("product_area"),
        F.lit("NONE").alias("loan_product"), F.lower(F.substring("channel", 3, 20)).alias("severity"),
        words.alias("keywords"), (F.col("amount") / 300000).alias("confidence"),
        F.lit(None).cast("string").alias("notes"),
    )
    return tickets(spark, sf_dir).select("row_id", F.array_join(L.violations(label), ",").alias("broken"))


# --- cache ------------------------------------------------------------------------------------

@query(
    "latest_cache_entries",
    """
SELECT k, v FROM (
  SELECT user_id || ':' || event_type AS k, props AS v,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""",
)
def latest_cache_entries(spark, sf_dir):
    writes = table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("k"), F.col("props").alias("v"),
        F.date_trunc("day", "ts").alias("created_at"), F.col("event_id").alias("seq"),
    )
    return labelling.latest_labels(writes)


CACHE = f"""
keyed AS (SELECT doc_id, {sql_key()} AS k FROM documents),
cache AS (
  SELECT k, arg_max('quality ' || quality || ' toxic ' || toxic, doc_id) AS v
  FROM keyed JOIN labels USING (doc_id) GROUP BY k
)"""


def keyed_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", document_key().alias("k"), F.col("text").alias("payload"))


def label_cache(spark, sf_dir):
    value = F.concat(
        F.lit("quality "), F.col("quality").cast("string"), F.lit(" toxic "), F.col("toxic").cast("string")
    )
    writes = keyed_documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(
        "k", value.alias("v"), F.col("doc_id").alias("seq")
    )
    return labelling.latest_labels(writes, order=("seq",))


@query("cache_hits", "WITH " + CACHE + " SELECT doc_id, k, v FROM keyed JOIN cache USING (k)")
def cache_hits(spark, sf_dir):
    rows = keyed_documents(spark, sf_dir).drop("payload")
    return labelling.cache_hits(rows, label_cache(spark, sf_dir)).select("doc_id", "k", "v")


@query(
    "cache_misses",
    "WITH " + CACHE + """
SELECT k, min(text) AS payload FROM keyed JOIN documents USING (doc_id)
WHERE k NOT IN (SELECT k FROM cache) GROUP BY k""",
)
def cache_misses(spark, sf_dir):
    return labelling.cache_misses(keyed_documents(spark, sf_dir), label_cache(spark, sf_dir))


@query(
    "cache_after_labelling",
    "WITH " + CACHE + """
SELECT k, v FROM cache
UNION ALL
SELECT k, 'lang ' || min(lang) FROM keyed JOIN documents USING (doc_id)
WHERE k NOT IN (SELECT k FROM cache) GROUP BY k""",
)
def cache_after_labelling(spark, sf_dir):
    cache = label_cache(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(document_key().alias("k"), F.col("lang").alias("payload"))
    fresh = labelling.cache_misses(docs, cache).select(
        "k", F.concat(F.lit("lang "), "payload").alias("v"), F.lit(1).alias("seq")
    )
    return labelling.latest_labels(cache.withColumn("seq", F.lit(0)).unionByName(fresh), order=("seq",))


# --- pluggable labelers ------------------------------------------------------------------------
# Plain Python callables, as a user would supply them.

def payload_rows(spark, sf_dir):
    body = F.to_json(
        F.struct(F.col("text").alias("full_dialog_text"), F.col("source").alias("product"), F.col("lang").alias("channel")),
        {"ignoreNullFields": "false"},
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"), body.alias("payload"))


def _answer(payload: dict, i: int) -> dict:
    bad = any(t in (payload["full_dialog_text"] or "").lower() for t in RULES.complaint_triggers)
    return {
        "_batch_index": i, "category": "TECHNICAL" if bad else "OTHER", "is_complaint": bad,
        "product": payload["product"], "loan_product": "NONE", "confidence": 0.75,
    }


def triggers_labeler(payloads: list[dict]) -> str:
    return json.dumps([_answer(p, i) for i, p in enumerate(payloads)])


def forgetful_labeler(payloads: list[dict]) -> str:
    """Leaves the last request of every batch of several unanswered."""
    answers = [_answer(p, i) for i, p in enumerate(payloads)]
    return json.dumps({"results": answers[:-1] if len(answers) > 1 else answers})


def sloppy_labeler(payloads: list[dict]) -> str:
    """Puts a forbidden keyword into every answer about German text."""
    answers = [_answer(p, i) for i, p in enumerate(payloads)]
    for p, a in zip(payloads, answers):
        if p["channel"] == "de":
            a["keywords"] = ["agent", "eins", "zwei"]
    return json.dumps(answers)


def drop_forbidden(text: str) -> str:
    answer = json.loads(text)
    answer["keywords"] = ["null", "eins", "zwei"]
    return json.dumps(answer)


def failing_labeler(payloads: list[dict]) -> str:
    if any(p["product"] == "src3" for p in payloads):
        raise RuntimeError("source src3 is not served")
    return triggers_labeler(payloads)


def _sql_labels(keywords: str = "NULL", failed: str = "false") -> str:
    default = "CASE WHEN bad THEN 'жалоба|обращение|сервис' ELSE 'вопрос|инфо|уточнение' END"
    return f"""
SELECT k, substr(text, 1, 120) AS short_summary, bad AND NOT ({failed}) AS is_complaint,
       CASE WHEN bad AND NOT ({failed}) THEN 'TECHNICAL' ELSE 'OTHER' END AS complaint_category,
       NULL::VARCHAR AS complaint_subcategory, source AS product_area, 'NONE' AS loan_product,
       CASE WHEN bad AND NOT ({failed}) THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN {failed} THEN 'вопрос|инфо|уточнение' ELSE coalesce({keywords}, {default}) END AS keywords,
       CASE WHEN {failed} THEN 0.0 ELSE 0.75 END::DOUBLE AS confidence,
       CASE WHEN {failed} THEN 'LLM_ERROR: source src3 is not served' END AS notes
FROM (SELECT CAST(doc_id AS VARCHAR) AS k, text, source, lang, {_any('text', RULES.complaint_triggers)} AS bad
      FROM documents)"""


@query("labels_from_function", _sql_labels())
def labels_from_function(spark, sf_dir):
    return flat(labelling.label_payloads(payload_rows(spark, sf_dir), triggers_labeler), ["k"])


@query("labels_after_retry", _sql_labels())
def labels_after_retry(spark, sf_dir):
    return flat(labelling.label_payloads(payload_rows(spark, sf_dir), forgetful_labeler), ["k"])


@query("labels_after_repair", _sql_labels("CASE WHEN lang = 'de' THEN 'null|eins|zwei' END"))
def labels_after_repair(spark, sf_dir):
    return flat(labelling.label_payloads(payload_rows(spark, sf_dir), sloppy_labeler, drop_forbidden), ["k"])


@query("labels_with_fallback", _sql_labels(failed="source = 'src3'"))
def labels_with_fallback(spark, sf_dir):
    return flat(labelling.label_payloads(payload_rows(spark, sf_dir), failing_labeler), ["k"])


@query(
    "labels_in_row_order",
    """
SELECT CAST(d.doc_id AS VARCHAR) AS k, d.source AS product_area,
       coalesce(CASE WHEN l.toxic = 1 THEN 'TOXIC' WHEN l.doc_id IS NOT NULL THEN 'CLEAN' END, 'OTHER') AS complaint_category,
       CASE WHEN l.doc_id IS NULL THEN 'LLM_ERROR: empty llm row' END AS notes
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def labels_in_row_order(spark, sf_dir):
    rows = payload_rows(spark, sf_dir)
    known = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    filled = L.fallback_label(F.col("text"), F.col("source"), F.lit("")).withField(
        "complaint_category", F.when(F.col("toxic") == 1, "TOXIC").otherwise("CLEAN")
    ).withField("notes", F.lit(None).cast("string"))
    labels = known.select(F.col("doc_id").cast("string").alias("k"), filled.alias("label"))
    joined = labelling.attach_labels(rows, labels)
    return joined.select("k", "label.product_area", "label.complaint_category", "label.notes")
