"""Joins, aggregates, orderings, metrics and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.catalog.bindings import (
    DIALOGS, TICKETS, WEAK, dialogs, sql_list, sql_strip, table, tickets, weak_labels,
)
from trendloom.catalog.label_queries import RULES, _any
from trendloom.catalog.registry import query
from trendloom.catalog.text_queries import DENY, sql_clean, sql_redact
from trendloom.functions import labels as L
from trendloom.functions import text as X
from trendloom.operators import joins, metrics, ordering, trends
from trendloom.sources import taxonomy as tax
from trendloom.catalog.bindings import spread

# --- the first slice: redact, clean, label by rule, rate per month ---------------------------


@query(
    "monthly_complaint_rate",
    "WITH " + TICKETS + f""", labelled AS (
  SELECT row_id, month, {_any(f"array_to_string({sql_clean(sql_redact('dialog_text'))}, ' ')", RULES.complaint_triggers)} AS bad
  FROM tickets)
SELECT month, round(avg(CAST(bad AS INTEGER)), 9) AS complaint_rate, count(row_id) AS n FROM labelled GROUP BY month""",
)
def monthly_complaint_rate(spark, sf_dir):
    cleaned = X.clean_for_model(X.redact(F.col("dialog_text")), DENY)
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    rows = tickets(spark, sf_dir, docs).select("row_id", "month", "product", "dialog_text")
    labelled = rows.select("row_id", "month", L.rule_label(cleaned, F.col("product"), RULES).alias("label"))
    rates = trends.monthly_rates(labelled.withColumn("is_complaint_llm", F.col("label.is_complaint")))
    return rates.withColumn("complaint_rate", F.round("complaint_rate", 9))


# --- aggregates ------------------------------------------------------------------------------

@query(
    "monthly_weak_rate",
    "WITH " + WEAK + """
SELECT month, round(avg(CAST(is_complaint_llm AS INTEGER)), 9) AS complaint_rate, count(row_id) AS n
FROM weak WHERE month IS NOT NULL GROUP BY month""",
)
def monthly_weak_rate(spark, sf_dir):
    rates = trends.monthly_rates(weak_labels(tickets(spark, sf_dir)))
    return rates.withColumn("complaint_rate", F.round("complaint_rate", 9))


@query(
    "month_category_counts",
    "WITH " + WEAK + """
SELECT month, complaint_category_llm, count(*) AS "count" FROM weak WHERE is_complaint_llm GROUP BY ALL""",
)
def month_category_counts(spark, sf_dir):
    return trends.month_category_counts(weak_labels(tickets(spark, sf_dir)))


@query(
    "top_types",
    'SELECT p_type, count(*) AS "count" FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IS NOT NULL '
    "GROUP BY p_type ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_types(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return trends.top_values(lines.join(parts, lines.l_partkey == parts.p_partkey), "p_type", 10)


@query("event_type_counts", 'SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type')
def event_type_counts(spark, sf_dir):
    return trends.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    "event_type_shares",
    "SELECT event_type, round(count(*) / (SELECT count(*) FROM events), 9) AS type_share FROM events GROUP BY event_type",
)
def event_type_shares(spark, sf_dir):
    shares = trends.value_shares(table(spark, sf_dir, "events"), "event_type", "type_share")
    return shares.withColumn("type_share", F.round("type_share", 9))


DELTAS = """
base AS (SELECT complaint_category_llm AS category FROM weak WHERE month BETWEEN '1995-01' AND '1997-12' AND is_complaint_llm),
new AS (SELECT lang AS category FROM weak WHERE month = '1998-05' AND is_complaint_llm
        UNION ALL SELECT complaint_category_llm FROM weak WHERE month = '1998-06' AND is_complaint_llm),
b AS (SELECT category, count(*) / (SELECT count(*) FROM base) AS s FROM base GROUP BY category),
n AS (SELECT category, count(*) / (SELECT count(*) FROM new) AS s FROM new GROUP BY category)"""


@query(
    "category_share_deltas",
    "WITH " + WEAK + ", " + DELTAS + """
SELECT coalesce(b.category, n.category) AS category, round(coalesce(b.s, 0), 9) AS baseline_share,
       round(coalesce(n.s, 0), 9) AS new_share, round((coalesce(n.s, 0) - coalesce(b.s, 0)) * 100, 7) AS delta_pp
FROM b FULL OUTER JOIN n ON b.category = n.category""",
)
def category_share_deltas(spark, sf_dir):
    from trendloom.operators.prepare import complaints, month_range

    rows = complaints(weak_labels(tickets(spark, sf_dir)))
    base = month_range(rows, "1995-01..1997-12")
    new = ordering.union_all([
        rows.filter(F.col("month") == "1998-05").select(F.col("lang").alias("category_pred")),
        rows.filter(F.col("month") == "1998-06").select(F.col("complaint_category_llm").alias("category_pred")),
    ])
    out = trends.share_deltas(base, "complaint_category_llm", new, "category_pred")
    return out.select(
        "category", F.round("baseline_share", 9).alias("baseline_share"), F.round("new_share", 9).alias("new_share"),
        F.round("delta_pp", 7).alias("delta_pp"),
    )


@query(
    "overall_totals",
    """
SELECT count(*) AS rows_total, count(*) FILTER (event_type = 'error') AS rows_complaints,
       round(avg(CAST(event_type = 'error' AS INTEGER)), 9) AS complaint_share FROM events""",
)
def overall_totals(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("flag"))
    return trends.totals(events, "flag").withColumn("complaint_share", F.round("complaint_share", 9))


@query(
    "blank_text_shares",
    "WITH " + DIALOGS + f"""
SELECT round(avg(CAST({sql_strip("coalesce(line2, '')")} = '' AS INTEGER)), 9) AS empty_dialog_share,
       round(avg(CAST({sql_strip("coalesce(line3, ' ')")} = '' AS INTEGER)), 9) AS empty_client_message_share
FROM dialogs""",
)
def blank_text_shares(spark, sf_dir):
    out = trends.blank_shares(dialogs(spark, sf_dir), "line2", "line3")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "unknown_subcategory_share",
    "WITH " + WEAK + """
SELECT round(avg(CASE WHEN status = 'F' AND channel = '2-HIGH' THEN 1 ELSE 0 END), 9) AS subcategory_unknown_share
FROM weak""",
)
def unknown_subcategory_share(spark, sf_dir):
    rows = weak_labels(tickets(spark, sf_dir)).withColumn(
        "complaint_subcategory_llm",
        F.when((F.col("status") == "F") & (F.col("channel") == "2-HIGH"), fv.UNKNOWN).otherwise(
            F.col("complaint_subcategory_llm")
        ),
    )
    out = trends.unknown_share(rows)
    return out.select(F.round("subcategory_unknown_share", 9).alias("subcategory_unknown_share"))


@query(
    "daily_variety",
    """
SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(DISTINCT event_type) AS category_count,
       count(DISTINCT CAST(user_id AS VARCHAR)) AS subcategory_count
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY 1""",
)
def daily_variety(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("ts").cast("string").alias("event_time"), "event_type", F.col("user_id").cast("string").alias("user")
    )
    return trends.daily_variety(events, "event_type", "user", "2024-01-05", "2024-01-25 12:00:00")


@query(
    "first_category_per_subcategory",
    """
SELECT CAST(user_id AS VARCHAR) AS sub, arg_min(event_type, event_id) AS category
FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
)
def first_category_per_subcategory(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sub"), F.col("event_type").alias("category"), "event_id"
    )
    return trends.first_category(events, "category", "sub", "event_id")


@query(
    "novel_topic_sizes",
    """
SELECT label AS cluster_id, count(*) AS "count" FROM embeddings WHERE embedding[1] > 0 GROUP BY label HAVING count(*) >= 20""",
)
def novel_topic_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("cluster_id"), (F.get("embedding", F.lit(0)) > 0).alias("is_novel")
    )
    return trends.topic_sizes(rows, 20)


# --- joins -----------------------------------------------------------------------------------

def gold(spark, sf_dir):
    quality, toxic = F.col("quality").cast("string"), F.col("toxic")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("row_id"),
        F.when(toxic == 1, "").otherwise(quality).alias("is_complaint_gold"),
        F.when(toxic == 1, "TOXIC").when(F.col("quality") == 1, "").alias("category_gold"),
    )


GOLD = """
gold AS (
  SELECT CAST(doc_id AS VARCHAR) AS row_id, CASE WHEN toxic = 1 THEN '' ELSE CAST(quality AS VARCHAR) END AS is_complaint_gold,
         CASE WHEN toxic = 1 THEN 'TOXIC' WHEN quality = 1 THEN '' END AS category_gold
  FROM labels
)"""


@query(
    "gold_labels_joined",
    "WITH " + WEAK + ", " + GOLD + """
SELECT w.row_id, w.is_complaint_llm, g.is_complaint_gold, g.category_gold FROM weak w LEFT JOIN gold g ON w.row_id = g.row_id""",
)
def gold_labels_joined(spark, sf_dir):
    joined = joins.with_gold(weak_labels(tickets(spark, sf_dir)), gold(spark, sf_dir))
    return joined.select("row_id", "is_complaint_llm", "is_complaint_gold", "category_gold")


@query(
    "gold_override",
    "WITH " + WEAK + ", " + GOLD + """
SELECT w.row_id, coalesce(TRY_CAST(nullif(is_complaint_gold, '') AS BOOLEAN), is_complaint_llm) AS y_bin,
       coalesce(nullif(category_gold, ''), complaint_category_llm) AS y_cat
FROM weak w LEFT JOIN gold g ON w.row_id = g.row_id""",
)
def gold_override(spark, sf_dir):
    joined = joins.with_gold(weak_labels(tickets(spark, sf_dir)), gold(spark, sf_dir))
    return joins.with_targets(joined).select("row_id", "y_bin", "y_cat")


def shop_taxonomy(spark, sf_dir):
    """Nations as subcategories of their regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("category"), F.col("n_name").alias("code"), F.lower("n_name").alias("label")
    )


SHOP = """
taxonomy AS (
  SELECT r_name AS category, n_name AS code, lower(n_name) AS label FROM nation JOIN region ON n_regionkey = r_regionkey
),
routed AS (
  SELECT c_custkey, (SELECT r_name FROM region WHERE r_regionkey = c_custkey % 5) AS cat,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN 'NOT_COMPLAINT'
              WHEN c_acctbal < 0 THEN NULL ELSE n_name END AS sub
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
)"""


def routed(spark, sf_dir):
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    sub = (
        F.when(F.col("c_mktsegment") == "BUILDING", "").when(F.col("c_mktsegment") == "MACHINERY", fv.NOT_COMPLAINT)
        .when(F.col("c_acctbal") < 0, None).otherwise(F.col("n_name"))
    )
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, customer.c_custkey % 5 == region.r_regionkey, "left")
        .select("c_custkey", F.col("r_name").alias("cat"), sub.alias("sub"))
    )


@query(
    "taxonomy_for_training",
    "WITH " + SHOP + """
SELECT c_custkey, cat, CASE WHEN t.code IS NOT NULL THEN sub ELSE 'UNKNOWN' END AS sub
FROM routed r LEFT JOIN taxonomy t ON r.cat = t.category AND r.sub = t.code""",
)
def taxonomy_for_training(spark, sf_dir):
    return joins.training_subcategories(routed(spark, sf_dir), shop_taxonomy(spark, sf_dir), "cat", "sub")


@query(
    "taxonomy_for_scoring",
    "WITH " + SHOP + """
SELECT c_custkey, cat, CASE WHEN t.code IS NOT NULL OR sub IN ('NOT_COMPLAINT', 'UNKNOWN') THEN sub ELSE 'UNKNOWN' END AS sub
FROM routed r LEFT JOIN taxonomy t ON r.cat = t.category AND r.sub = t.code""",
)
def taxonomy_for_scoring(spark, sf_dir):
    return joins.scored_subcategories(routed(spark, sf_dir), shop_taxonomy(spark, sf_dir), "cat", "sub")


@query(
    "labels_looked_up",
    "WITH " + SHOP + """
SELECT c_custkey, coalesce(t.label, r.sub) AS sub_label, coalesce(lower(g.r_name), r.cat) AS cat_label
FROM routed r LEFT JOIN taxonomy t ON r.cat = t.category AND r.sub = t.code
LEFT JOIN region g ON r.cat = g.r_name AND g.r_regionkey < 3""",
)
def labels_looked_up(spark, sf_dir):
    categories = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(
        F.col("r_name").alias("code"), F.lower("r_name").alias("label")
    )
    rows = joins.with_subcategory_label(routed(spark, sf_dir), shop_taxonomy(spark, sf_dir), "cat", "sub", "sub_label")
    return joins.with_code_label(rows, categories, "cat", "cat_label").select("c_custkey", "sub_label", "cat_label")


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + sql_list(r) + ")" for r in rows) + ")"


@query(
    "ticket_taxonomy_coverage",
    f"""
WITH t AS (SELECT * FROM {_values(tax.Taxonomy.default().subcategories)} AS v(category, code, label)),
coded AS (
  SELECT e.event_id, t.category, CASE WHEN e.event_type = 'error' THEN e.event_type ELSE t.code END AS code
  FROM events e JOIN (SELECT *, row_number() OVER (ORDER BY category, code) - 1 AS i FROM t) t
    ON e.user_id % (SELECT count(*) FROM t) = t.i
)
SELECT c.category, coalesce(t.label, c.code) AS label, count(*) AS n
FROM coded c LEFT JOIN t ON c.category = t.category AND c.code = t.code GROUP BY ALL""",
)
def ticket_taxonomy_coverage(spark, sf_dir):
    taxonomy = tax.Taxonomy.default()
    subs = taxonomy.subcategory_table(spark)
    numbered = spark.createDataFrame(
        [(i, c, s) for i, (c, s, _) in enumerate(sorted(taxonomy.subcategories))], "i long, category string, code string"
    )
    events = table(spark, sf_dir, "events").withColumn("i", F.col("user_id") % len(taxonomy.subcategories))
    coded = events.join(joins.broadcast_if_small(numbered), "i").withColumn(
        "code", F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("code"))
    )
    labelled = joins.with_subcategory_label(coded, subs, "category", "code", "label")
    return labelled.groupBy("category", "label").agg(F.count("*").alias("n"))


# --- set operations and order -------------------------------------------------------------------

@query(
    "token_set_union",
    f"""
SELECT lower({sql_strip('lang')}) AS token FROM documents UNION SELECT lower({sql_strip('source')}) FROM documents
UNION SELECT lower({sql_strip('p_brand')}) FROM part""",
)
def token_set_union(spark, sf_dir):
    docs, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    return tax.token_union(
        tax.normal_tokens(docs, "lang"), tax.normal_tokens(docs, "source"), tax.normal_tokens(part, "p_brand")
    )


@query(
    "months_in_order",
    "WITH " + WEAK + """, m AS (SELECT month, count(*) AS n FROM weak GROUP BY month)
SELECT month, n, row_number() OVER (ORDER BY month) AS place FROM m""",
)
def months_in_order(spark, sf_dir):
    months = trends.value_counts(tickets(spark, sf_dir), "month", "n")
    placed = ordering.running_total(months.withColumn("_one", F.lit(1)), ["month"], "_one", "_before")
    return placed.select("month", "n", (F.col("_before") + 1).alias("place")).orderBy("month")


@query(
    "first_complaints",
    "WITH " + WEAK + """
SELECT row_id, month, complaint_category_llm FROM weak WHERE is_complaint_llm ORDER BY doc_id LIMIT 30""",
)
def first_complaints(spark, sf_dir):
    from trendloom.operators.prepare import complaints, pilot_rows

    rows = pilot_rows(complaints(weak_labels(tickets(spark, sf_dir))), 30, ["doc_id"])
    return rows.select("row_id", "month", "complaint_category_llm")


@query(
    "month_over_month_rate",
    "WITH " + WEAK + """, m AS (
  SELECT month, avg(CAST(is_complaint_llm AS INTEGER)) AS r, count(*) AS n FROM weak GROUP BY month)
SELECT m.month, m.n, round(m.r, 9) AS complaint_rate, round(p.r, 9) AS previous_complaint_rate,
       round(m.r - p.r, 9) AS complaint_rate_change
FROM m LEFT JOIN m p ON p.month = strftime(strptime(m.month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m')""",
)
def month_over_month_rate(spark, sf_dir):
    rates = trends.monthly_rates(weak_labels(tickets(spark, sf_dir)))
    out = trends.month_over_month(rates, "complaint_rate")
    return out.select("month", "n", *[F.round(c, 9).alias(c) for c in out.columns if c.endswith(("rate", "change"))])


@query(
    "month_over_month_category",
    "WITH " + WEAK + """, m AS (
  SELECT month, complaint_category_llm, count(*) AS "count" FROM weak WHERE is_complaint_llm GROUP BY ALL),
ends AS (SELECT min(strptime(month || '-01', '%Y-%m-%d')) AS lo, max(strptime(month || '-01', '%Y-%m-%d')) AS hi FROM m),
months AS (SELECT strftime(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM ends),
f AS (
  SELECT g.month, c.complaint_category_llm, coalesce(m."count", 0) AS "count"
  FROM months g CROSS JOIN (SELECT DISTINCT complaint_category_llm FROM m) c
  LEFT JOIN m ON m.month = g.month AND m.complaint_category_llm = c.complaint_category_llm)
SELECT f.*, coalesce(p."count", 0) AS previous_count, f."count" - coalesce(p."count", 0) AS count_change
FROM f LEFT JOIN f p ON p.complaint_category_llm = f.complaint_category_llm
  AND p.month = strftime(strptime(f.month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m')""",
)
def month_over_month_category(spark, sf_dir):
    counts = trends.month_category_counts(weak_labels(tickets(spark, sf_dir)))
    return trends.month_over_month(counts, "count", "complaint_category_llm", absent=0)


# --- metrics --------------------------------------------------------------------------------------

@query(
    "scaled_margins",
    """
SELECT event_id, round((value - (SELECT min(value) FROM events))
       / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events) + 1e-9), 9) AS complaint_score FROM events""",
)
def scaled_margins(spark, sf_dir):
    scaled = metrics.min_max_scaled(table(spark, sf_dir, "events").select("event_id", "value"), "value", "complaint_score")
    return scaled.select("event_id", F.round("complaint_score", 9).alias("complaint_score"))


@query(
    "balanced_class_weights",
    """
SELECT event_type, round((SELECT count(*) FROM events) / ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 9) AS weight
FROM events GROUP BY event_type""",
)
def balanced_class_weights(spark, sf_dir):
    out = metrics.class_weights(table(spark, sf_dir, "events"), "event_type")
    return out.select("event_type", F.round("weight", 9).alias("weight"))


SCORES = """
pairs AS (SELECT CAST(quality AS VARCHAR) AS y, CASE WHEN toxic = 1 THEN '2' WHEN n_chars > 1500 THEN '1' ELSE '0' END AS p
          FROM labels JOIN documents USING (doc_id)),
seen AS (SELECT y AS label FROM pairs UNION SELECT p FROM pairs),
scores AS (
  SELECT label, (SELECT count(*) FROM pairs WHERE y = label AND p = label) AS hits,
         (SELECT count(*) FROM pairs WHERE y = label) AS support, (SELECT count(*) FROM pairs WHERE p = label) AS guessed
  FROM seen),
s AS (
  SELECT label, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rc,
         CASE WHEN support + guessed > 0 THEN 2 * hits / (support + guessed) ELSE 0 END AS f1, support, hits FROM scores)"""


def guesses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    guess = F.when(F.col("toxic") == 1, "2").when(F.col("n_chars") > 1500, "1").otherwise("0")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").cast("string").alias("y"), guess.alias("p"))


@query(
    "classification_report",
    "WITH " + SCORES + """
SELECT label, round(pr, 9) AS precision, round(rc, 9) AS recall, round(f1, 9) AS f1_score, support FROM s
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 9), round(sum(hits) / sum(support), 9),
                 round(sum(hits) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(pr), 9), round(avg(rc), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 9), round(sum(rc * support) / sum(support), 9),
                 round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM s""",
)
def classification_report(spark, sf_dir):
    out = metrics.classification_report(guesses(spark, sf_dir), "y", "p")
    return out.select("label", "support", *[F.round(m, 9).alias(m) for m in ("precision", "recall", "f1_score")])


@query(
    "binary_f1",
    """
SELECT round(2 * count(*) FILTER (quality = 1 AND n_chars > 1500)
       / (count(*) FILTER (quality = 1) + count(*) FILTER (n_chars > 1500)), 9) AS f1
FROM labels JOIN documents USING (doc_id)""",
)
def binary_f1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        (F.col("quality") == 1).alias("y"), (F.col("n_chars") > 1500).alias("p")
    )
    return metrics.binary_f1(rows, "y", "p").select(F.round("f1", 9).alias("f1"))


@query("macro_f1", "WITH " + SCORES + " SELECT round(avg(f1), 9) AS f1 FROM s")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(guesses(spark, sf_dir), "y", "p").select(F.round("f1", 9).alias("f1"))
