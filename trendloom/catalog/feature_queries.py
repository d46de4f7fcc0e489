"""Vocabularies, TF-IDF weights, splits and label encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.catalog.bindings import SPACE, table
from trendloom.catalog.registry import query
from trendloom.catalog.text_queries import DENY, W, sql_clean
from trendloom.operators.features import VectorizerConfig
from trendloom.operators.splits import SplitConfig
from trendloom.functions import text as X
from trendloom.operators import features, splits
from trendloom.session import cut_lineage
from trendloom.catalog.bindings import spread

CFG = VectorizerConfig()


def clean_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return docs.select("doc_id", "lang", X.clean_for_model(F.col("text"), DENY).alias("text_clean"))


CLEAN = f"clean AS (SELECT doc_id, lang, array_to_string({sql_clean('text')}, ' ') AS text_clean FROM documents)"
WORD_GRAMS = rf"""
w AS (SELECT doc_id, lang, regexp_extract_all(lower(text_clean), '[{W}]{{2,}}') AS words FROM clean),
grams AS (
  SELECT doc_id, lang, unnest(words) AS term FROM w
  UNION ALL
  SELECT doc_id, lang, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w
)"""
CHAR_GRAMS = f"""
words AS (
  SELECT doc_id, lang, ' ' || word || ' ' AS w FROM (
    SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text_clean), '[{SPACE}]+')) AS word FROM clean)
  WHERE word <> ''
), sized AS (
  SELECT doc_id, lang, w, length(w) AS len, unnest([3, 4, 5]) AS n FROM words
), grams AS (
  SELECT doc_id, lang, substr(w, i, n) AS term
  FROM (SELECT doc_id, lang, w, n, unnest(range(1, greatest(1, len - n + 1) + 1)) AS i
        FROM sized WHERE n = 3 OR n <= len)
)"""


def _vocabulary(fit_on: str = "true", limit: int = 200_000) -> str:
    rows = f"(SELECT count(*) FROM clean WHERE {fit_on})"
    return f"""
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM grams GROUP BY doc_id, lang, term),
stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS docs FROM tf WHERE {fit_on} GROUP BY term),
vocab AS (
  SELECT term, n, docs, ln((1 + {rows}) / (1 + docs)) + 1 AS idf FROM stats
  WHERE docs >= 5 AND docs <= 0.6 * {rows} ORDER BY n DESC, term LIMIT {limit}
),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id),
weights AS (SELECT doc_id, term, w / norm AS weight FROM raw JOIN norms USING (doc_id))"""


PER_DOC = """
SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max
FROM weights GROUP BY doc_id"""


def per_document(long):
    return long.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.max("weight"), 6).alias("weight_max"),
    )


@query(
    "word_vocabulary",
    "WITH " + CLEAN + "," + WORD_GRAMS + "," + _vocabulary(limit=3000) + " SELECT term, n, docs FROM vocab",
)
def word_vocabulary(spark, sf_dir):
    docs = clean_documents(spark, sf_dir)
    terms = features.Vectorizer.with_words(docs.select("text_clean"), "text_clean", "terms", CFG).select("terms")
    return features.vocabulary(terms, "terms", CFG.min_df, CFG.max_df, 3000, docs.count())


@query(
    "word_tfidf",
    "WITH " + CLEAN + "," + WORD_GRAMS + "," + _vocabulary()
    + " SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
)
def word_tfidf(spark, sf_dir):
    docs = clean_documents(spark, sf_dir).drop("lang")
    docs = cut_lineage(features.Vectorizer.with_words(docs, "text_clean", "terms", CFG).drop("text_clean"))
    block = features.TermBlock.fit(docs, "terms", CFG.min_df, CFG.max_df, CFG.max_features_word)
    long = features.exploded_weights(docs, "terms", block, "doc_id")
    return long.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "char_tfidf",
    "WITH " + CLEAN + "," + CHAR_GRAMS + "," + _vocabulary(limit=120_000) + PER_DOC,
)
def char_tfidf(spark, sf_dir):
    docs = clean_documents(spark, sf_dir).drop("lang")
    docs = cut_lineage(features.Vectorizer.with_chars(docs, "text_clean", "terms", CFG).drop("text_clean"))
    block = features.TermBlock.fit(docs, "terms", CFG.min_df, CFG.max_df, CFG.max_features_char)
    return per_document(features.exploded_weights(docs, "terms", block, "doc_id"))


@query(
    "frozen_vocabulary_weights",
    "WITH " + CLEAN + "," + WORD_GRAMS + "," + _vocabulary(fit_on="lang = 'fr'") + PER_DOC,
)
def frozen_vocabulary_weights(spark, sf_dir):
    """Vocabulary of the French documents applied to all of them."""
    docs = clean_documents(spark, sf_dir)
    docs = cut_lineage(features.Vectorizer.with_words(docs, "text_clean", "terms", CFG).drop("text_clean"))
    block = features.TermBlock.fit(docs.filter("lang = 'fr'"), "terms", CFG.min_df, CFG.max_df, CFG.max_features_word)
    block = features.TermBlock.from_table(block.table(spark))
    return per_document(features.exploded_weights(docs, "terms", block, "doc_id"))


@query(
    "feature_block_sizes",
    "WITH " + CLEAN + "," + WORD_GRAMS + "," + _vocabulary()
    + ", per AS (SELECT doc_id, count(*) AS word_terms, round(sum(weight * weight), 6) AS word_norm FROM weights GROUP BY doc_id)"
    + " SELECT doc_id, coalesce(word_terms, 0) AS word_terms, coalesce(word_norm, 0) AS word_norm"
    + " FROM documents LEFT JOIN per USING (doc_id)",
)
def feature_block_sizes(spark, sf_dir):
    """Word part of the assembled vector: its unit length survives next to the character part."""
    docs = cut_lineage(clean_documents(spark, sf_dir))  # read three times; their terms, many times as large, are not written
    vectorizer = features.Vectorizer.fit(docs, "text_clean")
    both = vectorizer.transform(docs, "text_clean").select("doc_id", F.unwrap_udt("features").alias("v"))
    words = len(vectorizer.word.terms)
    # Indices ascend, so the word part is the front of the vector.
    front = F.size(F.filter("v.indices", lambda i: i < words))
    return both.select("doc_id", F.slice("v.values", F.lit(1), front).alias("w")).select(
        "doc_id", F.size("w").cast("bigint").alias("word_terms"),
        F.round(F.aggregate("w", F.lit(0.0), lambda a, w: a + w * w), 6).alias("word_norm"),
    )


# --- splits ------------------------------------------------------------------------------------

@query(
    "time_split",
    """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, md5(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR))
       > CAST(floor((SELECT count(*) FROM orders) * 0.8) AS BIGINT) AS is_validation
FROM orders""",
)
def time_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_orderdate").alias("event_time")
    )
    return splits.with_split(orders, SplitConfig()).select("o_orderkey", "is_validation")


@query(
    "window_split",
    """
SELECT o_orderkey, o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-06-30' AS is_validation
FROM orders""",
)
def window_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_orderdate").alias("event_time")
    )
    cfg = SplitConfig(val_from="1998-01-01", val_to="1998-06-30")
    return splits.with_split(orders, cfg).select("o_orderkey", "is_validation")


@query(
    "random_split",
    """
SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id)) <= CAST(ceil((SELECT count(*) FROM events) * 0.2) AS BIGINT) AS is_validation
FROM events""",
)
def random_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("row_id"))
    return splits.with_split(events, SplitConfig(mode="random")).select("event_id", "is_validation")


@query(
    "training_side",
    """
WITH s AS (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (ORDER BY o_orderdate, md5(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR)) AS rn FROM orders)
SELECT o_orderpriority, count(*) AS n FROM s WHERE rn <= CAST(floor((SELECT count(*) FROM orders) * 0.8) AS BIGINT) GROUP BY 1""",
)
def training_side(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_orderdate").alias("event_time")
    )
    side = splits.training_rows(splits.with_split(orders, SplitConfig()))
    return side.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "encoded_labels",
    """
SELECT p_partkey, p_type AS decoded, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS encoded FROM part""",
)
def encoded_labels(spark, sf_dir):
    from trendloom.operators.models import LabelCodes

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    codes = LabelCodes.fit(parts, "p_type")
    encoded = codes.encode(parts, "p_type", "encoded")
    return codes.decode(encoded, "encoded", "decoded").select("p_partkey", "decoded", "encoded")
