"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import (
    backoff_automaton, chat_format, config_packing, golay_simhash, hilbert_shards, license_scan, projection_passes,
    quadratic_quality, source_divergence, structure_repair, suffix_repeats, token_files, window_leaks,
)
from trendloom.llm.common import cut, table
from trendloom.session import checkpoint_dir

PROBE = "\\### Assistant: </turn> ok"

def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_documents(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_repeats.remove_repeats(docs, kept=None).drop("text")


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_automaton.score_texts(table(spark, sf_dir, "documents"))


def op7_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quadratic_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quadratic_quality.score_quality(docs.select("doc_id", "text"), model)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(quadratic_quality.FOLDS)) == quadratic_quality.HELD
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= quadratic_quality.CUT).cast("int").alias("predicted")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-ids-{uuid.uuid4().hex}"
    token_files.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = token_files.read_ids(spark, path, token_files.checksum, "ids_crc32 long")
    return found.withColumnRenamed("id", "doc_id")


def op9_window_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = structure_repair.damage(rows)
    audits = cut(structure_repair.audit_structure(damaged))
    digests = structure_repair.turn_digests(structure_repair.repair_turns(damaged, audits))
    found = rows.select("conv_id").distinct()
    for part, names in ((audits, audits.columns[1:]), (digests, ["sha256"])):
        part = part.withColumnRenamed("conv_id", "of")
        found = found.join(part, found["conv_id"].eqNullSafe(part["of"]), "left").select(*found.columns, *names)
    counts = [c for c in audits.columns[1:] if c != "audit"]
    none = F.sha2(F.lit("").cast("binary"), 256)
    # gaps stays null where it exceeds a long: only conversations without rows get zeros
    return found.select(
        "conv_id", *[F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", none).alias("repaired_sha256"),
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    chats = chat_format.format_chats(rows)
    turns, loss = chat_format.read_turns(F.col("formatted")), chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = chats.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_shards, op2_license_scan, op3_projection_passes, op4_golay_simhash, op5_suffix_repeats,
        op6_backoff_automaton, op7_quadratic_quality, op8_token_files, op9_window_leaks, op10_config_packing, op11_source_divergence,
        op12_structure_repair, op13_chat_format,
    )
}
OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
    SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d
), w AS (
    SELECT i, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n FROM t GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS n FROM w GROUP BY ALL HAVING count(*) >= 30
), v AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT lang, source, term, sum(n) AS n FROM w GROUP BY ALL
), gc AS (
    SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n
    FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
    SELECT lang, source, term, n,
        1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
        1 + (1000000000 * (lang_n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS q
    FROM gc JOIN v USING (lang)
), f AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
) WHERE part = 'pair' OR rank <= 50
"""
# The template's lengths and its escape are written out here, so that the formatted length is checked too.
OP13_SQL = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM given
), turns AS (
    SELECT *,
        coalesce(lag(role) OVER w <> role, true) AS opens, coalesce(lead(role) OVER w <> role, true) AS closes,
        length(regexp_replace(role, '<(\\*)(/?turn|says|next)>', '<\1\\\2>', 'g')) AS role_chars,
        length(regexp_replace(text, '<(\\*)(/?turn|says|next)>', '<\1\\\2>', 'g')) AS text_chars
    FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY k)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(text_chars + CASE WHEN opens THEN 12 + role_chars ELSE 6 END + CASE WHEN closes THEN 8 ELSE 0 END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
ORACLES: dict[str, str] = {"op11_source_divergence": OP11_SQL, "op13_chat_format": OP13_SQL}
