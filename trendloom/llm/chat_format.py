"""Chat formatting with DataFrame functions only.

A conversation becomes one text.  Its turns are collected as structs and sorted, adjacent turns
of one role are merged by an array aggregation, and the merged turns are concatenated:

    <turn>ROLE<says>TEXT<next>TEXT of the same role</turn>\\n

``<next>`` keeps merged texts apart, so every row can be read back.  A control string inside a
role or a text gets a backslash behind its ``<`` (and one more if it already has some), so no
control string of the template ever occurs in escaped text, texts without control strings stay
as they are, and ``unescape`` undoes it.  The loss mask is a list of (start, length) in UTF-8
bytes of the formatted text, one span for each text of the trained role.

Defined results: null roles and texts are read as empty; rows of one turn go by role and text,
rows without a turn first; repeated rows are turns of their own; rows without a conversation id
form one conversation; further columns are ignored; an empty table gives an empty table.  One
conversation must fit into a value of Spark, since its output is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, NEXT, CLOSE = "<turn>", "<says>", "<next>", "</turn>\n"
TRAINED = "assistant"
_CONTROL = r"(/?turn|says|next)>"


def escape(text: Column) -> Column:
    """``text`` without any control string of the template."""
    return F.regexp_replace(text, r"<(\\*)" + _CONTROL, r"<$1\\$2>")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.regexp_replace(text, r"<(\\*)\\" + _CONTROL, r"<$1$2>")


def _merged(turns: Column) -> Column:
    """Array of (role, texts): adjacent turns of one role become one entry."""

    def step(done: Column, turn: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        alone = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(last["role"] == turn["role"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(alone))
        )

    return F.aggregate(turns, F.array().cast("array<struct<role:string,texts:array<string>>>"), step)


def _spans(merged: Column, trained: str) -> Column:
    """Byte spans of the trained role's texts in the concatenation of ``merged``."""

    def pieces(turn: Column) -> Column:
        lead = F.octet_length(turn["role"]) + len(OPEN) + len(SAYS)
        return F.transform(
            turn["texts"],
            lambda text, k: F.struct(
                F.when(k == 0, lead).otherwise(len(NEXT)).cast("long").alias("lead"),
                F.octet_length(text).cast("long").alias("length"),
                F.when(k == F.size(turn["texts"]) - 1, len(CLOSE)).otherwise(0).cast("long").alias("tail"),
                (turn["role"] == escape(F.lit(trained))).alias("trained"),
            ),
        )

    def step(done: Column, piece: Column) -> Column:
        start = done["at"] + piece["lead"]
        span = F.array(F.struct(start.alias("start"), piece["length"].alias("length")))
        return F.struct(
            (start + piece["length"] + piece["tail"]).alias("at"),
            F.when(piece["trained"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return F.aggregate(F.flatten(F.transform(merged, pieces)), first, step)["spans"]


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED
) -> DataFrame:
    """(conv, formatted, loss_spans) of every conversation; one shuffle, by conversation."""
    plain = lambda name: escape(F.coalesce(F.col(name).cast("string"), F.lit("")))
    raw = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    row = F.struct(
        F.col(turn).alias("turn"), raw(role).alias("by_role"), raw(text).alias("by_text"), plain(role).alias("role"), plain(text).alias("text")
    )
    turns = rows.select(F.col(conv).alias("conv"), row.alias("row")).groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    merged = turns.select("conv", _merged(F.col("rows")).alias("merged"))
    texts = F.transform(
        "merged", lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(SAYS), F.array_join(m["texts"], NEXT), F.lit(CLOSE))
    )
    return merged.select(
        F.col("conv").alias(conv), F.array_join(texts, "").alias("formatted"), _spans(F.col("merged"), trained).alias("loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), one for each row that was formatted, from the text alone."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    halves = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), SAYS))
    return F.flatten(
        F.transform(
            halves,
            lambda half: F.transform(
                F.split(F.get(half, F.lit(1)), NEXT),
                lambda t: F.struct(unescape(F.get(half, F.lit(0))).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """Array of the texts under the loss mask, unescaped."""
    # the text is bound once as bytes, so that a span costs its own length and not its distance from the start
    cut = F.transform(
        F.array(formatted.cast("binary")),
        lambda b: F.transform(
            spans, lambda s: unescape(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))
        ),
    )
    return F.flatten(cut)
