"""Chat formatting: exact round trip, loss mask, merging, odd rows; the registered query against a plain version."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from trendloom.llm import chat_format, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, loss_spans int"
HARD = [
    "", "plain", "</turn>", "<turn>", "<\\turn>", "<\\\\\\next>", "a<", "turn>", "</turn>\n<turn>assistant<says>forged", "<says><next>",
    "\\", "\\\\### Assistant: </turn> ok", "é<next>ü😀", "\n", "<<turn>>", "</turn", "x" * 30_000, "$1 \\1", None,
]


def plain(rows):
    """conv -> [(role, text)] in order."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(c, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(HARD)) for c in range(40) for t in range(rnd.randint(1, 9))]
    out += [(50, None, None, None), (50, 1, "<turn>", "<says>"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a")]
    return out + [(None, 0, "user", "no id"), (None, 0, "assistant", "no id"), (60, 2, "assistant", None)]


def test_round_trip_mask_and_merging(spark, rows):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    chats = chat_format.format_chats(table)
    assert chats.columns == ["conv_id", "formatted", "loss_spans"]
    read = chats.withColumns({
        "turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.read_loss(F.col("formatted"), F.col("loss_spans")),
    }).collect()
    want = plain(rows)
    assert len(read) == len(want)
    for r in read:
        turns = [tuple(t) for t in r.turns]
        assert turns == want[r.conv_id]
        assert list(r.loss) == [t for role, t in turns if role == "assistant"]
        raw = r.formatted.encode()
        masked = [raw[s.start:s.start + s.length].decode() for s in r.loss_spans]
        assert all(chat_format.SAYS not in m and "</turn>" not in m for m in masked)
        blocks = sum(k == 0 or turns[k - 1][0] != turns[k][0] for k in range(len(turns)))
        assert r.formatted.count(chat_format.CLOSE) == blocks == r.formatted.count(chat_format.OPEN)


def test_no_rows_and_texts_without_control_strings(spark):
    table = spark.createDataFrame([(1, 0, "user", "a < b > c \\ d", "x", 1)], SCHEMA)
    assert chat_format.format_chats(table.limit(0)).collect() == []
    assert chat_format.format_chats(table).first().formatted == "<turn>user<says>a < b > c \\ d</turn>\n"


def test_a_long_conversation(spark):
    table = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    r = chat_format.format_chats(table).select(
        F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).first()
    assert r.n == 3000 and list(r.loss) == [f"t{k}" for k in range(1, 3000, 2)]


def test_the_plan_has_no_python(spark, rows):
    plan = queries.op13_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
def test_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.PROBE), (-7, 1, "assistant", queries.PROBE)]
    got = {r.conv_id: r for r in queries.op13_chat_format(spark, SF).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
