"""Structure repair: the search against a plain search over all edits, chunks, the query against a plain version."""

import hashlib
import heapq
import os
import random
import re
import zlib

import pytest

from trendloom.llm import queries, structure_repair as sr

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, place int, kind int"
SF = "/root/testdata/sf0.001"
GOOD = re.compile("(s?(ua)+)?")


def plain_edits(rows):
    """(cost, edits, roles) by a shortest-path search over the written initials, with no automaton."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, written = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(written):
            return cost, edits
        seen = (i, written[:1] == "s", len(written) if len(written) < 2 else 2, written[-1:])
        if seen in done:
            continue
        done.add(seen)

        def go(price, letter, to, role, cost=cost, edits=edits, written=written):
            text = written + role
            if re.fullmatch("(s?(ua)*u?)?", text):
                heapq.heappush(heap, (cost + price, edits + letter, to, text))

        for role in "ua":
            go(3, "I", i, role)
        if i < len(rows):
            initial, fault = rows[i]
            go(4, "D", i + 1, "")
            if fault in (sr.FINE, sr.TRUNCATED):
                more = 3 if fault == sr.TRUNCATED else 0
                if initial:
                    go(more, "K", i + 1, initial)
                for role in "ua":
                    go(3 + more, "R", i + 1, role)
    raise AssertionError


def plain_repair(rows):
    """All results of the contract for the damaged rows [(turn, role, text)] of one conversation."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    rows = sorted(((t, " " if a is None else a, " " if b is None else b) for t, a, b in rows), key=lambda r: key(r))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        shown = re.findall("[^\x20\x09-\x0d]", text)
        if not shown:
            faults.append(sr.BLANK)
        elif (role, text) in seen:
            faults.append(sr.DUPLICATE)
        else:
            faults.append(sr.TRUNCATED if shown[-1] not in ".!?" else sr.FINE)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = plain_edits(list(zip(initials, faults)))
    out, k = [], 0
    for letter in audit:
        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((due, ""))
            continue
        _, role, text = rows[k]
        k += 1
        if letter != "D":
            out.append((role if letter == "K" else due, text))
    text = "\n".join(f"{a}:{b}" for a, b in out)
    counts = [faults.count(f) for f in (sr.BLANK, sr.DUPLICATE, sr.TRUNCATED)]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def draw(rnd, n):
    return [(rnd.choice(["s", "u", "a", "u", "a", "x", ""]), rnd.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_the_search_finds_the_least_of_the_cheapest():
    rnd = random.Random(11)
    for _ in range(1500):
        rows = draw(rnd, rnd.randint(0, 8))
        assert sr.cheapest_edits(rows) == plain_edits(rows)
    for rows in ([("s", 0)] * 40, [("a", 3)] * 40, [("u", 0)] * 41, draw(rnd, 60)):
        assert sr.cheapest_edits(rows) == plain_edits(rows)


def test_bounds_never_exceed_the_cost_and_are_close():
    rnd = random.Random(12)
    for _ in range(400):
        rows = draw(rnd, rnd.randint(0, 7))
        for entry in range(4):
            for exits in ((0,), (1,), (2,), (3,), (0, 3)):
                bound, best = sr.lower_bounds(rows, exits)[0][entry], sr.cheapest_edits(rows, entry, exits)
                assert (best is None) == (bound >= sr.NEVER)
                assert best is None or bound <= best[0] <= bound + 6


def test_chunks_chain_to_the_whole():
    rnd = random.Random(13)
    for _ in range(300):
        rows = draw(rnd, rnd.randint(1, 12))
        best = {sr.START: (0, "")}
        for at in range(0, len(rows), 3):
            after = {}
            for entry, out, cost, edits in sr.between_states(rows[at:at + 3]):
                if entry in best:
                    found = (best[entry][0] + cost, best[entry][1] + edits)
                    after[out] = min(found, after.get(out, found))
            best = after
        assert min(best[q] for q in sr.ACCEPTING if q in best) == plain_edits(rows)


def test_long_runs_are_searched_in_moderate_time():
    rnd = random.Random(14)
    rows = [(rnd.choice("sua"), rnd.choice([0, 0, 0, 1, 3])) for _ in range(20_000)]
    cost, audit = sr.cheapest_edits(rows)
    assert len(audit.replace("I", "")) == 20_000 and cost > 0
    assert sr.between_states(rows[:sr.CHUNK])


@pytest.fixture(scope="module")
def conversations():
    rnd = random.Random(15)
    texts = ["Yes.", "No", "", " \t", "What?", "a\x1c", "é!", "same.", "same.", None, "tail.  \n", "x" * 5000 + "."]
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 9)):
            role = ("user", "assistant")[turn % 2] if rnd.random() < 0.8 else rnd.choice(["system", "tool", None, "", "ux"])
            rows.append((conv, rnd.choice([turn, turn, turn, 2, None]), role, rnd.choice(texts)))
    rows += [(100, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(700)] + [(100, t, "user", "line 0.") for t in range(0, 700, 7)]
    rows += [(None, 0, "system", "Hi."), (None, 1, "system", "Hi."), (None, 1, "assistant", "Hi.")]
    rows += [(101, -(1 << 63), "user", "a."), (101, (1 << 63) - 1, "assistant", "b."), (102, None, None, None), (103, 1, "user", "Same?")]
    return rows + [(103, 1, "user", "Same?")] * 5


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


@pytest.mark.parametrize("chunk", [5, sr.CHUNK])
def test_tables_against_the_plain_version(spark, conversations, chunk):
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in conversations], SCHEMA).repartition(4)
    audits = sr.audit_structure(table, chunk=chunk).cache()
    turns = sr.repair_turns(table, audits)
    digests = {r.conv_id: r.sha256 for r in sr.turn_digests(turns).collect()}
    none = hashlib.sha256(b"").hexdigest()
    want = {c: plain_repair(rows) for c, rows in by_conversation(conversations).items()}
    want[101] = (None, *want[101][1:])
    assert {r.conv_id: (*tuple(r)[1:], digests.get(r.conv_id, none)) for r in audits.collect()} == want
    assert turns.columns == ["conv_id", "place", "edit", "role", "text"]
    for rows in by_conversation([(r.conv_id, r.place, r.role) for r in turns.collect()]).values():
        assert GOOD.fullmatch("".join(role[:1] for _, role in sorted(rows)))


def test_no_rows(spark):
    table = spark.createDataFrame([], SCHEMA)
    audits = sr.audit_structure(table)
    assert audits.collect() == [] and sr.turn_digests(sr.repair_turns(table, audits)).collect() == []


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def test_damage(spark, conversations):
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in conversations], SCHEMA)
    got = by_conversation([tuple(r) for r in sr.damage(table).collect()])
    want = {c: rows for c, rows in damaged(conversations).items() if rows}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert {c: sorted(rows, key=key) for c, rows in got.items()} == {c: sorted(rows, key=key) for c, rows in want.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
def test_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_structure_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {c: plain_repair(r) for c, r in damaged(rows).items()}
