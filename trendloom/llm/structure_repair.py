"""Structure of conversations: faults, the cheapest repair and the repaired turns.

A repair is a sequence of edits over a conversation's rows: Keep (0), Rerole to user or assistant
(3), Delete (4; the only edit of blank and duplicate rows) and Insert an empty turn (3, anywhere);
a truncated row that stays adds 3.  The initials of the roles that result must read
``(s?(ua)+)?``.  Wanted are the least cost and, among its edit sequences, the ASCII-least.

The search is iterative-deepening A*: depth-first in ASCII order of the edits under a cost bound
that grows by one, pruned by a lower bound of the cost that is left, with a table of (row, state)
and the budget that failed there, kept over the rounds.  The first accepting path is the answer.
The lower bound is the exact cost of an automaton that takes "after system" and "after assistant"
for one state; it is at most two inserts too low, so a few rounds are enough at any length.

Rows go in order of (turn, role, SHA-256 of the text), null turns first.  Only facts of a few
bytes are sorted for the search, by range, so a hot conversation is spread over tasks and
searched in chunks: a chunk yields the best edits from every state to every state, and
chunks are chained in order (of two cheapest sequences between two states neither is a prefix of
the other, so the least of a chain is a chain of least ones).  Texts move once, to apply the edits.

Defined results: null roles and texts are read as one space; equal rows of one turn are
duplicates of the first; rows without a conversation id form one conversation; further columns
are ignored; an empty table gives an empty table.  A conversation's edits are one text, so it must
have fewer than 2**31 of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import cut, small, tidy

START, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
ACCEPTING = (START, ASSISTANT)
CHUNK = 1024
NEVER = 1 << 60
_KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_WRITE = (USER, USER, ASSISTANT, USER)  # the state that an inserted or reroled turn leads to
_NAMES = {USER: "user", ASSISTANT: "assistant"}
Row = tuple[str, int]  # initial of the role, fault


# --- search over one run of rows ----------------------------------------------------------------

def _moves(rows: list[Row], i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, next row, next state, cost) of the edits that are possible here, in ASCII order."""
    written = _WRITE[state]
    if i == len(rows):
        yield "I", i, written, INSERT
        return
    initial, fault = rows[i]
    yield "D", i + 1, state, DELETE
    yield "I", i, written, INSERT
    if fault in (FINE, TRUNCATED):
        more = UNFINISHED if fault == TRUNCATED else 0
        if (kept := _KEEP.get((initial, state))) is not None:
            yield "K", i + 1, kept, more
        yield "R", i + 1, written, REROLE + more


def lower_bounds(rows: list[Row], exits: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For every row number and state a cost that no way from there to ``exits`` goes below.

    Nothing leads back to START or SYSTEM, so if only these are exits the costs are exact: all
    rows go, but for one system row.
    """
    n = len(rows)
    if ASSISTANT not in exits and USER not in exits:
        at = (0 if START in exits else NEVER, 0 if SYSTEM in exits else NEVER)
        out = [(*at, NEVER, NEVER)]
        for initial, fault in reversed(rows):
            begin = DELETE + at[0]
            if initial == "s" and fault in (FINE, TRUNCATED):
                begin = min(begin, (UNFINISHED if fault == TRUNCATED else 0) + at[1])
            at = (min(begin, NEVER), min(DELETE + at[1], NEVER))
            out.append((*at, NEVER, NEVER))
        return out[::-1]

    def with_inserts(begin: int, user: int, between: int) -> tuple[int, int, int]:
        user, between = min(user, INSERT + between), min(between, INSERT + user)
        return min(begin, INSERT + user), user, between

    begin, user, between = with_inserts(
        0 if START in exits else NEVER, 0 if USER in exits else NEVER, 0 if ASSISTANT in exits or SYSTEM in exits else NEVER
    )
    out = [(begin, between, user, between)]
    for k in range(n - 1, -1, -1):
        initial, fault = rows[k]
        b, u, x = DELETE + begin, DELETE + user, DELETE + between
        if fault in (FINE, TRUNCATED):
            more = UNFINISHED if fault == TRUNCATED else 0
            b, u, x = min(b, REROLE + more + user), min(u, REROLE + more + between), min(x, REROLE + more + user)
            if initial == "s":
                b = min(b, more + between)
            elif initial == "u":
                b, x = min(b, more + user), min(x, more + user)
            elif initial == "a":
                u = min(u, more + between)
        begin, user, between = with_inserts(b, u, x)
        out.append((begin, between, user, between))
    return out[::-1]


def _within(rows: list[Row], entry: int, exits: tuple[int, ...], bound: int, least: list, failed: dict) -> str | None:
    """The ASCII-least edits of cost ``bound`` at most, or None."""
    n = len(rows)
    if n == 0 and entry in exits:
        return ""
    i, state, left, moves = 0, entry, bound, _moves(rows, 0, entry)
    above, path = [], []
    while True:
        for letter, to, then, cost in moves:
            rest = left - cost
            if least[to][then] <= rest and failed.get((to, then), -1) < rest:
                above.append((i, state, left, moves))
                path.append(letter)
                if to == n and then in exits:
                    return "".join(path)
                i, state, left, moves = to, then, rest, _moves(rows, to, then)
                break
        else:
            failed[i, state] = max(left, failed.get((i, state), -1))
            if not above:
                return None
            i, state, left, moves = above.pop()
            path.pop()


def cheapest_edits(rows: list[Row], entry: int = START, exits: tuple[int, ...] = ACCEPTING) -> tuple[int, str] | None:
    """(cost, edits) of the best way from ``entry`` over ``rows`` to one of ``exits``, or None."""
    least = lower_bounds(rows, exits)
    bound, failed = least[0][entry], {}
    while bound < NEVER:
        found = _within(rows, entry, exits, bound, least, failed)
        if found is not None:
            return bound, found
        bound += 1
    return None


def between_states(rows: list[Row]) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, edits) for every pair of states that ``rows`` can lead through."""
    found = []
    for entry in range(4):
        for exit_ in range(4):
            best = cheapest_edits(rows, entry, (exit_,))
            if best is not None:
                found.append((entry, exit_, *best))
    return found


# --- facts of the rows ----------------------------------------------------------------------------

def _texts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, digest, text) of every row, null role and text read as one space."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text"),
    )


def row_facts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, digest, n, fault): equal rows of a turn are one row with their number ``n``.

    ``fault`` is that of the first of them; the others are blank too, or duplicates.
    """
    full = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = ~F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")
    facts = _texts(rows, conv, turn, role, text).select("conv", "turn", "role", "digest", full.alias("full"), ended.alias("ended"))
    facts = cut(facts.groupBy("conv", "turn", "role", "digest", "full", "ended").agg(F.count("*").alias("n")))
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    seen = facts.groupBy("conv", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("turns"))
    seen = seen.filter("turns > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    joined = facts.join(seen, same, "left")
    later = F.col("first").isNotNull() & (when != F.col("first"))
    fault = F.when(~F.col("full"), BLANK).when(later, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(FINE)
    return cut(joined.select("conv", "turn", "role", "digest", "n", fault.alias("fault")))


# --- pieces of conversations and their chain -----------------------------------------------------

_PIECE = (
    "part int, piece long, first string, last string, blank long, duplicate long, truncated long, illegal long, "
    "ways array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
)
_AUDIT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _summary(rows: list[Row], whole: bool) -> dict:
    """What later steps need of one run of rows: counts, edge initials, best edits between states."""
    count = [0] * 4
    for _, fault in rows:
        count[fault] += 1
    if whole:
        cost, audit = cheapest_edits(rows)
        ways = [(START, ASSISTANT, cost, audit)]
    else:
        ways = between_states(rows)
    return {
        "first": rows[0][0], "last": rows[-1][0], "blank": count[BLANK], "duplicate": count[DUPLICATE], "truncated": count[TRUNCATED],
        "illegal": sum((a[0], b[0]) not in _LEGAL for a, b in zip(rows, rows[1:])),
        "ways": [dict(zip(("entry", "exit", "cost", "audit"), w)) for w in ways],
    }


def _pieces(facts: DataFrame, chunk: int) -> DataFrame:
    """One row for each conversation, or chunk of it, of every range-sorted partition.

    A conversation that neither begins nor ends its partition is whole there.
    """
    order = ("conv", "turn", "role", "digest")
    placed = facts.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    kind = facts.schema["conv"].dataType.simpleString()

    @tidy
    def run(batches):
        part = TaskContext.get().partitionId()
        # at the edge: the conversation opens the partition, was cut before, or closes the partition
        held, current, edge, number, conv_type = [], None, True, 0, pa.null()

        def piece(whole: bool) -> pa.RecordBatch:
            nonlocal number
            number += 1
            row = {"conv": current, "part": part, "piece": number, **_summary(held, whole)}
            return pa.RecordBatch.from_pydict({
                k: pa.array([v], conv_type if k == "conv" else _types[k]) for k, v in row.items()
            })

        begun = False
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            columns = (batch.column(c).to_pylist() for c in ("conv", "initial", "fault", "n"))
            for conv, initial, fault, n in zip(*columns):
                if begun and conv != current:
                    if held:
                        yield piece(not edge)
                    held, edge = [], False
                begun, current = True, conv
                for k in range(n):
                    held.append((initial, fault if k == 0 or fault == BLANK else DUPLICATE))
                    if len(held) == chunk:
                        edge = True
                        yield piece(False)
                        held = []
        if held:
            yield piece(False)

    return placed.mapInArrow(run, f"conv {kind}, {_PIECE}")


_types = {
    "part": pa.int32(), "piece": pa.int64(), "first": pa.string(), "last": pa.string(), "blank": pa.int64(), "duplicate": pa.int64(),
    "truncated": pa.int64(), "illegal": pa.int64(),
    "ways": pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
}


def _chain(pieces: DataFrame) -> DataFrame:
    """(conv, counts, cost, audit) of every conversation from its pieces in order."""
    placed = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    kind = pieces.schema["conv"].dataType.simpleString()
    counts = ("blank", "duplicate", "truncated", "illegal")

    @tidy
    def run(batches):
        best, total, last, current, conv_type = {}, [0] * 4, None, None, pa.null()

        def result() -> pa.RecordBatch:
            cost, audit = min(best[q] for q in ACCEPTING if q in best)
            row = {"conv": pa.array([current], conv_type), **{c: pa.array([v], pa.int64()) for c, v in zip(counts, total)}}
            return pa.RecordBatch.from_pydict({**row, "cost": pa.array([cost], pa.int64()), "audit": pa.array([audit], pa.string())})

        for batch in small(batches):
            conv_type = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if best and row["conv"] != current:
                    yield result()
                    best = {}
                if not best:
                    best, total, last, current = {START: (0, "")}, [0] * 4, None, row["conv"]
                total = [have + row[c] for have, c in zip(total, counts)]
                total[3] += last is not None and (last, row["first"]) not in _LEGAL
                last, after = row["last"], {}
                for way in row["ways"]:
                    if way["entry"] in best:
                        cost, audit = best[way["entry"]]
                        found = (cost + way["cost"], audit + way["audit"])
                        after[way["exit"]] = min(found, after.get(way["exit"], found))
                best = after
        if best:
            yield result()

    return placed.mapInArrow(run, f"conv {kind}, {_AUDIT}")


def audit_structure(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows.

    ``gaps``: turn numbers missing between the first and the last (null if that exceeds a long).
    ``illegal``: adjacent rows whose initials are none of su, ua, au.  ``audit``: initials of the edits.
    """
    facts = row_facts(rows, conv, turn, role, text)
    audits = cut(_chain(cut(_pieces(facts, chunk))))
    number = F.col("turn").cast("decimal(20,0)")
    span = F.max(number) - F.min(number) + 1 - F.count_distinct("turn")
    gaps = facts.groupBy("conv").agg(F.when(F.count("turn") == 0, F.lit(0)).otherwise(span).try_cast("long").alias("gaps"))
    gaps = gaps.select(F.col("conv").alias("c"), "gaps")
    found = audits.join(gaps, F.col("conv").eqNullSafe(F.col("c")), "left")
    return found.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


# --- repaired turns --------------------------------------------------------------------------------

def repair_turns(
    rows: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, place, edit, role, text) of every repaired turn, each conversation's in order and in one task.

    The rows meet their edits in one shuffle of the texts, sorted behind a row that holds the
    edits, and are read one after the other: memory does not grow with a conversation's texts.
    """
    body = _texts(rows, conv, turn, role, text).withColumn("kind", F.lit(1))
    head = audits.select(
        F.col(conv).alias("conv"), F.lit(None).cast(body.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
        F.lit(b"").alias("digest"), F.col("audit").alias("text"), F.lit(0).alias("kind"),
    )
    placed = head.union(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "kind", "role", "text")
    kind = placed.schema["conv"].dataType.simpleString()

    @tidy
    def run(batches):
        current, audit, at, state, place = None, "", 0, START, 0

        def inserts() -> Iterator[tuple]:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                at, state, place = at + 1, _WRITE[state], place + 1
                yield current, place - 1, "I", _NAMES[state], ""

        def turns(batch) -> Iterator[tuple]:
            nonlocal current, audit, at, state, place
            for of, what, name, content in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))):
                yield from inserts()  # those behind the last row of the conversation before, too
                if what == 0:
                    current, audit, at, state, place = of, content, 0, START, 0
                    continue
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = _KEEP[name[:1], state] if edit == "K" else _WRITE[state]
                place += 1
                yield of, place - 1, edit, name if edit == "K" else _NAMES[state], content

        def batch_of(found: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
            of, places, edits, names, contents = zip(*found)
            return pa.RecordBatch.from_pydict({
                "conv": pa.array(of, conv_type), "place": pa.array(places, pa.int64()), "edit": pa.array(edits, pa.string()),
                "role": pa.array(names, pa.string()), "text": pa.array(contents, pa.string()),
            })

        conv_type = pa.null()
        for batch in small(batches):
            conv_type = batch.schema.field("conv").type
            if found := list(turns(batch)):
                yield batch_of(found, conv_type)
        if found := list(inserts()):
            yield batch_of(found, conv_type)

    return placed.mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string").withColumnRenamed("conv", conv)


def turn_digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of each conversation, straight from ``repair_turns``.

    Uses that its rows come in order; a conversation without turns has no row.
    """
    kind = turns.schema[conv].dataType.simpleString()

    @tidy
    def run(batches):
        current, digest = None, None
        for batch in batches:
            conv_type, convs, found = batch.schema.field("conv").type, [], []
            for of, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text"))):
                if place == 0:
                    if digest is not None:
                        convs.append(current)
                        found.append(digest.hexdigest())
                    current, digest = of, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if found:
                yield pa.RecordBatch.from_pydict({"conv": pa.array(convs, conv_type), "sha256": pa.array(found, pa.string())})
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"conv": pa.array([current], conv_type), "sha256": pa.array([digest.hexdigest()], pa.string())})

    read = turns.select(F.col(conv).alias("conv"), "place", "role", "text")
    return read.mapInArrow(run, f"conv {kind}, sha256 string").withColumnRenamed("conv", conv)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with faults, decided by a checksum of (conv, turn): a test load for the repair.

    Of 20 rows one goes, one loses its text, one its ``[.!?]``, one comes twice and one is made
    the user's; nulls are read as one space.
    """
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(filled(F.col(conv)), F.lit(":"), filled(F.col(turn))).cast("binary")), F.lit(20))
    body: Column = filled(F.col(text))
    changed = rows.select(
        F.col(conv), F.col(turn), F.when(fate == 4, "user").otherwise(filled(F.col(role))).alias(role),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body).alias(text),
        F.explode(F.array_repeat(F.lit(1), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")
