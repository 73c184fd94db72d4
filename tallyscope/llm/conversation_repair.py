"""Cheapest repair of conversations by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a place between two rows and the state of the wanted order of roles
``(s?(ua)+)?``. Its edges are the edits: keep, rerole or delete the next row, or insert an empty row. From both ends a heap
settles nodes by cost; once the two radii together reach the best crossing, all crossings of that cost are finished,
and the one with the least concatenated audit is taken. Two audits of equal cost between the same nodes are never prefixes
of one another (only inserts could make the difference, and they cost), so least parts make least wholes.

Order and faults of the rows are found by Spark: equal rows are one row with a count, the first occurrence of a text comes
from an aggregate, and rows are range-partitioned by conversation and place. A conversation is cut into blocks; each
block gives the cheapest audit between every state before it and every state after it, and blocks are
joined by state through one row each. No task holds the rows of a long conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.llm.tokens import give_back, in_small_batches
from tallyscope.session import settle

#: Rows of a conversation in one block of the lattice.
BLOCK_ROWS = 256
#: Remainders of the damage and what each does.
DAMAGE_PARTS, DROPPED, EMPTIED, UNSTOPPED, REPEATED, REROLED = 20, 0, 1, 2, 3, 4
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED_COST = 5
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

# States: nothing yet, after the system row, a user row is next, an assistant row is next.
START, OPENED, USER, ASSISTANT = range(4)
FINAL = (START, USER)
#: State after a row with this initial; a state that is missing refuses it.
_NEXT = {
    "s": {START: OPENED},
    "u": {START: ASSISTANT, OPENED: ASSISTANT, USER: ASSISTANT},
    "a": {ASSISTANT: USER},
}
_WANTED = {START: "u", OPENED: "u", USER: "u", ASSISTANT: "a"}
ROLE = {"u": "user", "a": "assistant"}


class Row(NamedTuple):
    """``initial`` of the role, first fault, and number of equal rows that follow (duplicates, so deleted)."""

    initial: str
    fault: str | None
    copies: int = 0


def _edits(row: Row, state: int) -> list[tuple[int, int, str]]:
    """Cost, next state and audit of every edit that uses up a row."""
    extra, tail = DELETE * row.copies, "D" * row.copies
    edits = [(DELETE + extra, state, "D" + tail)]
    if row.fault in (BLANK, DUPLICATE):
        return edits
    extra += TRUNCATED_COST if row.fault == TRUNCATED else 0
    if (after := _NEXT.get(row.initial, {}).get(state)) is not None:
        edits.append((KEEP + extra, after, "K" + tail))
    wanted = _WANTED[state]
    edits.append((REROLE + extra, _NEXT[wanted][state], "R" + tail))
    return edits


def _insert(state: int) -> tuple[int, int, str]:
    return INSERT, _NEXT[_WANTED[state]][state], "I"


def shortest(rows: list[Row], entry: int, exit: int) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way through the lattice between two states; None if there is none."""
    count = len(rows)
    ahead = [[_edits(row, state) for state in range(4)] for row in rows]

    def forth(node):
        place, state = node
        cost, after, letter = _insert(state)
        yield cost, (place, after), letter
        if place < count:
            for cost, after, letter in ahead[place][state]:
                yield cost, (place + 1, after), letter

    def back(node):
        place, after = node
        for state in range(4):
            cost, reached, letter = _insert(state)
            if reached == after:
                yield cost, (place, state), letter
            if place:
                for cost, reached, letter in ahead[place - 1][state]:
                    if reached == after:
                        yield cost, (place - 1, state), letter

    sides = (
        _Side((0, entry), forth, lambda audit, letter: audit + letter),
        _Side((count, exit), back, lambda audit, letter: letter + audit),
    )
    best: tuple[int, str] | None = None
    while True:
        fronts = [side.front() for side in sides]
        if best is not None and sum(fronts) > best[0] or _FAR in fronts:
            return best
        # The nearer front goes on, the smaller search on ties.
        k = min(range(2), key=lambda k: (fronts[k], len(sides[k].settled)))
        for crossing in sides[k].settle(sides[1 - k].settled):
            audit = crossing[1:] if k == 0 else crossing[:0:-1]
            found = (crossing[0], "".join(audit))
            best = found if best is None else min(best, found)


_FAR = float("inf")


class _Side:
    """One of the two searches: its settled nodes with cost and least audit.

    Edges without cost use up a row, so among nodes of one cost those nearer to the source are settled first; the audits that
    reach a node are then all known.
    """

    def __init__(self, source, neighbours, joined):
        self.settled: dict[tuple[int, int], tuple[int, str]] = {}
        self.source, self.neighbours, self.joined = source, neighbours, joined
        self.heap = [(0, 0, "", source)]

    def front(self) -> float:
        """Cost of the nearest node that is not settled."""
        while self.heap and self.heap[0][3] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else _FAR

    def settle(self, other: dict) -> Iterator[tuple]:
        """Settle the nearest node; yields cost and the audit parts, own part first, wherever it meets the other search."""
        cost, _, audit, node = heapq.heappop(self.heap)
        self.settled[node] = (cost, audit)
        if node in other:
            yield cost + other[node][0], audit, other[node][1]
        for step, reached, letter in self.neighbours(node):
            if reached in other:
                yield cost + step + other[reached][0], audit, letter, other[reached][1]
            if reached not in self.settled:
                away = abs(reached[0] - self.source[0])
                heapq.heappush(self.heap, (cost + step, away, self.joined(audit, letter), reached))


# --- blocks ---------------------------------------------------------------------------------------

_SPACE = " \t\n\x0b\x0c\r"
_PAIRS = ("su", "ua", "au")
_WAYS = pa.list_(pa.struct([("entry", pa.int8()), ("exit", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))
_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))
_BLOCK = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("seq", pa.int64()),
        ("ways", _WAYS),
        ("lines", _LINES),
        *[(n, pa.int64()) for n in ("least_turn", "most_turn", "turns", BLANK, DUPLICATE, TRUNCATED, "illegal")],
        ("first_initial", pa.string()),
        ("last_initial", pa.string()),
    ]
)
_BLOCK_SQL = (
    "conv_id long, part long, seq long, ways array<struct<entry:tinyint,exit:tinyint,cost:long,audit:string>>, "
    "lines array<struct<role:string,text:string,copies:long>>, least_turn long, most_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"
)
#: Bytes of text at which a block ends before it has all its rows.
BLOCK_BYTES = 1 << 22


def fault_of(text: str, seen: bool) -> str | None:
    """First fault of a row; ``seen``: its role and text stood earlier."""
    ending = text.rstrip(_SPACE)
    if not ending:
        return BLANK
    if seen:
        return DUPLICATE
    return None if ending[-1] in ".!?" else TRUNCATED


def _block(conv_id, seq: int, lines: list[tuple], first: bool, last: bool) -> dict:
    """``lines``: turn, role, text, number of equal rows, seen. ``first``, ``last``: surely an end of the conversation."""
    rows, counts, illegal = [], dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0), 0
    for _, role, text, n, seen in lines:
        row = Row(role[:1], fault_of(text, seen), n - 1)
        illegal += bool(rows) and rows[-1].initial + row.initial not in _PAIRS
        illegal += n - 1
        if row.fault is not None:
            counts[row.fault] += 1
        counts[BLANK if row.fault == BLANK else DUPLICATE] += n - 1
        rows.append(row)
    ways = [
        {"entry": entry, "exit": exit, "cost": found[0], "audit": found[1]}
        for entry in ((START,) if first else range(4))
        for exit in (FINAL if last else range(4))
        if (found := shortest(rows, entry, exit)) is not None
    ]
    turns = {line[0] for line in lines if line[0] is not None}
    return {
        "conv_id": conv_id,
        "part": TaskContext.get().partitionId(),
        "seq": seq,
        "ways": ways,
        "lines": [{"role": role, "text": text, "copies": n - 1} for _, role, text, n, _ in lines],
        "least_turn": min(turns, default=None),
        "most_turn": max(turns, default=None),
        "turns": len(turns),
        **counts,
        "illegal": illegal,
        "first_initial": rows[0].initial,
        "last_initial": rows[-1].initial,
    }


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(schema: pa.Schema, rows: Iterator[dict], size: int = 256) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting = []
    yield pa.RecordBatch.from_pylist(waiting, schema)
    give_back()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of one range partition.

    Only the first and the last conversation of a partition may go on in another one.
    """

    def blocks():
        seq = 0
        for nth, (conv_id, rows) in enumerate(groupby(_rows_of(batches), key=lambda row: row[0])):
            if nth:
                yield _block(*open_block, last=True)
            lines, size, first = [], 0, nth > 0
            for row in rows:
                if lines and (len(lines) == BLOCK_ROWS or size >= BLOCK_BYTES):
                    yield _block(conv_id, seq, lines, first, last=False)
                    lines, size, first, seq = [], 0, False, seq + 1
                lines.append(row[1:])
                size += len(row[3])
            open_block = (conv_id, seq, lines, first)
            seq += 1
        if seq:
            yield _block(*open_block, last=False)

    return _batched(_BLOCK, blocks(), 16)


# --- whole conversations --------------------------------------------------------------------------

_TOTALS = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")
_CHOSEN = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "part", "seq")] + [("piece", pa.string())] + [(n, pa.int64()) for n in _TOTALS]
)


def _common(texts: list[str]) -> int:
    a, b = min(texts), max(texts)
    return next((k for k in range(len(a)) if a[k] != b[k]), len(a))


def _pieces(blocks: list[dict]) -> tuple[int, list[str]]:
    """Cost of the cheapest repair and its audit, block by block."""
    reached = {START: (0, "")}
    came: list[dict[int, tuple[int, str]]] = []
    for block in blocks:
        found: dict[int, tuple[tuple[int, str], int, str]] = {}
        for way in block["ways"]:
            if (before := reached.get(way["entry"])) is not None:
                whole = (before[0] + way["cost"], before[1] + way["audit"])
                if way["exit"] not in found or whole < found[way["exit"]][0]:
                    found[way["exit"]] = (whole, way["entry"], way["audit"])
        came.append({exit: (entry, audit) for exit, (_, entry, audit) in found.items()})
        # What all audits begin with decides nothing any more.
        shared = _common([whole[1] for whole, _, _ in found.values()])
        reached = {exit: (whole[0], whole[1][shared:]) for exit, (whole, _, _) in found.items()}
    cost, _, state = min((*reached[exit], exit) for exit in FINAL if exit in reached)
    pieces = []
    for step in reversed(came):
        state, audit = step[state]
        pieces.append(audit)
    return cost, pieces[::-1]


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each block, and the totals of each conversation beside its first block."""

    def chosen():
        for conv_id, group in groupby(_records(batches), key=lambda block: block["conv_id"]):
            blocks = list(group)
            cost, pieces = _pieces(blocks)
            known = [b for b in blocks if b["turns"]]
            joints = list(zip(blocks, blocks[1:]))
            turns = sum(b["turns"] for b in known) - sum(a["most_turn"] == b["least_turn"] for a, b in zip(known, known[1:]))
            totals = {n: sum(b[n] for b in blocks) for n in (BLANK, DUPLICATE, TRUNCATED, "illegal")}
            totals["illegal"] += sum(a["last_initial"] + b["first_initial"] not in _PAIRS for a, b in joints)
            totals["gaps"] = known[-1]["most_turn"] - known[0]["least_turn"] + 1 - turns if known else 0
            totals["cost"] = cost
            for block, piece in zip(blocks, pieces, strict=True):
                yield {n: block[n] for n in ("conv_id", "part", "seq")} | {"piece": piece} | totals
                totals = {}

    return _batched(_CHOSEN, chosen())


_REPAIRED = pa.schema(
    [("conv_id", pa.int64())] + [(n, pa.int64()) for n in _TOTALS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def repaired_lines(lines: list[dict], piece: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """Role and text of the repaired rows of a block, and the state after it."""
    out, at = [], 0
    for line in [*lines, None]:
        while piece[at : at + 1] == "I":
            out.append((ROLE[_WANTED[state]], ""))
            state, at = _insert(state)[1], at + 1
        if line is None:
            return out, state
        edit, at = piece[at], at + 1 + line["copies"]
        if edit != "D":
            initial = line["role"][:1] if edit == "K" else _WANTED[state]
            out.append((line["role"] if edit == "K" else ROLE[initial], line["text"]))
            state = _NEXT[initial][state]
    return out, state


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of every conversation; before each block with its lines comes the row with its audit."""

    def written():
        for conv_id, group in groupby(_records(batches), key=lambda row: row["conv_id"]):
            digest, state, audits, totals, piece, started = hashlib.sha256(), START, [], None, "", False
            for row in group:
                if row["lines"] is None:
                    piece = row["piece"]
                    audits.append(piece)
                    totals = totals or {n: row[n] for n in _TOTALS}
                    continue
                out, state = repaired_lines(row["lines"], piece, state)
                for role, text in out:
                    digest.update(f"{chr(10) if started else ''}{role}:{text}".encode())
                    started = True
            yield {"conv_id": conv_id, **totals, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    return _batched(_REPAIRED, written())


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage; nulls of role and text are one space."""

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % DAMAGE_PARTS
    text = (
        F.when(F.col("kind") == EMPTIED, "")
        .when(F.col("kind") == UNSTOPPED, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    return (
        conversations.select(
            F.col("conv_id").cast("long"), F.col("turn").cast("long"), known("role").alias("role"),
            known("text").alias("text"), kind.alias("kind"),
        )
        .filter(F.col("kind") != DROPPED)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == REROLED, "user").otherwise(F.col("role")).alias("role"),
            text.alias("text"),
            F.when(F.col("kind") == REPEATED, 2).otherwise(1).cast("long").alias("times"),
        )
    )


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``rows`` (``conv_id, turn, role, text``, and ``times`` a row stands).

    Role and text are not null. Rows stand by turn, unknown turns first; rows of one turn stand by role and text. A row
    without an initial (an empty role) cannot be kept in its role. Rows without ``conv_id`` are one conversation. Returns
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    place = ["conv_id", "turn", "role", "text"]
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    once = settle(rows.groupBy(*place).agg(F.sum("times").alias("times")).withColumn("same", same))
    again = (
        once.groupBy("conv_id", "same")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    )
    found = once.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left").select(
        *place, "times", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)).alias("seen")
    )
    ordered = in_small_batches(settle(found)).repartitionByRange(*place).sortWithinPartitions(*place)
    blocks = settle(ordered.mapInArrow(_cut, _BLOCK_SQL))
    keys = ["conv_id", "part", "seq"]
    totals = ", ".join(f"{n} long" for n in _TOTALS)
    chosen = (
        blocks.drop("lines")
        .repartition("conv_id")
        .sortWithinPartitions(*keys)
        .mapInArrow(_chosen, f"conv_id long, part long, seq long, piece string, {totals}")
    )
    both = chosen.unionByName(blocks.select(*keys, "lines"), allowMissingColumns=True)
    return (
        both.repartition("conv_id")
        .sortWithinPartitions(*keys, F.col("lines").isNotNull())
        .mapInArrow(_written, f"conv_id long, {totals}, audit string, repaired_sha256 string")
        .select("conv_id", *_TOTALS, "audit", "repaired_sha256")
    )


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """:func:`repair` of the :func:`damaged` table, with a row of zeros for conversations that lost all their rows.

    Null roles and texts are one space; in the remainder that decides the damage, so are null ids and turns. Repeated rows are
    duplicates. Other columns are ignored.
    """
    done = repair(damaged(conversations)).withColumnRenamed("conv_id", "done_id")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    return ids.join(done, F.col("conv_id").eqNullSafe(F.col("done_id")), "left").select(
        "conv_id",
        *[F.coalesce(n, zero).alias(n) for n in _TOTALS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )
