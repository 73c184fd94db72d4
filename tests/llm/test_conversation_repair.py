import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyscope.llm import conversation_repair as cr
from tallyscope.llm.queries import op12_conversations

WANTED = re.compile("(s?(ua)+)?")


def plain_repair(rows):
    """Cost, audit and lines by trying every sequence of edits, with at most one insert at a place. ``rows``: role, text."""
    seen, faults = set(), []
    for role, text in rows:
        ending = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not ending else "duplicate" if (role, text) in seen else None if ending[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        own = [(2, "D", [])]
        if fault in (None, "truncated"):
            extra = 5 * (fault == "truncated")
            own += [(extra, "K", [(role, text)])] if role else []
            own += [(extra + 1, "R", [(r, text)]) for r in ("user", "assistant")]
        choices += [[(0, "", []), (5, "I", [("user", "")]), (5, "I", [("assistant", "")])], own]
    choices.append(choices[0] if rows else [(0, "", [])])
    best = None
    for combination in itertools.product(*choices):
        lines = [line for _, _, kept in combination for line in kept]
        if WANTED.fullmatch("".join(role[0] for role, _ in lines)):
            found = (sum(c for c, _, _ in combination), "".join(a for _, a, _ in combination), lines)
            best = found if best is None or found[:2] < best[:2] else best
    return *best, faults


def relaxed(rows, entry, exit):
    """The same as ``shortest`` by relaxing place after place."""
    best = {(0, entry): (0, "")}
    for place in range(len(rows) + 1):
        edges = [(s, cr._insert(s), 0) for s in range(4)] * 4
        if place < len(rows):
            edges += [(s, edit, 1) for s in range(4) for edit in cr._edits(rows[place], s)]
        for state, (cost, after, audit), step in edges:
            if (place, state) in best:
                found = (best[place, state][0] + cost, best[place, state][1] + audit)
                best[place + step, after] = min(found, best.get((place + step, after), found))
    return best.get((len(rows), exit))


def expected(table):
    """All columns of the contract from the undamaged rows ``conv_id, turn, role, text``."""
    out = []
    for conv_id in {row[0] for row in table}:
        rows = []
        for _, turn, role, text in (row for row in table if row[0] == conv_id):
            role, text = (" " if v is None else v for v in (role, text))
            name = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
            kind = zlib.crc32(name.encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        cost, audit, lines, faults = plain_repair([r[1:] for r in rows])
        turns = {r[0] for r in rows if r[0] is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out.append(
            (
                conv_id,
                max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                sum(p not in ("su", "ua", "au") for p in pairs),
                cost,
                audit,
                hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
            )
        )
    return out


def same(found, wanted):
    key = lambda row: (row[0] is not None, row)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_search_against_relaxation():
    rng = random.Random(3)
    faults = [None, None, "blank", "duplicate", "truncated"]
    for _ in range(400):
        size = rng.choice([0, 1, 2, 3, 5, 9])
        rows = [cr.Row(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice(faults), rng.choice([0, 0, 3])) for _ in range(size)]
        for entry, exit in itertools.product(range(4), repeat=2):
            assert cr.shortest(rows, entry, exit) == relaxed(rows, entry, exit), (rows, entry, exit)


def conversations(seed=4, count=120):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["a.", "b!", "c? \n", "open", " ", "", None, "é."]
    table = []
    for conv_id in range(count):
        turns = sorted(rng.sample(range(8), rng.randrange(1, 5)))
        table += [(conv_id, turn, rng.choice(roles), rng.choice(texts)) for turn in turns]
    table += [(900, None, "user", "a."), (900, None, "assistant", "b."), (900, 4, "user", "c."), (900, 4, "user", "c.")]
    table += [(None, 0, "user", "a."), (None, None, "assistant", "b.")]
    return table


@pytest.mark.parametrize("block_rows", [cr.BLOCK_ROWS, 2])
def test_query(spark, tmp_path, monkeypatch, block_rows):
    table = conversations()
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    frame.selectExpr("*", "'x' as same", "1 as times", "2 as part", "3 as cost").write.parquet(f"{tmp_path}/conversations.parquet")
    if block_rows == 2:
        # Workers import the module anew: the block size is set where the blocks are cut.
        cut = cr._cut

        def small(batches):
            cr.BLOCK_ROWS = 2
            yield from cut(batches)

        monkeypatch.setattr(cr, "_cut", small)
    folder = str(tmp_path)
    same(op12_conversations(spark, folder).collect(), expected(table))


def test_blocks_of_a_long_conversation():
    """Blocks joined by state give the audit of the whole."""
    rng = random.Random(8)
    for _ in range(60):
        rows = [cr.Row(rng.choice("suausx"), rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randrange(1, 40))]
        size = rng.randrange(1, 6)
        blocks = []
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            ways = [(e, x, cr.shortest(part, e, x)) for e in range(4) for x in range(4)]
            blocks.append({"ways": [{"entry": e, "exit": x, "cost": w[0], "audit": w[1]} for e, x, w in ways if w]})
        cost, pieces = cr._pieces(blocks)
        assert (cost, "".join(pieces)) == min(w for x in cr.FINAL if (w := relaxed(rows, cr.START, x)))


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.damage_and_repair(none).collect() == []
