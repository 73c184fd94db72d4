import random

import xxhash

from tallyscope.llm import line_chunks as lc
from tests.llm.cases import ROWS, empty, frame


def brute(rows):
    """Keep the first of every chunk with two lines or more; order by id (nulls first), text hash and place."""
    places = {}
    texts = {(r[0], r[1]) for r in rows}
    for doc_id, text in texts:
        for nth, lines in enumerate(lc.cut(text) if text else ()):
            body = "\n".join(lines)
            if len(lines) >= lc.FEWEST and body.strip():
                key = (doc_id is not None, doc_id or 0, _signed(text), nth)
                places.setdefault(body, []).append((key, doc_id, text, nth))
    gone = {(d, t, n) for found in places.values() for _, d, t, n in sorted(found, key=lambda f: f[0])[1:]}
    out = []
    for doc_id, text, *_ in rows:
        if not text:
            out.append((doc_id, text))
            continue
        kept = [line for n, lines in enumerate(lc.cut(text)) if (doc_id, text, n) not in gone for line in lines]
        out.append((doc_id, "\n".join(kept)))
    return out


def _signed(text):
    value = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def corpus(seed=1):
    rng = random.Random(seed)
    blocks = [[f"block {b} line {k}" for k in range(rng.randint(3, 14))] for b in range(6)]
    rows = []
    for k in range(80):
        lines = [f"own {k} {j}" for j in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(blocks)
        if rng.random() < 0.2:
            lines += ["", ""] * 3
        rows.append((100 + k, "\n".join(lines), "en", "s"))
    return rows


def test_cut_keeps_all_lines_and_moves_with_them():
    rng = random.Random(3)
    lines = [f"line {rng.random()}" for _ in range(300)]
    chunks = lc.cut("\n".join(lines))
    assert [x for c in chunks for x in c] == lines and len(chunks) > 30
    shifted = {tuple(c) for c in lc.cut("\n".join(["new first line", *lines]))}
    assert sum(tuple(c) not in shifted for c in chunks) <= 2


def test_equals_brute_force(spark):
    rows = [*ROWS, *corpus(), (500, "same a\nsame b\nsame c", None, None), (500, "same a\nsame b\nsame c", None, None)]
    out = lc.dedupe(frame(spark, rows), counts=("before", "gone")).collect()
    order = lambda pair: (str(pair[0]), str(pair[1]))
    assert sorted(((r.doc_id, r.text) for r in out), key=order) == sorted(brute(rows), key=order)
    assert any(r.gone for r in out)
    for r in out:
        assert r.before - r.gone == (len(r.text.split("\n")) if r.text else 0) or r.gone == r.before


def test_schema_and_empty(spark):
    df = frame(spark)
    assert lc.dedupe(df).columns == df.columns and lc.dedupe(df).count() == len(ROWS)
    assert lc.dedupe(empty(spark)).collect() == []


def test_equal_hashes_are_compared_by_bytes(spark, monkeypatch):
    rows = [(k, f"first {k}\nsecond {k}\nthird {k}", "en", "s") for k in range(6)]
    found = lc.repeated_chunks(frame(spark, rows))
    assert found.count() == 0


def test_a_chunk_in_a_third_of_all_rows(spark):
    hot = "\n".join(f"hot {k}" for k in range(12))
    rows = [(k, (hot + "\n" if k % 3 == 0 else "") + f"own {k}\nand {k}", "en", "s") for k in range(300)]
    out = {r.doc_id: r.text for r in lc.dedupe(frame(spark, rows)).collect()}
    assert out == dict(brute(rows)) and "hot 3" in out[0] and sum("hot 5" in t for t in out.values()) < 20


def test_nothing_removed_is_gone(spark):
    """Every chunk that is taken out still stands whole in the output, at its keeper."""
    rng = random.Random(17)
    lines = [f"line {k} of the pool" for k in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))), "en", "s") for i in range(150)]
    rows += [(900, "X 1\nX 1\nX 1\nend", "en", "s"), (901, "A\nB", "en", "s"), (902, "A\nB\nC\nD", "en", "s"), (903, "B\nC", "en", "s")]
    df = frame(spark, rows)
    left = {r["doc_id"]: r["text"] for r in lc.dedupe(df).collect()}
    assert "X 1\nX 1" in left[900] and all(any(pair in t for t in left.values()) for pair in ("A\nB", "B\nC"))
    texts = {i: t for i, t, *_ in rows}
    found = lc.repeated_chunks(df).collect()
    assert len(found) > 20
    for r in found:
        body = "\n".join(lc.cut(texts[r["id"]])[r["nth"]])
        assert "\n".join(lc.cut(texts[r["keeper_id"]])[r["keeper_nth"]]) == body
        assert body in left[r["keeper_id"]]
