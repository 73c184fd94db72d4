import random

import pyarrow as pa

from tallyscope.llm import string_tiling as st
from tests.llm.cases import ROWS, empty, frame


def brute(item, text, least):
    """Greedy string tiling without hashing: the longest unmarked match at a time."""
    used_a, used_b, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not (used_a[i + n] or used_b[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        used_a[i : i + n] = used_b[j : j + n] = [True] * n
        covered += n


def test_tiles_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        item = [rng.randrange(6) for _ in range(rng.randint(0, 25))]
        text = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        tiles = st.tile(item, text, 3)
        marked = [k for i, _, n in tiles for k in range(i, i + n)]
        assert len(marked) == len(set(marked)) and all(item[i : i + n] == text[j : j + n] for i, j, n in tiles)
        there = [k for _, j, n in tiles for k in range(j, j + n)]
        assert len(there) == len(set(there))
        # Ties between equally long matches may be cut differently, never by more than a tile.
        assert abs(len(marked) - brute(item, text, 3)) <= 3


def test_longest_first_and_closed_words():
    item, text = [1, 2, 3, 4, 5, 6, 7, 8], [5, 6, 7, 8, 0, 1, 2, 3, 4, 5]
    assert sorted(st.tile(item, text, 3)) == [(0, 5, 5), (5, 1, 3)]
    assert sorted(st.tile(item, [5, 6, 7, 8, 0, 1, 2, 3, 4], 3)) == [(0, 5, 4), (4, 0, 4)]
    assert st.tile(item, item, 3, bytearray([1] * 8)) == []


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_reordered_passages(spark):
    rng = random.Random(9)
    words = [f"t{k}" for k in range(40)]
    half = " ".join(words[20:]) + " " + " ".join(rng.choice("abcd") for _ in range(50)) + " " + " ".join(words[:20]).upper() + "!"
    rows = [*ROWS, (50, half, "en", "s"), (51, " ".join(words[:20]), "en", "s"), (52, ", ".join(words), None, None)]
    bench = items(spark, [(1, " ".join(words)), (2, None), (3, ""), (4, "too short"), (1, "quite other words that stand nowhere else")])
    out = {r.doc_id: r.matches for r in st.contamination(frame(spark, rows), bench).collect()}
    assert sorted(out) == [50, 52] and [m.covered for m in out[50]] == [40] and len(out[50][0].tiles) == 2
    kept = st.clean(frame(spark, rows), bench)
    assert kept.columns == frame(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r[0]) for r in rows if r[0] not in (50, 52)
    )


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(30)) for _ in range(12)]
    rows = [(k, f"x y {t} z", "en", "s") for k, t in enumerate(texts[:8])]
    bench = items(spark, list(enumerate(texts)))
    one = sorted((r.doc_id, r.matches[0].item_id) for r in st.contamination(frame(spark, rows), bench).collect())
    monkeypatch.setattr(st, "BLOCK_WORDS", 50)
    assert len(st.blocks(bench, "item_id", "text")) > 3
    many = sorted((r.doc_id, r.matches[0].item_id) for r in st.contamination(frame(spark, rows), bench).collect())
    assert one == many == [(k, str(k)) for k in range(8)]


def test_empty_tables(spark):
    bench = items(spark, [(1, "a b c d e f g")])
    assert st.contamination(empty(spark), bench).collect() == [] and st.clean(empty(spark), bench).collect() == []
    assert st.contamination(frame(spark), bench.limit(0)).collect() == []
    assert st.clean(frame(spark), bench.limit(0)).count() == len(ROWS)


def test_no_match_is_lost_to_the_seed_bound():
    rng = random.Random(12)
    item = [f"k{k}" for k in range(30)]
    block = st.ItemBlock([("i", " ".join(item))], 4)
    for _ in range(60):
        parts = [item[a : a + rng.randint(4, 9)] for a in rng.sample(range(26), 6)]
        text = " ".join(w for p in parts for w in [*p, f"n{rng.random()}"])
        words = [w.replace(".", " ").split() for w in text.split()]
        flat = [w for own in words for w in own]
        expected = brute(item, flat, 4)
        got = block.matches(pa.array([text]), 60)[0]
        assert bool(got) == (expected * 100 >= 60 * 30) or abs(expected - 18) <= 3
