import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyscope.llm import ngram_join as nj
from tallyscope.llm.components import components
from tallyscope.llm.tokens import shingle_sets
from tests.llm.cases import ROWS, empty, frame
import pyarrow as pa


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, size=5):
    own = words(text)
    return {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} or ({tuple(own)} if own else set())


def brute(rows):
    sets = [shingles(row[1]) for row in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = defaultdict(list)
    for k, own in enumerate(sets):
        shared = Counter(other for gram in own for other in where[gram])
        for other, count in shared.items():
            if 100 * count >= 80 * (len(own) + len(sets[other]) - count):
                parent[root(k)] = root(other)
        for gram in own:
            where[gram].append(k)
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[root(k)] = min(least.get(root(k), row[0]), row[0])
    return sorted((str(row[0]), len(sets[k]), str(least.get(root(k)) if sets[k] else row[0])) for k, row in enumerate(rows))


def corpus(seed=3, count=250):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for k in range(count):
        kind = rng.random()
        if k and kind < 0.45:
            own = rng.choice(texts)[:]
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        else:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
            if kind > 0.7:
                own += passage
        texts.append(own or ["x"])
    return [(1000 + k, " ".join(t).upper() if k % 7 == 0 else "\n".join(t), "en", "s") for k, t in enumerate(texts)]


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_equals_brute_force(spark):
    rows = [*ROWS, *corpus()]
    out = nj.near_duplicates(frame(spark, rows))
    assert found(out) == brute(rows)
    assert nj.near_duplicates(empty(spark)).collect() == []


def test_a_third_of_all_rows_are_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(360):
        if k % 3 == 0:
            own = base[:]
            own[rng.randrange(120)] = f"c{k}"
        else:
            own = [f"{rng.randrange(10**9)}" for _ in range(40)]
        rows.append((k, " ".join(own), "en", "s"))
    assert found(nj.near_duplicates(frame(spark, rows))) == brute(rows)


def test_frequent_grams_go_last(spark, monkeypatch):
    rows = [(k, f"a{k} b{k} c{k} d{k} the same ten words stand in all of these texts here", "en", "s") for k in range(60)]
    level = nj.frequent_slots(frame(spark, rows).coalesce(1), 5)
    assert level.max() == 6 and 0 < (level > 0).sum() < 15
    assert found(nj.near_duplicates(frame(spark, rows))) == brute(rows)


def test_one_of_each(spark):
    rows = [*ROWS, *corpus(11, 80)]
    df = frame(spark, rows)
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    alone = {(r[0], r[1]) for r in rows if not shingles(r[1])}
    groups = {c for _, n, c in brute(rows) if n}
    assert kept.count() == len(alone) + len(groups)
    ids = {str(r.doc_id) for r in kept.collect()}
    assert groups <= ids


def test_bounds_hold():
    rng = random.Random(4)
    for _ in range(300):
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(1, 300))], dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.randint(0, len(a))], np.array([rng.getrandbits(64) for _ in range(rng.randint(1, 100))], dtype=np.uint64)]))
        rows = [np.frombuffer(nj.folded_bits(x), np.uint8) for x in (a, b)]
        size = min(map(len, rows))
        apart = int(np.bitwise_count(nj._fold(rows[0], size) ^ nj._fold(rows[1], size)).sum())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_parts_meet_pairwise(spark, monkeypatch):
    monkeypatch.setattr(nj, "PART", 3)
    rows = corpus(21, 150)
    assert found(nj.near_duplicates(frame(spark, rows))) == brute(rows)


def test_near_copies_leave_the_product_in_a_linear_number(spark, monkeypatch):
    """A group in which few members reach the pivot: its pairs are squares, the rows that leave the product are not."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(300):
        own = base[:]
        own[rng.randrange(len(own))] = f"x{k}"
        rows.append((k, " ".join(own), None, None))
    made, product = [], nj._block_product

    def counted(*args, **kwargs):
        pairs = nj.settle(product(*args, **kwargs))
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(nj, "_block_product", counted)
    assert found(nj.near_duplicates(frame(spark, rows))) == brute(rows)
    assert made and sum(made) < 8 * len(rows), made
    monkeypatch.setattr(nj, "ROUNDS", 0)
    made.clear()
    assert found(nj.near_duplicates(frame(spark, rows))) == brute(rows)
    assert sum(made) > 8 * len(rows), made


def test_rounds_in_all_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nj, "CROWD", 2)
    monkeypatch.setattr(nj, "PART", 3)
    rows = corpus(seed=11)
    assert found(nj.near_duplicates(frame(spark, rows))) == brute(rows)


def test_part_pairs_lose_no_link():
    rng = random.Random(13)
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(200)]
        sets = []
        for _ in range(12):
            own = {g for g in base if rng.random() < rng.choice([0.5, 0.9, 0.97])} | {rng.getrandbits(64) for _ in range(rng.randint(0, 20))}
            sets.append(np.array(sorted(own | {7}), dtype=np.uint64))
        n = np.array([len(x) for x in sets])
        root, side = np.array([rng.randrange(6) for _ in sets]), np.array([rng.randrange(2) for _ in sets])
        bits = pa.array([nj.folded_bits(x) for x in sets], type=pa.binary())
        before = np.repeat(np.arange(12)[:, None], nj.BEFORE, axis=1)
        a, b = nj.part_pairs(np.array([0]), np.array([12]), n, np.zeros(12, dtype=int), root, side, bits, before, 80)
        assert not [p for p in zip(a, b, strict=True) if root[p[0]] == root[p[1]]]
        got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
        for i in range(12):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                links = 100 * shared >= 80 * (n[i] + n[j] - shared)
                if links and root[i] != root[j] and (side[i] != side[j] or len(set(side)) == 1):
                    assert (j, i) in got


def test_every_link_leaves_some_block():
    """Over all blocks of shared prefix grams, each linked pair is handed out, and few pairs more than once."""
    rng = random.Random(31)
    times = []
    for _ in range(40):
        base = [rng.getrandbits(62) for _ in range(rng.choice([6, 60, 200]))]
        keep = rng.choice([0.85, 0.93, 0.99])
        sets = [sorted({g for g in base if rng.random() < keep} | {rng.getrandbits(62) for _ in range(rng.randrange(4))}) for _ in range(10)]
        sets = [np.array(x or [k], dtype=np.int64) for k, x in enumerate(sets)]
        handed = {}
        for gram in {g for x in sets for g in x[: len(x) - -(-80 * len(x) // 100) + 1].tolist()}:
            own = [k for k, x in enumerate(sets) if gram in x[: len(x) - -(-80 * len(x) // 100) + 1]]
            at = np.array([int(np.searchsorted(sets[k], gram)) for k in own])
            before = np.array([[sets[k][i - j - 1] if i > j else -k - 1 for j in range(nj.BEFORE)] for k, i in zip(own, at)])
            n, bits = np.array([len(sets[k]) for k in own]), pa.array([nj.folded_bits(sets[k].view(np.uint64)) for k in own])
            none = np.zeros(len(own), dtype=int)
            a, b = nj.part_pairs(np.array([0]), np.array([len(own)]), n, at, np.array(own), none, bits, before, 80)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                pair = tuple(sorted((own[x], own[y])))
                handed[pair] = handed.get(pair, 0) + 1
        for i in range(10):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                    assert (j, i) in handed
        times += handed.values()
    assert sum(times) < 1.5 * len(times)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingle_sizes(size):
    texts = [None, "", "A b", "a B c d e f g", "x " * 50, "é ü ß", " \v a\fb "]
    assert [len(s) for s in shingle_sets(pa.array(texts), size)] == [len(shingles(t, size)) for t in texts]


def test_components(spark):
    rng = random.Random(2)
    for shape in ("random", "path", "star"):
        if shape == "random":
            links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
        elif shape == "path":
            links = [(k, k + 1) for k in range(60)]
        else:
            links = [(500, k) for k in range(300)]
        parent = {k: k for link in links for k in link}

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in links:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
        got = {r.node: r.root for r in components(df).collect()}
        assert got == {k: root(k) for link in links for k in link if link[0] != link[1]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
