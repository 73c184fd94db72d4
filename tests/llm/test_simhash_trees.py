import random
import re

import numpy as np
import pytest
import xxhash

from tallyscope.llm import simhash_trees as st
from tallyscope.llm.queries import op11_simhash
from tests.llm import cases


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Labels of the components of all pairs at most three bits apart, by comparing everything."""
    prints = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    labels = np.arange(len(prints))
    while True:
        least = np.where(near, labels[None, :], len(prints)).min(axis=1)
        if (least == labels).all():
            return labels.tolist()
        labels = least


def family(seed=0, lone=800, copies=120, dense=700):
    """Random prints, copies one to five bits away, and a dense family around one print."""
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(lone)]
    for flips in range(1, 6):
        prints += [p ^ sum(1 << b for b in rng.sample(range(64), flips)) for p in prints[:copies]]
    prints += [prints[0] ^ sum(1 << b for b in rng.sample(range(64), 5)) for _ in range(dense)]
    return sorted(set(prints))


def joined(links, prints):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert bin(a ^ b).count("1") <= 64
        parent[max(top(a), top(b))] = min(top(a), top(b))
    where = {p: i for i, p in enumerate(prints)}
    return [where[top(p)] for p in prints]


def test_fingerprint():
    rng = random.Random(5)
    texts = [None, "", " \n", "A", "a B", "a b c", "x  Y\x0bz\tÉ é \U0001f600 q", "a a a a a a a"]
    texts.append(" ".join(rng.choice(["ab", "Cd", "é", "x1"]) for _ in range(70_000)))
    for text in texts[:-1]:
        assert st.fingerprint(None if text is None else text.encode()) == plain_print(text)
    assert st.fingerprint(texts[-1].encode()) == plain_print(texts[-1])


@pytest.mark.parametrize("level", [0, 2, 5, 8])
def test_search_in_a_shard(level):
    prints = family()
    root = st._linked(
        np.array(prints, np.uint64), np.ones(len(prints), bool), np.full(len(prints), 3), prints[9], level, True
    )
    assert joined([(prints[i], prints[r]) for i, r in enumerate(root)], prints) == plain_components(prints)


def test_shards_and_parts(spark, monkeypatch):
    """The same links whatever the sizes of shards and parts are."""
    prints = family(1, 300, 60, 200)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "print long")
    expected = plain_components(prints)
    for rows, questions, at_once in ((1 << 16, 1 << 18, 1 << 20), (60, 1 << 18, 500), (20, 64, 50)):
        monkeypatch.setattr(st, "SHARD_ROWS", rows)
        monkeypatch.setattr(st, "SHARD_QUESTIONS", questions)
        if rows < 60:
            monkeypatch.setattr(st, "LEVELS", 3)  # all levels used up: parts by hash
        found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in st.links(frame).collect()]
        assert joined(found, prints) == expected


def test_query(spark, tmp_path):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) for _ in range(300)) for _ in range(12)]
    rows = [*cases.ROWS, *[(100 + i, t, "en", "a") for i, t in enumerate(base)]]
    rows += [(200 + i, t + " omega", "en", "a") for i, t in enumerate(base)] + [(300, base[3].upper(), "en", "b")]
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_simhash(spark, str(tmp_path)).collect()
    prints = [plain_print(r[1]) for r in rows]
    labels = plain_components(prints)
    least = {}
    for (doc_id, *_), label in zip(rows, labels, strict=True):
        if doc_id is not None:
            least[label] = min(doc_id, least.get(label, doc_id))
    expected = [(r[0], f"{p:016x}", least.get(label)) for r, p, label in zip(rows, prints, labels, strict=True)]
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert found[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"}


def test_empty(spark):
    assert st.near_copies(cases.empty(spark)).collect() == []
    lone = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in st.near_copies(lone).collect()] == [(1, "0" * 16, 1)]
