import math
import random
import re
from collections import Counter

import pytest

from tallyscope.llm import lexical_search as ls
from tallyscope.llm.queries import op13_ranking
from tests.llm import cases


def plain_terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_search(docs, items, top):
    bags = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    n_docs = sum(bool(bag) for _, bag in bags)
    length = sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs // length if length else 0)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t in plain_terms(text)
                if t in bag
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, unknown, doc_id) in enumerate(sorted(scored)[:top], 1):
            out.append((item_id, rank, None if unknown else doc_id, -score))
    return out


def same(found, expected):
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def table(seed=0, count=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Über", "x9", "A", "ÉÉ"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", "\x7f"]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 5, 40, 400]))) for k in range(count)]
    docs += [(1000 + k, docs[7][1]) for k in range(60)]  # equal scores
    items = [(k, text(rng.choice([0, 1, 3, 12]))) for k in range(30)] + [(4, "w1 w1 w2"), (None, "w3"), (5, None)]
    return docs, items + items[:2]


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 20, 1 << 21), (16, 64, 40)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_POSTINGS", "ADDED_AT_ONCE", "CELLS_AT_ONCE"), sizes, strict=True):
        monkeypatch.setattr(ls, name, value)
    docs, items = table()
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    same(ls.search(documents, benchmark, 5).collect(), plain_search(docs, items, 5))


def test_query(spark, tmp_path):
    docs = [(r[0], r[1]) for r in cases.ROWS]
    items = [(1, "One, two! lines 😀"), (2, "lorem"), (3, None), (4, ""), (5, "nowhere"), (6, "THREE three")]
    cases.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as score", "3 as item").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    same(op13_ranking(spark, str(tmp_path)).collect(), plain_search(docs, items, 20))


def test_empty(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([(1, None), (2, "?!")], "doc_id long, text string")
    assert ls.search(cases.empty(spark), items).collect() == []
    assert ls.search(none, items).collect() == []
    assert ls.search(cases.frame(spark), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ls.search(cases.frame(spark), items.limit(0)).collect() == []
