import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import language as lg
from tallyscope.llm.tokens import text_parts
from tests.llm.cases import ROWS, empty, frame

WORDS = {"xx": ["kol", "tak", "oka", "lota"], "yy": ["mine", "eris", "sein", "ires"], "zz": ["ŭvŭ", "ŭgb", "vvu", "bug"]}


def text(lang, seed, count=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], size=count))


def test_gradients():
    model = lg.ByteGru.fresh(["a", "b", "c"])
    model.weights = {name: w.astype(np.float64) for name, w in model.weights.items()}
    rng = np.random.default_rng(1)
    windows, label = rng.integers(0, 256, (5, 9)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = model.gradients(windows, label)
    for name, weight in model.weights.items():
        where = np.unravel_index(np.abs(grads[name]).argmax(), weight.shape)
        sides = []
        for step in (1e-5, -2e-5):
            weight[where] += step
            sides.append(model.gradients(windows, label)[0])
        weight[where] += 1e-5
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(grads[name][where], rel=1e-3, abs=1e-7)


def test_prediction_equals_the_training_pass(monkeypatch):
    model = lg.ByteGru.fresh(["a", "b"])
    monkeypatch.setattr(lg, "WINDOW", 16)
    texts = ["", "short", "exactly sixteen!", "quite a bit longer than one window of bytes, é too"]
    odds = model.probabilities(*text_parts(pa.array(texts)))
    assert odds[0].sum() == 0
    for row, value in zip(odds[1:], texts[1:], strict=True):
        data = np.frombuffer(value.encode(), np.uint8)
        total = np.zeros(2)
        for at in range(0, len(data), 16):
            steps = data[at : at + 16][:, None]
            fore, _ = model._train_side("fore", steps)
            back, _ = model._train_side("back", steps[::-1])
            scores = np.einsum("lh,thb->tlb", model.weights["out"], np.concatenate([fore, back[::-1]], axis=1))
            odd = np.exp(scores + model.weights["out_bias"])
            total += (odd / odd.sum(axis=1, keepdims=True)).sum(axis=(0, 2))
        assert row == pytest.approx(total / len(data), abs=1e-5)


def test_learns_from_the_other_folds_only(spark):
    rows = [(k, text(lang, k), lang, "s") for k, lang in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(900, "12345 !!", "xx", "s"), (901, None, "yy", "s"), (902, "", None, "s"), (903, text("zz", 903), None, None)]
    df = frame(spark, rows)
    out = {r.doc_id: r for r in lg.identify(df).collect()}
    assert len(out) == len(rows)
    fold = {r.doc_id: r.f for r in df.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("f")).collect()}
    assert all(out[k].held_out == (fold[k] == 0) for k in out)
    held = [k for k in range(120) if out[k].held_out]
    assert held and np.mean([out[k].lang_pred == rows[k][2] for k in held]) > 0.95
    assert [(out[k].lang_pred, out[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3 and out[903].lang_pred == "zz"
    assert all(0 <= r.score <= 1 for r in out.values())
    # A language that only the held-out fold has is not learned.
    alone = [(k, text("xx" if fold[k] else "yy", k), "xx" if fold[k] else "yy", "s") for k in range(60)]
    assert {r.lang_pred for r in lg.identify(frame(spark, alone)).collect()} == {"xx"}


def test_odd_rows(spark):
    out = lg.identify(frame(spark))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == len(ROWS)
    assert lg.identify(empty(spark)).collect() == []
    unlabelled = [(k, "some words here", None, None) for k in range(5)]
    assert {r.lang_pred for r in lg.identify(frame(spark, unlabelled)).collect()} == {"und"}
