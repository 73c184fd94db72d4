"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of 128 bytes, forwards and backwards, labels every byte from both states and
pools the label probabilities of all bytes into those of the document. Gates and candidate states use softsign, whose
slope is rational and cheap on a CPU. It is trained in numpy by backpropagation through time with Adam.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

from tallyscope.llm.tokens import in_small_batches, text_parts

UNKNOWN = "und"
HIDDEN = 8
#: Bytes of a window when predicting, and windows that are computed together.
WINDOW, BATCH = 128, 2048
#: Training sample: at most this many documents of a language and hash class, of so many classes, and windows of so many
#: bytes from each document.
SAMPLE_DOCS, SAMPLE_CLASSES, SAMPLE_WINDOWS, SAMPLE_BYTES = 38, 16, 4, 64
TRAIN_STEPS, TRAIN_BATCH, RATE = 160, 512, 0.02

_PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64())])
_LETTER = r"\p{L}"


def _softsign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope."""
    width = 1 / (1 + np.abs(x))
    return x * width, width * width


@dataclass
class ByteGru:
    """Parameters by name; both directions have a byte table, a recurrent matrix and its bias."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> ByteGru:
        rng = np.random.default_rng(seed)
        weights = {}
        for side in ("fore", "back"):
            weights[f"{side}_in"] = rng.normal(0, 0.5, (3 * HIDDEN, 256)).astype(np.float32)
            weights[f"{side}_rec"] = rng.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)).astype(np.float32)
            weights[f"{side}_bias"] = np.zeros((3 * HIDDEN, 1), dtype=np.float32)
        weights["out"] = rng.normal(0, 0.3, (len(langs), 2 * HIDDEN)).astype(np.float32)
        weights["out_bias"] = np.zeros((len(langs), 1), dtype=np.float32)
        return cls(langs, weights)

    # training

    def _train_side(self, side: str, steps: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step, and what the backward pass needs. ``steps``: (time, batch) bytes."""
        table, rec, bias = (self.weights[f"{side}_{part}"] for part in ("in", "rec", "bias"))
        state = np.zeros((HIDDEN, steps.shape[1]), dtype=np.float32)
        states, tape = [], []
        for now in steps:
            given = table[:, now]
            carried = rec @ state + bias
            gates, gate_slope = _softsign(given[: 2 * HIDDEN] + carried[: 2 * HIDDEN])
            gates = 0.5 + 0.5 * gates
            keep, reset = gates[:HIDDEN], gates[HIDDEN:]
            new, new_slope = _softsign(given[2 * HIDDEN :] + reset * carried[2 * HIDDEN :])
            tape.append((now, state, keep, reset, new, carried[2 * HIDDEN :], 0.5 * gate_slope, new_slope))
            state = new + keep * (state - new)
            states.append(state)
        return np.stack(states), tape

    def _back_side(self, side: str, tape: list, d_states: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        rec = self.weights[f"{side}_rec"]
        d_in = grads[f"{side}_in"] = np.zeros_like(self.weights[f"{side}_in"])
        d_rec = grads[f"{side}_rec"] = np.zeros_like(rec)
        d_bias = grads[f"{side}_bias"] = np.zeros((3 * HIDDEN, 1), dtype=np.float32)
        later = np.zeros_like(d_states[0])
        for (now, before, keep, reset, new, carried, gate_slope, new_slope), d_out in zip(
            reversed(tape), reversed(d_states), strict=True
        ):
            d_state = d_out + later
            d_new = d_state * (1 - keep) * new_slope
            d_gates = np.concatenate([d_state * (before - new), d_new * carried]) * gate_slope
            d_given = np.concatenate([d_gates, d_new])
            d_carried = np.concatenate([d_gates, d_new * reset])
            for row, values in enumerate(d_given):
                d_in[row] += np.bincount(now, weights=values, minlength=256)
            d_rec += d_carried @ before.T
            d_bias += d_carried.sum(axis=1, keepdims=True)
            later = d_state * keep + rec.T @ d_carried

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients. ``windows``: (batch, time) bytes."""
        steps = windows.T
        fore, fore_tape = self._train_side("fore", steps)
        back, back_tape = self._train_side("back", steps[::-1])
        both = np.concatenate([fore, back[::-1]], axis=1)
        scores = np.einsum("lh,thb->tlb", self.weights["out"], both) + self.weights["out_bias"]
        scores -= scores.max(axis=1, keepdims=True)
        odds = np.exp(scores)
        odds /= odds.sum(axis=1, keepdims=True)
        column = np.arange(len(label))
        loss = -float(np.log(np.maximum(odds[:, label, column], 1e-9)).mean())
        d_scores = odds
        d_scores[:, label, column] -= 1
        d_scores /= d_scores.shape[0] * d_scores.shape[2]
        grads = {
            "out": np.einsum("tlb,thb->lh", d_scores, both),
            "out_bias": d_scores.sum(axis=(0, 2))[:, None],
        }
        d_both = np.einsum("lh,tlb->thb", self.weights["out"], d_scores)
        self._back_side("fore", fore_tape, d_both[:, :HIDDEN], grads)
        self._back_side("back", back_tape, d_both[::-1, HIDDEN:], grads)
        return loss, grads

    def fit(self, windows: np.ndarray, label: np.ndarray, steps: int = TRAIN_STEPS, seed: int = 11) -> list[float]:
        """Adam on batches that draw every language alike; returns the losses."""
        rng = np.random.default_rng(seed)
        first = {name: np.zeros_like(w) for name, w in self.weights.items()}
        second = {name: np.zeros_like(w) for name, w in self.weights.items()}
        members = [np.flatnonzero(label == k) for k in range(len(self.langs))]
        losses = []
        for step in range(1, steps + 1):
            kinds = np.arange(TRAIN_BATCH) % len(members)
            chosen = np.array([members[k][int(u * len(members[k]))] for k, u in zip(kinds, rng.random(TRAIN_BATCH))])
            loss, grads = self.gradients(windows[chosen], label[chosen])
            losses.append(loss)
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for name, grad in grads.items():
                grad = grad * min(1.0, 1 / max(norm, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad * grad
                mean, square = first[name] / (1 - 0.9**step), second[name] / (1 - 0.99**step)
                self.weights[name] = (self.weights[name] - rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
        return losses

    # prediction

    def _states(self, side: str, steps: np.ndarray, live: list[int]) -> np.ndarray:
        """(time, hidden, batch) states; of step t only the first ``live[t]`` columns are computed, the others are 0."""
        rec, bias = self.weights[f"{side}_rec"], self.weights[f"{side}_bias"]
        table = self.weights[f"{side}_in"].copy()
        table[: 2 * HIDDEN] += bias[: 2 * HIDDEN]
        states = np.zeros((len(steps), HIDDEN, steps.shape[1]), dtype=np.float32)
        state = np.zeros((HIDDEN, steps.shape[1]), dtype=np.float32)
        order = range(len(steps)) if side == "fore" else range(len(steps) - 1, -1, -1)
        for t in order:
            n = live[t]
            given = table.take(steps[t, :n], axis=1)
            before = state[:, :n]
            carried = rec @ before
            gates, new = given[: 2 * HIDDEN], given[2 * HIDDEN :]
            gates += carried[: 2 * HIDDEN]
            size = np.abs(gates)
            size += 1
            gates /= size
            gates *= 0.5
            gates += 0.5
            inner = carried[2 * HIDDEN :]
            inner += bias[2 * HIDDEN :]
            inner *= gates[HIDDEN:]
            new += inner
            size = np.abs(new)
            size += 1
            new /= size
            change = before - new
            change *= gates[:HIDDEN]
            change += new
            state[:, :n] = change
            states[t, :, :n] = change
        return states

    def window_sums(self, steps: np.ndarray, live: list[int]) -> np.ndarray:
        """(languages, batch): label probabilities summed over the bytes of each window."""
        fore, back = self._states("fore", steps, live), self._states("back", steps, live)
        total = np.zeros((len(self.langs), steps.shape[1]), dtype=np.float64)
        out, bias = self.weights["out"], self.weights["out_bias"]
        for t, n in enumerate(live):
            scores = out[:, :HIDDEN] @ fore[t, :, :n]
            scores += out[:, HIDDEN:] @ back[t, :, :n]
            scores += bias
            scores -= scores.max(axis=0)
            np.exp(scores, out=scores)
            scores /= scores.sum(axis=0)
            total[:, :n] += scores
        return total

    def probabilities(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(documents, languages) from the bytes of documents that lie one after the other in ``data``.

        A document without bytes gets zeros.
        """
        pieces = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[doc] + nth * WINDOW
        width = np.minimum(WINDOW, sizes[doc] - nth * WINDOW)
        order = np.argsort(-width, kind="stable")
        pooled = np.zeros((len(sizes), len(self.langs)))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            longest = int(width[some[0]])
            place = np.minimum(begin[some] + np.arange(longest)[:, None], max(len(data) - 1, 0))
            live = np.searchsorted(-width[some], -np.arange(longest), side="left").tolist()
            sums = self.window_sums(data[place], live)
            for k in range(len(self.langs)):
                pooled[:, k] += np.bincount(doc[some], weights=sums[k], minlength=len(sizes))
        return pooled / np.maximum(sizes, 1)[:, None]


def sample_windows(
    docs: DataFrame, text: Column, lang: Column, usable: Column, docs_per_class: int = SAMPLE_DOCS
) -> DataFrame:
    """``lang, window``: at most ``SAMPLE_WINDOWS`` windows of ``docs_per_class`` documents of each language and class.

    Documents are drawn by a hash of their text, so the draw does not depend on partitions or order. Classes of that hash
    split a frequent language into many groups, and row limits are applied before the shuffle.
    """

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def windows(texts: pa.Array) -> pa.Array:
        data, starts, sizes = text_parts(texts)
        out = []
        for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            room = size - SAMPLE_BYTES
            places = {room * k // SAMPLE_WINDOWS for k in range(SAMPLE_WINDOWS)} if room >= 0 else ()
            out.append([data[start + p : start + p + SAMPLE_BYTES].tobytes() for p in sorted(places)])
        return pa.array(out, type=pa.list_(pa.binary()))

    labelled = in_small_batches(docs).filter(usable & lang.isNotNull() & (F.octet_length(text) >= SAMPLE_BYTES)).select(
        lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("draw")
    )
    group = Window.partitionBy("lang", F.pmod("draw", F.lit(SAMPLE_CLASSES)))
    nth = F.row_number().over(group.orderBy("draw", "text"))
    drawn = labelled.withColumn("nth", nth).filter(F.col("nth") <= docs_per_class)
    return drawn.select("lang", F.explode(windows("text")).alias("window"))


def train(sample: DataFrame) -> ByteGru | None:
    """Fit on the bounded rows of ``sample_windows``; None if there are none. Ties are broken by the window's bytes."""
    rows = sorted((row.lang, bytes(row.window)) for row in sample.collect())
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    model = ByteGru.fresh(langs)
    windows = np.frombuffer(b"".join(w for _, w in rows), dtype=np.uint8).reshape(len(rows), SAMPLE_BYTES)
    model.fit(windows, np.array([langs.index(lang) for lang, _ in rows]))
    return model


def predictor(model: ByteGru | None):
    """Column function: text to ``struct<lang, score>``.

    ``und`` with score 0 if the text is null, empty or without a letter, or if nothing could be learned. Ties go to the
    language that sorts first.
    """

    @F.arrow_udf(from_arrow_type(_PREDICTED))
    def predict(texts: pa.Array) -> pa.Array:
        data, starts, sizes = text_parts(texts)
        odds = model.probabilities(data, starts, sizes)
        best = odds.argmax(axis=1)
        score = np.clip(odds[np.arange(len(best)), best], 0.0, 1.0)
        return pa.StructArray.from_arrays(
            [pa.array([model.langs[k] for k in best.tolist()], type=pa.string()), pa.array(score)],
            fields=list(_PREDICTED),
        )

    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))

    def column(text: Column) -> Column:
        if model is None:
            return nothing
        return F.when(F.coalesce(text.rlike(_LETTER), F.lit(False)), predict(text)).otherwise(nothing)

    return column


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document belongs to the fold that is not learned from; false for a null id, which is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5
) -> DataFrame:
    """One row per input row: ``id_col, held_out, lang_pred, score``.

    The model learns from documents with a language outside the held-out fold; language, source and id are no inputs of
    a prediction. Repeated rows give repeated rows; other columns are not carried; an empty table gives an empty result.
    """
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    learn = F.crc32(doc_id.cast("string").cast("binary")) % folds != 0
    model = train(sample_windows(docs, text, F.col(f"`{lang_col}`").cast("string"), learn))
    return docs.select(
        doc_id, held_out(doc_id, folds).alias("held_out"), predictor(model)(text).alias("predicted")
    ).select(
        F.col(f"`{id_col}`"), "held_out", F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score")
    )
