"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, gives every position a probability of each language, and a
document the mean over its positions. It is trained in numpy by backpropagation through time, on a bounded
sample of crops, and then applied to whole texts inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.tokens import release, slices

UNKNOWN = "und"
#: Bound of the training sample: crops per language and characters per crop.
CROPS, CROP_CHARS = 400, 96
#: Units of each direction, bytes of a segment of a text, and segments that are read at once.
UNITS, SEGMENT, BLOCK = 8, 128, 2048
STEPS, BATCH, RATE = 130, 160, 0.015
#: Crops of one text at most, where a language has few texts.
CROPS_EACH = 8


@dataclass
class Network:
    """Tables of the two directions (3H x 256 input, 3H x H state), output L x 2H and its offset."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    def probabilities(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(T, L, B) probabilities of bytes (T, B), of which a column has its first `lengths`; others stand behind them."""
        w = self.weights
        ahead = states(w["ahead_x"], w["ahead_h"], codes)[0]
        back = turned(states(w["back_x"], w["back_h"], turned(codes, lengths))[0], lengths)
        logits = w["out_ahead"] @ ahead + w["out_back"] @ back + w["out"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits


def turned(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each column's own steps in reverse order, what stands behind them left in place; (T, B) or (T, H, B).

    The backward direction so starts at a text's own end, whatever the other columns' lengths are.
    """
    steps = len(values)
    if not len(lengths) or lengths.min() == steps:
        return values[::-1]
    place = np.arange(steps)[:, None]
    place = np.where(place < lengths, lengths - 1 - place, place)
    return np.take_along_axis(values, place if values.ndim == 2 else place[:, None, :], axis=0)


def states(table: np.ndarray, recurrent: np.ndarray, codes: np.ndarray, trace: bool = False):
    """Hidden states (T, H, B); with `trace` also what the backward pass needs.

    The first 2H rows are the update and reset gates, the last H the candidate.
    """
    steps, batch = codes.shape
    h = recurrent.shape[1]
    state = np.zeros((h, batch), dtype=np.float32)
    out = np.empty((steps, h, batch), dtype=np.float32)
    kept = [np.empty((steps, n, batch), dtype=np.float32) for n in (2 * h, h, h)] if trace else None
    for t in range(steps):
        x = np.take(table, codes[t], axis=1)
        u = recurrent @ state
        gates = x[: 2 * h]
        gates += u[: 2 * h]
        gates *= 0.5  # the logistic function by the faster tanh
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new = gates[h:] * u[2 * h :]
        new += x[2 * h :]
        np.tanh(new, out=new)
        if trace:
            kept[0][t], kept[1][t], kept[2][t] = gates, new, u[2 * h :]
        state = state - new
        state *= gates[:h]
        state += new
        out[t] = state
    return out, kept


def gradients(table, recurrent, codes, out, kept, d_out) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time for one direction."""
    gates, new, inner = kept
    steps, h, batch = out.shape
    d_state, d_rec = np.zeros((h, batch), dtype=np.float32), np.zeros_like(recurrent)
    d_x = np.empty((steps, 3 * h, batch), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        before = out[t - 1] if t else np.zeros((h, batch), dtype=np.float32)
        update, reset = gates[t, :h], gates[t, h:]
        d = d_state + d_out[t]
        a_new = d * (1 - update) * (1 - new[t] ** 2)
        a_update = d * (before - new[t]) * update * (1 - update)
        a_reset = a_new * inner[t] * reset * (1 - reset)
        d_x[t, :h], d_x[t, h : 2 * h], d_x[t, 2 * h :] = a_update, a_reset, a_new
        through = np.concatenate([a_update, a_reset, a_new * reset])
        d_rec += through @ before.T
        d_state = d * update + recurrent.T @ through
    flat = d_x.transpose(1, 0, 2).reshape(3 * h, -1)
    which = (codes.reshape(-1)[:, None] == np.arange(table.shape[1])).astype(np.float32)
    return flat @ which, d_rec


def train(texts: list[bytes], labels: list[str], units: int = UNITS, steps: int = STEPS, seed: int = 7) -> Network:
    """Fit by Adam on the cross entropy of every position; the order of the rows doesn't matter beforehand."""
    languages = sorted(set(labels))
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    rng = np.random.default_rng(seed)
    width = max([1, *(len(x) for x in texts)])
    codes, real = padded([texts[i] for i in order], width)
    lengths = real.sum(axis=0)
    target = np.array([languages.index(labels[i]) for i in order])
    n, many = len(order), len(languages)
    shapes = {"ahead_x": (3 * units, 256), "ahead_h": (3 * units, units), "back_x": (3 * units, 256), "back_h": (3 * units, units),
              "out_ahead": (many, units), "out_back": (many, units), "out": (many,)}
    w = {k: (rng.standard_normal(s) * (0.5 if k[-1] == "x" else 0.3)).astype(np.float32) for k, s in shapes.items()}
    w["out"][:] = 0
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    epochs = -(-steps // max(1, -(-n // BATCH)))
    total = max(1, epochs * -(-n // BATCH))
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = shuffled[at : at + BATCH]
            c, mask, own = codes[:, rows], real[:, rows].astype(np.float32), lengths[rows]
            ahead, kept_a = states(w["ahead_x"], w["ahead_h"], c, True)
            c_r = turned(c, own)
            back_r, kept_b = states(w["back_x"], w["back_h"], c_r, True)
            back = turned(back_r, own)
            logits = w["out_ahead"] @ ahead + w["out_back"] @ back + w["out"][:, None]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[:, target[rows], np.arange(len(rows))] -= 1
            p *= (mask / max(1.0, mask.sum()))[:, None, :]
            grads = {"out_ahead": np.einsum("tlb,thb->lh", p, ahead), "out_back": np.einsum("tlb,thb->lh", p, back), "out": p.sum(axis=(0, 2))}
            grads["ahead_x"], grads["ahead_h"] = gradients(w["ahead_x"], w["ahead_h"], c, ahead, kept_a, w["out_ahead"].T @ p)
            grads["back_x"], grads["back_h"] = gradients(w["back_x"], w["back_h"], c_r, back_r, kept_b, turned(w["out_back"].T @ p, own))
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(size, 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.98 * second[k] + 0.02 * g * g
                w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
    return Network(languages, w)


def padded(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, real) of shape (T, B); byte 0 fills short columns."""
    codes = np.zeros((len(texts), width), dtype=np.uint8)
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    real = np.arange(width) < lengths[:, None]
    codes[real] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return np.ascontiguousarray(codes.T), np.ascontiguousarray(real.T)


def training_crops(docs: DataFrame, held_out: Column, id_col: str, text_col: str, lang_col: str, crops: int) -> list[tuple[bytes, str]]:
    """A sample of labelled crops, at most `crops` per language, from rows that aren't held out.

    Rows are chosen by a hash of the id, with a threshold from the language's row count, so the sample is
    bounded whatever the table's size; each crop starts at a hashed place.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    rows = docs.filter(~held_out & lang.isNotNull() & text.isNotNull() & text.rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang.cast("string")).count().collect()}
    # a little more than wanted is asked for, then the lowest hashes are taken
    share = {k: min(1.0, 1.2 * crops / n + 20 / n) for k, n in counts.items()}
    if not share:
        return []
    limits = F.create_map(*[F.lit(x) for k, v in sorted(share.items()) for x in (k, v)])
    each = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(CROPS_EACH, -(-crops // n)))])
    rows = rows.withColumn("crop_no", F.explode(F.sequence(F.lit(1), each[lang.cast("string")])))
    place = (F.xxhash64(F.col(id_col).cast("string"), F.length(text), "crop_no") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    start = F.lit(1) + (place * F.greatest(F.length(text) - CROP_CHARS + 1, F.lit(1))).cast("int")
    chosen = (
        rows.select(F.xxhash64(F.lit("crop"), F.col(id_col).cast("string"), F.crc32(text), "crop_no").alias("h"), lang.cast("string").alias("lang"),
                    F.substring(text, start, F.lit(CROP_CHARS)).alias("crop"))
        .filter((F.col("h") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003 < limits[F.col("lang")])
        .select("h", "lang", "crop")
    )
    found: dict[str, list] = {}
    for r in sorted(chosen.collect()):
        found.setdefault(r.lang, []).append(r.crop.encode()[:CROP_CHARS])
    return [(crop, k) for k, v in sorted(found.items()) for crop in v[:crops]]


def predict_texts(texts: pa.Array, network: Network) -> tuple[list[str], np.ndarray]:
    """Language and pooled probability of each text, over all of its bytes."""
    n, many = len(texts), len(network.languages)
    if not many:
        return [UNKNOWN] * n, np.zeros(n)
    readable = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    held = pc.if_else(pa.array(readable), texts, "").cast(pa.large_binary())
    lengths = pc.binary_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(held.to_pylist()), dtype=np.uint8)
    # segments of nearly equal length, so that no text ends in a tiny one
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(n), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    base = np.repeat(np.cumsum(lengths) - lengths, pieces)
    begin = base + place * lengths[owner] // np.maximum(pieces[owner], 1)
    end = base + (place + 1) * lengths[owner] // np.maximum(pieces[owner], 1)
    sums = np.zeros((n, many))
    order = np.argsort(end - begin, kind="stable")  # segments of like lengths together
    for at in range(0, len(order), BLOCK):
        rows = order[at : at + BLOCK]
        size = end[rows] - begin[rows]
        where = begin[rows] + np.arange(size.max())[:, None]
        real = np.arange(size.max())[:, None] < size
        codes = np.where(real, data[np.minimum(where, len(data) - 1)], 0)
        p = network.probabilities(codes, size)
        pooled = np.einsum("tlb,tb->bl", p, real.astype(np.float32))
        for k in range(many):
            sums[:, k] += np.bincount(owner[rows], pooled[:, k], n)
    mean = sums / np.maximum(lengths, 1)[:, None]
    best, known = mean.argmax(axis=1), readable
    names = [network.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
    return names, np.where(known, np.clip(mean.max(axis=1, initial=0), 0, 1), 0.0)


def identify(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): `row` is a struct of all columns of `docs`.

    A null text, one without a letter, or a network without languages gives "und" and score 0.
    """
    packed = docs.select(F.struct("*").alias("row"))
    schema = packed.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = packed.sparkSession.sparkContext.broadcast(network)  # of a fixed size

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), text_col).cast(pa.string())
            for part in slices(pa.RecordBatch.from_arrays([batch.column("row"), texts], names=["row", "text"]), "text"):
                names, score = predict_texts(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])
                release()

    return packed.mapInArrow(predict, schema)


def fit(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", crops: int = CROPS) -> Network:
    sample = training_crops(docs, F.lit(False) if held_out is None else held_out, id_col, text_col, lang_col, crops)
    return train([x for x, _ in sample], [k for _, k in sample])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def recognised_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows with a language of a score of `least` or more, all columns as they are.

    A text of one language scores about 0.95; below 0.3 no language has even a third of the positions. Where no
    row with a letter is labelled there is nothing to learn or to judge by: all rows with a letter stay.
    """
    network = fit(docs, None, id_col, text_col, lang_col)
    if not network.languages:
        return docs.filter(F.col(text_col).cast("string").rlike(r"\p{L}"))
    found = identify(docs, network, text_col)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
