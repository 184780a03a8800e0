"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are read in windows of bytes, both ways. Every position gets probabilities of the languages from the two states that
meet there; a document's are the means over all its positions. The network is trained on the driver by
backpropagation through time, from excerpts of a bounded number of labelled documents for each language; the weights
are some hundred kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .mixing import draw
from .words import batches_of, slices

UNKNOWN = "und"
WINDOW = 64
HIDDEN = 8
#: Bound of the sample: documents of each language, and excerpts of one window from each.
PER_LANGUAGE = 400
EXCERPTS = 4
EPOCHS = 10
BATCH = 128
RATE = 0.02
LANES = 2048
PAD = 256


class Direction(NamedTuple):
    table: np.ndarray  # input and bias by byte: update, reset and candidate
    back: np.ndarray  # from the state before


class Network(NamedTuple):
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # from both states and 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(languages: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    scaled = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    made = [Direction((rng.standard_normal((PAD + 1, 3 * hidden)) * 0.3).astype(np.float32), scaled(hidden, 3 * hidden)) for _ in range(2)]
    return Network(languages, *made, scaled(2 * hidden + 1, len(languages)))


def states(d: Direction, symbols: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The states (step, hidden, lane) after each step, for symbols of (step, lane); keep gets what the way back needs."""
    h = d.back.shape[0]
    table, back = np.ascontiguousarray(d.table.T), np.ascontiguousarray(d.back.T)
    state = np.zeros((h, symbols.shape[1]), np.float32)
    out = np.empty((len(symbols), *state.shape), np.float32)
    for t, row in enumerate(symbols):
        read, old = table.take(row, axis=1), back @ state
        gates = _sigmoid(read[: 2 * h] + old[: 2 * h])
        update, reset = gates[:h], gates[h:]
        new = np.tanh(read[2 * h :] + reset * old[2 * h :])
        if keep is not None:
            keep.append((row, state, update, reset, new, old[2 * h :]))
        state = new + update * (state - new)
        out[t] = state
    return out


def through_time(d: Direction, keep: list, grad_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of (table, back), given the loss's by every state."""
    table, back = np.zeros_like(d.table), np.zeros_like(d.back)
    grad = np.zeros_like(grad_out[0])
    for (row, before, update, reset, new, old_new), more in zip(reversed(keep), grad_out[::-1], strict=True):
        grad = grad + more
        d_new = grad * (1 - update) * (1 - new * new)
        d_update = grad * (before - new) * update * (1 - update)
        d_reset = d_new * old_new * reset * (1 - reset)
        read = np.concatenate([d_update, d_reset, d_new])
        old = np.concatenate([d_update, d_reset, d_new * reset])
        np.add.at(table, row, read.T)
        back += before @ old.T
        grad = grad * update + d.back @ old
    return table, back


def chances_of(net: Network, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """(step, language, lane) from the states of both directions at each step."""
    h = ahead.shape[1]
    scores = np.ascontiguousarray(net.out[:h].T) @ ahead
    scores += np.ascontiguousarray(net.out[h:-1].T) @ behind
    scores += net.out[-1][:, None]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def probabilities(net: Network, symbols: np.ndarray) -> np.ndarray:
    """(step, language, lane)."""
    return chances_of(net, states(net.forward, symbols), states(net.backward, symbols[::-1])[::-1])


def gradients(net: Network, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean loss over the positions that aren't padding, gradients in the order of weights())."""
    kept = [], []
    ahead, behind = states(net.forward, symbols, kept[0]), states(net.backward, symbols[::-1], kept[1])[::-1]
    chances = chances_of(net, ahead, behind)
    real = (symbols != PAD)[:, None].astype(np.float32)
    wanted = np.eye(len(net.languages), dtype=np.float32)[:, labels][None]
    loss = float(-(np.log(np.maximum((chances * wanted).sum(axis=1), 1e-12)) * real[:, 0]).sum() / real.sum())
    by_score = (chances - wanted) * real / real.sum()
    out = [np.einsum("tib,tjb->ij", both, by_score) for both in (ahead, behind)]
    out = np.concatenate([*out, by_score.sum(axis=(0, 2))[None]])
    by_state = net.out[:-1] @ by_score
    h = net.forward.back.shape[0]
    forward = through_time(net.forward, kept[0], by_state[:, :h])
    backward = through_time(net.backward, kept[1], by_state[::-1, h:])
    return loss, [*forward, *backward, out]


def weights(net: Network) -> list[np.ndarray]:
    return [*net.forward, *net.backward, net.out]


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of (step, lane), the text of each lane): whole texts, in lanes of size bytes, the last one padded."""
    lengths = np.array([len(t) for t in texts], np.int64)
    each = -(-lengths // size)
    text = np.repeat(np.arange(len(texts)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    ends = np.cumsum(lengths)
    at = (ends - lengths)[text] + nth * size
    place = at[None, :] + np.arange(size)[:, None]
    data = np.frombuffer(b"".join(texts) + b"\0", np.uint8).astype(np.int16)
    return np.where(place < ends[text][None, :], data[np.minimum(place, len(data) - 1)], PAD), text


def train(excerpts: list[tuple[str, bytes]], hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> Network:
    """Fit by Adam on (language, bytes) excerpts, of which each is a lane."""
    languages = sorted({lang for lang, _ in excerpts})
    net, rng = start(languages, hidden, seed), np.random.default_rng(seed)
    symbols, lane_of = windows([t[:WINDOW] for _, t in excerpts])
    labels = np.array([languages.index(lang) for lang, _ in excerpts], np.int64)[lane_of]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights(net)]
    step, steps = 0, epochs * -(-len(labels) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            step += 1
            _, grads = gradients(net, symbols[:, order[k : k + batch]], labels[order[k : k + batch]])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            pace = rate * (1 - 0.9 * step / steps)
            for w, g, (m, v) in zip(weights(net), grads, moments, strict=True):
                g = g / max(1.0, size)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: Network, texts: list[str]) -> tuple[list[str], list[float]]:
    """(languages, scores) of whole texts."""
    total = np.zeros((len(texts), len(net.languages)))
    for at, run in batches_of([t.encode() for t in texts] if net.languages else []):
        symbols, text = windows(run)
        for k in range(0, symbols.shape[1], LANES):
            part = symbols[:, k : k + LANES]
            np.add.at(total, at + text[k : k + LANES], (probabilities(net, part) * (part != PAD)[:, None]).sum(axis=0).T)
    best = total.argmax(axis=1) if len(net.languages) else np.zeros(len(texts), int)
    sizes = total.sum(axis=1)
    langs, scores = [], []
    for t, b, row, size in zip(texts, best.tolist(), total, sizes.tolist(), strict=True):
        known = size > 0 and any(map(str.isalpha, t))
        langs.append(net.languages[b] if known else UNKNOWN)
        scores.append(min(1.0, float(row[b]) / size) if known else 0.0)
    return langs, scores


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def excerpts_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """At most per_language documents of each language, those with the smallest draws, EXCERPTS windows of each.

    A draw is by id and text: rows that share an id (or have none) are drawn by their texts, and rows that are equal in both
    are drawn alike. The rows of a language's smallest draw are always in.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where(~held_out(F.col("id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.withColumn("draw", draw(F.concat_ws("#", F.col("id").cast("string"), F.xxhash64("text").cast("string")), "language"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least"))
    drawn = rows.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "lang").where((F.col("draw") * F.col("n") < 2 * per_language + 20) | (F.col("draw") == F.col("least")))
    cut = lambda k: F.substring("text", (F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1).cast("int"), WINDOW)
    drawn = drawn.select("lang", "draw", F.array(*map(cut, range(EXCERPTS))).alias("cuts"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "cuts"))
    found = drawn.withColumn("nth", first).where(F.col("nth") <= per_language).orderBy("lang", "nth").select("lang", "cuts").collect()
    return [(r["lang"], c.encode()) for r in found for c in dict.fromkeys(r["cuts"]) if c]


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred and score.

    Null texts and texts without a letter are `und` with score 0, and all are if nothing could be learned. Repeated
    rows are predicted alike; other columns are ignored.
    """
    rows = docs.select(docs[id_col].alias(id_col), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            langs, scores = predict(net, [t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predicted, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(excerpts_of(docs, "doc_id", "text", "lang")))


QUERIES = {"op4_language_id": (op4_language_id, None)}
