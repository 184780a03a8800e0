import pathlib
import random
import zlib

import numpy as np
import pytest

from kelpmill.llm import language_id as li

from . import cases

FOLDER = pathlib.Path("/root/testdata/sf0.01")
SYLLABLES = {"x": ["ba", "bo", "bu", "ra"], "y": ["ke", "ki", "né", "mi"], "z": ["ß", "st", "au", "ba"]}


def text(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))


def test_gradients_against_differences():
    net = li.start(["a", "b", "c"], 3, 5)
    net = li.Network(net.languages, *(li.Direction(*(w.astype(np.float64) for w in d)) for d in (net.forward, net.backward)), net.out.astype(np.float64))
    rng = np.random.default_rng(1)
    symbols, labels = rng.integers(97, 101, (7, 4)), np.array([0, 1, 2, 1])
    symbols[5:, 2] = li.PAD
    _, grads = li.gradients(net, symbols, labels)
    for w, g in zip(li.weights(net), grads, strict=True):
        for k in rng.integers(0, w.size, 12).tolist() + ([98 * 9 + 1] if w.shape[0] == 257 else []):
            flat = w.reshape(-1)
            kept = flat[k]
            flat[k] = kept + 1e-3
            up = li.gradients(net, symbols, labels)[0]
            flat[k] = kept - 1e-3
            down = li.gradients(net, symbols, labels)[0]
            flat[k] = kept
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_every_position_counts():
    texts = [b"a" * 1, b"b" * 64, b"c" * 65, b"", b"d" * 1000]
    symbols, lane = li.windows(texts)
    assert [(symbols[:, lane == k] != li.PAD).sum() for k in range(5)] == [1, 64, 65, 0, 1000]


def test_held_out_accuracy(spark):
    draw = random.Random(6)
    rows = [(k, text(draw, lang, draw.choice([8, 40, 400])), lang, "s", 0) for k, lang in enumerate(draw.choice("xyz") for _ in range(600))]
    docs = cases.documents(spark, rows)
    net = li.train(li.excerpts_of(docs, "doc_id", "text", "lang", per_language=60), epochs=6)
    out = li.identify(docs, net).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    test = [(r.lang_pred, row[2]) for r, row in zip(out, rows, strict=True) if r.held_out]
    assert sum(a == b for a, b in test) > 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in out)


def test_sample_is_bounded(spark):
    docs = cases.documents(spark, [(k, f"text number {k} of them", "x" if k % 9 else "y", "s", 0) for k in range(2000)])
    found = li.excerpts_of(docs, "doc_id", "text", "lang", per_language=30)
    assert {lang for lang, _ in found} == {"x", "y"} and len(found) <= 2 * 30 * li.EXCERPTS


def plain(net, body):
    """One byte after another, one document at a time."""
    h, data = net.forward.back.shape[0], body.encode()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def walk(d, part):
        state, out = np.zeros(h), []
        for b in part:
            read, old = d.table[b].astype(float), state @ d.back
            update, reset = sigmoid(read[:h] + old[:h]), sigmoid(read[h : 2 * h] + old[h : 2 * h])
            state = update * state + (1 - update) * np.tanh(read[2 * h :] + reset * old[2 * h :])
            out.append(state)
        return out

    total = np.zeros(len(net.languages))
    for at in range(0, len(data), li.WINDOW):
        part = data[at : at + li.WINDOW]
        padded = [*part, *[li.PAD] * (li.WINDOW - len(part))]
        ahead, back = walk(net.forward, padded), walk(net.backward, padded[::-1])[::-1]
        for k in range(len(part)):
            scores = np.exp(np.concatenate([ahead[k], back[k], [1.0]]) @ net.out)
            total += scores / scores.sum()
    return total / max(1, len(data))


def test_predictions_against_a_plain_pass():
    draw = random.Random(12)
    net = li.train([(lang, text(draw, lang, 20).encode()) for lang in "xyz" for _ in range(30)], epochs=2)
    texts = [text(draw, draw.choice("xyz"), n) for n in (1, 2, 7, 15, 40, 90)] + ["é", "12 34", ""]
    for body, lang, score in zip(texts, *li.predict(net, texts), strict=True):
        want = plain(net, body)
        if any(map(str.isalpha, body)):
            assert score == pytest.approx(want.max(), abs=1e-4) and want[net.languages.index(lang)] == pytest.approx(want.max(), abs=1e-4)
        else:
            assert (lang, score) == ("und", 0.0)


def test_rows_of_one_id_and_equal_rows_are_drawn(spark):
    docs = cases.documents(spark, [(None, f"text {k}", "x", "s", 0) for k in range(1200)] + [(next(k for k in range(9) if zlib.crc32(str(k).encode()) % 4 != 2), "ever the same", "y", "s", 0)] * 1200)
    found = li.excerpts_of(docs, "doc_id", "text", "lang", per_language=30)
    assert len({t for lang, t in found if lang == "x"}) == 30 and {t for lang, t in found if lang == "y"} == {b"ever the same"}


def test_cases(spark):
    net = li.train(li.excerpts_of(cases.clashing(spark), "doc_id", "text", "lang"), epochs=1)
    for r, (_, body, *_) in zip(li.identify(cases.clashing(spark), net).collect(), cases.documents(spark).collect(), strict=True):
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, body or "")))
    assert li.identify(cases.empty(spark), net).count() == 0
    nothing = li.train(li.excerpts_of(cases.empty(spark), "doc_id", "text", "lang"))
    assert {(r.lang_pred, r.score) for r in li.identify(cases.documents(spark), nothing).collect()} == {("und", 0.0)}


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")
def test_held_out_accuracy_on_the_given_tables(spark):
    rows = li.op4_language_id(spark, str(FOLDER)).where("held_out")
    rows = rows.join(spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
