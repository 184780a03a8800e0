import random

import pytest

from kelpmill.llm import token_counts as tc
from kelpmill.llm.vocabulary import place, tokenizer

from . import cases

LETTERS = ["a", "b", "the", " ", "  ", "\n", " \n", "\t", "'s", "'", "'ll", "'re", "é", "ß", "1", "23", "!", "<|endoftext|>", "\xa0", "\U0001f600", "漢字", " ", "x" * 300, "Ω", "\x00", "\x1c", "²", "Ⅷ", "ing", "..."]


def wanted(texts):
    return [len(e.ids) for e in tokenizer(place(tc.VOCABULARY)).encode_batch(texts, add_special_tokens=False)]


def test_random_texts():
    draw = random.Random(1)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.choice([0, 1, 5, 60]))) for _ in range(1500)]
    assert list(tc.transducer(place(tc.VOCABULARY)).count_all(texts)) == wanted(texts)


def test_all_classes_and_long_pieces():
    texts = ["".join(map(chr, range(k, k + 64))) for k in range(0, 0xD800, 64)] + ["x" * 5000, " " * 3000 + "a", "ab" * 4000 + "\n", cases.LONG]
    assert list(tc.transducer(place(tc.VOCABULARY)).count_all(texts)) == wanted(texts)


def test_planes_above_and_long_runs():
    texts = ["".join(map(chr, range(k, k + 256))) for k in [*range(0xE000, 0x32400, 256), *range(0xE0000, 0xE0200, 256)]]
    draw = random.Random(5)
    texts += ["x" * 300_000, "ab" * 60_000, "漢" * 40_000, "aaab" * 30_000 + " b", "".join(draw.choice("abcdefgh") for _ in range(60_000)), "".join(draw.choice("ab") for _ in range(20_000)) * 3]
    assert list(tc.transducer(place(tc.VOCABULARY)).count_all(texts)) == wanted(texts)


@pytest.mark.parametrize("rounds,composed", [(1, 50_000), (1, 10)])
def test_composed_or_not(monkeypatch, rounds, composed):
    monkeypatch.setattr(tc, "ROUNDS", rounds)
    monkeypatch.setattr(tc, "COMPOSED", composed)
    draw = random.Random(7)
    texts = ["x" * 9_000 + " y" + "z" * 5_000, "ab" * 4_000, "".join(draw.choice("ab") for _ in range(9_000)), "é" * 3_000, " " * 7_000, "=" * 5_001]
    assert list(tc.Transducer(place(tc.VOCABULARY)).count_all(texts)) == wanted(texts)


def test_table_made_anew():
    machine = tc.Transducer(place(tc.VOCABULARY), max_states=50)
    texts = [f"some{k} words{k * 7} and others" for k in range(50)]
    for t in texts:
        assert list(machine.count_all([t])) == wanted([t])


def test_cases(spark):
    rows = tc.token_counts(cases.clashing(spark)).collect()
    texts = [r.text or "" for r in cases.documents(spark).collect()]
    assert [r.n_tokens for r in rows] == wanted(texts)
    assert [r.n_bytes for r in rows] == [len(t.encode()) for t in texts]
    assert [r.over_limit for r in rows] == [n > 1024 for n in wanted(texts)]
    assert tc.token_counts(cases.empty(spark)).count() == 0
