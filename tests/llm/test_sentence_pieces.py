import random

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from kelpmill.llm import sentence_pieces as sp
from kelpmill.llm.vocabulary import place

from . import cases

LETTERS = ["a", "b", "the", " ", "  ", "\n", " \n", "\t", "é", "ß", "123", "!", "<s>", "</s>", "<0x41>", "<unk>", "▁", "\U0001f600", "漢字", " word", "\x00", " ing"]


def test_parity_and_round_trip():
    draw = random.Random(2)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.choice([0, 1, 5, 60]))) for _ in range(1500)] + [cases.LONG]
    machine = sp.encoder(place(sp.MODEL), 2)
    want = sentencepiece.SentencePieceProcessor(model_file=place(sp.MODEL)).encode(texts)
    got = machine.encode(pa.array(texts))
    assert [g.tolist() for g in np.split(got.ids, np.cumsum(got.lengths)[:-1])] == want
    assert [e.ids for e in machine.library.encode_batch(texts, add_special_tokens=False)] == want
    assert got.parity.all()
    assert got.restored.tolist() == ["▁" not in t for t in texts]
    back = machine.library.decode_batch(want, skip_special_tokens=False)
    assert back == [t.replace("▁", " ") for t in texts]


def test_a_difference_is_told_and_the_ids_are_the_rebuilt_models():
    machine = sp.Encoder(place(sp.MODEL), 2)
    texts = [f"word{k} and some {'odd' if k % 7 == 0 else 'even'} ones" for k in range(300)]

    class Other:
        def encode(self, texts, num_threads):
            return [[0, *ids] if "odd" in t else ids for t, ids in zip(texts, want(texts), strict=True)]

    want, machine.reference = machine.reference.encode, Other()
    got = machine.encode(pa.array(texts))
    assert got.parity.tolist() == [k % 7 > 0 for k in range(300)]
    assert [g.tolist() for g in np.split(got.ids, np.cumsum(got.lengths)[:-1])] == want(texts)


def test_unigram_scores_are_kept():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁ab"]
    model = sp.Model(pieces, [0.0, -2.0, -3.0, -3.0, -2.5, -3.5], [2, 1, 1, 1, 1, 1], sp.UNIGRAM, False, b"", True, False, True, False)
    made = sp.rebuild(model)
    assert [pieces[i] for i in made.encode("ab abb").ids] == ["▁ab", "▁ab", "b"]


def test_cases(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=place(sp.MODEL))
    texts = {(r.doc_id, len(model.encode(r.text or ""))): r.text or "" for r in cases.documents(spark).collect()}
    rows = sp.decode(sp.encode(cases.clashing(spark))).collect()
    assert len(rows) == 11
    for r in rows:
        assert r.parity and r.restored and r.n_tokens == len(r.ids) and r.text == texts[r.doc.doc_id, r.n_tokens]
    assert sp.encode(cases.empty(spark)).count() == 0
    assert sp.decode(spark.createDataFrame([(None,)], "ids array<int>")).select(F.length("text")).first()[0] == 0
