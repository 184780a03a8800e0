import hashlib
import random
import re

import sentencepiece

import corpus_pipeline
from kelpmill.llm import mixing, quality, sentence_pieces
from kelpmill.llm.vocabulary import place

from . import cases
from .test_minhash_dedup import brute as near_brute
from .test_mixing import fill


def plain(rows):
    """The pipeline over (doc_id, text, lang, source, n_chars) rows, without Spark."""
    kept = []
    for i, text, _, source, _ in rows:
        counts, (cleaned,) = quality.reports([text])
        (n,), (chars,), _, _, (repeats,), (lost,) = counts
        if n >= 50 and 100 * repeats <= 50 * n and 100 * lost <= 50 * chars:
            kept.append((i, cleaned, source))
    best = {}
    for row in kept:
        norm = re.sub(r"[\x20\x09-\x0D]", "", row[1])
        best[norm] = min(best.get(norm, row), row, key=lambda r: (-len(r[1]), r[0]))
    kept = list(best.values())
    firsts = {i for i, _, c in near_brute(kept, 80) if i == c}
    kept = [r for r in kept if str(r[0]) in firsts]
    sizes = {}
    for _, text, source in kept:
        sizes[source] = sizes.get(source, 0) + len(text.encode().split())
    targets, model, out = fill(sizes), sentencepiece.SentencePieceProcessor(model_file=place(sentence_pieces.MODEL)), []
    for i, text, source in kept:
        rate = targets[source] / sizes[source]
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
        out += [(i, source, tuple(model.encode(text)))] * (int(rate) + (draw < rate - int(rate)))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    line = lambda: " ".join(word() for _ in range(12)) + "."
    texts = ["\n".join(line() for _ in range(draw.choice([2, 6, 30]))) for _ in range(60)]
    texts += [t + "\nHome | About | Contact" for t in texts[:10]] + [t.replace(" ", "  ") for t in texts[10:20]]
    texts += [t + " " + word() + "." for t in texts[20:40]] + ["\n".join("a | b | c | d" for _ in range(40)), "", None, "the the " * 40 + "."]
    return [(k, t, "en", draw.choice(["a", "b", "c", None]), len(t or "")) for k, t in enumerate(texts)]


def test_against_the_plain_version(spark, tmp_path):
    rows = corpus()
    cases.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert all(r.parity for r in out)
    assert sorted(((r.doc_id, r.source, tuple(r.ids)) for r in out), key=str) == plain(rows)


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    cases.empty(spark).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
    cases.documents(spark).write.parquet(str(tmp_path / "o/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "o")).count() == 0
