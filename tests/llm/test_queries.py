"""The registered queries over a small folder of odd tables, against SQL where there is some, else against plain versions."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

from kelpmill.llm import queries
from kelpmill.llm.vocabulary import place, tokenizer

from . import cases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    draw = random.Random(21)
    word = lambda: draw.choice(["alpha", "beta", "gämma", "Delta", "the", "of", "x1", "\U0001f600"])
    texts = [None, "", " \n", "one", "a b c d e", "A b\tc  d e f", cases.LONG, "x\nx\n\nx y", "<|endoftext|> </turn> ▁ \x00"]
    texts += ["\n".join(" ".join(word() for _ in range(draw.choice([3, 9, 40]))) + draw.choice([".", "", " | b | c"]) for _ in range(5)) for _ in range(60)]
    texts += texts[9:20] + [t + " more" for t in texts[20:40]]
    for k in (10, 13):
        a, b = cases.alike(k)
        texts += [f"{a} {b} c d e f", f"{b} {a} c d e f", " ".join(f"{w} x y z" for w in (a, b))]
    rows = [(k, t, draw.choice(["en", "fr", None]), draw.choice(["a", "b", "é", "", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    cases.documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    urls = [None, "", "a.com/en/", "http://A.com/en/7?x", "https://b.net/de/8#y", "x://org/es/", "http://forum.org", "http://example.com/en/71", "http://com/en/\n"]
    spark.createDataFrame([(k, u, "<p>") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "user", "a"), (2, 1, "assistant", "</turn>\\"), (2, 2, None, "é\U0001f600"), (3, 5, "a>\nb", "<l")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    items = [(1, "alpha beta"), (2, "gämma x1 \U0001f600 x1"), (3, None), (4, "of"), (5, "endoftext turn")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def rows_of(names, rows):
    return sorted(str(tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in sorted(names))) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_against_sql(spark, folder, name):
    query, sql = queries.QUERIES[name]
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS FROM read_parquet('{folder[0]}/{table}.parquet/*.parquet')")
    want = con.sql(sql)
    names = want.columns
    got = query(spark, folder[0])
    assert sorted(got.columns) == sorted(names)
    assert rows_of(names, [r.asDict() for r in got.collect()]) == rows_of(names, [dict(zip(names, r, strict=True)) for r in want.fetchall()])


def test_token_ids_and_counts(spark, folder):
    t, start = tokenizer(place("byte_bpe_50k.json")), 0
    nine = {r.doc_id: r for r in queries.QUERIES["op9_token_output"][0](spark, folder[0]).collect()}
    ten = {r.doc_id: r for r in queries.QUERIES["op10_token_counts"][0](spark, folder[0]).collect()}
    eight = {r.doc_id: r for r in queries.QUERIES["op8_sentence_pieces"][0](spark, folder[0]).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=place("piece_bpe_32k.model"))
    for k, text, *_ in folder[1]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (ten[k].n_bytes, ten[k].n_tokens, ten[k].over_limit) == (len((text or "").encode()), len(ids), len(ids) > 1024)
        assert (nine[k].start, nine[k].n_tokens, nine[k].ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        start += len(ids) + 1
        assert list(eight[k].ids) == model.encode(text or "") and eight[k].parity and eight[k].restored == ("▁" not in (text or ""))


def test_languages(spark, folder):
    rows = {r.doc_id: r for r in queries.QUERIES["op4_language_id"][0](spark, folder[0]).collect()}
    for k, text, *_ in folder[1]:
        r = rows[k]
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and not math.isnan(r.score)
        assert r.lang_pred in (["en", "fr"] if any(map(str.isalpha, text or "")) else ["und"])
