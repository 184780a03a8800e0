import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kelpmill.llm import token_output as out
from kelpmill.llm.vocabulary import place, tokenizer

from . import cases


def brute(rows):
    t = tokenizer(place(out.VOCABULARY))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in rows]


def test_round_trip(spark, tmp_path):
    draw = random.Random(3)
    letters = ["a", "b", "the", " ", "  ", "\n", " \n", "\t", "'s", "'", "é", "ß", "1", "23", "!", "<|endoftext|>", " ", "\U0001f600", "漢字", " ", " "]
    rows = [(k, "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 5, 60]))), None, None, None) for k in range(400)]
    rows[7] = (7, cases.LONG, None, None, None)
    docs = cases.documents(spark, rows)
    out.write_shards(docs.repartition(3), str(tmp_path / "s"), shard_ids=500)
    shards = out.read_shards(spark, str(tmp_path / "s"))
    want, start = brute([r[1] for r in rows]), 0
    got = {r.key: (r.start, r.n_tokens, r.ids_crc32) for r in out.read_documents(shards).collect()}
    for k, ids in enumerate(want):
        assert got[f"{k}"] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert shards.agg(F.sum("n_ids")).first()[0] == start
    asked = {r.key: list(r.ids) for r in out.lookup(spark, str(tmp_path / "s"), [3, 399, 400, -1, None]).collect()}
    assert asked == {"3": want[3], "399": want[399]}
    assert out.lookup(spark, str(tmp_path / "s"), [400]).count() == 0


def test_a_hot_id_is_several_tasks_work(spark, tmp_path):
    rows = [(5 if k % 3 else k, f"text {k} of many", None, None, None) for k in range(600)]
    out.write_shards(cases.documents(spark, rows), str(tmp_path / "s"), shard_ids=200)
    shards = out.read_shards(spark, str(tmp_path / "s"))
    assert shards.where("first = 5 and last = 5").select("part").distinct().count() > 1
    found = out.lookup(spark, str(tmp_path / "s"), [5, 9]).collect()
    want = brute([r[1] for r in rows])
    assert sorted(list(r.ids) for r in found if r.key == "5") == sorted(w for w, r in zip(want, rows, strict=True) if r[0] == 5)
    assert [list(r.ids) for r in found if r.key == "9"] == [want[9]]
    assert out.read_documents(shards).count() == 600


def test_absent_keys_are_told_apart_by_the_stored_key():
    data = out.pack([b"a", b"b", b"b", b"c"], [b"\1\0", b"\2\0", b"\3\0", b""], 2)
    shard = out.Shard(data)
    assert [list(shard.find(k)) for k in (b"a", b"b", b"c", b"d")] == [[0], [1, 2], [3], []]
    fake = out.Shard(data)
    fake.index = fake.index.copy()
    fake.index[::2] = out._hashed(b"d")[1]
    assert list(fake.find(b"d")) == []


def test_cases(spark, tmp_path):
    out.write_shards(cases.clashing(spark), str(tmp_path / "s"))
    rows = out.read_documents(out.read_shards(spark, str(tmp_path / "s"))).orderBy("start").collect()
    assert [r.key for r in rows] == ["1", "2", "2", "3", "4", "5", "6", "7", "8", "null", "null"]
    sizes = [r.n_tokens for r in rows]
    assert sizes[3] == sizes[4] == 1 and min(sizes[-2:]) == 1
    assert out.lookup(spark, str(tmp_path / "s"), [2, None]).count() == 4
    out.write_shards(cases.empty(spark), str(tmp_path / "e"))
    assert out.read_documents(out.read_shards(spark, str(tmp_path / "e"))).count() == 0


def test_perfect_hash():
    for n in (1, 2, 7, 1000):
        hashes = np.array([out._hashed(str(k).encode())[0] for k in range(n)], np.uint64)
        assert sorted(out.perfect_hash(hashes)[1].tolist()) == list(range(n))
