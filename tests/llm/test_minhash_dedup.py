import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpmill.llm import minhash_dedup as md
from kelpmill.llm.components import components

from . import cases


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent):
    found = [(r[0], sets(r[1])) for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (_, x) in enumerate(found):
        for b in range(a):
            y = found[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(found):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(s), str(least.get(root(k)))) for k, (i, s) in enumerate(found))


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(draw.choice([3, 6, 20, 80, 300]))) for _ in range(60)]
    base = [word() for _ in range(150)]
    for _ in range(150):  # a hub and copies with up to four changed words, many of them unlike each other
        own = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 4])):
            own[draw.randrange(150)] = word()
        texts.append(" ".join(own))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(80)) for _ in range(40)]
    for t in texts[:60]:
        words = t.split()
        if draw.random() < 0.6:
            words[-1] = word()
            texts.append("  ".join(words).upper())
        if draw.random() < 0.3:
            texts.append(t)
    draw.shuffle(texts)
    return [(k, t, None, None, None) for k, t in enumerate(texts)]


@pytest.mark.parametrize("percent,block,shingles", [(85, 128, 250_000), (80, 40, 2_000)])
def test_against_brute_force(spark, monkeypatch, percent, block, shingles):
    monkeypatch.setattr(md, "BLOCK", block)
    monkeypatch.setattr(md, "SET_SHINGLES", shingles)
    rows = corpus()
    assert got(md.near_duplicates(cases.documents(spark, rows), percent=percent)) == brute(rows, percent)


def test_cases(spark):
    rows = [tuple(r) for r in cases.documents(spark).collect()]
    assert got(md.near_duplicates(cases.clashing(spark))) == brute(rows, 80)
    assert md.near_duplicates(cases.empty(spark)).count() == 0
    kept = md.drop_near_duplicates(cases.clashing(spark))
    assert kept.columns == cases.clashing(spark).columns
    want = {(i, c) for i, _, c in brute(rows, 80) if i == c}
    assert {str(r.doc_id) for r in kept.collect()} == {i for i, _ in want}


def test_estimates():
    draw = np.random.default_rng(0)
    words = [str(x).encode() for x in draw.integers(0, 10**9, 2000)]
    left, right = b" ".join(words[:1100]), b" ".join(words[:1000] + words[1200:1300])
    hashes, ends, _ = md.shingles([left, right])
    regs = md.registers(hashes, ends)
    a, b = set(hashes[: ends[1]].tolist()), set(hashes[ends[1] :].tolist())
    true = len(a & b) / len(a | b)
    assert abs(md.estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.2
    assert 0 < md.chance(20, 20) < 0.01
    least = np.sort(draw.integers(1, 2**32 - 1, 1000).astype(np.uint32))
    assert (np.diff((md.compressed(least) >> md.MANTISSA).astype(int)) <= 0).all()


def test_bands_use_all_registers_and_miss_few_pairs():
    assert md._BAND_OF.shape == (md.BANDS, md.BAND)
    assert (np.bincount(md._BAND_OF.ravel(), minlength=md.REGISTERS) == md.PERMUTATIONS).all()
    draw, missed = np.random.default_rng(5), 0
    for _ in range(10):  # 200,000 pairs of similarity 0.80, whose registers agree independently
        agree = draw.random((20_000, md.REGISTERS)) < 0.80
        shared = np.zeros(len(agree), bool)
        for band in md._BAND_OF:
            shared |= agree[:, band].all(axis=1)
        missed += int((~shared).sum())
    assert missed <= 20  # about 2 are expected


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(500, 500 + k) for k in range(1, 100)] + [(k, k + 1) for k in range(700, 760)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_megabyte_texts_share_buckets(spark, monkeypatch):
    monkeypatch.setattr(md, "SET_SHINGLES", 100_000)
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(160_000)]
    texts = []
    for changed in (0, 5_000, 10_000, 40_000, 45_000):  # some are alike, some share buckets alone
        own = list(base)
        own[:changed] = [word() for _ in range(changed)]
        texts.append(" ".join(own))
    texts += [" ".join(base[k : k + 100]) for k in range(0, 400, 10)]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    assert got(md.near_duplicates(cases.documents(spark, rows))) == brute(rows, 80)


def test_short_texts_that_share_some_words(spark):
    """Unlike texts with common shingles meet in no bucket; like ones do, whatever their sizes."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts = [f"thank you for your message {word()}" for _ in range(20_000)]
    few = [f"we have got your order and will send it to {word()} within a day or two as you have asked us to do" for _ in range(300)]
    base = [word() for _ in range(60)]
    few += [" ".join(base[k : k + n]) for n in (9, 10, 14, 28, 44, 45, 50, 54) for k in (0, 1, 2)]
    few += [t + " " + word() for t in few[:150:10]] + texts[:40] + [t.upper() + "!" for t in texts[:5]]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts + few)]
    signed = md.signatures(cases.documents(spark, rows), "doc_id", "text", 80)
    classes = signed.groupBy("key").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.first("regs").alias("regs"), F.first("few").alias("few"), F.min("id").alias("cid"))
    assert classes.count() > 20_000 and md.buckets(classes, 80).count() < 20_000
    of_texts = md.buckets(classes.where("words = 6"), 80)
    assert of_texts.count() == 0
    # Two of the 20,000 share one shingle of two, and so do none with the others, but for the copies.
    same = brute(rows[20_000:], 80)
    found = {(str(r.doc_id), r.n_shingles): r.component_id for r in md.near_duplicates(cases.documents(spark, rows)).collect()}
    copies = {i: (texts + few).index(t) for i, t in enumerate(texts + few) if i >= 20_000 and t in texts[:40]}
    for i, n, c in same:
        assert found[i, n] == copies.get(int(i), int(c)), (i, n, c)
    assert all(found[str(k), 2] == k for k in range(20_000))


def test_long_words_that_sums_confuse(spark):
    rows = []
    for k in (10, 11, 12, 13):
        a, b = cases.alike(k)
        texts = [f"{a} {b} c d e f", f"{b} {a} c d e f", " ".join([a, "x y z u", b, "x y z u", a, "x y z u"]), a, b, a.upper()]
        rows += [(10 * k + n, t, None, None, None) for n, t in enumerate(texts)]
    assert got(md.near_duplicates(cases.documents(spark, rows))) == brute(rows, 80)
