import math
import random
import re
from collections import Counter

import pytest

from kelpmill.llm import lexical_search as ls

from . import cases

ITEMS = "item_id long, text string"


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, top=10):
    docs = [(r[0], plain_terms(r[1])) for r in rows]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(plain_terms(text))
    out = []
    for i, words in asked.items():
        found = []
        for doc, own in docs:
            tf, score = Counter(own), 0
            for w in words & set(own):
                m = 10 + 90 * len(own) * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(i, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus():
    draw = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["é", "ÄB", "\U0001f600x", "AB", "x_y", "a-b"]
    texts = [" ".join(draw.choice(words[: draw.choice([5, 20, 66])]) for _ in range(draw.choice([1, 3, 3, 10, 60]))) for _ in range(400)]
    texts += [" ".join(reversed(t.split())).upper() for t in texts[:120]] + texts[:50] * 3
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    draw.shuffle(rows)
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 5, 12])))) for k in range(40)]
    return rows, items + [(50, None), (51, ""), (52, "nowhere"), (3, "w1 w2"), (3, "w1 w2"), (None, "W7 é")]


@pytest.mark.parametrize("held,run,pairs", [(200_000, 512, 8192), (40, 7, 9)])
def test_against_brute_force(spark, monkeypatch, held, run, pairs):
    for name, value in (("HELD", held), ("RUN", run), ("PAIRS", pairs)):
        monkeypatch.setattr(ls, name, value)
    rows, items = corpus()
    assert got(ls.search(cases.documents(spark, rows).repartition(3), spark.createDataFrame(items, ITEMS))) == brute(rows, items)


def test_cases(spark):
    rows = [tuple(r) for r in cases.documents(spark).collect()]
    items = [(1, "one WORD ß"), (2, "Nobody end"), (3, "endoftext turn javascript")]
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as nth", "2 as rank", "3 as term")
    assert got(ls.search(cases.clashing(spark), asked)) == brute(rows, items)
    assert ls.search(cases.empty(spark), asked).count() == 0 == ls.search(cases.clashing(spark), asked.limit(0)).count()
    assert ls.search(cases.documents(spark, [(1, None, None, None, None)]), asked).count() == 0


def test_equal_bags_are_scored_once(spark):
    rows = [(k, text, None, None, None) for k, text in enumerate(["a b x", "B A y", "a b b z", "a b x", "q r s"] * 30)]
    found = ls.bags(cases.documents(spark, rows), {b"a": 0, b"b": 1}, "doc_id", "text")
    classes = ls.classes_of(found.selectExpr("id", "n as m", "bag"), 10).collect()
    assert sorted((r.m, len(r.ids)) for r in classes) == [(3, 10), (4, 10)]
    assert sorted(classes)[0].ids == sorted(k for k in range(150) if k % 5 in (0, 1, 3))[:10]
