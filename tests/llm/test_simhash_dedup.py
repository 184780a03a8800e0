import random
import re

import pytest
import xxhash

from kelpmill.llm import simhash_dedup as sh

from . import cases


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(prints):
    """The place of the first fingerprint of each one's component."""
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(k) for k in range(len(prints))]


def brute(rows):
    prints = [plain(r[1]) for r in rows]
    of = labels(prints)
    least = {}
    for (i, *_), k in zip(rows, of, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return sorted((str(i), f"{p:016x}", str(least.get(k)), i == least.get(k)) for (i, *_), p, k in zip(rows, prints, of, strict=True))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id), r.kept) for r in df.collect())


def corpus():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(draw.choice([1, 2, 3, 4, 6, 40, 300]))) for _ in range(80)]
    for t in texts[:40]:  # equal but for case and space, or with some words changed
        own = t.split()
        for _ in range(draw.choice([0, 1, 2])):
            own[draw.randrange(len(own))] = word()
        texts += ["\n".join(own).upper(), t] if draw.random() < 0.5 else [" ".join(own)]
    base = [word() for _ in range(400)]
    for k in range(40):
        texts.append(" ".join(base[:k] + [word()] + base[k + 1 :]))
    draw.shuffle(texts)
    return [(k, t, None, None, None) for k, t in enumerate(texts)]


def test_query_against_brute_force(spark, tmp_path):
    rows = corpus()
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(sh.op11_simhash_dedup(spark, str(tmp_path))) == brute(rows)


def test_cases(spark, monkeypatch):
    rows = [tuple(r) for r in cases.documents(spark).collect()]
    assert got(sh.near_duplicates(cases.clashing(spark))) == brute(rows)
    assert sh.near_duplicates(cases.empty(spark)).count() == 0
    kept = sh.drop_near_duplicates(cases.clashing(spark))
    assert kept.columns == cases.clashing(spark).columns
    assert {str(r.doc_id) for r in kept.collect()} == {i for i, _, _, k in brute(rows) if k}
    whole = sh.fingerprint(cases.LONG)
    monkeypatch.setattr(sh, "AT_ONCE", 7)
    assert sh.fingerprint(cases.LONG) == whole == plain(cases.LONG)


@pytest.mark.parametrize("cell,split", [(256, 4096), (5, 12)])
def test_links_of_fingerprints(spark, monkeypatch, cell, split):
    monkeypatch.setattr(sh, "CELL", cell)
    monkeypatch.setattr(sh, "SPLIT", split)
    draw, prints = random.Random(9), {0, (1 << 64) - 1, 1 << 63}
    flipped = lambda x, n: x ^ sum(1 << b for b in draw.sample(range(64), n))
    for n in (0, 3, 4, 5, 6):  # pairs at a distance, chains, and a crowd round one fingerprint that isn't there
        for _ in range(20):
            x = draw.getrandbits(64)
            prints |= {x, flipped(x, n)}
    x = draw.getrandbits(64)
    for _ in range(30):
        x = flipped(x, 4)
        prints.add(x)
    for spread in (range(22), range(22, 43), range(30, 64)):
        centre = draw.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in draw.sample(spread, draw.choice([3, 4, 5]))) for _ in range(120)}
    prints = sorted(prints)
    of = labels(prints)
    rows = sh.linked(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")).collect()
    found = {r.fp % (1 << 64): r.label for r in rows}
    assert len(rows) == len(prints) and len({found[p] for p in prints}) == len(set(of))
    assert len({(found[p], k) for p, k in zip(prints, of, strict=True)}) == len(set(of))
