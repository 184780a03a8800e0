import hashlib
import random
import re

import pytest

from kelpmill.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

from . import cases


def brute(rows):
    groups = {}
    for k, (i, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i, k))
    out = []
    for norm, group in groups.items():
        best = min(group)
        out += [(str(i), str(best[3]), len(group), hashlib.sha256(norm.encode()).hexdigest()) for _, _, _, i, _ in group]
    return sorted(out)


def got(df):
    rows = df.collect()
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows), sum(r.kept for r in rows)


@pytest.mark.parametrize("bits,size", [(64, 16_384), (64, 16), (2, 16), (4, 64)])
def test_against_brute_force(spark, bits, size):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice("ab ") for _ in range(draw.choice([0, 3, 40, 41, 90]))), None, None, None) for i in range(60)]
    rows += [(100 + i, rows[i][1], None, None, None) for i in range(20)]
    found, kept = got(exact_duplicates(cases.documents(spark, rows), block_bytes=size, hash_bits=bits))
    assert found == brute(rows)
    assert kept == len({x[3] for x in found})


def test_cases(spark):
    rows = [tuple(r) for r in cases.documents(spark).collect()]
    found, kept = got(exact_duplicates(cases.clashing(spark)))
    assert found == brute(rows)
    assert kept == len({x[3] for x in found})
    assert exact_duplicates(cases.empty(spark)).count() == 0


def test_rows_that_stay(spark):
    docs = cases.clashing(spark)
    stay = drop_exact_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["2", "5", "6", "8", "None"]
