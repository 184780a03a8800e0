from collections import Counter

from kelpmill.llm import mixing

from . import cases


def fill(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Targets by rounds, in plain Python."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    wanted, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (wanted - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if most * sizes[s] <= level * weight[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, None: 80, "": 3, "é": 900}
    table = spark.createDataFrame(list(sizes.items()), "src string, size long")
    got = {r.src: r.target for r in mixing.source_targets(table).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in fill(sizes).items()}


def test_copies_follow_the_rate(spark):
    rows = [(i, "a b c d", None, "big" if i % 4 else "small", None) for i in range(4000)]
    docs = cases.documents(spark, rows)
    mixed = Counter(r.source for r in mixing.mix(docs).select("source").collect())
    target = fill({"big": 12000, "small": 4000})
    for source, want in target.items():
        assert abs(mixed[source] * 4 - want) < 0.1 * want
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == Counter(r.doc_id for r in mixing.mix(docs).collect())


def test_cases(spark):
    out = mixing.with_copies(cases.clashing(spark)).collect()
    assert len(out) == 11
    assert all(r.copies <= 2 for r in out)
    assert all(r["size"] == len((r.doc.text or "").encode().split()) for r in out)
    assert mixing.mix(cases.clashing(spark)).columns == cases.clashing(spark).columns
    assert mixing.mix(cases.empty(spark)).count() == 0
