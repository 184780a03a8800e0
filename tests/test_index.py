import hashlib
import math
import random
import re
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpmill.functions import text as tx
from kelpmill.functions import vectors
from kelpmill.operators import index, search, store, templates

DOCS = "document_id string, entity_id string, file_url string, text string, metadata string"


def windows(text, size, overlap):
    """Chunks of a text, one after another."""
    norm, out, start = re.sub(r"\s+", " ", text or "").strip(), [], 0
    if len(norm) <= size:
        return [norm] if norm else []
    while True:
        stop = min(len(norm), start + size)
        cut = norm.rfind(" ", start, stop) if stop < len(norm) else -1
        piece = norm[start : cut if cut > start + size // 2 else stop].strip()
        out += [piece] if piece else []
        start += max(1, size - overlap)
        if stop >= len(norm) or start >= len(norm):
            return out


TEXTS = ["", None, " \n", "short", "a" * 50, "abcdefghijk " + "b" * 28, "one two three four five six seven eight nine ten " * 4, "é\U0001f600 x y\x1cz " * 9, " lead and trail ", "a b c d e f g h i j k l m n o p"]


@pytest.mark.parametrize("size,overlap", [(20, 4), (800, 120), (40, 0), (50, -13), (10, 30), (2, 1), (16, 15)])
def test_chunks(spark, size, overlap):
    rows = [(str(k), "e", None, t, "{}") for k, t in enumerate(TEXTS)]
    found = {}
    for r in index.chunks(spark.createDataFrame(rows, DOCS), size, overlap).collect():
        found.setdefault(r.document_id, []).append((r.chunk_index, r.chunk))
    for k, t in enumerate(TEXTS):
        want = [] if t is None else windows(re.sub("\x1c", " ", t), size, overlap)
        assert sorted(found.get(str(k), [])) == list(enumerate(want))


def test_point_ids_are_version_5_uuids(spark):
    texts = ["a:b:0:c", "é\U0001f600", "", "x" * 999]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.point_id(F.col("t"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in texts]


def test_expressions(spark):
    cases = ["  a b ", " é\x1f", "", None, "Net-Weight (kg)!", "___", "true", " YES ", "x_v1"]
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select(tx.strip(F.col("t")).alias("s"), tx.upper_snake(F.col("t")).alias("u"), tx.attribute_name(F.col("t")).alias("a"), tx.template_id(F.col("t")).alias("i"), tx.loose_boolean(F.col("t")).alias("b"), tx.five_lines(F.col("t"), F.lit("T")).alias("f")).collect()
    assert [r.s for r in rows] == ["a b", "é", "", None, "Net-Weight (kg)!", "___", "true", "YES", "x_v1"]
    assert rows[4].u == "NET_WEIGHT_KG" and rows[4].a == "net_weight_kg" and rows[4].i == "net_weight_kg_v1"
    assert [rows[k].i for k in (2, 5, 8)] == ["template_v1", "template_v1", "x_v1"]
    assert [r.b for r in rows] == [False] * 6 + [True, True, False]
    assert rows[0].f.split("\n") == ["a b"] + ["Additional template guidance."] * 4 and rows[2].f.startswith("Reusable template for T.")


def test_vectors(spark):
    rows = spark.createDataFrame([("1", "A a b"), ("2", ""), ("3", None)], "id string, text string")
    got = {r.id: r.vector for r in index.embed_texts(rows, "id", "text").collect()}
    assert sorted(round(v, 6) for v in got["1"] if v) == [round(1 / 5**0.5, 6), round(2 / 5**0.5, 6)]
    assert len(got["2"]) == index.DIMENSION and not any(got["2"]) and not any(got["3"])
    own = {r.id: r.vector for r in index.embed_texts(rows, "id", "text", model=lambda texts: [[float(len(t)), 0.0] for t in texts]).collect()}
    assert own == {"1": [5.0, 0.0], "2": [0.0, 0.0], "3": [0.0, 0.0]}


def test_a_model_sees_each_text_once(spark, tmp_path):
    class Model:
        def load(self):
            (tmp_path / f"load-{uuid.uuid4().hex}").touch()

            def encode(texts):
                (tmp_path / f"call-{uuid.uuid4().hex}").write_text("\n".join(texts))
                return [[float(len(t)), 1.0] for t in texts]

            return encode

    rows = spark.createDataFrame([(k, f"text {k % 7}") for k in range(100)], "id long, text string")
    got = index.embed_texts(rows, "id", "text", Model(), batch_size=3).collect()
    assert len(got) == 100 and {tuple(r.vector) for r in got} == {(6.0, 1.0)}
    seen = [p.read_text().split("\n") for p in tmp_path.glob("call-*")]
    assert sorted(t for c in seen for t in c) == [f"text {k}" for k in range(7)] and max(map(len, seen)) <= 3
    assert len(list(tmp_path.glob("load-*"))) <= 4  # a worker loads once


def test_upsert_twice_changes_nothing_and_keeps_stale_chunks(spark):
    docs = spark.createDataFrame([("d", "e", "u1", "alpha beta gamma", '{"name":"Spec"}')], DOCS)
    old = index.points(docs).withColumn("seq", F.lit(0))
    again = index.points(docs.withColumn("file_url", F.lit("u2"))).withColumn("seq", F.lit(1))
    changed = index.points(docs.withColumn("text", F.lit("delta"))).withColumn("seq", F.lit(2))
    once = index.index_upsert(old, again)
    assert [(r.file_url, r.text) for r in once.collect()] == [("u2", "alpha beta gamma")]
    assert once.collect() == index.index_upsert(once, again).collect()
    assert sorted(r.text for r in index.index_upsert(once, changed).collect()) == ["alpha beta gamma", "delta"]
    good, bad = index.split_dimension(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<double>"), 2)
    assert good.count() == 1 and bad.first().reason


def test_rejects(spark):
    docs = spark.createDataFrame([("1", "e", None, " \t\n", "{}"), ("2", "e", None, None, "{}"), ("3", "e", None, "x", "{}")], DOCS)
    good, bad = index.reject_empty_text(docs)
    assert [r.document_id for r in good.collect()] == ["3"] and {r.reason for r in bad.collect()} == {"No indexable text was provided."}
    asked = spark.createDataFrame([("1", "  ", "e", 3), ("2", None, "e", 3), ("3", "What changed?", "e", 2), ("4", "x", "e", 0)], "question_id string, question string, entity_id string, top_k int")
    good, bad = search.reject_blank_question(asked)
    assert [r.question_id for r in good.collect()] == ["3"]
    padded = spark.createDataFrame([("1", " \u2003What changed?\t\n", "e", 3)], asked.schema)
    assert search.reject_blank_question(padded)[0].first().question == "What changed?"
    names = spark.createDataFrame([("1", " Member Access "), ("2", " \t")], "request_id string, template_name string")
    good_names, bad_names = templates.reject_blank_template(names)
    assert [r.template_name for r in good_names.collect()] == ["Member Access"] and [r.template_name for r in bad_names.collect()] == [" \t"]
    assert sorted((r.question_id, r.reason) for r in bad.collect()) == [("1", "question is required."), ("2", "question is required."), ("4", "top_k must be positive.")]


def test_sparse_and_dense_search_agree(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"e{k % 2}", t) for k, t in enumerate(["red green", "green blue blue", "red", "none here", "green red red", ""])], "id string, entity_id string, text string")
    asked = spark.createDataFrame([("q0", "green red", "e0", 3), ("q1", "absent", "e1", 2)], "question_id string, question string, entity_id string, top_k int")
    dense_chunks = chunks.join(index.embed_texts(chunks, "id", "text"), "id")
    dense_asked = asked.join(index.embed_texts(asked, "question_id", "question"), "question_id")
    assert sorted(map(tuple, search.knn_sparse(asked, chunks).collect())) == sorted(map(tuple, search.knn_dense(dense_asked, dense_chunks).collect()))


@pytest.mark.parametrize("questions,rows", [(256, 4096), (3, 7)])
def test_cells_of_one_entity(spark, monkeypatch, questions, rows):
    """One entity alone, ties, vectors of no length, of another length, and none."""
    monkeypatch.setattr(search, "QUESTIONS", questions)
    monkeypatch.setattr(search, "ROWS", rows)
    draw = random.Random(4)
    vector = lambda n: [float(draw.choice([-1, 0, 0, 1, 2])) for _ in range(n)]
    own = [(f"r{k:02}", "e", draw.choice([vector(3), vector(3), [0.0] * 3, vector(2), None])) for k in range(60)]
    asked = [(f"q{k}", "e", draw.choice([1, 4, 100]), draw.choice([vector(3), vector(2), None])) for k in range(10)]
    want = []
    for q, _, top, v in asked:
        found = []
        for i, _, w in own:
            if v is not None and w is not None and len(v) == len(w):
                norms = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
                found.append((-round(sum(x * y for x, y in zip(v, w, strict=True)) / norms, 6) if norms else 0.0, i))
        want += [(q, i, -s, k) for k, (s, i) in enumerate(sorted(found)[:top], 1)]
    asked = spark.createDataFrame(asked, "question_id string, entity_id string, top_k int, vector array<double>")
    own = spark.createDataFrame(own, "id string, entity_id string, vector array<double>")
    got = [(r.question_id, r.id, r.score + 0.0, r["rank"]) for r in search.knn_dense(asked, own).collect()]
    assert sorted(got) == sorted((q, i, s + 0.0, k) for q, i, s, k in want)
    dealt = search._dealt(asked, own)
    assert max(r["count"] for r in dealt[0].groupBy("i", "j").count().collect()) <= max(10, 3 * questions)


def test_hashed_places():
    row, bucket, weight = vectors.hashed_places(pa.array(["b a b", "", None, "c"]), 384)
    of = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 384
    got = {(int(r), int(b)): round(float(w), 6) for r, b, w in zip(row, bucket, weight, strict=True)}
    assert got == {(0, of("b")): round(2 / 5**0.5, 6), (0, of("a")): round(1 / 5**0.5, 6), (3, of("c")): 1.0}
    assert list(vectors.runs(pa.array(["xx", "", None, "x" * 9, "y"]), 3)) == [(0, 3), (3, 1), (4, 1)]


@pytest.mark.parametrize("run_bytes,questions", [(4_000_000, 256), (40, 2)])
def test_few_questions_go_to_the_chunks(spark, monkeypatch, run_bytes, questions):
    """Ties, no text, unasked entities and none: as in cells, without moving a vector or hashing a chunk twice."""
    monkeypatch.setattr(search, "QUESTIONS", questions)
    monkeypatch.setattr(vectors.runs, "__defaults__", (run_bytes,))
    draw = random.Random(6)
    text = lambda n: " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(n)))
    chunks = spark.createDataFrame([(f"c{k:03}", draw.choice(["e0", "e1", "e2", None]), draw.choice([text(6), text(6), None])) for k in range(300)], "id string, entity_id string, text string").repartition(3)
    asked = spark.createDataFrame([(k, text(5), draw.choice(["e0", "e1", "e9", None]), draw.choice([1, 4, 200])) for k in range(12)], "question_id long, question string, entity_id string, top_k int")
    here = search.knn_sparse(asked, chunks)
    got = sorted(map(tuple, here.collect()))
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") and "CoGroups" not in plan
    monkeypatch.setattr(search, "SENT", 0)
    cells = search.knn_sparse(asked, chunks)
    assert got == sorted(map(tuple, cells.collect())) and len(got) > 100
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4  # chunks once, questions, and these for the sizes, which both sides get
    payload = chunks.selectExpr("*", "'d' as document_id", "'u' as file_url", "0 as chunk_index", "'{}' as metadata")
    of = {r.question_id: [c.id for c in r.chunks] for r in search.collect_chunks(here, payload).collect()}
    assert of == {q: [i for _, i, _, k in sorted((r for r in got if r[0] == q), key=lambda r: r[3])] for q in of} and sum(map(len, of.values())) == len(got)


def test_search_gives_all_hits_that_are_asked(spark):
    chunks = spark.createDataFrame([(f"c{k:03}", "e", f"red word{k}") for k in range(160)], "id string, entity_id string, text string")
    asked = spark.createDataFrame([("q0", "red", "e", 150), ("q1", "red", "e", 3)], "question_id string, question string, entity_id string, top_k int")
    dense_chunks = chunks.join(index.embed_texts(chunks, "id", "text"), "id")
    dense_asked = asked.join(index.embed_texts(asked, "question_id", "question"), "question_id")
    for hits in (search.knn_sparse(asked, chunks), search.knn_dense(dense_asked, dense_chunks)):
        ranks = {q: sorted(r.rank for r in hits.where(f"question_id = '{q}'").collect()) for q in ("q0", "q1")}
        assert ranks == {"q0": list(range(1, 151)), "q1": [1, 2, 3]}
    assert search.knn_sparse(asked.limit(0), chunks).count() == 0


def leaf_metrics(df):
    """(files, rows) that the scan of df reads."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    return tuple(scan.metrics().apply(name).value() for name in ("numFiles", "numOutputRows"))


def stored(spark, rows, seq, size=2):
    vector = F.array(*[F.lit(3.0 + k) for k in range(size)])
    return spark.createDataFrame(rows, "id string, entity_id string, text string").select("id", F.lit("d").alias("document_id"), "entity_id", F.lit(None).cast("string").alias("file_url"), F.lit(0).alias("chunk_index"), "text", F.lit("{}").alias("metadata"), vector.alias("vector"), F.lit("m").alias("embedder"), F.lit(seq).cast("long").alias("seq"))


def test_store(spark, tmp_path):
    box = store.IndexStore(spark, str(tmp_path / "s"), parts=8, buckets=3)
    assert box.read().count() == 0 and box.dimension() is None
    rows = [(f"p{k}", f"e{k % 40}", f"text {k}") for k in range(2000)]
    assert box.upsert(stored(spark, rows, 1)).count() == 0 and box.dimension() == 2
    names = sorted(str(p) for p in (tmp_path / "s/rows").glob("part=*/*.parquet"))
    again = [(f"p{k}", "e3", "new") for k in range(3, 2000, 400)] + [("p3", "e3", "newer"), ("px", "e3", "first")]
    new = stored(spark, again[:-2], 2).unionByName(stored(spark, again[-2:], 3))
    plan = box.merged(new.withColumns({"norm": F.lit(1.0), "part": box._part(F.col("entity_id"))}), [r[0] for r in new.select(box._part(F.col("entity_id"))).distinct().collect()])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Scan parquet")[0].count("Exchange hashpartitioning") <= 1  # that of the new rows
    assert box.upsert(new).count() == 0
    assert box.upsert(stored(spark, [("p3", "e3", "late and old")], 0)).count() == 0
    got = {r.id: r.text for r in box.read().collect()}
    assert len(got) == 2001 and got["p3"] == "newer" and got["px"] == "first" and got["p403"] == "new" and got["p4"] == "text 4"
    later = sorted(str(p) for p in (tmp_path / "s/rows").glob("part=*/*.parquet"))
    kept = set(names) & set(later)  # only one folder was written anew
    assert len({n.split("part=")[1][0] for n in set(names) - kept}) == 1
    bad = box.upsert(stored(spark, [("py", "e5", "x")], 4, size=3)).collect()
    assert [(r.id, r.reason) for r in bad] == [("py", "Vector dimension differs from the index.")]
    opened = store.IndexStore(spark, str(tmp_path / "s"), parts=8, buckets=3)
    assert opened.read().count() == 2001 and opened.dimension() == 2
    of = opened.of_entity("e3")
    files, read = leaf_metrics(of)
    assert of.count() == 51 and files <= 3 and read < 700
    row = of.where("id = 'p3'").first()
    assert (row.norm, row.embedder, list(row.vector)) == (5.0, "m", [3.0, 4.0])


def test_buckets_go_with_the_rows(spark, tmp_path, monkeypatch):
    """No bucket, which is one task's work, has more than twice the rows that it is laid out for, however often the store is filled; and it is found again."""
    monkeypatch.setattr(store, "ROWS", 50)
    path = str(tmp_path / "s")
    box, other = (store.IndexStore(spark, path, parts=2, buckets=2) for _ in range(2))
    most = lambda: max(r["count"] for r in box.spark.table(box.table).groupBy(F.regexp_extract(F.input_file_name(), r"_(\d+)\.c", 1)).count().collect())
    for seq, n in enumerate((60, 900, 901, 2000)):
        assert box.upsert(stored(spark, [(f"p{k}", f"e{k % 4}", f"{seq}") for k in range(n)], seq)).count() == 0
        assert most() <= 2 * 50 * 1.5 and box.read().count() == n and {r.text for r in box.read().select("text").distinct().collect()} == {str(seq)}
    assert box.buckets == 32
    assert other.read().count() == 2000
    other.upsert(stored(spark, [("p7", "e3", "again"), ("px", "e1", "new")], 9))
    opened = store.IndexStore(spark, path, parts=2, buckets=2)
    assert opened.buckets == 32 and opened.dimension() == 2 and opened.read().count() == 2001
    assert {r.text for r in opened.of_entity("e3").where("id in ('p7', 'p3')").collect()} == {"again", "3"}
