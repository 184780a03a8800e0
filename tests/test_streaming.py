import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from kelpmill.operators import graph, index
from kelpmill.sources import requests, tables
from kelpmill.streaming import jobs

DOCS = tables.SCHEMAS["documents_in"]


def arrive(spark, tmp_path, k, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    return spark.readStream.schema(DOCS).json(str(tmp_path / "in/*"))


def run(spark, tmp_path, k, rows, tables, model=None):
    jobs.stream_index(arrive(spark, tmp_path, k, rows), tables, str(tmp_path / "checkpoint"), model).awaitTermination()


def state(spark, tables, names=("chunks", "nodes", "edges", "summaries", "rejects")):
    return {name: sorted(map(str, tables.read(spark, name).collect())) for name in names}


def test_stream_index_over_batches_a_failure_and_a_replay(spark, tmp_path):
    tables = jobs.IndexTables(str(tmp_path / "index"))
    assert not any(state(spark, tables).values())
    run(spark, tmp_path, 0, [("d1", "e", None, "alpha beta", "{}"), ("d2", "e", None, "gamma", "{}"), ("d4", "e", "u", " \n", "{}")], tables)
    before = state(spark, tables)
    assert [r.reason for r in tables.read(spark, "rejects").collect()] == ["No indexable text was provided."]
    later = [("d1", "e", "u", "alpha beta", '{"name":"new"}'), ("d3", "f", None, " ", "{}"), ("d5", "f", "v", "delta", "{}")]
    for sink in ("nodes", "rejects", None):  # the batch fails before a sink, then before its marker; no part of it is visible

        class Broken(jobs.IndexTables):
            def write(self, name, rows, number):
                if name == sink:
                    raise OSError("disk")
                super().write(name, rows, number)

            def finish(self, *given):
                raise OSError("marker")

        with pytest.raises(StreamingQueryException):
            if sink == "nodes":
                run(spark, tmp_path, 1, later, Broken(tables.path))
            else:
                jobs.stream_index(spark.readStream.schema(DOCS).json(str(tmp_path / "in/*")), Broken(tables.path), str(tmp_path / "checkpoint")).awaitTermination()
        assert state(spark, tables) == before
    jobs.stream_index(spark.readStream.schema(DOCS).json(str(tmp_path / "in/*")), tables, str(tmp_path / "checkpoint")).awaitTermination()
    rows = {r.document_id: (r.text, r.file_url, r.metadata, r.seq, round(r.norm, 6), r.embedder) for r in tables.read(spark, "chunks").collect()}
    assert rows == {"d1": ("alpha beta", "u", '{"name":"new"}', 1, 1.0, "md5-bag"), "d2": ("gamma", None, "{}", 0, 1.0, "md5-bag"), "d5": ("delta", "v", "{}", 1, 1.0, "md5-bag")}
    assert {(r.label, r.id): r.name for r in tables.read(spark, "nodes").collect()} == {("Entity", "e"): None, ("Entity", "f"): None, ("Document", "d1"): "new", ("Document", "d2"): None, ("Document", "d5"): "v"}
    assert tables.read(spark, "edges").count() == 3 and {r.document_id for r in tables.read(spark, "rejects").collect()} == {"d4", "d3"}
    assert {(r.document_id, r.status, r.chunks_indexed, r.graph.document.name) for r in tables.read(spark, "summaries").collect()} == {("d1", "ok", 1, "new"), ("d2", "ok", 1, None), ("d5", "ok", 1, "v")}
    run(spark, tmp_path, 2, [("d2", "e", "w", "gamma", "{}")], tables)
    assert {(r.document_id, r.file_url) for r in tables.read(spark, "chunks").collect()} == {("d1", "u"), ("d2", "w"), ("d5", "v")}


def test_stream_index_keeps_its_dimension(spark, tmp_path):
    tables = jobs.IndexTables(str(tmp_path / "index"))
    run(spark, tmp_path, 0, [("d0", "e", None, " ", "{}")], tables, lambda texts: [[1.0, 0.0]] * len(texts))
    assert tables.dimension(spark) is None
    run(spark, tmp_path, 1, [("d1", "e", None, "a", "{}")], tables, lambda texts: [[1.0, 0.0]] * len(texts))
    run(spark, tmp_path, 2, [("d1", "e", "u", "a", "{}"), ("d2", "e", None, "b", "{}")], tables, lambda texts: [[1.0, 0.0, 0.0]] * len(texts))
    run(spark, tmp_path, 3, [("d3", "e", None, "c", "{}")], tables, lambda texts: [[0.0, 2.0]] * len(texts))
    assert tables.dimension(spark) == 2
    assert {(r.document_id, r.file_url, r.norm) for r in tables.read(spark, "chunks").collect()} == {("d1", None, 1.0), ("d3", None, 2.0)}
    assert {(r.document_id, r.reason) for r in tables.read(spark, "rejects").where("reason like 'Vector%'").collect()} == {(d, "Vector dimension differs from the index.") for d in ("d1", "d2")}
    assert {r.id for r in tables.read(spark, "nodes").where("label = 'Document'").collect()} == {"d1", "d3"}


def test_compaction(spark, tmp_path):
    table = jobs.KeyedTable(str(tmp_path / "t"), "id string, text string", ["id"])
    rows = lambda *r: spark.createDataFrame(r, "id string, text string")
    same = lambda old, new: new
    table.upsert(rows(("a", "1"), ("b", "1")), 0, same)
    table.upsert(rows(("a", "2")), 1, same)
    small = table.compact(spark, str(tmp_path / "small"))
    small.upsert(rows(("b", "3")), 0, same)
    assert {tuple(r) for r in small.read(spark).collect()} == {("a", "2"), ("b", "3")}


def test_stream_relate(spark, tmp_path):
    nodes = spark.createDataFrame([("Entity", "e", None), ("Document", "d", None)], "label string, id string, name string")
    spark.createDataFrame([("e", "Entity", "d", "Document", "OWNS"), ("e", "Entity", "d", "Document", "OWNS"), ("e", "Entity", "x", "Document", "OWNS"), ("e", "Entity", "d", "Document", "EATS")], tables.SCHEMAS["relationships_in"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tables.SCHEMAS["relationships_in"]).parquet(str(tmp_path / "in"))
    table = jobs.edge_table(str(tmp_path / "edges"))
    assert table.read(spark).count() == 0
    jobs.stream_relate(stream, lambda: nodes, table, str(tmp_path / "rejects"), str(tmp_path / "checkpoint")).awaitTermination()
    assert [tuple(r[c] for c in graph.EDGE) for r in table.read(spark).collect()] == [("Entity", "e", "OWNS", "Document", "d")]
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 2


def test_requests_of_lines(spark, tmp_path):
    lines = [
        '{"document_id": "d1", "entity_id": "e", "text": "x", "metadata": {"b": 1, "a": [null, "z"]}, "more": 1}',
        '{"document_id": "d2", "entity_id": "e", "text": "", "file_url": null}',
        '{"document_id": "d3", "entity_id": "e"}',
        '{"document_id": "d4", "entity_id": "e", "text": null}',
        '{"document_id": 5, "entity_id": "e", "text": "x"}',
        '{"document_id": "d6", "entity_id": "e", "text": "x", "metadata": null}',
        '{"document_id": "d7", "entity_id": "e", "text": "x", "metadata": "{}"}',
        '{"document_id": "d8", "entity_id": ',
        '["d9"]',
        "",
        '{"text": "y", "text": "x", "document_id": "d10", "entity_id": "e"}',
    ]
    (tmp_path / "d.json").write_text("\n".join(lines) + "\n")
    good, bad = requests.read_requests(spark, "documents_in", str(tmp_path / "d.json"))
    assert sorted((r.document_id, r.text, r.file_url, r.metadata) for r in good.collect()) == [("d1", "x", None, '{"a":[null,"z"],"b":1}'), ("d10", "x", None, "{}"), ("d2", "", None, "{}")]
    reasons = {r.line: r.reason for r in bad.collect()}
    assert reasons == {lines[2]: "Missing field: text.", lines[3]: "Wrong type: text.", lines[4]: "Wrong type: document_id.", lines[5]: "Wrong type: metadata.", lines[6]: "Wrong type: metadata.", **{x: "Not a JSON object." for x in lines[7:10]}}
    assert good.count() + bad.count() == len(lines)
    top = ["3", '"4"', "5.0", "5.5", "true", "null", '"x"', "99999999999"]
    (tmp_path / "q.json").write_text("\n".join('{"question_id": "q%d", "question": "Why?", "entity_id": "e", "top_k": %s}' % x for x in enumerate(top)) + '\n{"question_id": "q9", "question": "Why?", "entity_id": "e"}')
    good, bad = requests.read_requests(spark, "questions", str(tmp_path / "q.json"))
    assert {r.question_id: r.top_k for r in good.collect()} == {"q0": 3, "q1": 4, "q2": 5, "q9": 5}
    assert {r.reason for r in bad.collect()} == {"Wrong type: top_k."} and bad.count() == 5
    (tmp_path / "r.json").write_text('{"from_id": "a", "from_type": "Entity", "to_id": "b", "to_type": "Thing", "relationship_type": "OWNS"}')
    assert [r.reason for r in requests.read_requests(spark, "relationships_in", str(tmp_path / "r.json"))[1].collect()] == ["Unsupported value: to_type."]


def test_readers(spark, tmp_path):
    (tmp_path / "seed.json").write_text('[{"_id": "1", "domain": "bank", "attribute_key": "k", "priority": 3, "tags": ["a"]}]')
    row = tables.read(spark, "catalog_global", str(tmp_path / "seed.json"), "json_array").first()
    assert (row["_id"], row.priority, row.tags, row.label) == ("1", 3, ["a"], None)
    (tmp_path / "q.json").write_text('{"question_id": "1", "question": "Why?", "entity_id": "e"}\n')
    assert tables.with_top_k(tables.read(spark, "questions", str(tmp_path / "q.json"), "json")).first().top_k == 5


def test_values_of_the_latest_chunks(spark, tmp_path):
    """Values are those of each id's latest row, and neither vectors nor texts are moved for them; vectors are added without a shuffle."""
    tables = jobs.IndexTables(str(tmp_path / "index"))
    run(spark, tmp_path, 0, [("d1", "e", None, "alpha beta", "{}"), ("d2", "e", None, "gamma", "{}")], tables)
    run(spark, tmp_path, 1, [("d1", "e", "u", "alpha beta", "{}")], tables)
    got = tables.read(spark, "chunks", {"file_url": F.col("file_url"), "size": F.size("vector"), "n": F.length("text")})
    whole = tables.read(spark, "chunks").select("id", "file_url", F.size("vector").alias("size"), F.length("text").alias("n"))
    assert got.columns == whole.columns and sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(struct(file_url, file_url" in plan and "vector, vector#" not in plan
    points = index.points(spark.createDataFrame([("d", "e", None, "a b a", "{}")], DOCS))
    own = index.with_vectors(points)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert own.join(index.embed_texts(points, "id", "text").withColumnRenamed("vector", "want"), "id").where("vector = want").count() == 1
