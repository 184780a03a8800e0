import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from kelpmill.operators import calls, graph, index, prompts

REQUESTS = "from_id string, from_type string, to_id string, to_type string, relationship_type string"
DOCS = "document_id string, entity_id string, file_url string, text string, metadata string"


def nodes(spark):
    return spark.createDataFrame([("Entity", "entity-1", "One"), ("Document", "doc-1", None), ("Document", "doc-2", None)], "label string, id string, name string")


def test_edges(spark):
    asked = spark.createDataFrame([("entity-1", "Entity", "doc-1", "Document", "HAS_DOCUMENT"), ("entity-1", "Entity", "doc-1", "Document", "HAS_DOCUMENT"), ("entity-9", "Entity", "doc-1", "Document", "OWNS"), ("entity-1", "Entity", "doc-9", "Document", "OWNS"), ("entity-1", "Entity", "doc-2", "Document", "LIKES"), ("entity-1", "Person", "doc-2", "Document", "OWNS")], REQUESTS)
    good, bad = graph.check_requests(asked)
    matched, missing = graph.match_endpoints(good, nodes(spark))
    assert sorted(r.reason for r in bad.unionByName(missing).collect()) == ["Source or target node was not found."] * 2 + ["Unsupported node label.", "Unsupported relationship type."]
    edges = graph.upsert_edges(spark.createDataFrame([], ", ".join(f"{c} string" for c in graph.EDGE)), matched)
    assert edges.count() == 1 and graph.upsert_edges(edges, matched).count() == 1
    hops = graph.expand_one_hop(spark.createDataFrame([("entity-1",), ("entity-7",)], "entity_id string"), nodes(spark), edges)
    got = {r.entity_id: (r.entity and r.entity.name, r.page, [e.to_id for e in r.relationships]) for r in hops.collect()}
    assert got == {"entity-1": ("One", 0, ["doc-1"]), "entity-7": (None, 0, [])}


def test_pages_of_a_hub(spark):
    """Edges of one entity over several ranges: pages are full, in order, and numbered without gaps."""
    ids = spark.range(20_000).select(F.lit("Entity").alias("from_type"), F.when(F.col("id") % 10 > 0, "hub").otherwise(F.concat(F.lit("e"), F.col("id") % 50)).alias("from_id"), F.lit("OWNS").alias("relationship"), F.lit("Document").alias("to_type"), F.lpad(F.col("id").cast("string"), 6, "0").alias("to_id"))
    rows = graph.relationship_pages(ids, page=700).orderBy("entity_id", "page").collect()
    of_hub = [r for r in rows if r.entity_id == "hub"]
    assert [r.page for r in of_hub] == list(range(26)) and [len(r.relationships) for r in of_hub] == [700] * 25 + [500]
    assert [e.to_id for r in of_hub for e in r.relationships] == [f"{k:06}" for k in range(20_000) if k % 10]
    assert sum(len(r.relationships) for r in rows) == 20_000 and max(len(r.relationships) for r in rows) == 700
    nodes_of = spark.createDataFrame([("Entity", "hub", "Hub")], "label string, id string, name string")
    text = prompts.graph_texts(graph.expand_one_hop(spark.createDataFrame([("hub",), ("e0",)], "entity_id string"), nodes_of, ids, page=700))
    got = {r.entity_id: r for r in text.collect()}
    assert got["hub"].n_relationships == 18_000 and [x.split("(")[-1] for x in got["hub"].graph.split("\n")] == [f"{k:06})" for k in range(20_000) if k % 10]
    assert got["e0"].graph == "No graph relationships found." and got["e0"].entity is None


def test_nodes_keep_their_names(spark):
    docs = spark.createDataFrame([("d1", "e", "url", "x", '{"name":"Spec"}'), ("d2", "e", "url2", "x", '{"name":""}'), ("d3", "e", None, "x", "not json")], DOCS)
    new = graph.document_nodes(docs).withColumn("seq", F.lit(1))
    blank = new.withColumns({"name": F.lit(None).cast("string"), "seq": F.lit(2)})
    got = {(r.label, r.id): r.name for r in graph.upsert_nodes(new, blank).collect()}
    assert got == {("Entity", "e"): None, ("Document", "d1"): "Spec", ("Document", "d2"): "url2", ("Document", "d3"): None}
    summary = index.index_summary(docs, index.chunks(docs), graph.upsert_nodes(new, blank)).orderBy("document_id").collect()
    assert [(r.status, r.chunks_indexed, r.collection) for r in summary] == [("ok", 1, "document_chunks")] * 3
    assert summary[0].graph.asDict(True) == {"entity": {"id": "e", "name": None}, "document": {"id": "d1", "name": "Spec"}, "relationship": {"from_id": "e", "from_type": "Entity", "relationship": "HAS_DOCUMENT", "to_id": "d1", "to_type": "Document"}}


def test_prompts(spark):
    none = spark.createDataFrame([("q", "Why?", "e")], "question_id string, question string, entity_id string")
    chunks = spark.createDataFrame([("x", [(1, 0.5, "i", "d", 0, "text")])], "question_id string, chunks array<struct<rank:int,score:double,id:string,document_id:string,chunk_index:int,text:string>>")
    edge = ",".join(f"{c}:string" for c in graph.EDGE)
    hops = spark.createDataFrame([("z", None, 0, [])], f"entity_id string, entity struct<id:string,name:string>, page int, relationships array<struct<{edge}>>")
    row = prompts.with_ask_prompt(prompts.ask_context(none, chunks, hops)).first()
    assert row.messages[1].content == "Question:\nWhy?\n\nDocument Chunks:\nNo matching chunks found.\n\nGraph Context:\nNo graph relationships found."
    full = none.withColumn("question_id", F.lit("x")).withColumn("entity_id", F.lit("z"))
    hops = spark.createDataFrame([("z", ("z", "Z"), 1, [("Entity", "z", "OWNS", "Document", "d2")]), ("z", ("z", "Z"), 0, [("Entity", "z", "OWNS", "Document", "d")])], hops.schema)
    row = prompts.with_ask_prompt(prompts.ask_context(full, chunks, hops)).first()
    assert row.messages[1].content.endswith("[Chunk 1] text\n\nGraph Context:\nEntity(z) -[OWNS]-> Document(d)\nEntity(z) -[OWNS]-> Document(d2)")


def test_completion_hook(spark):
    def complete(messages):
        if "bad" in messages[1]["content"]:
            raise ValueError("no")
        return messages[1]["content"].upper()

    rows = spark.createDataFrame([("1", "good"), ("2", "bad")], "request_id string, text string").withColumn("messages", prompts.messages("s", F.col("text")))
    got = {r.request_id: (r.http_status, r.body, r.transport_error, r.attempts) for r in calls.complete_prompts(rows, complete, retries=2).collect()}
    assert got["1"] == (200, "GOOD", None, 1) and got["2"] == (None, None, "no", 3)


def test_calls_that_hang_or_wait(spark):
    def complete(messages):
        time.sleep(20 if messages[1]["content"] == "hang" else 0.05)
        return messages[1]["content"]

    rows = spark.createDataFrame([(str(k), "hang" if k == 2 else f"t{k}") for k in range(40)], "request_id string, text string").coalesce(1).withColumn("messages", prompts.messages("s", F.col("text")))
    began = time.time()
    got = {r.request_id: r for r in calls.complete_prompts(rows, complete, at_once=4, time_limit=1.0).collect()}
    assert got["2"].transport_error == "no answer in 1 seconds" and time.time() - began < 18
    assert all(got[str(k)].body == f"t{k}" for k in range(40) if k != 2)


def test_answers_are_asked_for_once(spark, tmp_path):
    def counted(kind):
        folder = tmp_path / kind
        folder.mkdir()

        def complete(messages):
            text = messages[1]["content"]
            (folder / uuid.uuid4().hex).write_text(text)
            if kind == "broken" and text == "t3":
                os._exit(1)  # the worker is gone, and the job with it
            if kind == "first" and text == "t2":
                raise OSError("no")
            return f"{kind} {text}"

        return complete, lambda: sorted(p.read_text() for p in folder.iterdir())

    rows = spark.createDataFrame([(str(k), f"t{k % 5}") for k in range(10)], "request_id string, text string").withColumn("messages", prompts.messages("s", F.col("text")))
    table = calls.Answers(str(tmp_path / "answers"))
    complete, asked = counted("broken")
    with pytest.raises(Exception):  # noqa: B017
        table.resume(rows, complete, slice_rows=1)
    kept = {r.body for r in table.read(spark).collect()}
    complete, asked = counted("first")
    table.resume(rows, complete)
    assert asked() == sorted(f"t{k}" for k in range(5) if f"broken t{k}" not in kept)
    complete, asked = counted("second")
    got = {r.request_id: r.body for r in table.resume(rows, complete).collect()}
    assert asked() == ([] if "broken t2" in kept else ["t2"])
    assert all(got[str(k)].endswith(f" t{k % 5}") for k in range(10)) and len(got) == 10
    complete, asked = counted("third")
    assert table.resume(rows, complete).count() == 10 and asked() == []
