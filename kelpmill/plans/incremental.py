"""Queries of the streaming jobs and the function hooks. The streams read the given tables and stop when they are through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, index, prompts, search
from ..sources import folders, tables
from ..streaming import jobs
from . import sql


def _arrivals(spark, folder, schema, parts, run):
    """Each part is added to a folder that a stream reads, and run takes what has arrived: a batch for each part."""
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/arriving/{k}")
        run(spark.readStream.schema(schema).parquet(f"{folder}/arriving/*")).awaitTermination()


def stream_index(spark, sf_dir):
    """All documents in four batches, some without text, then every eighth again with another name: what the tables say of each document at the end."""
    d, k = tables.documents_in(spark, sf_dir), F.col("document_id").cast("long")
    d = d.withColumn("text", F.when(k % 9 > 0, F.col("text")).otherwise(" \n"))
    parts = [d.where(k % 4 == n) for n in range(4)] + [d.where(k % 8 == 1).withColumn("metadata", F.lit('{"name":"again"}'))]
    folder = folders.new_folder(spark, "job")
    out = jobs.IndexTables(f"{folder}/index")
    _arrivals(spark, folder, d.schema, parts, lambda rows: jobs.stream_index(rows, out, f"{folder}/checkpoint"))
    kept = {c: F.col(c) for c in ("document_id", "entity_id", "norm", "embedder")}
    chunks = out.read(spark, "chunks", kept | {"dimension": F.size("vector"), "moment": _moment()})
    of_chunks = chunks.groupBy("document_id", "entity_id").agg(F.count("*").alias("n_points"), F.max("dimension").cast("long").alias("dimension"), F.round(F.max("norm"), 6).alias("norm"), F.round(F.sum("moment"), 4).alias("moment"), F.max("embedder").alias("embedder"))
    summaries = out.read(spark, "summaries").select("document_id", "entity_id", "status", "chunks_indexed", F.col("graph.document.name").alias("name"))
    edges = out.read(spark, "edges").select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("document_id"), "relationship")
    nodes = out.read(spark, "nodes").where("label = 'Document'").select(F.col("id").alias("document_id"), F.col("name").alias("node_name"))
    both = ["document_id", "entity_id"]
    good = summaries.join(of_chunks, both).join(edges, both).join(nodes, "document_id").withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(out.read(spark, "rejects").distinct(), allowMissingColumns=True)


def stream_relate(spark, sf_dir):
    """Requests of odd orders, then of even ones and the rejected once more: by then the nodes of all orders are there."""
    o, k = tables.star(spark, sf_dir, "orders"), F.col("o_orderkey")
    requests = o.select(F.col("o_custkey").cast("string").alias("from_id"), F.lit("Entity").alias("from_type"), F.when(k % 7 == 0, k + 1_000_000_000).otherwise(k).cast("string").alias("to_id"), F.lit("Document").alias("to_type"), F.when(k % 11 == 0, "LIKES").otherwise("HAS_DOCUMENT").alias("relationship_type"))
    of = lambda n: requests.where(F.col("to_id").cast("long") % 2 == n)
    folder = folders.new_folder(spark, "job")
    table, nodes = jobs.edge_table(f"{folder}/edges"), tables.nodes(spark, sf_dir)
    early = nodes.where("label = 'Entity' or cast(id as long) % 5 > 0")
    there = iter([early, nodes])
    _arrivals(spark, folder, requests.schema, [of(1), of(0).unionByName(of(1).where(F.col("to_id").cast("long") % 5 == 0))], lambda rows: jobs.stream_relate(rows, lambda known=next(there): known, table, f"{folder}/rejects", f"{folder}/checkpoint"))
    rejected = spark.read.parquet(f"{folder}/rejects").groupBy("batch", "reason").agg(F.count("*").alias("n"))
    return table.read(spark).groupBy(F.lit("accepted").alias("reason")).agg(F.count("*").alias("n")).withColumn("batch", F.lit(None).cast("int")).unionByName(rejected)


def _lengths(texts):
    """A stand-in for a model: the share of letters and of the rest, as a unit vector."""
    out = []
    for t in texts:
        letters = sum(map(str.isalpha, t))
        size = (letters**2 + (len(t) - letters) ** 2) ** 0.5 or 1.0
        out.append([letters / size, (len(t) - letters) / size])
    return out


def _moment():
    """The vector as one number: each place times its number, summed."""
    return F.round(F.aggregate(F.transform("vector", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x), 6).alias("moment")


def embed_texts(spark, sf_dir):
    docs = tables.documents_in(spark, sf_dir)
    hashed = index.embed_texts(docs, "document_id", "text").select("document_id", _moment())
    own = index.embed_texts(docs, "document_id", "text", model=_lengths).select("document_id", F.round(F.col("vector")[0], 6).alias("letters"), F.round(F.col("vector")[1], 6).alias("others"))
    return hashed.join(own, "document_id")


def _echo(messages):
    """A stand-in for a model: answers with the length of the question, and fails on some."""
    size = len(messages[1]["content"])
    if size % 7 == 0:
        raise TimeoutError("no answer")
    return '{"choices":[{"message":{"content":"' + str(size) + '"}}]}'


def _later(messages):
    """One that says by its answer that it was asked, but for lengths that it is too busy for."""
    size = len(messages[1]["content"])
    return (429, "{}") if size % 3 == 0 else '{"choices":[{"message":{"content":"later ' + str(size) + '"}}]}'


def complete_prompts(spark, sf_dir):
    """Each question twice, asked once; a second run asks only what failed in the first."""
    q = search.reject_blank_question(tables.questions(spark, sf_dir))[0]
    asked = q.withColumn("messages", prompts.messages("Count.", F.col("question"))).select("question_id", "messages")
    asked = asked.unionByName(asked.withColumn("question_id", F.concat(F.lit("again "), "question_id")))
    table = calls.Answers(f"{folders.new_folder(spark, 'job')}/answers")
    table.resume(asked, _echo, "question_id", slice_rows=16, retries=1)
    return table.resume(asked, _later, "question_id").select("request_id", "http_status", "body", "transport_error", "attempts")


QUERIES = {
    "stream_index": (stream_index, sql.query(sql.CHUNKS, sql.weights("cw", "points", "id", "text"), """SELECT document_id, entity_id, 'ok' AS status, count(*) AS chunks_indexed, CASE WHEN document_id::BIGINT % 8 = 1 THEN 'again' ELSE json_extract_string(any_value(metadata), '$.name') END AS name, count(*) AS n_points, 384::BIGINT AS dimension, 1.0::DOUBLE AS norm, round(sum(moment), 4) AS moment,
  'md5-bag' AS embedder, 'HAS_DOCUMENT' AS relationship, CASE WHEN document_id::BIGINT % 8 = 1 THEN 'again' ELSE json_extract_string(any_value(metadata), '$.name') END AS node_name, NULL::VARCHAR AS reason
FROM points JOIN (SELECT id, round(sum(bucket * weight), 6) AS moment FROM cw GROUP BY id) USING (id) WHERE document_id::BIGINT % 9 > 0 GROUP BY document_id, entity_id
UNION ALL SELECT doc_id::VARCHAR, source, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'No indexable text was provided.' FROM documents WHERE doc_id % 9 = 0 OR trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = ''""")),
    "stream_relate": (stream_relate, """WITH r AS (
  SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS k, o_orderkey % 11 = 0 AS odd_type, o_orderkey % 7 = 0 OR c_custkey IS NULL AS missing FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), b AS (
  SELECT *, 0 AS batch, missing OR k % 5 = 0 AS unknown FROM r WHERE k % 2 = 1 UNION ALL SELECT *, 1, missing FROM r WHERE k % 2 = 0 OR k % 5 = 0
)
SELECT CASE WHEN odd_type THEN 'Unsupported relationship type.' ELSE 'Source or target node was not found.' END AS reason, count(*) AS n, batch FROM b WHERE odd_type OR unknown GROUP BY ALL
UNION ALL SELECT 'accepted', count(DISTINCT (o_custkey, k)), NULL FROM b WHERE NOT odd_type AND NOT unknown"""),
    "embed_texts": (embed_texts, sql.query(sql.weights("w", "documents", "doc_id", "text"), """SELECT doc_id::VARCHAR AS document_id, round(coalesce(moment, 0), 6)::DOUBLE AS moment, round(coalesce(n / size, 0), 6)::DOUBLE AS letters, round(coalesce((len - n) / size, 0), 6)::DOUBLE AS others
FROM (SELECT *, nullif(sqrt(n * n + (len - n) * (len - n)), 0) AS size FROM (SELECT doc_id, length(text) AS len, length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')) AS n FROM documents)) LEFT JOIN (SELECT doc_id, sum(bucket * weight) AS moment FROM w GROUP BY doc_id) USING (doc_id)""")),
    "complete_prompts": (complete_prompts, r"""WITH q AS (
  SELECT item_id::VARCHAR AS id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM benchmark
), a AS (
  SELECT id, CASE WHEN n % 7 = 0 AND n % 3 = 0 THEN 429 ELSE 200 END AS http_status, CASE WHEN n % 7 > 0 THEN '{"choices":[{"message":{"content":"' || n || '"}}]}' WHEN n % 3 = 0 THEN '{}' ELSE '{"choices":[{"message":{"content":"later ' || n || '"}}]}' END AS body,
    NULL::VARCHAR AS transport_error, CASE WHEN n % 7 = 0 THEN 3 ELSE 1 END AS attempts FROM q
)
SELECT id AS request_id, http_status, body, transport_error, attempts FROM a UNION ALL SELECT 'again ' || id, http_status, body, transport_error, attempts FROM a"""),
}
