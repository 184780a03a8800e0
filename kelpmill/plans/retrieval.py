"""Queries of the retrieval jobs: index, relate, retrieve, neighbourhood, ask context."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import calls, graph, index, prompts, search, store
from ..sources import folders, tables
from . import sql


def _accepted(spark, sf_dir) -> DataFrame:
    return index.reject_empty_text(tables.documents_in(spark, sf_dir))[0]


def chunk_text(spark, sf_dir):
    return index.chunks(_accepted(spark, sf_dir)).select("document_id", "chunk_index", "chunk")


def point_id(spark, sf_dir):
    return index.points(_accepted(spark, sf_dir)).select("id", "document_id", "chunk_index")


def hash_embed(spark, sf_dir):
    rows = index.hash_weights(index.points(_accepted(spark, sf_dir)).select("id", "text"), "text", normal=True)
    return rows.select("id", "bucket", F.round("weight", 9).alias("weight"))


def token_count(spark, sf_dir):
    return index.points(_accepted(spark, sf_dir)).select("id", F.size(tokens(F.col("text"), normal=True)).cast("long").alias("n_tokens"))


def reject_empty_text(spark, sf_dir):
    docs = tables.documents_in(spark, sf_dir).withColumn("text", F.when(F.col("document_id").cast("long") % 9 > 0, F.col("text")).otherwise(" \n"))
    good, bad = index.reject_empty_text(docs)
    return good.select("document_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("document_id", "reason"))


def reject_blank_question(spark, sf_dir):
    asked = tables.questions(spark, sf_dir).withColumns({"question": F.when(F.col("question_id").cast("long") % 7 > 0, F.col("question")).otherwise(" \t "), "top_k": F.when(F.col("question_id").cast("long") % 5 > 0, F.col("top_k")).otherwise(0)})
    good, bad = search.reject_blank_question(tables.with_top_k(asked))
    return good.select("question_id", "question", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("question_id", "question", "reason"))


def src_questions(spark, sf_dir):
    return tables.with_top_k(tables.questions(spark, sf_dir))


def src_documents(spark, sf_dir):
    return tables.documents_in(spark, sf_dir).select("document_id", "entity_id", "file_url", F.sha2("text", 256).alias("text_sha256"), "metadata", index.document_name(F.col("metadata"), F.col("file_url")).alias("document_name"))


def _hits(spark, sf_dir):
    points = folders.written_once(index.points(_accepted(spark, sf_dir)))
    return search.knn_sparse(search.reject_blank_question(src_questions(spark, sf_dir))[0], points), points


def topk_per_question(spark, sf_dir):
    return _hits(spark, sf_dir)[0]


def collect_chunks(spark, sf_dir):
    found = search.collect_chunks(*_hits(spark, sf_dir))
    return found.select("question_id", F.array_join(F.transform("chunks", lambda c: F.concat_ws("/", c["rank"].cast("string"), c["id"])), ",").alias("chunks"))


def _asked_vectors(spark, sf_dir):
    e = tables.star(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("entity_id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = e.where(F.col("id").cast("long") % 20 == 0).select(F.col("id").alias("question_id"), "entity_id", "vector", (1 + F.col("id").cast("long") % 5).cast("int").alias("top_k"))
    return asked, e


def knn_join(spark, sf_dir):
    return search.knn_dense(*_asked_vectors(spark, sf_dir))


def _store(spark):
    return store.IndexStore(spark, folders.new_folder(spark, "index"), parts=16, buckets=4)


def _vector_points(spark, sf_dir):
    """The embeddings as index rows."""
    none = F.lit(None).cast("string")
    return _asked_vectors(spark, sf_dir)[1].select("id", F.lit("").alias("document_id"), "entity_id", none.alias("file_url"), F.lit(0).alias("chunk_index"), F.lit("").alias("text"), none.alias("metadata"), "vector", F.lit("given").alias("embedder"), F.lit(0).cast("long").alias("seq"))


def filter_entity(spark, sf_dir):
    """One entity's rows from the files of an index."""
    box = _store(spark)
    box.upsert(_vector_points(spark, sf_dir))
    return box.of_entity("3").select("id", "entity_id", F.round("norm", 6).alias("norm"))


def cosine_score(spark, sf_dir):
    return search.scored_dense(*_asked_vectors(spark, sf_dir)).select("question_id", "id", "score")


def index_dimension_check(spark, sf_dir):
    """Rows whose vectors have a place less come after the index has learned its dimension."""
    rows, box = _vector_points(spark, sf_dir), _store(spark)
    short = F.col("id").cast("long") % 10 == 3
    box.upsert(rows.where(~short))
    bad = box.upsert(rows.where(short).withColumn("vector", F.slice("vector", 1, 63)))
    return box.read().select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


def index_upsert(spark, sf_dir):
    """All points, then those of every third document again with new metadata: a full overwrite of just these, read back from the files."""
    points, box = folders.written_once(index.points(_accepted(spark, sf_dir))), _store(spark)
    old = index.with_vectors(points).withColumns({"embedder": F.lit(index.EMBEDDER), "seq": F.lit(0).cast("long")})
    box.upsert(old)
    new = old.where(F.col("document_id").cast("long") % 3 == 0).withColumns({"metadata": F.lit('{"name":"again"}'), "seq": F.lit(1).cast("long")})
    box.upsert(new.unionByName(new))
    return box.read().select("id", "document_id", "metadata", F.size("vector").cast("long").alias("dimension"), F.round("norm", 6).alias("norm"), "embedder", "seq")


def index_summary(spark, sf_dir):
    docs = _accepted(spark, sf_dir)
    nodes = graph.upsert_nodes(graph.document_nodes(docs).withColumn("seq", F.lit(0)), tables.nodes(spark, sf_dir).limit(0).withColumn("seq", F.lit(0)))
    out = index.index_summary(docs, index.chunks(docs), nodes)
    g = lambda c, name: F.col(f"graph.{c}").alias(name)
    edge = F.concat_ws(">", *[f"graph.relationship.{c}" for c in ("from_type", "from_id", "relationship", "to_type", "to_id")]).alias("relationship")
    return out.select("status", "document_id", "entity_id", "file_url", "metadata", "chunks_indexed", "collection", g("entity.id", "graph_entity_id"), g("entity.name", "entity_name"), g("document.id", "graph_document_id"), g("document.name", "document_name"), edge)


def index_edges(spark, sf_dir):
    return graph.index_edges(_accepted(spark, sf_dir))


def upsert_document(spark, sf_dir):
    """Nodes of the documents, again with no name, and again with another name for some."""
    new = graph.document_nodes(_accepted(spark, sf_dir)).withColumn("seq", F.lit(0))
    named = new.where("label = 'Document' and cast(id as long) % 4 = 0").withColumns({"name": F.concat(F.lit("new "), "id"), "seq": F.lit(1)})
    blank = new.withColumns({"name": F.lit(None).cast("string"), "seq": F.lit(2)})
    return graph.upsert_nodes(new, named.unionByName(blank)).select("label", "id", "name")


def _matched(spark, sf_dir):
    good, bad = graph.check_requests(tables.relationships_in(spark, sf_dir))
    nodes = tables.nodes(spark, sf_dir)
    matched, missing = graph.match_endpoints(good, nodes)
    return matched, bad.unionByName(missing), nodes


def edge_endpoint_match(spark, sf_dir):
    good, bad, _ = _matched(spark, sf_dir)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


def _edges(spark, sf_dir):
    good, _, nodes = _matched(spark, sf_dir)
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in graph.EDGE))
    return graph.upsert_edges(none, good), nodes


def upsert_edge(spark, sf_dir):
    return _edges(spark, sf_dir)[0]


def expand_one_hop(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    asked = tables.star(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).cast("string").alias("entity_id"))
    out = graph.expand_one_hop(asked, nodes, edges, page=4)
    return out.select("entity_id", F.col("entity.name").alias("name"), "page", F.array_join(F.transform("relationships", lambda r: F.concat_ws(">", r["relationship"], r["to_id"])), ",").alias("relationships"))


def _context(spark, sf_dir):
    docs = _accepted(spark, sf_dir)
    nodes = graph.document_nodes(docs).distinct()
    asked = search.reject_blank_question(src_questions(spark, sf_dir))[0]
    hits, points = _hits(spark, sf_dir)
    return prompts.ask_context(asked, search.collect_chunks(hits, points), graph.expand_one_hop(asked, nodes, graph.index_edges(docs)))


def attach_graph_context(spark, sf_dir):
    return _context(spark, sf_dir).select("question_id", F.size("chunks").alias("n_chunks"), F.col("entity.id").alias("entity"), F.col("n_relationships").cast("int").alias("n_relationships"))


def format_chunk_block(spark, sf_dir):
    return _context(spark, sf_dir).select("question_id", F.sha2(prompts.chunk_block(F.col("chunks")), 256).alias("block_sha256"))


def format_graph_block(spark, sf_dir):
    return _context(spark, sf_dir).select("question_id", F.sha2("graph", 256).alias("block_sha256"))


def chunk_index(spark, sf_dir):
    rows = index.points(_accepted(spark, sf_dir)).groupBy("document_id")
    return rows.agg(F.max("chunk_index").alias("last"), F.countDistinct("chunk_index").alias("n"))


def l2_normalize(spark, sf_dir):
    places = index.hash_places(index.points(_accepted(spark, sf_dir)).select("id", "text"), "text", normal=True)
    return places.select("id", F.size("places").cast("long").alias("n_places"), F.round(F.aggregate("places", F.lit(0.0), lambda a, p: a + p["weight"] * p["weight"]), 6).alias("norm"), F.round(F.array_max(F.transform("places", lambda p: p["weight"])), 9).alias("most"))


def build_ask_prompt(spark, sf_dir):
    return prompts.with_ask_prompt(_context(spark, sf_dir)).select("question_id", F.sha2(F.col("messages")[1]["content"], 256).alias("user_sha256"))


def _digest(messages):
    """A stand-in for a model: answers with the hash of what it is asked."""
    return '{"choices":[{"message":{"content":"' + hashlib.sha256(messages[1]["content"].encode()).hexdigest() + '"}}]}'


def ask_result(spark, sf_dir):
    """Questions to answers, through a function in place of a model; hits with the hash of their payload."""
    asked = folders.written_once(prompts.with_ask_prompt(_context(spark, sf_dir)))
    out = prompts.ask_results(asked, calls.complete_prompts(asked, _digest, "question_id"))
    payload = F.transform("chunks", lambda c: F.concat_ws("|", c["id"], c["document_id"], c["entity_id"], F.coalesce(c["file_url"], F.lit("")), c["chunk_index"].cast("string"), c["text"], c["metadata"]))
    return out.select("question_id", "answer", F.array_join(F.transform("chunks", lambda c: c["id"]), ",").alias("ids"), F.sha2(F.array_join(payload, ","), 256).alias("payload_sha256"), F.col("graph.entity.id").alias("entity"), F.col("graph.n_relationships").cast("long").alias("n_relationships"))


_REASON = "CASE WHEN {} THEN '{}' END AS reason"
_USER = r"'Question:' || chr(10) || regexp_replace(question, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || 'Document Chunks:' || chr(10) || coalesce(c, 'No matching chunks found.') || chr(10) || chr(10) || 'Graph Context:' || chr(10) || coalesce(g, 'No graph relationships found.')"
_CONTEXT = """FROM questions q LEFT JOIN (SELECT question_id, string_agg('[Chunk ' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS c, string_agg(id, ',' ORDER BY rank) AS ids, string_agg(concat_ws('|', id, document_id, entity_id, '', chunk_index, text, metadata), ',' ORDER BY rank) AS payload FROM hits JOIN points USING (id) GROUP BY ALL) USING (question_id)
LEFT JOIN (SELECT entity_id, string_agg('Entity(' || entity_id || ') -[HAS_DOCUMENT]-> Document(' || document_id || ')', chr(10) ORDER BY document_id) AS g, count(*) AS n_relationships FROM documents_in WHERE trim(text) <> '' GROUP BY ALL) USING (entity_id)"""
QUERIES = {
    "src_documents": (src_documents, sql.query(sql.DOCUMENTS, "SELECT document_id, entity_id, file_url, sha256(text) AS text_sha256, metadata, json_extract_string(metadata, '$.name') AS document_name FROM documents_in")),
    "src_questions": (src_questions, sql.query(sql.QUESTIONS, "SELECT * FROM questions")),
    "reject_empty_text": (reject_empty_text, "SELECT doc_id::VARCHAR AS document_id, " + _REASON.format("doc_id % 9 = 0 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = ''", "No indexable text was provided.") + " FROM documents"),
    "reject_blank_question": (reject_blank_question, r"""SELECT item_id::VARCHAR AS question_id, CASE WHEN item_id % 7 = 0 THEN ' ' || chr(9) || ' ' WHEN item_id % 5 = 0 AND item_id % 4 = 1 THEN '  ' || text || ' ' || chr(10) WHEN item_id % 5 = 0 THEN text ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS question,
  CASE WHEN item_id % 7 = 0 THEN 'question is required.' WHEN item_id % 5 = 0 THEN 'top_k must be positive.' END AS reason FROM benchmark"""),
    "chunk_text": (chunk_text, sql.query(sql.CHUNKS, "SELECT document_id, chunk_index, chunk FROM chunked")),
    "point_id": (point_id, sql.query(sql.CHUNKS, "SELECT id, document_id, chunk_index FROM points")),
    "hash_embed": (hash_embed, sql.query(sql.CHUNKS, sql.weights("cw", "points", "id", "text"), "SELECT id, bucket, round(weight, 9) AS weight FROM cw")),
    "token_count": (token_count, sql.query(sql.CHUNKS, sql.weights("cw", "points", "id", "text"), "SELECT id, sum(n)::BIGINT AS n_tokens FROM cw_counts GROUP BY id")),
    "topk_per_question": (topk_per_question, sql.query(sql.HITS, "SELECT * FROM hits")),
    "collect_chunks": (collect_chunks, sql.query(sql.HITS, "SELECT question_id, string_agg(rank || '/' || id, ',' ORDER BY rank) AS chunks FROM hits GROUP BY ALL")),
    "knn_join": (knn_join, """WITH s AS (
  SELECT q.vec_id::VARCHAR AS question_id, e.vec_id::VARCHAR AS id, 1 + q.vec_id % 5 AS top_k, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0
) SELECT question_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= top_k"""),
    "filter_entity": (filter_entity, "SELECT vec_id::VARCHAR AS id, label::VARCHAR AS entity_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings WHERE label = 3"),
    "cosine_score": (cosine_score, "SELECT q.vec_id::VARCHAR AS question_id, e.vec_id::VARCHAR AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0"),
    "index_dimension_check": (index_dimension_check, "SELECT vec_id::VARCHAR AS id, " + _REASON.format("vec_id % 10 = 3", "Vector dimension differs from the index.") + " FROM embeddings"),
    "index_upsert": (index_upsert, sql.query(sql.CHUNKS, """SELECT id, document_id, CASE WHEN document_id::BIGINT % 3 = 0 THEN '{"name":"again"}' ELSE metadata END AS metadata, 384::BIGINT AS dimension, 1.0::DOUBLE AS norm, 'md5-bag' AS embedder, (document_id::BIGINT % 3 = 0)::BIGINT AS seq FROM points""")),
    "index_summary": (index_summary, sql.query(sql.CHUNKS, """SELECT 'ok' AS status, document_id, entity_id, NULL::VARCHAR AS file_url, any_value(metadata) AS metadata, count(*) AS chunks_indexed, 'document_chunks' AS collection, entity_id AS graph_entity_id, NULL::VARCHAR AS entity_name, document_id AS graph_document_id, json_extract_string(any_value(metadata), '$.name') AS document_name,
  'Entity>' || entity_id || '>HAS_DOCUMENT>Document>' || document_id AS relationship FROM chunked GROUP BY document_id, entity_id""")),
    "index_edges": (index_edges, "SELECT DISTINCT 'Entity' AS from_type, source AS from_id, 'HAS_DOCUMENT' AS relationship, 'Document' AS to_type, doc_id::VARCHAR AS to_id FROM documents WHERE trim(text) <> ''"),
    "upsert_document": (upsert_document, sql.query(sql.DOCUMENTS, """SELECT DISTINCT 'Entity' AS label, entity_id AS id, NULL AS name FROM documents_in WHERE trim(text) <> ''
UNION ALL SELECT 'Document', document_id, CASE WHEN document_id::BIGINT % 4 = 0 THEN 'new ' || document_id ELSE json_extract_string(metadata, '$.name') END FROM documents_in WHERE trim(text) <> ''""")),
    "edge_endpoint_match": (edge_endpoint_match, sql.query(sql.NODES, sql.RELATIONSHIPS, """SELECT from_type, from_id, to_type, to_id, relationship_type, CASE WHEN from_type NOT IN ('Entity', 'Document') THEN 'Unsupported node label.' WHEN relationship_type NOT IN ('HAS_DOCUMENT', 'BELONGS_TO', 'OWNS', 'USED_IN_EVENT') THEN 'Unsupported relationship type.'
  WHEN NOT EXISTS (FROM nodes n WHERE n.label = 'Entity' AND n.id = from_id) OR NOT EXISTS (FROM nodes n WHERE n.label = 'Document' AND n.id = to_id) THEN 'Source or target node was not found.' END AS reason FROM requests""")),
    "upsert_edge": (upsert_edge, sql.query(sql.NODES, sql.RELATIONSHIPS, "SELECT * FROM edges")),
    "expand_one_hop": (expand_one_hop, sql.query(sql.NODES, sql.RELATIONSHIPS, """SELECT entity_id, any_value(c_name) AS name, page, coalesce(string_agg(relationship || '>' || to_id, ',' ORDER BY relationship, to_type, to_id) FILTER (to_id IS NOT NULL), '') AS relationships
FROM (SELECT entity_id, c_name, relationship, to_type, to_id, ((row_number() OVER (PARTITION BY entity_id ORDER BY relationship, to_type, to_id) - 1) // 4)::INT AS page
  FROM (SELECT (c_custkey * 2)::VARCHAR AS entity_id FROM customer) a LEFT JOIN customer c ON c.c_custkey::VARCHAR = entity_id LEFT JOIN edges e ON e.from_type = 'Entity' AND e.from_id = entity_id AND c_name IS NOT NULL) GROUP BY entity_id, page""")),
    "attach_graph_context": (attach_graph_context, sql.query(sql.HITS, """SELECT q.question_id, coalesce((SELECT count(*) FROM hits h WHERE h.question_id = q.question_id), 0)::INT AS n_chunks, CASE WHEN n > 0 THEN q.entity_id END AS entity, coalesce(n, 0)::INT AS n_relationships
FROM questions q LEFT JOIN (SELECT entity_id, count(DISTINCT document_id) AS n FROM documents_in WHERE trim(text) <> '' GROUP BY ALL) d USING (entity_id)""")),
    "format_chunk_block": (format_chunk_block, sql.query(sql.HITS, f"SELECT q.question_id, sha256(coalesce(c, 'No matching chunks found.')) AS block_sha256\n{_CONTEXT}")),
    "format_graph_block": (format_graph_block, sql.query(sql.HITS, f"SELECT q.question_id, sha256(coalesce(g, 'No graph relationships found.')) AS block_sha256\n{_CONTEXT}")),
    "chunk_index": (chunk_index, sql.query(sql.CHUNKS, "SELECT document_id, max(chunk_index) AS last, count(*) AS n FROM points GROUP BY ALL")),
    "l2_normalize": (l2_normalize, sql.query(sql.CHUNKS, sql.weights("cw", "points", "id", "text"), "SELECT id, count(*) AS n_places, round(sum(weight * weight), 6) AS norm, round(max(weight), 9) AS most FROM cw GROUP BY id")),
    "build_ask_prompt": (build_ask_prompt, sql.query(sql.HITS, f"SELECT q.question_id, sha256({_USER}) AS user_sha256\n{_CONTEXT}")),
    "ask_result": (ask_result, sql.query(sql.HITS, f"""SELECT q.question_id, sha256({_USER}) AS answer, coalesce(ids, '') AS ids, sha256(coalesce(payload, '')) AS payload_sha256, CASE WHEN g IS NOT NULL THEN q.entity_id END AS entity, coalesce(n_relationships, 0) AS n_relationships
{_CONTEXT}""")),
}
