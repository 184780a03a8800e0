"""Queries that show single steps of the jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, completions, graph, index, prompts, templates
from ..sources import requests, tables
from . import sql
from .generation import COMPLETIONS, GLOBAL, LINES, REQUESTS


def _sha(x):
    return F.sha2(x, 256)


def normalize_whitespace(spark, sf_dir):
    return tables.star(spark, sf_dir, "documents").select("doc_id", _sha(tx.normalize_whitespace(F.col("text"))).alias("norm_sha256"))


def py_strip(spark, sf_dir):
    return tables.star(spark, sf_dir, "documents").select("doc_id", F.length(tx.strip(F.concat(F.lit("\t \n"), "text", F.lit(" \r")))).cast("long").alias("n_chars"))


def tokenize_lower(spark, sf_dir):
    return tables.star(spark, sf_dir, "documents").select("doc_id", _sha(F.array_join(tx.tokens(F.col("text")), " ")).alias("tokens_sha256"))


def hash_bucket(spark, sf_dir):
    words = tables.star(spark, sf_dir, "part").select(F.explode(tx.tokens(F.col("p_name"))).alias("token")).distinct()
    return index.hash_weights(words.withColumn("text", F.col("token")), "text", normal=True).select("token", "bucket")


def vector_norm(spark, sf_dir):
    e = index.with_norm(tables.star(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
    v = F.col("vector")
    return e.select("vec_id", F.round("norm", 6).alias("norm"), F.round(index.cosine(v, v, F.col("norm"), F.col("norm")), 6).alias("own_cosine"))


def embedding_dimension(spark, sf_dir):
    return index.dimensions(tables.star(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"), "label")


def chunks_indexed(spark, sf_dir):
    docs = index.reject_empty_text(tables.documents_in(spark, sf_dir))[0]
    return index.chunks(docs).groupBy("document_id").agg(F.count("*").alias("chunks_indexed"))


def upsert_entity(spark, sf_dir):
    new = tables.nodes(spark, sf_dir).where("label = 'Entity'").withColumn("seq", F.lit(0))
    blank = new.withColumns({"name": F.lit(None).cast("string"), "seq": F.lit(1)})
    renamed = new.where("cast(id as long) % 5 = 0").withColumns({"name": F.upper("name"), "seq": F.lit(2)})
    return graph.upsert_nodes(new, blank.unionByName(renamed)).select("label", "id", "name")


def src_relationships(spark, sf_dir):
    """Requests as lines of JSON, some cut off, some without a field, some with a number for a text: accepted rows, and rejects with their line."""
    r, k = tables.relationships_in(spark, sf_dir), F.col("to_id").cast("long")
    fields = F.struct("from_id", "from_type", "to_id", F.when(k % 23 > 0, F.col("to_type")).alias("to_type"), "relationship_type")
    line = F.when(k % 19 == 0, F.regexp_replace(F.to_json(fields), '"from_id":"([0-9]+)"', '"from_id":$1')).otherwise(F.to_json(fields))
    good, bad = requests.checked(r.select(F.when(k % 17 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")), "relationships_in")
    return good.unionByName(bad, allowMissingColumns=True)


def _rejected(spark, sf_dir, reason):
    return graph.check_requests(tables.relationships_in(spark, sf_dir))[1].where(F.col("reason") == reason).select("from_type", "from_id", "to_id", "relationship_type")


def filter_rel_type(spark, sf_dir):
    return _rejected(spark, sf_dir, "Unsupported relationship type.")


def filter_node_label(spark, sf_dir):
    return _rejected(spark, sf_dir, "Unsupported node label.")


def collect_relationships(spark, sf_dir):
    """Pages of at most three edges of each entity, in order."""
    good = graph.check_requests(tables.relationships_in(spark, sf_dir))[0]
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in graph.EDGE))
    pages = graph.relationship_pages(graph.upsert_edges(none, good), page=3)
    return pages.select(F.col("entity_id").alias("from_id"), "page", F.array_join(F.transform("relationships", lambda e: F.concat_ws(">", e["relationship"], e["to_id"])), ",").alias("relationships"))


def src_template_requests(spark, sf_dir):
    return tables.template_requests(spark, sf_dir).select("request_id", "template_name", "description", "domain_id", catalog.domain_type(F.col("domain_type")).alias("domain_type"))


def src_completions(spark, sf_dir):
    return tables.completions(spark, sf_dir).select("request_id", "http_status", "body", "transport_error")


def map_domain_alias(spark, sf_dir):
    r = tables.template_requests(spark, sf_dir)
    return r.select("request_id", catalog.mapped_domain(catalog.domain_type(F.col("domain_type"))).alias("domain"))


def normalize_domain_type(spark, sf_dir):
    return tables.template_requests(spark, sf_dir).select("request_id", catalog.domain_type(F.col("domain_type")).alias("domain_type"))


def parse_bool_loose(spark, sf_dir):
    """What lines of responses say after `required`."""
    good = completions.parse_completion(tables.completions(spark, sf_dir)).where("error_code is null")
    raw = good.select("request_id", completions.scalar(completions.lenient_json(F.col("content")), "$.description").alias("description"))
    lines = raw.select("request_id", F.posexplode(F.split("description", "\n")).alias("pos", "line")).where("line like 'required%'")
    return lines.select("request_id", F.col("pos").cast("long").alias("pos"), tx.loose_boolean(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def document_name(spark, sf_dir):
    """The metadata's name; where that is empty or absent, the file's address."""
    d = tables.star(spark, sf_dir, "documents").select("doc_id")
    metadata = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"name":"n'), "doc_id", F.lit('"}'))).when(F.col("doc_id") % 3 == 1, F.lit('{"name":""}')).otherwise("not json")
    return d.select("doc_id", index.document_name(metadata, F.concat(F.lit("file-"), "doc_id")).alias("name"))


def node_coalesce(spark, sf_dir):
    """Names of customers that are first unknown, then known for some, then unknown again: the last known name stays."""
    blank = tables.nodes(spark, sf_dir).where("label = 'Entity'").withColumns({"name": F.lit(None).cast("string"), "seq": F.lit(0)})
    known = tables.nodes(spark, sf_dir).where("label = 'Entity' and cast(id as long) % 2 = 0").withColumn("seq", F.lit(1))
    return graph.upsert_nodes(blank, known.unionByName(blank.withColumn("seq", F.lit(2)))).select("id", "name")


def filter_catalog_domain(spark, sf_dir):
    items = catalog.global_items(tables.catalog_global(spark, sf_dir))
    asked = tables.template_requests(spark, sf_dir).select("request_id", catalog.mapped_domain(catalog.domain_type(F.col("domain_type"))).alias("domain"))
    return asked.join(catalog.domain_totals(items), "domain").groupBy("request_id").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


def filter_domain_default(spark, sf_dir):
    docs = catalog.one_doc(tables.catalog_domain(spark, sf_dir).where("scope = 'domain_type_default'"), "domainType")
    asked = tables.template_requests(spark, sf_dir).select("request_id", catalog.domain_type(F.col("domain_type")).alias("domainType"))
    return asked.join(docs, "domainType").select("request_id", "_id")


def filter_domain_id(spark, sf_dir):
    docs = catalog.one_doc(tables.catalog_domain(spark, sf_dir).withColumnRenamed("domainId", "domain_id"), "domain_id")
    return tables.template_requests(spark, sf_dir).join(docs, "domain_id").select("request_id", "_id")


def sort_catalog_priority(spark, sf_dir):
    asked = tables.template_requests(spark, sf_dir)
    rows = catalog.by_priority(catalog.layers(asked, tables.catalog_global(spark, sf_dir), tables.catalog_domain(spark, sf_dir)))
    return rows.select("domain_type", "domain_id", F.col("pos").cast("long").alias("pos"), "attribute_key", "priority")


def names(spark, sf_dir):
    p, x = tables.star(spark, sf_dir, "part"), F.concat_ws(" - ", "p_name", "p_type")
    return p.select("p_partkey", tx.upper_snake(x).alias("upper_snake"), tx.attribute_name(x).alias("attribute_name"), tx.template_id(x).alias("template_id"))


def slice_json_object(spark, sf_dir):
    good = completions.parse_completion(tables.completions(spark, sf_dir)).where("error_code is null")
    return good.select("request_id", completions.json_slice(F.col("content")).alias("slice"), completions.scalar(completions.lenient_json(F.col("content")), "$.description").alias("description"))


def filter_placeholder_enum(spark, sf_dir):
    good = completions.parse_completion(tables.completions(spark, sf_dir)).where("error_code is null")
    raw = good.select("request_id", completions.lenient_json(F.col("content")).alias("raw"))
    return templates.json_attributes(raw).where("type = 'enum'").select("request_id", "name", F.array_join("enum_values", "|").alias("enum_values"))


def build_description_prompt(spark, sf_dir):
    short = templates.route(templates.reject_blank_template(tables.template_requests(spark, sf_dir))[0])[1]
    return prompts.with_description_prompt(short).select("request_id", F.col("messages")[1]["content"].alias("content"))


_SNAKE = "trim(regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g'), '_')"
_NAME = "p_name || ' - ' || p_type"
QUERIES = {
    "normalize_whitespace": (normalize_whitespace, r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS norm_sha256 FROM documents"),
    "py_strip": (py_strip, r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n_chars FROM documents"),
    "tokenize_lower": (tokenize_lower, r"SELECT doc_id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS tokens_sha256 FROM documents"),
    "hash_bucket": (hash_bucket, "SELECT DISTINCT token, (('0x' || substr(md5(token), 1, 8))::BIGINT % 384)::INT AS bucket FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part) WHERE token <> ''"),
    "vector_norm": (vector_norm, "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS own_cosine FROM embeddings"),
    "embedding_dimension": (embedding_dimension, "SELECT label, max(len(embedding)) AS dimension FROM embeddings GROUP BY label"),
    "chunks_indexed": (chunks_indexed, sql.query(sql.CHUNKS, "SELECT document_id, count(*) AS chunks_indexed FROM chunked GROUP BY ALL")),
    "upsert_entity": (upsert_entity, "SELECT 'Entity' AS label, c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer"),
    "src_relationships": (src_relationships, sql.query(sql.NODES, sql.RELATIONSHIPS, """lines AS (
  SELECT *, to_id::BIGINT AS k, '{"from_id":' || CASE WHEN to_id::BIGINT % 19 = 0 THEN from_id ELSE '"' || from_id || '"' END || ',"from_type":"' || from_type || '","to_id":"' || to_id || '"' || CASE WHEN to_id::BIGINT % 23 = 0 THEN '' ELSE ',"to_type":"' || to_type || '"' END || ',"relationship_type":"' || relationship_type || '"}' AS whole FROM requests
), judged AS (
  SELECT *, CASE WHEN k % 17 = 0 THEN whole[1:20] ELSE whole END AS line, CASE WHEN k % 17 = 0 THEN 'Not a JSON object.' WHEN k % 19 = 0 THEN 'Wrong type: from_id.' WHEN from_type = 'Person' THEN 'Unsupported value: from_type.' WHEN k % 23 = 0 THEN 'Missing field: to_type.' WHEN relationship_type = 'LIKES' THEN 'Unsupported value: relationship_type.' END AS reason FROM lines
)""", """SELECT CASE WHEN reason IS NULL THEN from_id END AS from_id, CASE WHEN reason IS NULL THEN from_type END AS from_type, CASE WHEN reason IS NULL THEN to_id END AS to_id, CASE WHEN reason IS NULL THEN to_type END AS to_type, CASE WHEN reason IS NULL THEN relationship_type END AS relationship_type, CASE WHEN reason IS NOT NULL THEN line END AS line, reason FROM judged""")),
    "filter_rel_type": (filter_rel_type, sql.query(sql.NODES, sql.RELATIONSHIPS, "SELECT from_type, from_id, to_id, relationship_type FROM requests WHERE relationship_type = 'LIKES' AND from_type = 'Entity'")),
    "filter_node_label": (filter_node_label, sql.query(sql.NODES, sql.RELATIONSHIPS, "SELECT from_type, from_id, to_id, relationship_type FROM requests WHERE from_type = 'Person'")),
    "collect_relationships": (collect_relationships, sql.query(sql.NODES, sql.RELATIONSHIPS, "SELECT from_id, page, string_agg(relationship_type || '>' || to_id, ',' ORDER BY relationship_type, to_id) AS relationships FROM (SELECT *, ((row_number() OVER (PARTITION BY from_id ORDER BY relationship_type, to_id) - 1) // 3)::INT AS page FROM (SELECT DISTINCT from_id, relationship_type, to_id FROM valid)) GROUP BY ALL")),
    "src_template_requests": (src_template_requests, sql.query(REQUESTS, "SELECT request_id, given_name AS template_name, description, domain_id, domain_type FROM requests")),
    "src_completions": (src_completions, sql.query(COMPLETIONS, """SELECT request_id, CASE WHEN k % 19 = 0 THEN 503 ELSE 200 END AS http_status, CASE WHEN k % 23 = 0 THEN '<html>' WHEN k % 19 = 0 THEN '{"error":"too busy"}' WHEN k % 29 = 0 THEN '{"choices":[]}' ELSE '{"choices":[{"message":{"content":' || coalesce(to_json(content)::VARCHAR, 'null') || '}}]}' END AS body,
  CASE WHEN k % 31 = 0 THEN 'timed out' END AS transport_error FROM contents""")),
    "map_domain_alias": (map_domain_alias, sql.query(REQUESTS, "SELECT request_id, catalog_name AS domain FROM requests")),
    "normalize_domain_type": (normalize_domain_type, sql.query(REQUESTS, "SELECT request_id, domain_type FROM requests")),
    "parse_bool_loose": (parse_bool_loose, sql.query(COMPLETIONS, """SELECT request_id, pos, lower(trim(regexp_replace(line, '^[^:]*:', ''))) IN ('true', 'yes', 'required') AS value
FROM (SELECT request_id, unnest(string_split(raw->>'$.description', chr(10))) AS line, generate_subscripts(string_split(raw->>'$.description', chr(10)), 1) - 1 AS pos FROM good) WHERE starts_with(line, 'required')""")),
    "document_name": (document_name, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'n' ELSE 'file-' END || doc_id AS name FROM documents"),
    "node_coalesce": (node_coalesce, "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer"),
    "filter_catalog_domain": (filter_catalog_domain, sql.query(GLOBAL, REQUESTS, "SELECT request_id, count(*) AS n, max(priority) AS most FROM requests JOIN global_items ON domain = catalog_name GROUP BY ALL")),
    "filter_domain_default": (filter_domain_default, sql.query(REQUESTS, "SELECT DISTINCT request_id, domain_type || '/domain_type_default' AS _id FROM requests JOIN part ON lower(p_brand) = domain_type WHERE p_partkey % 3 > 0 AND p_partkey % 2 = 0")),
    "filter_domain_id": (filter_domain_id, sql.query(REQUESTS, "SELECT DISTINCT request_id, brand || '/domain' AS _id FROM requests JOIN part ON 'id-' || lower(p_brand) = domain_id WHERE p_partkey % 3 > 0 AND p_partkey % 2 = 1")),
    "sort_catalog_priority": (sort_catalog_priority, sql.query(GLOBAL, REQUESTS, "SELECT domain_type, domain_id, row_number() OVER (PARTITION BY domain_type, domain_id ORDER BY priority DESC, _id) AS pos, attribute_key, priority FROM pairs JOIN global_items ON domain = catalog_name")),
    "to_upper_snake": (names, f"SELECT p_partkey, upper({_SNAKE.format(_NAME)}) AS upper_snake, lower({_SNAKE.format(_NAME)}) AS attribute_name, lower({_SNAKE.format(_NAME)}) || '_v1' AS template_id FROM part"),
    "slice_json_object": (slice_json_object, sql.query(COMPLETIONS, r"SELECT request_id, CASE WHEN shape IN (3, 6, 7) THEN content ELSE regexp_extract(content, '(?s)\{.*\}', 0) END AS slice, coalesce(trim(raw->>'$.description', ' ' || chr(10)), '') AS description FROM good")),
    "filter_placeholder_enum": (filter_placeholder_enum, sql.query(COMPLETIONS, "SELECT request_id, 'Status' AS name, 'Open|Closed' AS enum_values FROM good WHERE shape < 3")),
    "build_description_prompt": (build_description_prompt, sql.query(REQUESTS, f"SELECT request_id, {LINES} AS content FROM requests r WHERE trim(template_name) <> '' AND mode <> ''")),
}
