"""SQL shared by the oracles: the derived input tables and the steps that several queries build on."""

DOCUMENTS = """documents_in AS (
  SELECT doc_id::VARCHAR AS document_id, source AS entity_id, NULL::VARCHAR AS file_url, text, '{"name":"' || lang || '-' || doc_id || '"}' AS metadata FROM documents
)"""

QUESTIONS = """questions AS (
  SELECT item_id::VARCHAR AS question_id, CASE WHEN item_id % 4 = 1 THEN '  ' || text || ' ' || chr(10) ELSE text END AS question, 'src' || (item_id % 20) AS entity_id, CASE WHEN item_id % 6 < 5 THEN 1 + item_id % 5 ELSE 5 END AS top_k FROM benchmark
)"""

CHUNKS = (
    DOCUMENTS
    + r""", normal AS (
  SELECT document_id, entity_id, metadata, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM documents_in
), starts AS (
  SELECT *, length(norm) AS len, unnest(CASE WHEN length(norm) <= 800 THEN [0] ELSE range(0, ((length(norm) - 800 + 679) // 680 + 1)::BIGINT) END) AS i FROM normal WHERE norm <> ''
), spans AS (
  SELECT *, substr(norm, i * 680 + 1, 800) AS w FROM starts WHERE i * 680 < len
), cuts AS (
  SELECT document_id, entity_id, metadata, i, trim(CASE WHEN i * 680 + 800 < len AND contains(w, ' ') AND length(w) - instr(reverse(w), ' ') > length(w) // 2 THEN substr(w, 1, length(w) - instr(reverse(w), ' ')) ELSE w END) AS chunk FROM spans
), chunked AS (
  SELECT document_id, entity_id, metadata, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS chunk_index, chunk FROM cuts WHERE chunk <> ''
), hashed AS (
  SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(coalesce(document_id, '') || ':' || coalesce(entity_id, '') || ':' || chunk_index || ':' || chunk)) AS h FROM chunked
), points AS (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', instr('0123456789abcdef', substr(h, 17, 1))::INT - 4 * ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) // 4)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
    document_id, entity_id, chunk_index, chunk AS text, metadata FROM hashed
)"""
)


def weights(name: str, source: str, id_col: str, text_col: str) -> str:
    return f"""{name}_tokens AS (
  SELECT {id_col}, unnest(string_split_regex(lower(trim(regexp_replace({text_col}, '\\s+', ' ', 'g'))), ' ')) AS token FROM {source}
), {name}_counts AS (
  SELECT {id_col}, (('0x' || substr(md5(token), 1, 8))::BIGINT % 384)::INT AS bucket, count(*)::DOUBLE AS n FROM {name}_tokens WHERE token <> '' GROUP BY ALL
), {name} AS (
  SELECT {id_col}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {id_col})) AS weight FROM {name}_counts
)"""


HITS = (
    CHUNKS
    + ", "
    + QUESTIONS
    + ", "
    + weights("cw", "points", "id", "text")
    + ", "
    + weights("qw", "questions", "question_id", "question")
    + """, pairs AS (
  SELECT question_id, id, top_k, entity_id FROM questions JOIN points USING (entity_id)
), dots AS (
  SELECT p.question_id, p.id, sum(c.weight * q.weight) AS dot FROM pairs p JOIN cw c USING (id) JOIN qw q ON q.question_id = p.question_id AND q.bucket = c.bucket GROUP BY ALL
), scored AS (
  SELECT p.*, round(coalesce(dot, 0), 6) AS score FROM pairs p LEFT JOIN dots d ON d.question_id = p.question_id AND d.id = p.id
), hits AS (
  SELECT question_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= top_k
)"""
)

NODES = """nodes AS (
  SELECT 'Entity' AS label, c_custkey::VARCHAR AS id, c_name AS name FROM customer
  UNION ALL SELECT 'Document', o_orderkey::VARCHAR, NULL FROM orders
)"""

RELATIONSHIPS = """asked_once AS (
  SELECT o_custkey::VARCHAR AS from_id, CASE WHEN o_orderkey % 13 = 0 THEN 'Person' ELSE 'Entity' END AS from_type,
    (CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END)::VARCHAR AS to_id, 'Document' AS to_type,
    CASE WHEN o_orderkey % 11 = 0 THEN 'LIKES' WHEN o_orderkey % 3 = 0 THEN 'OWNS' ELSE 'HAS_DOCUMENT' END AS relationship_type FROM orders
), requests AS (
  SELECT * FROM asked_once UNION ALL SELECT * FROM asked_once WHERE from_id::BIGINT % 5 = 0
), valid AS (
  SELECT * FROM requests WHERE from_type IN ('Entity', 'Document') AND to_type IN ('Entity', 'Document') AND relationship_type IN ('HAS_DOCUMENT', 'BELONGS_TO', 'OWNS', 'USED_IN_EVENT')
), matched AS (
  SELECT * FROM valid v WHERE EXISTS (FROM nodes n WHERE n.label = v.from_type AND n.id = v.from_id) AND EXISTS (FROM nodes n WHERE n.label = v.to_type AND n.id = v.to_id)
), edges AS (
  SELECT DISTINCT from_type, from_id, relationship_type AS relationship, to_type, to_id FROM matched
)"""


def query(*parts: str) -> str:
    """WITH all parts but the last, then that."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
