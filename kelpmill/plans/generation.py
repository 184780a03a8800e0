"""Queries of the catalog, completion and template jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import five_lines
from ..operators import catalog, completions, prompts, templates
from ..sources import folders, tables
from . import sql

GLOBAL = """global_items AS (
  SELECT lpad(p_partkey::VARCHAR, 12, '0') AS _id, CASE p_partkey % 30 WHEN 0 THEN 'grocery' WHEN 15 THEN 'bank' ELSE lower(p_brand) END AS domain, trim(p_name) AS attribute_key, CASE WHEN p_partkey % 2 = 0 THEN trim(p_type) ELSE trim(p_name) END AS label,
    CASE WHEN p_partkey % 5 = 0 THEN 'enum' ELSE 'string' END AS type, CASE WHEN p_partkey % 5 = 0 THEN string_split(p_type, ' ') ELSE [] END AS enum_values, p_partkey % 4 = 0 AS required_default, p_size AS priority
  FROM part WHERE p_partkey % 3 = 0
)"""
REQUESTS = """brands AS (
  SELECT s_suppkey AS k, s_suppkey::VARCHAR AS request_id, CASE WHEN s_suppkey % 17 = 0 THEN '  ' WHEN s_suppkey % 5 = 1 THEN chr(9) || s_name || ' ' ELSE s_name END AS given_name, trim(given_name, chr(9) || ' ') AS template_name, CASE WHEN s_suppkey % 2 = 0 THEN 'First line' || chr(10) || chr(10) || ' second line ' END AS description,
    'brand#' || (1 + s_suppkey % 5) || (1 + (s_suppkey // 5) % 5) AS brand, CASE WHEN s_suppkey % 6 = 0 THEN 'description_only' ELSE '' END AS mode FROM supplier
), requests AS (
  SELECT *, CASE WHEN k % 20 = 7 THEN 'groceries' WHEN k % 20 = 13 THEN 'banking' WHEN k % 4 > 0 THEN brand ELSE '' END AS domain_type, CASE domain_type WHEN 'groceries' THEN 'grocery' WHEN 'banking' THEN 'bank' ELSE domain_type END AS catalog_name, CASE WHEN k % 3 = 0 THEN 'id-' || brand END AS domain_id FROM brands
), pairs AS (
  SELECT DISTINCT domain_type, catalog_name, domain_id FROM requests
)"""
ITEMS = (
    GLOBAL
    + """, by_key AS (
  SELECT attribute_key, min_by(_id, _id) AS key_id FROM global_items GROUP BY ALL
), refs AS (
  SELECT lower(p_brand) AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'domain_type_default' ELSE 'domain' END AS scope, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN lpad((p_partkey - 1)::VARCHAR, 12, '0') END AS ref_id, p_name AS ref_key FROM part WHERE p_partkey % 3 = 1
), found AS (
  SELECT r.*, coalesce(g._id, b.key_id) AS item_id, row_number() OVER (PARTITION BY brand, scope ORDER BY k) - 1 AS pos FROM refs r LEFT JOIN global_items g ON g._id = ref_id LEFT JOIN by_key b ON b.attribute_key = ref_key
), own AS (
  SELECT brand || '/' || scope AS _id, brand, scope, 0 AS kind, pos, g.attribute_key, CASE WHEN k % 5 = 0 THEN 'Label' ELSE g.label END AS label, g.type, CASE WHEN k % 7 = 0 THEN true ELSE g.required_default END AS required_default, g.enum_values, g.priority, 'domain_ref' AS source
  FROM found JOIN global_items g ON g._id = item_id
  UNION ALL
  SELECT brand || '/' || scope, brand, scope, 1, pos, name, name, 'number', k % 4 = 0, [], p_size, 'domain_custom' FROM (
    SELECT lower(p_brand) AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'domain_type_default' ELSE 'domain' END AS scope, p_partkey AS k, p_size, row_number() OVER (PARTITION BY lower(p_brand), p_partkey % 2 ORDER BY p_partkey) - 1 AS pos, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'own ' || p_name END AS name FROM part WHERE p_partkey % 3 = 2
  ) WHERE name <> ''
)"""
)
OVERLAY = (
    ITEMS
    + ", "
    + REQUESTS
    + """, layered AS (
  SELECT domain_type, domain_id, 0 AS layer, 0 AS kind, row_number() OVER (PARTITION BY domain_type, domain_id ORDER BY priority DESC, _id) AS pos, attribute_key, type, required_default, enum_values, priority, 'global' AS source FROM pairs JOIN global_items ON domain = catalog_name
  UNION ALL SELECT domain_type, domain_id, 1, kind, pos, attribute_key, type, required_default, enum_values, priority, source FROM pairs JOIN own ON brand = domain_type AND scope = 'domain_type_default'
  UNION ALL SELECT domain_type, domain_id, 2, kind, pos, attribute_key, type, required_default, enum_values, priority, source FROM pairs JOIN own ON 'id-' || brand = domain_id AND scope = 'domain'
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY domain_type, domain_id, attribute_key ORDER BY CASE WHEN layer > 0 THEN 0 ELSE 1 END, CASE WHEN layer = 0 THEN pos ELSE -layer END, kind DESC, pos DESC) AS nth,
    min(layer * 1000000000000 + kind * 100000000000 + pos) OVER (PARTITION BY domain_type, domain_id, attribute_key) AS first_seq FROM layered
), overlaid AS (
  SELECT * FROM ordered WHERE nth = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY domain_type, domain_id ORDER BY priority DESC, first_seq) AS rank FROM overlaid QUALIFY rank <= 100
)"""
)
COMPLETIONS = r"""contents AS (
  SELECT s_suppkey AS k, s_suppkey::VARCHAR AS request_id,
    CASE WHEN s_suppkey % 37 = 0 THEN 5 WHEN s_suppkey % 18 = 0 THEN 6 WHEN s_suppkey % 30 = 6 THEN 7 ELSE s_suppkey % 5 END AS shape,
    CASE shape WHEN 5 THEN NULL WHEN 6 THEN '{"description": "", "x": 1' WHEN 7 THEN '{"description": "Cut \"off\"\n here", "attr' WHEN 4 THEN '{"description":"Text.\n- name: Shelf Life\ntype: Number, days\nrequired\n- name: Grade\nenum_values: [''High'', \"Low\"]\nrequired: ' || CASE s_suppkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN ' TRUE' ELSE 'Yes ' END || '\n- name: Shelf-life"}'
      WHEN 3 THEN 'no json at all'
      ELSE 'Here: {"templateId":' || CASE WHEN s_suppkey % 2 = 0 THEN '"lower_snake_v1"' ELSE '"own_' || s_suppkey || '"' END || ',"entity_type":' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE '"THING"' END
        || ',"description":"One\n Two \n\nThree","attributes":[{"name":"Net Weight","type":"number","required":true},{"name":"net-weight"},{"name":"field_x"},{"name":"Status","type":"enum","enumValues":["A","Open ","Closed"]},{"name":"Empty","type":"enum","enum_values":["a"]},7,{"name":"Color ' || s_suppkey || '","type":"shade","required":"TRUE"}]} done' END AS content FROM supplier
), parsed AS (
  SELECT *, CASE WHEN k % 31 = 0 THEN 502 WHEN k % 23 = 0 THEN 502 WHEN k % 19 = 0 THEN 503 WHEN k % 29 = 0 THEN 502 END AS error_code,
    CASE WHEN k % 31 = 0 THEN 'Model request failed: timed out' WHEN k % 23 = 0 THEN 'Model response was not JSON.' WHEN k % 19 = 0 THEN 'too busy' WHEN k % 29 = 0 THEN 'Model response had no content.' END AS error_detail FROM contents
), good AS (
  SELECT k, shape, request_id, content, CASE WHEN shape = 3 OR shape > 4 THEN '{}' ELSE regexp_extract(content, '(?s)\{.*\}', 0) END::JSON AS raw FROM parsed WHERE error_code IS NULL
)"""
ATTRIBUTES = (
    COMPLETIONS
    + r""", items AS (
  SELECT request_id, unnest(from_json(json_extract(raw, '$.attributes'), '["json"]')) AS v, generate_subscripts(from_json(json_extract(raw, '$.attributes'), '["json"]'), 1) - 1 AS pos FROM good WHERE json_extract(raw, '$.attributes') IS NOT NULL
), named AS (
  SELECT request_id, pos, trim(coalesce(v->>'$.name', '')) AS name, lower(coalesce(v->>'$.type', '')) AS given, lower(coalesce(v->>'$.required', '')) = 'true' AS required,
    list_filter(list_transform(coalesce(from_json(coalesce(json_extract(v, '$.enum_values'), json_extract(v, '$.enumValues')), '["varchar"]'), []), lambda x: trim(x)), lambda x: lower(x) NOT IN ('', 'a', 'b', 'value', 'test')) AS vals
  FROM items WHERE json_type(v) = 'OBJECT'
), json_attributes AS (
  SELECT request_id, pos, name, CASE WHEN given IN ('string', 'number', 'boolean', 'date', 'enum', 'array', 'json') THEN given ELSE 'string' END AS type, required, CASE WHEN given = 'enum' THEN vals ELSE [] END AS enum_values
  FROM named WHERE lower(name) NOT IN ('', 'field_name', 'field', 'attribute', 'value', 'test') AND NOT starts_with(lower(name), 'field_') AND (given <> 'enum' OR len(vals) > 0)
), lines AS (
  SELECT request_id, unnest(string_split(raw->>'$.description', chr(10))) AS raw_line, generate_subscripts(string_split(raw->>'$.description', chr(10)), 1) - 1 AS pos FROM good
), grouped AS (
  SELECT request_id, trim(raw_line) AS line, pos, sum(starts_with(trim(raw_line), '- name:')::INT) OVER (PARTITION BY request_id ORDER BY pos) AS nth FROM lines WHERE trim(raw_line) <> ''
), line_attributes AS (
  SELECT request_id, min(pos) AS pos, trim(regexp_replace(lower(trim(max(line) FILTER (starts_with(line, '- name:'))[8:])), '[^a-z0-9]+', '_', 'g'), '_') AS name,
    coalesce(max_by(CASE WHEN trim(split_part(lower(trim(line[6:])), ',', 1)) IN ('string', 'number', 'boolean', 'date', 'enum', 'array', 'json') THEN trim(split_part(lower(trim(line[6:])), ',', 1)) ELSE 'string' END, pos) FILTER (starts_with(line, 'type:')), 'string') AS type,
    coalesce(max_by(lower(trim(regexp_replace(line, '^[^:]*:', ''))) IN ('true', 'yes', 'required'), pos) FILTER (starts_with(line, 'required')), false) AS required,
    coalesce(max_by(list_transform(regexp_extract_all(line, '''[^'']+''|"[^"]+"'), lambda x: x[2:-2]), pos) FILTER (starts_with(line, 'enum_values:')), []) AS enum_values
  FROM grouped WHERE nth > 0 GROUP BY request_id, nth
), all_attributes AS (
  SELECT * FROM json_attributes UNION ALL SELECT * FROM line_attributes WHERE request_id NOT IN (SELECT request_id FROM json_attributes)
), firsts AS (
  SELECT request_id, pos, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_') AS name, CASE WHEN type = 'string' AND len(enum_values) > 0 THEN 'enum' ELSE type END AS type, required, enum_values FROM all_attributes
  QUALIFY row_number() OVER (PARTITION BY request_id, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_') ORDER BY pos) = 1
)"""
)
MERGED = (
    OVERLAY
    + ", "
    + ATTRIBUTES
    + """, wanted AS (
  SELECT r.*, g.raw, g.content, g.shape FROM requests r JOIN good g USING (request_id) WHERE trim(template_name) <> '' AND mode = ''
), from_catalog AS (
  SELECT request_id, rank - 1 AS pos, trim(regexp_replace(lower(attribute_key), '[^a-z0-9]+', '_', 'g'), '_') AS name, type, required_default AS required, enum_values
  FROM wanted w JOIN ranked c ON c.domain_type = w.domain_type AND c.domain_id IS NOT DISTINCT FROM w.domain_id
  QUALIFY row_number() OVER (PARTITION BY request_id, trim(regexp_replace(lower(attribute_key), '[^a-z0-9]+', '_', 'g'), '_') ORDER BY rank) = 1
), merged AS (
  SELECT *, 0 AS part FROM from_catalog UNION ALL SELECT f.*, 1 FROM firsts f WHERE request_id IN (SELECT request_id FROM wanted) AND NOT EXISTS (FROM from_catalog c WHERE c.request_id = f.request_id AND c.name = f.name)
)"""
)

def _listed():
    return F.array_join("enum_values", "|").alias("enum_values")



def _catalog(spark, sf_dir):
    return tables.catalog_global(spark, sf_dir), tables.catalog_domain(spark, sf_dir)


def src_catalog_global(spark, sf_dir):
    rows = catalog.global_items(tables.catalog_global(spark, sf_dir))
    return rows.select("_id", "domain", "attribute_key", "label", "type", _listed(), "required_default", "priority")


def src_catalog_domain(spark, sf_dir):
    text = lambda x, *names: F.concat_ws("/", *[F.coalesce(x[n].cast("string"), F.lit("")) for n in names])
    refs = F.array_join(F.transform("attributeRefs", lambda r: text(r, "attributeId", "attributeKey", "label", "type", "required")), ",").alias("refs")
    customs = F.array_join(F.transform("customAttributes", lambda c: text(c, "name", "label", "type", "required", "priority")), ",").alias("customs")
    return tables.catalog_domain(spark, sf_dir).select("_id", "scope", "domainType", "domainId", "description", refs, customs)


def resolve_catalog_ref(spark, sf_dir):
    items, docs = _catalog(spark, sf_dir)
    rows = catalog.resolve_refs(docs, catalog.global_items(items))
    return rows.select("_id", F.col("pos").cast("long").alias("pos"), "attribute_key", "label", "type", "required_default", "priority")


def filter_nonempty_key(spark, sf_dir):
    rows = catalog.custom_items(tables.catalog_domain(spark, sf_dir))
    return rows.select("_id", "attribute_key", "type", "required_default", "priority")


def _requests(spark, sf_dir):
    return templates.reject_blank_template(tables.template_requests(spark, sf_dir))[0]


def _layers(spark, sf_dir):
    return catalog.layers(tables.template_requests(spark, sf_dir), *_catalog(spark, sf_dir))


def catalog_layer_join(spark, sf_dir):
    return _layers(spark, sf_dir).groupBy("domain_type", "domain_id", "layer", "kind").agg(F.count("*").alias("n"), F.min("attribute_key").alias("least"))


def overlay_catalog(spark, sf_dir):
    return catalog.overlay(_layers(spark, sf_dir)).select("domain_type", "domain_id", "attribute_key", "type", "required_default", "source", "priority")


def topn_candidates(spark, sf_dir):
    return catalog.candidates(catalog.overlay(_layers(spark, sf_dir))).select("domain_type", "domain_id", "rank", "attribute_key")


def _with_candidates(spark, sf_dir):
    found = catalog.candidates(catalog.overlay(_layers(spark, sf_dir)))
    return catalog.with_candidates(templates.route(_requests(spark, sf_dir))[0], found)


def build_template_prompt(spark, sf_dir):
    rows = prompts.with_template_prompt(_with_candidates(spark, sf_dir))
    return rows.select("request_id", F.size("candidates").cast("long").alias("n_candidates"), F.sha2(F.col("messages")[1]["content"], 256).alias("user_sha256"))


def route_response_mode(spark, sf_dir):
    full, short = templates.route(_requests(spark, sf_dir))
    return full.select("request_id", F.lit("template").alias("route")).unionByName(short.select("request_id", F.lit("description").alias("route")))


def reject_blank_template(spark, sf_dir):
    return templates.reject_blank_template(tables.template_requests(spark, sf_dir))[1].select("request_id", "reason")


def parse_completion(spark, sf_dir):
    return completions.parse_completion(tables.completions(spark, sf_dir)).select("request_id", "content", F.col("error_code").cast("string").alias("error_code"), "error_detail")


def _raw(spark, sf_dir):
    rows = completions.parse_completion(tables.completions(spark, sf_dir)).where("error_code is null")
    return rows.select("request_id", completions.lenient_json(F.col("content")).alias("raw"))


def _shown(rows):
    return rows.select("request_id", F.col("pos").cast("long").alias("pos"), "name", "type", "required", _listed())


def filter_placeholder_attr(spark, sf_dir):
    return _shown(templates.json_attributes(_raw(spark, sf_dir)))


def segment_attr_lines(spark, sf_dir):
    return _shown(templates.line_attributes(_raw(spark, sf_dir)))


def dedupe_first_by_name(spark, sf_dir):
    return _shown(templates.response_attributes(_raw(spark, sf_dir)))


def merged(spark, sf_dir):
    joined = folders.written_once(_with_candidates(spark, sf_dir).select("request_id", "candidates").join(_raw(spark, sf_dir), "request_id"))
    return templates.merge(templates.catalog_attributes(joined), templates.response_attributes(joined))


def merge_template_attrs(spark, sf_dir):
    rows = merged(spark, sf_dir)
    return rows.select("request_id", "part", F.col("pos").cast("long").alias("pos"), "name", "type", "required", _listed())


def template_result(spark, sf_dir):
    contents = completions.parse_completion(tables.completions(spark, sf_dir)).where("error_code is null")
    rows = templates.template_results(_with_candidates(spark, sf_dir), contents)
    shown = lambda c, values: F.array_join(F.transform(c, lambda a: F.concat_ws(":", a["name"], a["type"], a["required"].cast("string"), F.array_join(a[values], "|"))), ",").alias(c)
    return rows.select("request_id", "template_id", "template_name", "description", "entity_type", "version", "templateId", "templateName", "entityType", shown("attributes", "enum_values"), shown("attributesCamelCase", "enumValues"), shown("attributes_compat", "enumValues"))


def resolve_template_id(spark, sf_dir):
    return template_result(spark, sf_dir).select("request_id", "template_id")


def resolve_entity_type(spark, sf_dir):
    return template_result(spark, sf_dir).select("request_id", "entity_type")


def camel_case_twin(spark, sf_dir):
    return template_result(spark, sf_dir).select("request_id", "attributesCamelCase")


def extract_description(spark, sf_dir):
    good = completions.parse_completion(tables.completions(spark, sf_dir)).where("error_code is null")
    return good.select("request_id", completions.described(F.col("content")).alias("description"))


def key_alias_lookup(spark, sf_dir):
    """The first key that is there, even if it is null, of two: a null entity_type stops the chain before templateId."""
    kind = completions.first_present(F.col("raw"), "$.entity_type", "$.templateId")
    return _raw(spark, sf_dir).select("request_id", kind.alias("kind"), completions.first_present(F.col("raw"), "$.template_id", "$.templateId").alias("id"))


def apply_ref_overrides(spark, sf_dir):
    items, docs = _catalog(spark, sf_dir)
    rows = catalog.resolve_refs(docs, catalog.global_items(items))
    return rows.select("_id", F.col("pos").cast("long").alias("pos"), "label", "type", "required_default", _listed(), "source")


def format_candidate_block(spark, sf_dir):
    return _with_candidates(spark, sf_dir).select("request_id", prompts.candidate_block(F.col("candidates")).alias("block"))


def description_only_result(spark, sf_dir):
    contents = completions.parse_completion(tables.completions(spark, sf_dir)).where("error_code is null")
    rows = completions.description_results(templates.route(_requests(spark, sf_dir))[1], contents)
    sizes = [F.size(c).alias(f"n_{c}") for c in ("attributes", "attributesCamelCase", "attributes_compat")]
    return rows.select("request_id", "template_id", "template_name", "description", "entity_type", "version", "templateId", "templateName", "entityType", *sizes, completions.scalar(F.col("raw"), "$.description").alias("raw_description"))


def five_line_description(spark, sf_dir):
    d = tables.star(spark, sf_dir, "documents")
    return d.select("doc_id", five_lines(F.col("text"), F.col("source")).alias("description"))


_FIVE = """array_to_string(CASE WHEN len(l) = 0 THEN ['Reusable template for ' || {name} || '.', 'Captures identity, classification, and core descriptive fields.', 'Includes inventory, storage, and lifecycle information.', 'Supports optional nutrition and flexible tagging metadata.', 'Designed for AI-assisted suggestion and structured data entry.']
  ELSE (l || ['Additional template guidance.', 'Additional template guidance.', 'Additional template guidance.', 'Additional template guidance.', 'Additional template guidance.'])[1:5] END, chr(10))"""
_LINES = "list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l"
_SQL_LISTED = "array_to_string(enum_values, '|') AS enum_values"
_SHOWN = f"SELECT request_id, pos, name, type, required, {_SQL_LISTED} FROM "

#: The request's lines in a prompt.
LINES = "'Name: ' || template_name || chr(10) || 'Domain id: ' || coalesce(r.domain_id, '') || chr(10) || 'Domain type: ' || CASE WHEN r.domain_type = '' THEN '' ELSE ' ' || upper(r.domain_type) END || chr(10) || 'Guidance: ' || coalesce(r.description, '') || chr(10)"

_RESULT = f"""SELECT request_id, CASE WHEN k % 2 = 0 OR shape >= 3 THEN trim(regexp_replace(lower(template_name), '[^a-z0-9]+', '_', 'g'), '_') || '_v1' ELSE 'own_' || k END AS template_id, template_name, {_FIVE.format(name="template_name")} AS description,
  CASE WHEN k % 3 = 0 OR shape >= 3 THEN trim(regexp_replace(upper(CASE WHEN domain_type = '' THEN template_name ELSE domain_type END), '[^A-Z0-9]+', '_', 'g'), '_') ELSE 'THING' END AS entity_type, 1 AS version,
  coalesce((SELECT string_agg(concat_ws(':', name, type, required::VARCHAR, array_to_string(enum_values, '|')), ',' ORDER BY part, pos) FROM merged m WHERE m.request_id = w.request_id), '') AS attributes, template_id AS "templateId", template_name AS "templateName", entity_type AS "entityType"
FROM (SELECT *, {_LINES.format(text="coalesce(nullif(trim(raw->>'$.description'), ''), description, '')")} FROM wanted) w"""
QUERIES = {
    "src_catalog_global": (src_catalog_global, sql.query(GLOBAL, f"SELECT _id, domain, attribute_key, label, type, {_SQL_LISTED}, required_default, priority FROM global_items")),
    "src_catalog_domain": (src_catalog_domain, """SELECT lower(p_brand) || '/' || scope AS _id, scope, lower(p_brand) AS domainType, CASE WHEN scope = 'domain' THEN 'id-' || lower(p_brand) END AS domainId, NULL::VARCHAR AS description,
  coalesce(string_agg(CASE WHEN p_partkey % 2 = 0 THEN lpad((p_partkey - 1)::VARCHAR, 12, '0') ELSE '' END || '/' || p_name || '/' || CASE WHEN p_partkey % 5 = 0 THEN 'Label' ELSE '' END || '//' || CASE WHEN p_partkey % 7 = 0 THEN 'true' ELSE '' END, ',' ORDER BY p_partkey) FILTER (p_partkey % 3 = 1), '') AS refs,
  coalesce(string_agg(CASE WHEN p_partkey % 10 = 0 THEN '  ' ELSE 'own ' || p_name END || '//Number/' || (p_partkey % 4 = 0) || '/' || p_size, ',' ORDER BY p_partkey) FILTER (p_partkey % 3 = 2), '') AS customs
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'domain_type_default' ELSE 'domain' END AS scope FROM part WHERE p_partkey % 3 > 0) GROUP BY ALL"""),
    "resolve_catalog_ref": (resolve_catalog_ref, sql.query(ITEMS, "SELECT _id, pos, attribute_key, label, type, required_default, priority FROM own WHERE kind = 0")),
    "filter_nonempty_key": (filter_nonempty_key, sql.query(ITEMS, "SELECT _id, attribute_key, type, required_default, priority FROM own WHERE kind = 1")),
    "catalog_layer_join": (catalog_layer_join, sql.query(OVERLAY, "SELECT domain_type, domain_id, layer, kind, count(*) AS n, min(attribute_key) AS least FROM layered GROUP BY ALL")),
    "overlay_catalog": (overlay_catalog, sql.query(OVERLAY, "SELECT domain_type, domain_id, attribute_key, type, required_default, source, priority FROM overlaid")),
    "topn_candidates": (topn_candidates, sql.query(OVERLAY, "SELECT domain_type, domain_id, rank, attribute_key FROM ranked")),
    "build_template_prompt": (build_template_prompt, sql.query(OVERLAY, f"""SELECT request_id, count(attribute_key) AS n_candidates, sha256({LINES} || 'Candidates:' || chr(10) || coalesce(string_agg('- ' || attribute_key || ' (' || type || ', required_default=' || required_default || ', enum_values=[' || array_to_string(enum_values, ', ') || '], tags=[])', chr(10) ORDER BY rank), 'No catalog attribute candidates available.')) AS user_sha256
FROM requests r LEFT JOIN ranked c ON c.domain_type = r.domain_type AND c.domain_id IS NOT DISTINCT FROM r.domain_id WHERE trim(template_name) <> '' AND mode = '' GROUP BY request_id, template_name, r.domain_id, r.domain_type, r.description""")),
    "route_response_mode": (route_response_mode, sql.query(REQUESTS, "SELECT request_id, CASE WHEN mode = '' THEN 'template' ELSE 'description' END AS route FROM requests WHERE trim(template_name) <> ''")),
    "reject_blank_template": (reject_blank_template, sql.query(REQUESTS, "SELECT request_id, 'template_name is required.' AS reason FROM requests WHERE trim(template_name) = ''")),
    "parse_completion": (parse_completion, sql.query(COMPLETIONS, "SELECT request_id, CASE WHEN error_code IS NULL THEN content END AS content, error_code::VARCHAR AS error_code, error_detail FROM parsed")),
    "filter_placeholder_attr": (filter_placeholder_attr, sql.query(ATTRIBUTES, _SHOWN + "json_attributes")),
    "segment_attr_lines": (segment_attr_lines, sql.query(ATTRIBUTES, _SHOWN + "line_attributes")),
    "dedupe_first_by_name": (dedupe_first_by_name, sql.query(ATTRIBUTES, _SHOWN + "firsts")),
    "merge_template_attrs": (merge_template_attrs, sql.query(MERGED, f"SELECT request_id, part, pos, name, type, required, {_SQL_LISTED} FROM merged")),
    "template_result": (template_result, sql.query(MERGED, f"SELECT *, attributes AS \"attributesCamelCase\", attributes AS attributes_compat FROM ({_RESULT})")),
    "resolve_template_id": (resolve_template_id, sql.query(MERGED, f"SELECT request_id, template_id FROM ({_RESULT})")),
    "resolve_entity_type": (resolve_entity_type, sql.query(MERGED, f"SELECT request_id, entity_type FROM ({_RESULT})")),
    "camel_case_twin": (camel_case_twin, sql.query(MERGED, f"SELECT request_id, attributes AS \"attributesCamelCase\" FROM ({_RESULT})")),
    "extract_description": (extract_description, sql.query(COMPLETIONS, "SELECT request_id, CASE WHEN shape = 5 OR shape = 6 THEN '' WHEN shape = 7 THEN 'Cut \"off\"' || chr(10) || ' here' WHEN shape = 3 THEN content ELSE trim(raw->>'$.description', ' ' || chr(10)) END AS description FROM good")),
    "key_alias_lookup": (key_alias_lookup, sql.query(COMPLETIONS, "SELECT request_id, CASE WHEN shape < 3 AND k % 3 > 0 THEN 'THING' ELSE '' END AS kind, CASE WHEN shape >= 3 THEN '' WHEN k % 2 = 0 THEN 'lower_snake_v1' ELSE 'own_' || k END AS id FROM good")),
    "apply_ref_overrides": (apply_ref_overrides, sql.query(ITEMS, f"SELECT _id, pos, label, type, required_default, {_SQL_LISTED}, source FROM own WHERE kind = 0")),
    "format_candidate_block": (format_candidate_block, sql.query(OVERLAY, """SELECT request_id, coalesce(string_agg('- ' || attribute_key || ' (' || type || ', required_default=' || required_default || ', enum_values=[' || array_to_string(enum_values, ', ') || '], tags=[])', chr(10) ORDER BY rank), 'No catalog attribute candidates available.') AS block
FROM requests r LEFT JOIN ranked c ON c.domain_type = r.domain_type AND c.domain_id IS NOT DISTINCT FROM r.domain_id WHERE trim(template_name) <> '' AND mode = '' GROUP BY request_id""")),
    "description_only_result": (description_only_result, sql.query(REQUESTS, COMPLETIONS, """SELECT request_id, '' AS template_id, template_name, CASE WHEN shape = 5 OR shape = 6 THEN CASE WHEN domain_type <> '' THEN 'This domain supports ' || domain_type || ' business operations. ' ELSE '' END || 'It organizes the main business data, workflows, users, and records needed to run the business consistently. It is intended to provide a clear foundation for structured data entry, operations, and reporting.'
  WHEN shape = 7 THEN 'Cut "off" here' WHEN shape = 3 THEN content ELSE trim(regexp_replace(raw->>'$.description', '\\s+', ' ', 'g')) END AS description,
  trim(regexp_replace(upper(CASE WHEN domain_type = '' THEN template_name ELSE domain_type END), '[^A-Z0-9]+', '_', 'g'), '_') AS entity_type, 1 AS version, template_id AS "templateId", template_name AS "templateName", entity_type AS "entityType", 0 AS n_attributes, 0 AS "n_attributesCamelCase", 0 AS n_attributes_compat, coalesce(trim(raw->>'$.description', ' ' || chr(10)), '') AS raw_description
FROM (SELECT r.*, g.content, g.raw, g.shape FROM requests r JOIN good g USING (request_id)) WHERE trim(template_name) <> '' AND mode <> ''""")),
    "five_line_description": (five_line_description, f"SELECT doc_id, {_FIVE.format(name='source')} AS description FROM (SELECT *, {_LINES.format(text='text')} FROM documents)"),
}
