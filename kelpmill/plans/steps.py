"""Queries of single steps of the catalog and template jobs, over odd values made from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, completions, graph, templates
from ..sources import tables
from . import generation, sql


def _part(spark, sf_dir):
    """part, with its number as k."""
    return tables.star(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))


def _by(n, *cases):
    """The case at k % n; each is a column, a text or None."""
    column = lambda c: F.lit(c) if c is None or isinstance(c, (str, bool)) else c
    out = F.lit(None)
    for i, case in enumerate(cases):
        out = F.when(F.col("k") % n == i, column(case)).otherwise(out)
    return out


def _variant(*cases):
    return F.parse_json(_by(len(cases), *cases))


def filter_null_relationship(spark, sf_dir):
    """Every customer with its edges; those without any have an empty list, not one null."""
    nodes = tables.nodes(spark, sf_dir).where("label = 'Entity'")
    o = tables.star(spark, sf_dir, "orders")
    edges = o.where("o_custkey % 3 > 0").select(F.lit("Entity").alias("from_type"), F.col("o_custkey").cast("string").alias("from_id"), F.lit("HAS_DOCUMENT").alias("relationship"), F.lit("Document").alias("to_type"), F.col("o_orderkey").cast("string").alias("to_id"))
    out = graph.expand_one_hop(nodes.select(F.col("id").alias("entity_id")), nodes, edges)
    return out.groupBy("entity_id").agg(F.sum(F.size("relationships")).alias("n"), F.max(F.exists("relationships", lambda r: r.isNull())).alias("has_null"))


def normalize_global_attribute(spark, sf_dir):
    k = F.col("k")
    none = F.lit(None).cast("array<string>")
    odd = _part(spark, sf_dir).select(k.cast("string").alias("_id"), F.lit("d").alias("domain"), F.concat(F.lit(" "), "p_name", F.lit("\t")).alias("attribute_key"), _by(4, None, "", "  ", F.concat(F.col("p_type"), F.lit(" "))).alias("label"), _by(3, None, "", " Enum ").alias("type"), F.when(k % 2 == 0, F.array("p_brand")).otherwise(none).alias("enum_values"), F.when(k % 5 > 0, k % 5 == 1).alias("required_default"), none.alias("tags"), F.when(k % 7 > 0, F.col("p_size")).cast("int").alias("priority"))
    return catalog.global_items(odd).select("_id", "attribute_key", "label", "type", F.array_join("enum_values", "|").alias("enum_values"), "required_default", F.size("tags").cast("long").alias("n_tags"), "priority", "source")


def normalize_custom_attribute(spark, sf_dir):
    k = F.col("k")
    none = F.lit(None).cast("array<string>")
    own = F.struct(_by(4, None, "  ", F.concat(F.lit("\n"), "p_name"), F.col("p_type")).alias("name"), _by(3, None, "  ", " L ").alias("label"), _by(3, None, "", " Number ").alias("type"), F.when(k % 5 > 0, k % 5 == 1).alias("required"), F.when(k % 2 == 0, F.array("p_brand")).otherwise(none).alias("enumValues"), F.when(k % 7 > 0, F.col("p_size")).cast("int").alias("priority"), F.when(k % 11 == 0, F.lit('{"max":1}')).alias("validationRules"))
    rows = _part(spark, sf_dir).select(k.cast("string").alias("_id"), F.array(F.when(k % 13 > 0, own)).alias("customAttributes"))
    return catalog.custom_items(rows).select("_id", "attribute_key", "label", "type", F.array_join("enum_values", "|").alias("enum_values"), "required_default", "priority", "source", "validation_rules")


def _content():
    odd = F.concat(F.lit('{"a":-Infinity,"b":"NaN, '), "p_name", F.lit('","c":[NaN,1]} '))
    return _by(8, F.concat(F.lit('{"a":" '), "p_name", F.lit(' "}')), 'so {"a":null} end', "not json", "[1,2]", F.concat(F.lit('{"a":'), "p_size", F.lit("}")), "", odd, F.concat(F.lit('{"a":NaNa,"b":'), "p_size", F.lit("}")))


def parse_json_lenient(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", F.to_json(completions.lenient_json(_content())).alias("raw"), completions.parse_status(_content()).alias("parse_status"))


def normalize_scalar(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", completions.scalar(completions.lenient_json(_content()), "$.a").alias("value"))


def to_template_id(spark, sf_dir):
    name = _by(3, F.concat("p_name", F.lit(" V1")), " -- ", F.concat(F.lit("*"), "p_name", F.lit("!")))
    return _part(spark, sf_dir).select("p_partkey", tx.template_id(name).alias("template_id"))


def sanitize_attr_name(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", tx.attribute_name(F.concat(F.lit("--"), "p_type", F.lit("!!"), "p_name", F.lit("."))).alias("name"))


def normalize_enum_values(spark, sf_dir):
    v = _variant(F.concat(F.lit('{"values":[" '), "p_type", F.lit('","",null,3]}')), '{"enum_values":"x"}', '{"enum_values":null,"values":["a"]}', '{"enumValues":["A","b "],"values":["c"]}')
    return _part(spark, sf_dir).select("p_partkey", F.array_join(templates.enum_values(v), "|").alias("enum_values"))


def parse_required_json(spark, sf_dir):
    """What the attributes of JSON responses have as `required`."""
    good = completions.parse_completion(tables.completions(spark, sf_dir)).where("error_code is null")
    raw = good.select("request_id", completions.lenient_json(F.col("content")).alias("raw"))
    items = raw.select("request_id", F.posexplode(F.try_variant_get("raw", "$.attributes", "array<variant>")).alias("pos", "v"))
    return items.select("request_id", F.col("pos").cast("long").alias("pos"), templates.required_flag(F.col("v")).alias("required"))


def coerce_attr_type(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", templates.attribute_type(_by(6, " Number ", "DATE", "", None, "shade", F.col("p_type"))).alias("type"))


def promote_enum(spark, sf_dir):
    none = F.array().cast("array<string>")
    kind, values = _by(4, "string", "string", "number", "array"), F.when(F.col("k") % 2 == 0, F.split("p_name", " ")).otherwise(none)
    return _part(spark, sf_dir).select("p_partkey", templates.promoted(kind, values).alias("type"))


def collect_attributes(spark, sf_dir):
    rows = templates.collected(generation.merged(spark, sf_dir))
    return rows.select("request_id", F.array_join(F.transform("all", lambda a: a["name"]), ",").alias("names"))


def pick_one_doc(spark, sf_dir):
    return catalog.one_doc(tables.catalog_domain(spark, sf_dir), "domainType")


_LOWER = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
QUERIES = {
    "filter_null_relationship": (filter_null_relationship, "SELECT c_custkey::VARCHAR AS entity_id, count(DISTINCT o_orderkey) AS n, false AS has_null FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_custkey % 3 > 0 GROUP BY c_custkey"),
    "normalize_global_attribute": (normalize_global_attribute, """SELECT p_partkey::VARCHAR AS _id, p_name AS attribute_key, CASE p_partkey % 4 WHEN 2 THEN '' WHEN 3 THEN p_type ELSE p_name END AS label, CASE WHEN p_partkey % 3 = 2 THEN 'enum' ELSE 'string' END AS type, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS enum_values,
  p_partkey % 5 = 1 AS required_default, 0::BIGINT AS n_tags, CASE WHEN p_partkey % 7 > 0 THEN p_size ELSE 0 END AS priority, 'global' AS source FROM part"""),
    "normalize_custom_attribute": (normalize_custom_attribute, """SELECT p_partkey::VARCHAR AS _id, name AS attribute_key, CASE p_partkey % 3 WHEN 0 THEN name WHEN 1 THEN '' ELSE 'L' END AS label, CASE WHEN p_partkey % 3 = 2 THEN 'number' ELSE 'string' END AS type, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS enum_values,
  p_partkey % 5 = 1 AS required_default, CASE WHEN p_partkey % 7 > 0 THEN p_size ELSE 0 END AS priority, 'domain_custom' AS source, CASE WHEN p_partkey % 11 = 0 THEN '{"max":1}' ELSE '{}' END AS validation_rules
FROM (SELECT *, CASE WHEN p_partkey % 4 = 2 THEN p_name ELSE p_type END AS name FROM part WHERE p_partkey % 4 > 1 AND p_partkey % 13 > 0)"""),
    "parse_json_lenient": (parse_json_lenient, """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '{"a":" ' || p_name || ' "}' WHEN 1 THEN '{"a":null}' WHEN 4 THEN '{"a":' || p_size || '}' WHEN 6 THEN '{"a":"-inf","b":"NaN, ' || p_name || '","c":["nan",1]}' ELSE '{}' END AS raw,
  CASE WHEN p_partkey % 8 IN (0, 1, 4, 6) THEN 'ok' WHEN p_partkey % 8 = 3 THEN 'not_object' WHEN p_partkey % 8 = 5 THEN 'empty' ELSE 'not_json' END AS parse_status FROM part"""),
    "normalize_scalar": (normalize_scalar, "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 4 THEN p_size::VARCHAR WHEN 6 THEN '-inf' ELSE '' END AS value FROM part"),
    "to_template_id": (to_template_id, f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'template' ELSE {_LOWER.format('p_name')} END || '_v1' AS template_id FROM part"),
    "sanitize_attr_name": (sanitize_attr_name, f"SELECT p_partkey, {_LOWER.format('p_type')} || '_' || {_LOWER.format('p_name')} AS name FROM part"),
    "normalize_enum_values": (normalize_enum_values, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || '|3' WHEN 3 THEN 'A|b' ELSE '' END AS enum_values FROM part"),
    "parse_required_json": (parse_required_json, sql.query(generation.ATTRIBUTES, "SELECT request_id, pos, lower(coalesce(v->>'$.required', '')) = 'true' AS required FROM items")),
    "coerce_attr_type": (coerce_attr_type, "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'date' ELSE 'string' END AS type FROM part"),
    "promote_enum": (promote_enum, "SELECT p_partkey, (['enum', 'string', 'number', 'array'])[(p_partkey % 4 + 1)::INT] AS type FROM part"),
    "collect_attributes": (collect_attributes, sql.query(generation.MERGED, "SELECT request_id, string_agg(name, ',' ORDER BY part, pos) AS names FROM merged GROUP BY ALL")),
    "pick_one_doc": (pick_one_doc, """SELECT lower(p_brand) AS "domainType", min(lower(p_brand) || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'domain_type_default' ELSE 'domain' END) AS _id FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL"""),
}
