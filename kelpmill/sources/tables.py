"""Schemas and readers of the input tables, and the same tables derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTE_REF = "struct<attributeId:string,attributeKey:string,label:string,type:string,required:boolean,enumValues:array<string>,validationRules:string>"
CUSTOM_ATTRIBUTE = "struct<name:string,label:string,type:string,required:boolean,enumValues:array<string>,priority:int,validationRules:string>"
SCHEMAS = {
    "documents_in": "document_id string, entity_id string, file_url string, text string, metadata string",
    "relationships_in": "from_id string, from_type string, to_id string, to_type string, relationship_type string",
    "questions": "question_id string, question string, entity_id string, top_k int",
    "template_requests": "request_id string, template_name string, description string, domain_id string, domain_type string, response_mode string",
    "catalog_global": "_id string, domain string, subdomain string, attribute_key string, label string, type string, enum_values array<string>, required_default boolean, tags array<string>, priority int",
    "catalog_domain": f"_id string, scope string, domainType string, domainId string, description string, attributeRefs array<{ATTRIBUTE_REF}>, customAttributes array<{CUSTOM_ATTRIBUTE}>",
    "completions": "request_id string, http_status int, body string, transport_error string",
}
DEFAULT_TOP_K = 5


def read(spark: SparkSession, table: str, path: str, kind: str = "parquet") -> DataFrame:
    """A table of SCHEMAS from parquet, from lines of JSON, or (kind json_array) from a file that is one JSON array."""
    reader = spark.read.schema(SCHEMAS[table])
    if kind == "json_array":
        return reader.option("multiLine", True).json(path)
    return reader.json(path) if kind == "json" else reader.parquet(path)


def with_top_k(questions: DataFrame) -> DataFrame:
    return questions.withColumn("top_k", F.coalesce("top_k", F.lit(DEFAULT_TOP_K)))


def star(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star(spark, sf_dir, "documents")
    name = F.concat_ws("-", "lang", F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("entity_id"), F.lit(None).cast("string").alias("file_url"), "text", F.to_json(F.struct(name.alias("name"))).alias("metadata"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = star(spark, sf_dir, "benchmark")
    n = F.col("item_id")
    text = F.when(n % 4 == 1, F.concat(F.lit("  "), "text", F.lit(" \n"))).otherwise(F.col("text"))  # some with white space round them
    return b.select(n.cast("string").alias("question_id"), text.alias("question"), F.concat(F.lit("src"), (n % 20).cast("string")).alias("entity_id"), F.when(n % 6 < 5, (1 + n % 5).cast("int")).alias("top_k"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = star(spark, sf_dir, "customer"), star(spark, sf_dir, "orders")
    return c.select(F.lit("Entity").alias("label"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")).unionByName(o.select(F.lit("Document").alias("label"), F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("name")))


def relationships_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge requests between customers and orders; some name missing orders, and some have no valid type or label."""
    o, k = star(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(k % 11 == 0, "LIKES").when(k % 3 == 0, "OWNS").otherwise("HAS_DOCUMENT")
    one = o.select(F.col("o_custkey").cast("string").alias("from_id"), F.when(k % 13 == 0, "Person").otherwise("Entity").alias("from_type"), F.when(k % 7 == 0, k + 1_000_000_000).otherwise(k).cast("string").alias("to_id"), F.lit("Document").alias("to_type"), kind.alias("relationship_type"))
    return one.unionByName(one.where("from_id % 5 = 0"))  # repeated requests


def catalog_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = star(spark, sf_dir, "part"), F.col("p_partkey")
    none = F.array().cast("array<string>")
    return p.where(k % 3 == 0).select(F.lpad(k.cast("string"), 12, "0").alias("_id"), F.when(k % 30 == 0, "grocery").when(k % 30 == 15, "bank").otherwise(F.lower("p_brand")).alias("domain"), F.lit(None).cast("string").alias("subdomain"), F.col("p_name").alias("attribute_key"), F.when(k % 2 == 0, F.col("p_type")).alias("label"), F.when(k % 5 == 0, "Enum").when(k % 5 < 4, "string").alias("type"), F.when(k % 5 == 0, F.split("p_type", " ")).otherwise(none).alias("enum_values"), (k % 4 == 0).alias("required_default"), none.alias("tags"), F.col("p_size").cast("int").alias("priority"))


def catalog_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each brand and scope: references from one third of the parts, custom attributes from another."""
    p, k = star(spark, sf_dir, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    ref = F.struct(F.when(k % 2 == 0, F.lpad((k - 1).cast("string"), 12, "0")).alias("attributeId"), F.col("p_name").alias("attributeKey"), F.when(k % 5 == 0, F.lit("Label")).alias("label"), none.alias("type"), F.when(k % 7 == 0, F.lit(True)).alias("required"), F.array().cast("array<string>").alias("enumValues"), none.alias("validationRules"))
    own = F.struct(F.concat(F.when(k % 10 == 0, F.lit(" ")).otherwise(F.lit("own ")), F.when(k % 10 == 0, F.lit(" ")).otherwise(F.col("p_name"))).alias("name"), none.alias("label"), F.lit("Number").alias("type"), (k % 4 == 0).alias("required"), F.array().cast("array<string>").alias("enumValues"), F.col("p_size").cast("int").alias("priority"), none.alias("validationRules"))
    rows = p.where(k % 3 > 0).withColumn("scope", F.when(k % 2 == 0, "domain_type_default").otherwise("domain"))
    items = lambda third, item: F.transform(F.array_sort(F.collect_list(F.when(k % 3 == third, F.struct(k.alias("k"), item.alias("v"))))), lambda x: x["v"])
    docs = rows.groupBy(F.lower("p_brand").alias("brand"), "scope").agg(items(1, ref).alias("attributeRefs"), items(2, own).alias("customAttributes"))
    return docs.select(F.concat("brand", F.lit("/"), "scope").alias("_id"), "scope", F.col("brand").alias("domainType"), F.when(F.col("scope") == "domain", F.concat(F.lit("id-"), "brand")).alias("domainId"), none.alias("description"), "attributeRefs", "customAttributes")


def template_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = star(spark, sf_dir, "supplier"), F.col("s_suppkey")
    brand = F.concat(F.lit("brand#"), (1 + k % 5).cast("string"), (1 + F.floor(k / 5) % 5).cast("string"))
    name = F.when(k % 20 == 7, "groceries").when(k % 20 == 13, "banking").otherwise(brand)  # the first two have other names in the global catalog
    return s.select(k.cast("string").alias("request_id"), F.when(k % 17 == 0, "  ").when(k % 5 == 1, F.concat(F.lit("\t"), "s_name", F.lit(" "))).otherwise(F.col("s_name")).alias("template_name"), F.when(k % 2 == 0, F.lit("First line\n\n second line ")).alias("description"), F.when(k % 3 == 0, F.concat(F.lit("id-"), brand)).alias("domain_id"), F.when(k % 4 > 0, F.concat(F.lit(" "), F.upper(name))).alias("domain_type"), F.when(k % 6 == 0, F.lit(" Description_Only ")).alias("response_mode"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response envelopes for the template requests: good ones, prose, broken and truncated ones and errors, by the key's residue."""
    s, k = star(spark, sf_dir, "supplier"), F.col("s_suppkey")
    attrs = F.concat(F.lit('[{"name":"Net Weight","type":"number","required":true},{"name":"net-weight"},{"name":"field_x"},{"name":"Status","type":"enum","enumValues":["A","Open ","Closed"]},{"name":"Empty","type":"enum","enum_values":["a"]},7,{"name":"Color '), k.cast("string"), F.lit('","type":"shade","required":"TRUE"}]'))
    good = F.concat(F.lit('Here: {"templateId":'), F.when(k % 2 == 0, F.lit('"lower_snake_v1"')).otherwise(F.concat(F.lit('"own_'), k.cast("string"), F.lit('"'))), F.lit(',"entity_type":'), F.when(k % 3 == 0, F.lit("null")).otherwise(F.lit('"THING"')), F.lit(',"description":"One\\n Two \\n\\nThree","attributes":'), attrs, F.lit("} done"))
    required = F.when(k % 3 == 0, "no").when(k % 3 == 1, " TRUE").otherwise("Yes ")
    prose = F.concat(F.lit('{"description":"Text.\\n- name: Shelf Life\\ntype: Number, days\\nrequired\\n- name: Grade\\nenum_values: [\'High\', \\"Low\\"]\\nrequired: '), required, F.lit('\\n- name: Shelf-life"}'))
    cut = F.when(k % 18 == 0, F.lit('{"description": "", "x": 1')).when(k % 30 == 6, F.lit('{"description": "Cut \\"off\\"\\n here", "attr'))
    content = F.when(k % 37 == 0, F.lit(None).cast("string")).when(cut.isNotNull(), cut).when(k % 5 == 4, prose).when(k % 5 == 3, F.lit("no json at all")).otherwise(good)
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")), {"ignoreNullFields": "false"})
    body = F.when(k % 23 == 0, F.lit("<html>")).when(k % 19 == 0, F.lit('{"error":"too busy"}')).when(k % 29 == 0, F.lit('{"choices":[]}')).otherwise(envelope)
    return s.select(k.cast("string").alias("request_id"), F.when(k % 19 == 0, 503).otherwise(200).cast("int").alias("http_status"), body.alias("body"), F.when(k % 31 == 0, F.lit("timed out")).alias("transport_error"))
