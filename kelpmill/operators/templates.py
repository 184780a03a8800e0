"""Templates from model responses: attributes from JSON or from lines of text, merged with the catalog's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import LINE_END, attribute_name, five_lines, loose_boolean, nullif_empty, or_empty, strip, template_id, upper_snake
from ..sources import folders
from .completions import first_present, last_key_wins, lenient_json, scalar
from .index import reject

# Fixed values
TYPES = ("string", "number", "boolean", "date", "enum", "array", "json")
PLACEHOLDER_NAMES = ("", "field_name", "field", "attribute", "value", "test")
PLACEHOLDER_VALUES = ("a", "b", "value", "test")
PLACEHOLDER_IDS = ("", "lower_snake_v1", "template_v1", "template_id")
ATTRIBUTE = ["name", "type", "required", "enum_values"]


def reject_blank_template(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted requests with the name stripped; rejects as they came, with a reason)."""
    good, bad = reject(requests, strip(or_empty(F.col("template_name"))) == "", "template_name is required.")
    return good.withColumn("template_name", strip(F.col("template_name"))), bad


def route(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests for templates, requests for descriptions alone)."""
    short = F.lower(strip(or_empty(F.col("response_mode")))) == "description_only"
    return requests.where(~short), requests.where(short)


def attribute_type(x: Column) -> Column:
    """A known type in lower case; anything else is a string."""
    kind = F.lower(strip(or_empty(x)))
    return F.when(kind.isin(*TYPES), kind).otherwise("string")


def required_flag(v: Column) -> Column:
    """True in JSON, or the text in any case without white space around it."""
    return F.lower(or_empty(F.try_variant_get(v, "$.required", "string"))) == "true"


def enum_values(v: Column) -> Column:
    """The stripped items of the first list name that is there, without empty ones; what isn't a list gives none."""
    listed = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ("enum_values", "enumValues", "values")])
    items = F.coalesce(F.try_variant_get(listed, "$", "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: or_empty(strip(x))), lambda x: x != "")


def promoted(kind: Column, values: Column) -> Column:
    """Strings with a list of values are enums."""
    return F.when((kind == "string") & (F.size(values) > 0), "enum").otherwise(kind)


def json_attributes(contents: DataFrame) -> DataFrame:
    """(request_id, pos, attribute...) of the attribute objects in raw, without placeholders."""
    items = F.try_variant_get("raw", "$.attributes", "array<variant>")
    rows = contents.select("request_id", F.posexplode(items).alias("pos", "v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    v = F.col("v")
    rows = rows.select("request_id", "pos", scalar(v, "$.name").alias("name"), attribute_type(scalar(v, "$.type")).alias("type"), required_flag(v).alias("required"), enum_values(v).alias("values"))
    rows = rows.where(~F.lower("name").isin(*PLACEHOLDER_NAMES) & ~F.lower("name").startswith("field_"))
    real = F.filter("values", lambda x: ~F.lower(x).isin(*PLACEHOLDER_VALUES))
    rows = rows.withColumn("enum_values", F.when(F.col("type") == "enum", real).otherwise(F.array().cast("array<string>")))
    return rows.where((F.col("type") != "enum") | (F.size("enum_values") > 0)).select("request_id", "pos", *ATTRIBUTE)


def line_attributes(contents: DataFrame) -> DataFrame:
    """(request_id, pos, attribute...) from `- name:` lines of raw's description and the lines behind each."""
    lines = contents.select("request_id", F.posexplode(F.split(scalar(F.col("raw"), "$.description"), LINE_END)).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    opens = F.col("line").startswith("- name:")
    lines = lines.withColumn("nth", F.sum(opens.cast("int")).over(Window.partitionBy("request_id").orderBy("pos"))).where("nth > 0")
    after = F.regexp_replace("line", r"(?s)\A[^:]*:", "")
    last = lambda test, value: F.max_by(F.when(test, value), F.when(test, F.col("pos")))
    kind = F.lower(F.regexp_extract(strip(after), r"(?s)\A[^,]*", 0))
    quoted = F.transform(F.regexp_extract_all(strip(after), F.lit("""'[^']+'|"[^"]+\""""), F.lit(0)), lambda x: F.regexp_replace(strip(F.substring(x, F.lit(2), F.length(x) - 2)), """\\A['"]+|['"]+\\z""", ""))
    required, typed, listed = F.col("line").startswith("required"), F.col("line").startswith("type:"), F.col("line").startswith("enum_values:")
    out = lines.groupBy("request_id", "nth").agg(F.min("pos").alias("pos"), last(opens, attribute_name(strip(after))).alias("name"), last(typed, F.when(kind.isin(*TYPES), kind).otherwise("string")).alias("type"), last(required, loose_boolean(after)).alias("required"), last(listed, quoted).alias("enum_values"))
    return out.select("request_id", "pos", "name", F.coalesce("type", F.lit("string")).alias("type"), F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("enum_values", F.array().cast("array<string>")).alias("enum_values"))


def first_by_name(attributes: DataFrame) -> DataFrame:
    """The first attribute of each sanitized name, under that name."""
    rows = attributes.withColumn("name", attribute_name(strip(F.col("name")))).where("name <> ''")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("request_id", "name").orderBy("pos"))).where("nth = 1").drop("nth")


def response_attributes(contents: DataFrame) -> DataFrame:
    """Attributes from JSON, or from lines where JSON gives none; strings with values become enums."""
    both = json_attributes(contents).withColumn("kind", F.lit(0)).unionByName(line_attributes(contents).withColumn("kind", F.lit(1)))
    rows = first_by_name(both.withColumn("least", F.min("kind").over(Window.partitionBy("request_id"))).where("kind = least").drop("kind", "least"))
    return rows.withColumn("type", promoted(F.col("type"), F.col("enum_values")))


def catalog_attributes(requests: DataFrame) -> DataFrame:
    """(request_id, pos, attribute...) of the requests' candidates."""
    rows = requests.select("request_id", F.posexplode("candidates").alias("pos", "c"))
    return first_by_name(rows.select("request_id", "pos", F.col("c.attribute_key").alias("name"), F.col("c.type").alias("type"), F.col("c.required_default").alias("required"), F.col("c.enum_values").alias("enum_values")))


def merge(catalog: DataFrame, response: DataFrame) -> DataFrame:
    """The catalog's attributes, then the response's whose names are new; part orders the two."""
    both = catalog.withColumn("part", F.lit(0)).unionByName(response.withColumn("part", F.lit(1)))
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("request_id", "name").orderBy("part"))).where("nth = 1").drop("nth")


def collected(merged: DataFrame) -> DataFrame:
    """(request_id, all): the merged attributes of each request, in order."""
    return merged.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", *ATTRIBUTE))).alias("all"))


def template_results(requests: DataFrame, contents: DataFrame) -> DataFrame:
    """One row for each request with a response; requests come with candidates, contents are of completions without an error."""
    raw = last_key_wins(contents).select("request_id", lenient_json(strip(F.col("content"))).alias("raw"))
    joined = folders.settled(requests.join(raw, "request_id"))  # read three times
    packed = collected(merge(catalog_attributes(joined), response_attributes(joined)))
    rows = joined.join(packed, "request_id", "left")
    own_id, own_type = first_present(F.col("raw"), "$.template_id", "$.templateId"), first_present(F.col("raw"), "$.entity_type", "$.entityType")
    use_id = F.lower(own_id).isin(*PLACEHOLDER_IDS) | F.contains(F.lower(own_id), F.lit("lower_snake_case"))
    use_type = (own_type == "") | (F.upper(own_type) == "UPPER_SNAKE_CASE")
    shape = lambda values: F.transform(F.coalesce("all", F.array().cast(packed.schema["all"].dataType)), lambda a: F.struct(a["name"].alias("name"), a["type"].alias("type"), a["required"].alias("required"), a["enum_values"].alias(values)))
    text = F.coalesce(nullif_empty(scalar(F.col("raw"), "$.description")), F.col("description"))
    rows = rows.select(
        "request_id",
        F.when(use_id, template_id(F.col("template_name"))).otherwise(own_id).alias("template_id"),
        "template_name",
        five_lines(text, F.col("template_name")).alias("description"),
        F.when(use_type, upper_snake(F.coalesce(nullif_empty(F.col("domain_type")), F.col("template_name")))).otherwise(own_type).alias("entity_type"),
        shape("enum_values").alias("attributes"),
        F.lit(1).alias("version"),
        F.col("raw"),
        shape("enumValues").alias("attributesCamelCase"),
        shape("enumValues").alias("attributes_compat"),
    )
    return rows.withColumns({"templateId": F.col("template_id"), "templateName": F.col("template_name"), "entityType": F.col("entity_type")})
