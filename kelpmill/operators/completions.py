"""Response envelopes: the content or an error, and what can be read out of the content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nullif_empty, or_empty, strip, upper_snake


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def last_key_wins(rows: DataFrame) -> DataFrame:
    """rows, whose session now reads JSON objects with repeated keys, of which the last one counts."""
    rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return rows


def parse_completion(completions: DataFrame) -> DataFrame:
    """completions with content, or error_code and error_detail: the first that applies of a transport error, a body that isn't
    JSON, a status of 400 or more, and a body without content. A content that is null is there: no error, and null."""
    body = F.try_parse_json("body")
    rows = last_key_wins(completions).withColumn("v", body)
    found = _get(F.col("v"), "$.choices[0].message.content")
    named = F.schema_of_variant("v").startswith("OBJECT")
    no_content = F.try_variant_get("v", "$.choices[0].message.content", "variant").isNull()
    code = F.when(F.col("transport_error").isNotNull(), 502).when(F.col("v").isNull(), 502).when(F.col("http_status") >= 400, F.col("http_status")).when(no_content, 502)
    detail = F.when(F.col("transport_error").isNotNull(), F.concat(F.lit("Model request failed: "), "transport_error")).when(F.col("v").isNull(), "Model response was not JSON.").when(F.col("http_status") >= 400, F.when(named, _get(F.col("v"), "$.error")).otherwise(F.col("body"))).when(no_content, "Model response had no content.")
    return rows.select(*completions.columns, F.when(code.isNull(), found).alias("content"), code.alias("error_code"), detail.alias("error_detail"))


def json_slice(text: Column) -> Column:
    """From the first `{` to the last `}`, or the text as it is."""
    return F.coalesce(nullif_empty(F.regexp_extract(text, r"(?s)\{.*\}", 0)), text)


def _with_numbers(text: Column) -> Column:
    """Text whose bare NaN and Infinity, which Python reads as numbers, are the words that it writes for them; those inside quotes stay."""
    parts = F.regexp_extract_all(text, F.lit(r'(?s)"(?:\\.|[^"\\])*"|[^"]+|"'), F.lit(0))
    word = lambda x, bare, shown: F.regexp_replace(x, rf"(?<![\w.-]){bare}(?!\w)", shown)
    words = lambda x: word(word(word(x, "NaN", '"nan"'), "-Infinity", '"-inf"'), "Infinity", '"inf"')
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith('"'), x).otherwise(words(x))), "")


def _parsed(text: Column) -> Column:
    sliced = json_slice(text)
    return F.coalesce(F.try_parse_json(sliced), F.when(sliced.rlike("NaN|Infinity"), F.try_parse_json(_with_numbers(sliced))))


def lenient_json(text: Column) -> Column:
    """The sliced text as a VARIANT object; anything else is {}. NaN and Infinity are read, as the texts nan, inf and -inf."""
    v = _parsed(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.parse_json(F.lit("{}")))


def parse_status(text: Column) -> Column:
    """What lenient_json made of a text: ok, not_object (JSON of another kind), not_json, or empty (nothing, or null)."""
    v = _parsed(text)
    return F.when(or_empty(strip(text)) == "", "empty").when(v.isNull(), "not_json").when(F.schema_of_variant(v).startswith("OBJECT"), "ok").otherwise("not_object")


def scalar(v: Column, path: str) -> Column:
    """A value as stripped text; null or absent: empty."""
    return or_empty(strip(_get(v, path)))


def first_present(v: Column, *paths: str) -> Column:
    """The text at the first path that is there, even if it is null."""
    found = F.lit("")
    for path in reversed(paths):
        raw = F.try_variant_get(v, path, "variant")
        found = F.when(raw.isNotNull(), scalar(v, path)).otherwise(found)
    return found


def described(content: Column) -> Column:
    """The description in a text that isn't the JSON it should be."""
    text = strip(or_empty(content))
    # A fence, the quoted description, and what stands around a bare one.
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")
    pattern = r'(?is)"description"\s*:\s*"((?:\\.|[^"])*)"'
    quoted = F.regexp_extract(text, pattern, 1)
    # JSON has no control characters inside quotes; a text with some stays as it is, escapes and all.
    plain = F.when(~quoted.rlike(r"[\x00-\x1f]"), F.get_json_object(F.concat(F.lit('{"v":"'), quoted, F.lit('"}')), "$.v"))
    bare = F.regexp_replace(F.regexp_replace(text, r"""\A["']|["']\z""", ""), r"(?U)\s+", " ")
    return F.when(text.rlike(pattern), strip(F.coalesce(plain, quoted))).when(text.startswith("{") & text.endswith("}"), "").otherwise(F.trim(bare))


def description_results(requests: DataFrame, contents: DataFrame) -> DataFrame:
    """Results of the requests that want a description alone: one paragraph, an entity type, no attributes. contents are of completions without an error."""
    rows = last_key_wins(requests).join(contents.select("request_id", "content"), "request_id").withColumn("raw", lenient_json(strip(F.col("content"))))
    # Fixed values
    domain = F.when(F.col("domain_type") != "", F.concat(F.lit("This domain supports "), F.lower(strip(F.col("domain_type"))), F.lit(" business operations.")))
    fallback = F.concat_ws(" ", domain, F.lit("It organizes the main business data, workflows, users, and records needed to run the business consistently."), F.lit("It is intended to provide a clear foundation for structured data entry, operations, and reporting."))
    text = F.coalesce(nullif_empty(scalar(F.col("raw"), "$.description")), nullif_empty(described(F.col("content"))), fallback)
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r"\A\s*[-*]\s*", "")
    kind = upper_snake(F.coalesce(nullif_empty(F.col("domain_type")), F.col("template_name")))
    none = lambda values: F.array().cast(f"array<struct<name:string,type:string,required:boolean,{values}:array<string>>>")
    rows = rows.select("request_id", F.lit("").alias("template_id"), "template_name", text.alias("description"), kind.alias("entity_type"), none("enum_values").alias("attributes"), F.lit(1).alias("version"), "raw", none("enumValues").alias("attributesCamelCase"), none("enumValues").alias("attributes_compat"))
    return rows.withColumns({"templateId": F.col("template_id"), "templateName": F.col("template_name"), "entityType": F.col("entity_type")})
