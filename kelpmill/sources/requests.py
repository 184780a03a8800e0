"""Requests from lines of JSON, checked once: accepted rows, and rejects with their line and a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import DEFAULT_TOP_K, SCHEMAS

# What a request has to say, and the values of closed fields.
REQUIRED = {
    "documents_in": ("document_id", "entity_id", "text"),
    "relationships_in": ("from_id", "from_type", "to_id", "to_type", "relationship_type"),
    "questions": ("question_id", "question", "entity_id"),
    "template_requests": ("request_id", "template_name"),
}
_LABELS = ("Entity", "Document")
CLOSED = {"from_type": _LABELS, "to_type": _LABELS, "relationship_type": ("HAS_DOCUMENT", "BELONGS_TO", "OWNS", "USED_IN_EVENT")}
#: Fields that may be absent but not null, with what then stands for them; others that aren't required may be null too.
DEFAULTS = {"metadata": "{}", "top_k": DEFAULT_TOP_K}


def _typed(value: Column, kind: Column, name: str) -> Column:
    """The field's value, null if it has another type: text, an object as text with its keys in order, or a whole number, also as text."""
    if name == "metadata":
        return F.when(kind.startswith("OBJECT"), F.to_json(value))
    if name == "top_k":
        text = F.try_variant_get(value, "$", "string")
        return F.when(text.rlike(r"\A\s*[+-]?[0-9]+(\.0*)?\s*\z") & (kind != "BOOLEAN"), F.regexp_replace(F.trim(text), r"\.0*\z", "").try_cast("int"))
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def checked(lines: DataFrame, table: str, line_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows of SCHEMAS[table], rejects (line, reason)) of a table of lines, each of which is in one of the two.

    A line is one JSON object. The first reason counts: no object; then, in the schema's order, a required field
    that is missing, a value of another type, one outside a closed set. Unknown fields are ignored; of repeated keys the last counts.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    names = [f.name for f in StructType.fromDDL(SCHEMAS[table])]
    v = F.try_parse_json(lines[line_col])
    # What explode gives is worked out once for a row, however often it is used.
    once = lambda x: F.explode(F.array(x))
    rows = lines.select(lines[line_col].alias("line"), once(v).alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    rows = rows.select("line", once(is_object).alias("is_object"), "v").select("line", "is_object", F.when(F.col("is_object"), F.col("v")).alias("v"))
    field = lambda n: F.try_variant_get("v", f"$.{n}", "variant")
    parts = [F.struct(field(n).isNull().alias("absent"), (F.schema_of_variant(field(n)) == "VOID").alias("none"), _typed(field(n), F.schema_of_variant(field(n)), n).alias("value")).alias(n) for n in names]
    rows = rows.select("line", "is_object", once(F.struct(*parts)).alias("f")).select("line", "is_object", "f.*")
    reason = F.when(~F.col("is_object"), F.lit("Not a JSON object."))
    for n in names:
        absent, none, value = (F.col(n)[x] for x in ("absent", "none", "value"))
        if n in REQUIRED[table]:
            reason = reason.when(absent, F.lit(f"Missing field: {n}."))
        may_be_none = F.lit(n not in REQUIRED[table] and n not in DEFAULTS)
        reason = reason.when(~absent & value.isNull() & ~(none & may_be_none), F.lit(f"Wrong type: {n}."))
        if n in CLOSED and table == "relationships_in":
            reason = reason.when(~value.isin(*CLOSED[n]), F.lit(f"Unsupported value: {n}."))
    rows = rows.withColumn("reason", reason)
    value = lambda n: F.coalesce(F.col(n)["value"], F.lit(DEFAULTS[n])) if n in DEFAULTS else F.col(n)["value"]
    return rows.where("reason is null").select(*[value(n).alias(n) for n in names]), rows.where("reason is not null").select("line", "reason")


def read_requests(spark: SparkSession, table: str, path: str) -> tuple[DataFrame, DataFrame]:
    """checked over the lines of text files; an empty line is no object."""
    return checked(spark.read.text(path), table)
