"""Attribute catalogs in three layers: global, defaults of a domain type, and a domain's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import nullif_empty, or_empty, strip

#: Candidates of a request.
LIMIT = 100
ITEM = ["attribute_key", "label", "type", "enum_values", "required_default", "tags", "priority", "source", "validation_rules"]


def domain_type(x: Column) -> Column:
    return F.lower(strip(or_empty(x)))


def mapped_domain(x: Column) -> Column:
    """The normalized type by its global name; fixed values."""
    return F.when(x == "groceries", "grocery").when(x == "banking", "bank").otherwise(x)


def _list(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def _label(label: Column, key: Column) -> Column:
    """The label, or the key where there is none; one of white space alone is there, and becomes empty."""
    return strip(F.coalesce(nullif_empty(label), key))


def _kind(x: Column) -> Column:
    return F.lower(strip(F.coalesce(nullif_empty(x), F.lit("string"))))


def global_items(catalog: DataFrame) -> DataFrame:
    """Normalized global attributes, with _id and domain; keys may be blank."""
    key = strip(or_empty(F.col("attribute_key")))
    return catalog.select("_id", "domain", key.alias("attribute_key"), _label(F.col("label"), key).alias("label"), _kind(F.col("type")).alias("type"), _list(F.col("enum_values")).alias("enum_values"), F.coalesce("required_default", F.lit(False)).alias("required_default"), _list(F.col("tags")).alias("tags"), F.coalesce("priority", F.lit(0)).alias("priority"), F.lit("global").alias("source"), F.lit(None).cast("string").alias("validation_rules"))


def domain_totals(items: DataFrame) -> DataFrame:
    """(domain, n, most): how many items each domain has, and their highest priority. No rows are made for a domain's requests times its items."""
    return items.groupBy("domain").agg(F.count("*").alias("n"), F.max("priority").alias("most"))


def custom_items(domain_docs: DataFrame) -> DataFrame:
    """(_id, kind, pos, item...) of the custom attributes that have a name."""
    rows = domain_docs.select("_id", F.posexplode("customAttributes").alias("pos", "c")).where(F.col("c").isNotNull())
    key = strip(or_empty(F.col("c.name")))
    out = rows.select("_id", F.lit(1).alias("kind"), "pos", key.alias("attribute_key"), _label(F.col("c.label"), key).alias("label"), _kind(F.col("c.type")).alias("type"), _list(F.col("c.enumValues")).alias("enum_values"), F.coalesce("c.required", F.lit(False)).alias("required_default"), _list(F.lit(None)).alias("tags"), F.coalesce("c.priority", F.lit(0)).alias("priority"), F.lit("domain_custom").alias("source"), F.coalesce("c.validationRules", F.lit("{}")).alias("validation_rules"))
    return out.where("attribute_key <> ''")


def resolve_refs(domain_docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_id, kind, pos, item...) of the references: the global item by id, else by key (of the smallest id), with what the
    reference overrides. References that lead nowhere are dropped."""
    refs = domain_docs.select("_id", F.posexplode("attributeRefs").alias("pos", "r")).where(F.col("r").isNotNull())
    refs = refs.select("_id", "pos", "r", strip(F.col("r.attributeId")).alias("ref_id"), nullif_empty(strip(F.col("r.attributeKey"))).alias("ref_key"))
    item = F.struct(*ITEM)
    by_id = items.select(F.col("_id").alias("ref_id"), item.alias("of_id"))
    by_key = items.groupBy(F.col("attribute_key").alias("ref_key")).agg(F.min_by(item, "_id").alias("of_key"))
    found = refs.join(by_id, "ref_id", "left").join(by_key, "ref_key", "left").withColumn("g", F.coalesce("of_id", "of_key")).where("g is not null")
    over = lambda x, base: F.coalesce(nullif_empty(x), base)
    out = found.select("_id", F.lit(0).alias("kind"), "pos", F.col("g.attribute_key").alias("attribute_key"), strip(over(F.col("r.label"), F.col("g.label"))).alias("label"), F.lower(strip(over(F.col("r.type"), F.col("g.type")))).alias("type"), F.when(F.size("r.enumValues") > 0, F.col("r.enumValues")).otherwise(F.col("g.enum_values")).alias("enum_values"), F.coalesce("r.required", "g.required_default").alias("required_default"), F.col("g.tags").alias("tags"), F.col("g.priority").alias("priority"), F.lit("domain_ref").alias("source"), F.coalesce("r.validationRules", "g.validation_rules").alias("validation_rules"))
    return out.where("attribute_key <> ''")


def one_doc(domain_docs: DataFrame, by: str) -> DataFrame:
    """(by, _id): of the catalog documents that share it, the one with the smallest _id."""
    return domain_docs.groupBy(by).agg(F.min("_id").alias("_id"))


def layers(requests: DataFrame, catalog: DataFrame, domain_docs: DataFrame) -> DataFrame:
    """(domain_type, domain_id, layer, kind, neg, item_id, pos, item...) for each distinct pair of the requests, which are normalized.

    Global items stand in the order of neg, their priority with its sign turned, and item_id; the others in that of kind and pos.
    """
    asked = requests.select(domain_type(F.col("domain_type")).alias("domain_type"), nullif_empty(F.col("domain_id")).alias("domain_id")).distinct()
    items = global_items(catalog)
    typed = asked.where("domain_type <> ''").withColumn("domain", mapped_domain(F.col("domain_type")))
    keys = ["domain_type", "domain_id"]
    zero = typed.join(items, "domain").select(*keys, F.lit(0).alias("layer"), F.lit(0).alias("kind"), (-F.col("priority")).alias("neg"), F.col("_id").alias("item_id"), F.lit(0).alias("pos"), *ITEM)
    own = resolve_refs(domain_docs, items).unionByName(custom_items(domain_docs))
    defaults = one_doc(domain_docs.where("scope = 'domain_type_default'").withColumnRenamed("domainType", "domain_type"), "domain_type")
    named = one_doc(domain_docs.where("domainId is not null").withColumnRenamed("domainId", "domain_id"), "domain_id")
    one = typed.join(defaults, "domain_type").join(own, "_id").select(*keys, F.lit(1).alias("layer"), "kind", F.lit(0).alias("neg"), F.lit("").alias("item_id"), "pos", *ITEM)
    two = asked.join(named, "domain_id").join(own, "_id").select(*keys, F.lit(2).alias("layer"), "kind", F.lit(0).alias("neg"), F.lit("").alias("item_id"), "pos", *ITEM)
    return zero.unionByName(one).unionByName(two)


def by_priority(layered: DataFrame) -> DataFrame:
    """The global items of each pair with pos, from 1, their place by priority, then id."""
    order = Window.partitionBy("domain_type", "domain_id").orderBy("neg", "item_id")
    return layered.where("layer = 0").withColumn("pos", F.row_number().over(order))


def overlay(layered: DataFrame) -> DataFrame:
    """One row for each key of a pair: the last layer's item (in layer 0 the first), at the key's first place. Nothing is numbered for that."""
    seq = F.struct("layer", "kind", "neg", "item_id", "pos")
    last = F.when(F.col("layer") > 0, -(F.col("kind") * 1_000_000_000 + F.col("pos")).cast("long")).otherwise(F.col("neg"))
    prec = F.struct(-F.col("layer"), last, "item_id")
    return layered.groupBy("domain_type", "domain_id", "attribute_key").agg(F.min_by(F.struct(*[c for c in ITEM if c != "attribute_key"]), prec).alias("i"), F.min(seq).alias("first_seq")).select("domain_type", "domain_id", "attribute_key", "i.*", "first_seq")


def candidates(merged: DataFrame, limit: int = LIMIT) -> DataFrame:
    """merged with rank, the first limit of each pair by priority, then first place."""
    order = Window.partitionBy("domain_type", "domain_id").orderBy(F.col("priority").desc(), "first_seq")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def with_candidates(requests: DataFrame, found: DataFrame) -> DataFrame:
    """requests with candidates, an array in rank order; the overlay is made once for each distinct pair, then joined."""
    packed = found.groupBy("domain_type", "domain_id").agg(F.array_sort(F.collect_list(F.struct("rank", *ITEM))).alias("candidates")).withColumnsRenamed({"domain_type": "of_type", "domain_id": "of_id"})
    same = (domain_type(requests["domain_type"]) == F.col("of_type")) & nullif_empty(requests["domain_id"]).eqNullSafe(F.col("of_id"))
    rows = requests.join(packed, same, "left").drop("of_type", "of_id")
    return rows.withColumn("candidates", F.coalesce("candidates", F.array().cast(packed.schema["candidates"].dataType)))
