"""A typed graph of entities and documents as two tables: nodes (label, id, name) and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import folders
from .index import document_name, reject

# Fixed values
LABELS = ("Entity", "Document")
RELATIONSHIPS = ("HAS_DOCUMENT", "BELONGS_TO", "OWNS", "USED_IN_EVENT")
EDGE = ["from_type", "from_id", "relationship", "to_type", "to_id"]
#: Edges of a page.
PAGE = 1000


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by (label, id), with the name of the highest seq that has one; both tables have a column seq."""
    both = nodes.unionByName(new)
    return both.groupBy("label", "id").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"), F.max("seq").alias("seq"))


def document_nodes(documents: DataFrame) -> DataFrame:
    """(label, id, name) of the entities and documents of accepted documents."""
    entities = documents.select(F.lit("Entity").alias("label"), F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("name"))
    return entities.unionByName(documents.select(F.lit("Document").alias("label"), F.col("document_id").alias("id"), document_name(F.col("metadata"), F.col("file_url")).alias("name")))


def index_edges(documents: DataFrame) -> DataFrame:
    return documents.select(F.lit("Entity").alias("from_type"), F.col("entity_id").alias("from_id"), F.lit("HAS_DOCUMENT").alias("relationship"), F.lit("Document").alias("to_type"), F.col("document_id").alias("to_id")).distinct()


def check_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, label = reject(requests, ~F.col("from_type").isin(*LABELS) | ~F.col("to_type").isin(*LABELS), "Unsupported node label.")
    good, kind = reject(good, ~F.col("relationship_type").isin(*RELATIONSHIPS), "Unsupported relationship type.")
    return good, label.unionByName(kind)


def match_endpoints(requests: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose two nodes exist, the others with a reason)."""
    side = lambda end: nodes.select(F.col("label").alias(f"{end}_type"), F.col("id").alias(f"{end}_id"))
    good = requests.join(side("from"), ["from_type", "from_id"], "left_semi").join(side("to"), ["to_type", "to_id"], "left_semi")
    no_from = requests.join(side("from"), ["from_type", "from_id"], "left_anti")
    no_to = requests.join(side("from"), ["from_type", "from_id"], "left_semi").join(side("to"), ["to_type", "to_id"], "left_anti")
    return good.select(requests.columns), no_from.unionByName(no_to.select(requests.columns)).withColumn("reason", F.lit("Source or target node was not found."))


def upsert_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    return edges.select(EDGE).unionByName(requests.select("from_type", "from_id", F.col("relationship_type").alias("relationship"), "to_type", "to_id")).dropDuplicates(EDGE)


def relationship_pages(edges: DataFrame, page: int = PAGE) -> DataFrame:
    """(entity_id, page, relationships): the edges that leave each entity, in order, in pages of page edges, numbered from 0; edges are distinct.

    Edges are sorted into ranges, so those of a hub are the work of many tasks. An edge's place is that in its range, after those of
    its entity in the ranges before.
    """
    out = edges.where(F.col("from_type") == "Entity").select(F.col("from_id").alias("entity_id"), F.struct(*EDGE).alias("edge"))
    ranges = out.repartitionByRange(folders.partitions(edges.sparkSession), "entity_id", "edge").sortWithinPartitions("entity_id", "edge")
    rows = folders.settled(ranges.withColumn("n", F.monotonically_increasing_id())).withColumn("part", F.shiftright("n", 33))
    counts = rows.groupBy("entity_id", "part").agg(F.min("n").alias("first"), F.count("*").alias("c"))
    earlier = Window.partitionBy("entity_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("entity_id", "part", "first", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("n") - F.col("first")
    placed = rows.join(counts, ["entity_id", "part"]).select("entity_id", F.floor(place / page).cast("int").alias("page"), "edge")
    return placed.groupBy("entity_id", "page").agg(F.sort_array(F.collect_list("edge")).alias("relationships"))


def expand_one_hop(asked: DataFrame, nodes: DataFrame, edges: DataFrame, page: int = PAGE) -> DataFrame:
    """(entity_id, entity, page, relationships): for each entity_id of asked its entity (null if unknown) and the edges that leave it, a row for
    each page; one with an empty page 0 where there are none."""
    ids = asked.select("entity_id").distinct()
    known = ids.join(nodes.where(F.col("label") == "Entity").select(F.col("id").alias("entity_id"), F.struct("id", "name").alias("entity")), "entity_id")
    found = relationship_pages(edges.join(known.select(F.col("entity_id").alias("from_id")), "from_id", "left_semi"), page)
    rows = ids.join(known, "entity_id", "left").join(found, "entity_id", "left")
    none = F.array().cast(found.schema["relationships"].dataType)
    return rows.select("entity_id", "entity", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("relationships", none).alias("relationships"))
