"""Incremental jobs: documents and edge requests arrive as streams, tables are kept as folders of Parquet.

The index job fills several tables, which stand side by side under the same batch numbers. A batch counts only when its
marker is there, which is written last, so readers never see half of one. A batch that failed before its marker overwrites what
it had written when it runs again; one that has a marker is left as it is.

A single table is one folder for each batch of its stream; readers take each key's row of the latest batch, in one aggregation.
A batch that runs again after a failure overwrites its own folder, so nothing is counted twice, and the work of a batch
goes with its rows, not with the table. A table belongs to one checkpoint, whose batches it numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import graph, index, store


class KeyedTable:
    """Rows by key in a folder that Spark can read and write."""

    def __init__(self, path: str, schema: str, key: list[str]):
        self.path, self.schema, self.key = path, schema, key

    def read(self, spark: SparkSession) -> DataFrame:
        """One row for each key: that of the latest batch. Before the first batch there are none."""
        none = spark.createDataFrame([], self.schema)
        rows = _found(spark, self.path, f"{self.schema}, batch long")
        rest = [c for c in none.columns if c not in self.key]
        if not rest:
            return rows.select(none.columns).distinct()
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*self.key, "r.*").select(none.columns)

    def upsert(self, new: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Writes a batch; merge makes one row of those that it has for one key."""
        none = new.sparkSession.createDataFrame([], self.schema)
        merge(none, new.select(none.columns)).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def compact(self, spark: SparkSession, path: str) -> KeyedTable:
        """The table as it is now in a new folder, as batch -1 of a next one: a job whose tasks follow the data. For use between two runs of a stream."""
        small = KeyedTable(path, self.schema, self.key)
        self.read(spark).write.mode("overwrite").parquet(f"{path}/batch=-1")
        return small


EDGE_SCHEMA = ", ".join(f"{c} string" for c in graph.EDGE)
_NODE = "struct<id:string,name:string>"
SUMMARY_SCHEMA = f"status string, document_id string, entity_id string, file_url string, metadata string, chunks_indexed long, collection string, graph struct<entity:{_NODE},document:{_NODE},relationship:struct<from_id:string,from_type:string,relationship:string,to_id:string,to_type:string>>"


def _found(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder; none if it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class IndexTables:
    """What the index job writes: chunks, nodes, edges, summaries and rejects, by batch, and a marker for each finished batch."""

    #: (schema, key): readers get one row for each key, that of the latest batch; without a key, all rows.
    TABLES = {
        "chunks": (store.SCHEMA, ["id"]),
        "nodes": ("label string, id string, name string", ["label", "id"]),
        "edges": (EDGE_SCHEMA, graph.EDGE),
        "summaries": (SUMMARY_SCHEMA, ["document_id", "entity_id"]),
        "rejects": ("document_id string, entity_id string, reason string", None),
    }

    def __init__(self, path: str):
        self.path = path

    def finished(self, spark: SparkSession) -> DataFrame:
        """(dimension, batch): the markers; dimension is that of the first vector of the batch, null without any."""
        return _found(spark, f"{self.path}/finished", "dimension int, batch long")

    def dimension(self, spark: SparkSession) -> int | None:
        """The dimension of the first vector that was stored, which holds for the whole index."""
        return self.finished(spark).where("dimension is not null").agg(F.min_by("dimension", "batch")).first()[0]

    def write(self, name: str, rows: DataFrame, number: int) -> None:
        names = [c.name for c in StructType.fromDDL(self.TABLES[name][0])]
        rows.select(names).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def finish(self, spark: SparkSession, number: int, dimension: int | None) -> None:
        spark.createDataFrame([(dimension,)], "dimension int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/finished/batch={number}")

    def read(self, spark: SparkSession, name: str, values: dict[str, Column] | None = None) -> DataFrame:
        """The rows of finished batches. A node keeps the last name that it was given; chunks of another dimension than the index's don't count.

        values: columns by name that are worked out of each row and stand for its columns beside the key, so that chunks needn't be moved with their texts and vectors.
        """
        schema, key = self.TABLES[name]
        rows = _found(spark, f"{self.path}/{name}", f"{schema}, batch long").join(self.finished(spark).select("batch"), "batch", "left_semi")
        if name == "chunks":
            rows = rows.where(F.size("vector") == F.lit(self.dimension(spark)))
        names = [c.name for c in StructType.fromDDL(schema)]
        rest = [c for c in names if c not in (key or names)]
        if values is not None and rest and name != "nodes":
            rows, rest = rows.select(*key, *[c.alias(n) for n, c in values.items()], "batch"), list(values)
            names = [*key, *rest]
        if not key:
            return rows.select(names)
        if not rest:
            return rows.select(names).distinct()
        if name == "nodes":
            return rows.groupBy(key).agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("batch"))).alias("name"))
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*").select(names)


def edge_table(path: str) -> KeyedTable:
    return KeyedTable(path, EDGE_SCHEMA, graph.EDGE)


def stream_index(documents: DataFrame, tables: IndexTables, checkpoint: str, model=None) -> StreamingQuery:
    """Index arriving documents. Of a batch's requests for one document the greatest by address, metadata and text counts, so a replay gives the same.

    Empty texts go to the rejects, and so do documents whose vectors have another dimension than the index. The first batch
    with a vector learns the dimension while it writes. A batch's nodes have the names that it brings.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if not tables.finished(spark).where(F.col("batch") == number).isEmpty():
            return
        key = ["document_id", "entity_id"]
        accepted, empty = index.reject_empty_text(rows)
        one = F.max(F.struct("file_url", "metadata", "text")).alias("r")
        accepted = accepted.groupBy(key).agg(one).select(*key, "r.*").persist()
        points = index.points(accepted)
        stored = index.with_norm(index.with_vectors(points, model)).withColumns({"embedder": F.lit(index.EMBEDDER if model is None else getattr(model, "name", type(model).__name__)), "seq": F.lit(number).cast("long")})
        seen = Observation()
        tables.write("chunks", stored.observe(seen, F.min(F.struct("id", F.size("vector").alias("n"))).alias("first")), number)
        own = seen.get["first"]
        dimension = tables.dimension(spark) or (own and own["n"])
        written = spark.read.parquet(f"{tables.path}/chunks/batch={number}")
        good, bad = index.split_dimension(written, dimension or 0)
        indexed = accepted.join(good.select(key).distinct(), key, "left_semi")
        nodes = graph.document_nodes(indexed).groupBy("label", "id").agg(F.max("name").alias("name"))
        tables.write("nodes", nodes, number)
        tables.write("edges", graph.index_edges(indexed), number)
        tables.write("summaries", index.index_summary(indexed, good, nodes), number)
        tables.write("rejects", empty.select(*key, "reason").distinct().unionByName(bad.select(*key, "reason").distinct()), number)
        tables.finish(spark, number, own and own["n"])
        accepted.unpersist()

    return documents_writer(documents, checkpoint, batch)


def stream_relate(requests: DataFrame, nodes: Callable[[], DataFrame], table: KeyedTable, rejects: str, checkpoint: str) -> StreamingQuery:
    """Add arriving edges whose two nodes are there by then; the others go to rejects with a reason, by batch."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        good, bad = graph.check_requests(rows)
        matched, missing = graph.match_endpoints(good, nodes())
        table.upsert(matched.select("from_type", "from_id", F.col("relationship_type").alias("relationship"), "to_type", "to_id"), number, lambda old, new: old.unionByName(new).dropDuplicates(graph.EDGE))
        bad.unionByName(missing).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        rows.unpersist()

    return documents_writer(requests, checkpoint, batch)


def documents_writer(rows: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
