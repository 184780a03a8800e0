"""A chunk index that is kept in files: upserts rewrite what they touch, and a search for one entity reads what may hold it."""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .index import split_dimension, with_norm

SCHEMA = "id string, document_id string, entity_id string, file_url string, chunk_index int, text string, metadata string, vector array<double>, norm double, embedder string, seq long"
#: Folders by entity, of which an upsert rewrites those that it touches, and the fewest buckets by id inside each.
PARTS, BUCKETS = 64, 16
#: Rows of a bucket, over all folders, for which buckets are laid out; the table is dealt anew when it would have twice as many.
ROWS = 32_768


def _latest(rows: DataFrame) -> DataFrame:
    """Of each id the row of the highest seq."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")


class IndexStore:
    """Index rows in folders by a hash of their entity, in each folder bucketed by id, each file in order of its entities.

    A point's id comes with its entity, so an upsert needs only the folders of its entities: their rows are joined bucket by bucket, without
    a shuffle, new rows are dealt to the buckets once, and these folders are written anew. An entity that fills its folder is spread over the buckets. A bucket is one task's work, so
    their number goes with the rows: before an upsert that would give a bucket twice ROWS, the table is dealt to more buckets in a folder of
    its own, which counts once its layout is written, and the old folder stays for readers who have it open. The dimension of the first vector that was stored holds for all others; it is kept beside the table. The table's name lives in the session,
    its rows in the folder: a store that is opened again finds them.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, buckets: int = BUCKETS):
        self.spark, self.path, self.parts, self.buckets = spark, path, parts, buckets
        self.table = self._table("rows", buckets)
        self._follow()

    def _table(self, folder: str, buckets: int) -> str:
        """A table of the session over a folder."""
        table = f"index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({SCHEMA}, part int) USING parquet OPTIONS ('parquet.bloom.filter.enabled#entity_id' 'true') PARTITIONED BY (part) CLUSTERED BY (id) SORTED BY (entity_id, id) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        if self._there(folder) is not None:
            self.spark.catalog.recoverPartitions(table)
        return table

    def _follow(self) -> None:
        """Takes the last layout, where the table has been dealt anew."""
        found = self._there("layout", "folder string, buckets int")
        last = None if found is None else found.orderBy(F.col("buckets").desc()).first()
        if last and last["buckets"] > self.buckets:
            self.table, self.buckets = self._table(last["folder"], last["buckets"]), last["buckets"]

    def _make_room(self, coming: int) -> None:
        """More buckets, if the stored rows and the coming ones would give one twice ROWS."""
        rows = self.read().count() + coming
        if rows <= 2 * ROWS * self.buckets:
            return
        buckets = self.buckets * 2 ** math.ceil(math.log2(rows / ROWS / self.buckets))
        folder = f"rows-{buckets}-{uuid.uuid4().hex}"
        table, columns = self._table(folder, buckets), self.spark.table(self.table).columns
        if rows > coming:
            self.spark.table(self.table).select(columns).repartition(buckets, "id").write.mode("append").insertInto(table)
        self.spark.createDataFrame([(folder, buckets)], "folder string, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/layout")
        self.table, self.buckets = table, buckets

    def _part(self, entity: Column) -> Column:
        return F.pmod(F.xxhash64(entity), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        self._follow()
        return self.spark.table(self.table).drop("part")

    def of_entity(self, entity_id: str) -> DataFrame:
        """The rows of one entity: other folders aren't listed, and in its own, files are skipped where statistics and bloom filters rule it out."""
        self._follow()
        rows = self.spark.table(self.table).where((F.col("part") == self._part(F.lit(entity_id))) & (F.col("entity_id") == entity_id))
        return rows.drop("part")

    def _there(self, name: str, schema: str = "id string") -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def dimension(self) -> int | None:
        found = self._there("dimension", "dimension int")
        return None if found is None else found.first()[0]

    def upsert(self, new: DataFrame) -> DataFrame:
        """Stores new rows (SCHEMA but norm), of each id that of the highest seq, and not above a stored one of a higher seq. Gives the rejects, with a reason: rows whose vector has another dimension.

        An upsert that fails is repeated as a whole: it gives the same rows.
        """
        staged, seen = f"{self.path}/staged/{uuid.uuid4().hex}", Observation()
        first = F.struct("id", (-F.col("seq")).alias("seq"), F.size("vector").alias("n"))
        rows = with_norm(new).observe(seen, F.count("*").alias("n"), F.min(F.when(F.col("vector").isNotNull(), first)).alias("first"))
        rows.select(*[c.name for c in StructType.fromDDL(SCHEMA)], self._part(F.col("entity_id")).alias("part")).write.parquet(staged)
        known, first = self.dimension(), seen.get["first"]
        if known is None and first:
            known = first["n"]
            self.spark.createDataFrame([(known,)], "dimension int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/dimension")
        rows = self.spark.read.parquet(staged)
        touched = [r[0] for r in split_dimension(rows, known or 0)[0].select("part").distinct().collect()]  # at most parts
        if touched:
            self._make_room(seen.get["n"])
            self._merge(split_dimension(_latest(rows.repartition(self.buckets, "id")), known)[0], touched)
        return split_dimension(_latest(rows), known or 0)[1].drop("part")

    def merged(self, new: DataFrame, touched: list[int]) -> DataFrame:
        """The rows of the touched folders with new ones: old rows stay in their buckets, new ones are dealt to these."""
        rest = [f.name for f in new.schema if f.name != "id"]
        packed = lambda df, c: df.select("id", F.struct(*rest).alias(c))
        both = packed(self.spark.table(self.table).where(F.col("part").isin(touched)), "old").join(packed(new, "new"), "id", "full_outer")
        row = F.when(F.col("new").isNull() | (F.col("old.seq") > F.col("new.seq")), F.col("old")).otherwise(F.col("new"))
        return both.select("id", row.alias("r")).select("id", "r.*")

    def _merge(self, new: DataFrame, touched: list[int]) -> None:
        conf, key = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(key)
        conf.set(key, "dynamic")
        try:
            self.merged(new, touched).select(self.spark.table(self.table).columns).write.mode("overwrite").insertInto(self.table)
        finally:
            conf.set(key, before)
        self.spark.catalog.refreshTable(self.table)
