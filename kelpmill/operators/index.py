"""Indexing: overlapping chunks, their ids and hashed vectors, and an idempotent chunk index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from ..functions import vectors
from ..functions.text import normalize_whitespace, nullif_empty, or_empty, point_id

PLACES = "array<struct<bucket:int,weight:double>>"
CHUNK_SIZE, CHUNK_OVERLAP, DIMENSION, EMBEDDER = 800, 120, 384, "md5-bag"
COLLECTION = "document_chunks"
#: Texts that a model sees at once.
BATCH = 256


def reject(rows: DataFrame, bad: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects with a reason)."""
    bad = F.coalesce(bad, F.lit(False))
    return rows.where(~bad), rows.where(bad).withColumn("reason", F.lit(reason))


def reject_empty_text(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    return reject(documents, normalize_whitespace(F.col("text")) == "", "No indexable text was provided.")


def chunks(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """documents without text, with chunk_index and chunk: one row for each chunk.

    Windows of size code points start at every multiple of the step, whatever the text. One that doesn't reach the end
    is cut at its last space if that lies in its second half. Chunks are stripped, empty ones dropped. The text is cut
    into pieces of one step once, and a window is put together from its pieces, so long texts take time in proportion.
    """
    step = max(1, size - overlap)
    rest = [c for c in documents.columns if c != "text"]
    rows = documents.select(*rest, normalize_whitespace(F.col("text")).alias("norm")).where("norm <> ''").withColumn("len", F.length("norm"))
    last = F.when(F.col("len") <= size, 0).otherwise(F.least(F.ceil((F.col("len") - size) / F.lit(step)), F.floor((F.col("len") - 1) / F.lit(step))))
    rows = rows.select(*rest, "len", F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("steps"))
    window = lambda i: F.substring(F.array_join(F.slice("steps", i + 1, F.lit(-(-size // step))), ""), F.lit(1), F.lit(size))
    spans = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.struct(window(i).alias("w"), (i * step + size < F.col("len")).alias("open")))
    rows = rows.select(*rest, F.transform(spans, _cut).alias("all")).select(*rest, F.posexplode(F.filter("all", lambda c: c != "")).alias("chunk_index", "chunk"))
    return rows


def _cut(span: Column) -> Column:
    w = span["w"]
    at = F.length(w) - F.instr(F.reverse(w), " ")
    cut = span["open"] & (F.instr(w, " ") > 0) & (at > F.floor(F.length(w) / 2))
    return F.trim(F.when(cut, F.substring(w, F.lit(1), at.cast("int"))).otherwise(w))


def with_point_ids(chunked: DataFrame) -> DataFrame:
    key = F.concat_ws(":", or_empty(F.col("document_id")), or_empty(F.col("entity_id")), F.col("chunk_index").cast("string"), "chunk")
    return chunked.withColumn("id", point_id(key))


def _by_batch(rows: DataFrame, text_col: str, normal: bool, column: str, kind: str, made: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """rows without text_col, with a column that made works out from arrays of its lower-cased texts, whose tokens stand between single spaces."""
    norm = or_empty(F.col(text_col)) if normal else normalize_whitespace(F.col(text_col))
    given = rows.select(F.struct(*[rows[c] for c in rows.columns if c != text_col]).alias("row"), F.lower(norm).alias("text"))
    schema = StructType([given.schema["row"], StructField(column, DataType.fromDDL(kind))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in vectors.runs(batch.column(1)):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column(0), made(part.column(1))], ["row", column])

    return given.mapInArrow(mapped, schema).select("row.*", column)


def hash_places(rows: DataFrame, text_col: str, dimension: int = DIMENSION, normal: bool = False) -> DataFrame:
    """rows without text_col, with places, array<struct<bucket, weight>>: the non-zero places of the text's unit vector of hashed tokens; none for a text without tokens.

    normal: texts are chunks, whose white space is normalized. A batch's different tokens are hashed once.
    """
    return _by_batch(rows, text_col, normal, "places", PLACES, lambda texts: vectors.places_column(*vectors.hashed_places(texts, dimension), len(texts)))


def hash_weights(rows: DataFrame, text_col: str, dimension: int = DIMENSION, normal: bool = False) -> DataFrame:
    """rows without text_col, with bucket and weight: a row for each place of each text's vector."""
    rest = [c for c in rows.columns if c != text_col]
    return hash_places(rows, text_col, dimension, normal).select(*rest, F.explode("places").alias("place")).select(*rest, "place.bucket", "place.weight")


def embed_texts(rows: DataFrame, id_col: str, text_col: str, model=None, dimension: int = DIMENSION, batch_size: int = BATCH) -> DataFrame:
    """(id_col, vector): by hashed tokens, or by model, a function of a list of at most batch_size texts that makes a list of unit vectors.

    The model sees each different text once. One with a method `load` is loaded once for each worker; its failures are not covered up by
    hashed vectors, which live in another space. A null text counts as empty.
    """
    if model is None:
        return _by_batch(rows.select(id_col, text_col), text_col, False, "vector", "array<double>", lambda texts: vectors.dense_column(*vectors.hashed_places(texts, dimension), len(texts), dimension))

    texts = rows.select(id_col, or_empty(F.col(text_col)).alias("text")).withColumn("h", F.xxhash64("text"))

    def loaded():
        import numpy as np

        encode = model.load() if hasattr(model, "load") else model
        return lambda texts: np.array(encode(texts.tolist()), dtype=float)

    different = texts.select("h", "text").distinct()
    encoded = different.select("h", "text", predict_batch_udf(loaded, return_type=ArrayType(DoubleType()), batch_size=batch_size)("text").alias("vector"))
    return texts.join(encoded, ["h", "text"]).select(id_col, "vector")


def with_vectors(rows: DataFrame, model=None) -> DataFrame:
    """rows (id, text, ...) with vector, as embed_texts makes it. Hashed vectors are added where the rows are, without a shuffle."""
    if model is None:
        return _by_batch(rows.withColumn("hashed_text", F.col("text")), "hashed_text", False, "vector", "array<double>", lambda texts: vectors.dense_column(*vectors.hashed_places(texts, DIMENSION), len(texts), DIMENSION))
    return rows.join(embed_texts(rows.select("id", "text"), "id", "text", model), "id")


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def with_norm(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Of two arrays of numbers with their norms; 0 if either has no length."""
    return F.when(norm_a * norm_b == 0, 0.0).otherwise(dot(a, b) / (norm_a * norm_b))


def points(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The chunks of documents as index rows, without vectors."""
    found = with_point_ids(chunks(documents, size, overlap))
    return found.select("id", "document_id", "entity_id", "file_url", "chunk_index", F.col("chunk").alias("text"), "metadata")


def index_upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new points: the row of the highest seq for each id, whole; rows that no new point names stay."""
    both = index.unionByName(new)
    return both.groupBy("id").agg(F.max_by(F.struct(*[c for c in both.columns if c != "id"]), "seq").alias("r")).select("id", "r.*")


def split_dimension(new: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    return reject(new, F.size("vector") != dimension, "Vector dimension differs from the index.")


def document_name(metadata: Column, file_url: Column) -> Column:
    return F.coalesce(nullif_empty(F.try_variant_get(F.try_parse_json(metadata), "$.name", "string")), file_url)


def dimensions(index: DataFrame, by: str) -> DataFrame:
    """(by, dimension): the largest dimension of each group's vectors."""
    return index.groupBy(by).agg(F.max(F.size("vector")).cast("long").alias("dimension"))


def index_summary(documents: DataFrame, chunked: DataFrame, nodes: DataFrame, collection: str = COLLECTION) -> DataFrame:
    """A row for each accepted document: its chunks, and the graph's entity, document and edge. nodes (label, id, name) are those after the upsert."""
    counts = chunked.groupBy("document_id", "entity_id").agg(F.count("*").alias("chunks_indexed"))
    node = lambda label, id_col, name: nodes.where(F.col("label") == label).select(F.col("id").alias(id_col), F.struct("id", "name").alias(name))
    rows = documents.join(counts, ["document_id", "entity_id"]).join(node("Entity", "entity_id", "entity"), "entity_id").join(node("Document", "document_id", "document"), "document_id")
    edge = F.struct(F.col("entity_id").alias("from_id"), F.lit("Entity").alias("from_type"), F.lit("HAS_DOCUMENT").alias("relationship"), F.col("document_id").alias("to_id"), F.lit("Document").alias("to_type"))
    return rows.select(F.lit("ok").alias("status"), "document_id", "entity_id", "file_url", "metadata", "chunks_indexed", F.lit(collection).alias("collection"), F.struct("entity", "document", edge.alias("relationship")).alias("graph"))
