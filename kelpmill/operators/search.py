"""Nearest chunks per question inside an entity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import vectors
from ..functions.text import or_empty, strip
from ..sources import folders
from .index import DIMENSION, PLACES, hash_places, reject

#: Questions and rows of one entity that meet in a cell.
QUESTIONS, ROWS = 256, 4096
#: Questions up to which each task gets all of them, and hits up to which they are broadcast; both are counted first.
SENT, BROADCAST_ROWS = 4096, 100_000


def reject_blank_question(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted questions, stripped; rejects as they came, with a reason)."""
    good, blank = reject(questions, strip(or_empty(F.col("question"))) == "", "question is required.")
    good, none = reject(good, F.col("top_k") < 1, "top_k must be positive.")
    return good.withColumn("question", strip(F.col("question"))), blank.unionByName(none)


def most_hits(questions: DataFrame) -> int:
    """The largest top_k: one number on the driver, by which each task keeps a part of the ranking only."""
    return questions.agg(F.max("top_k")).first()[0] or 0


def rank_hits(scored: DataFrame, most: int) -> DataFrame:
    """scored (question_id, id, score, top_k, ...) with rank, the best top_k of each question; ties by id. No top_k is above most."""
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= F.col("top_k")) & (F.col("rank") <= most))


def _dealt(questions: DataFrame, index: DataFrame, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (entity_id, i, j) in which they meet: a cell has some QUESTIONS of an entity and some ROWS of its rows. counted: the rows of index before their
    vectors were made, which aren't made for counting."""
    blocks = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    sizes = questions.groupBy("entity_id").agg(F.count("*").alias("q")).join((index if counted is None else counted).groupBy("entity_id").agg(F.count("*").alias("r")), "entity_id")
    sizes = sizes.select("entity_id", blocks("q", QUESTIONS).alias("q"), blocks("r", ROWS).alias("r"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = questions.join(sizes, "entity_id").withColumns({"i": own("question_id", "q"), "j": every("r")}).drop("q", "r")
    rows = index.join(sizes, "entity_id").withColumns({"j": own("id", "r"), "i": every("q")}).drop("q", "r")
    return asked, rows


def scored(questions: DataFrame, index: DataFrame, all_pairs: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """(question_id, id, top_k, score): of each cell the best top_k rows of each question, or all pairs of an entity.

    questions (question_id, entity_id, top_k, vector) and index (id, entity_id, vector) are dealt to cells of bounded size, in which two
    matrices are multiplied. A vector is array<double> or array<struct<bucket, weight>>. Vectors of unlike length, or null, don't meet.
    """
    n = folders.partitions(index.sparkSession)
    asked = questions.select("question_id", F.col("entity_id").alias("entity_id"), "top_k", F.col("vector").alias("vector"))  # both sides may be of one table
    asked, rows = _dealt(asked, index.select("id", "entity_id", "vector"), counted)
    cell = ["entity_id", "i", "j"]
    sparse = index.schema["vector"].dataType.simpleString() == PLACES
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((questions, "question_id"), (index, "id"))]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        of_left, of_right = (np.zeros(len(t), np.int64) if sparse else vectors.lengths(t.column("vector")) for t in (left, right))
        for size in np.intersect1d(of_left, of_right[of_right >= 0]):
            a, b = left.filter(of_left == size), right.filter(of_right == size)
            dimension = DIMENSION if sparse else int(size)
            scores = vectors.cosines(vectors.matrix(a.column("vector"), dimension), vectors.matrix(b.column("vector"), dimension))
            if all_pairs:
                asked, row = (x.ravel() for x in np.indices(scores.shape))
            else:
                asked, row = vectors.nearest(scores, pc.rank(b.column("id"), tiebreaker="first").to_numpy(), a.column("top_k").to_numpy())
            found.append(pa.table({"question_id": a.column("question_id").take(asked), "id": b.column("id").take(row), "top_k": a.column("top_k").take(asked), "score": scores[asked, row]}))
        return pa.concat_tables(found) if found else pa.table({"question_id": left.column("question_id")[:0], "id": right.column("id")[:0], "top_k": left.column("top_k")[:0], "score": pa.array([], pa.float64())})

    grouped = [side.repartition(n, *cell).groupBy(*cell) for side in (asked, rows)]
    return grouped[0].cogroup(grouped[1]).applyInArrow(best, f"question_id {kinds[0]}, id {kinds[1]}, top_k int, score double")


def scored_dense(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(question_id, id, top_k, score) of every question and every index row of its entity."""
    return scored(questions, index, all_pairs=True)


def knn_dense(questions: DataFrame, index: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Questions and index rows of one entity, with vectors: (question_id, id, score, rank). counted: see _dealt."""
    return rank_hits(scored(questions, index, counted=counted), most_hits(questions)).select("question_id", "id", "score", "rank")


def _best(found: pa.Table) -> pa.Table:
    """found (question_id, id, top_k, score) with the best top_k rows of each question."""
    found = found.sort_by([("question_id", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
    codes = pc.rank(found.column("question_id"), tiebreaker="min").to_numpy().astype(np.int64)
    return found.filter(pa.array(np.arange(1, len(found) + 1) - codes < found.column("top_k").to_numpy()))


def _found_here(asked: pa.Table, kind: str, chunks: DataFrame) -> DataFrame:
    """(question_id, id, top_k, score): of the chunks that a task reads the best top_k of each question. asked (question_id of that kind, entity_id, top_k, vector) goes to every
    task, which scores its chunks as it hashes them: no vector is moved, and what is ranked at last are top_k rows of each question and task."""
    of: dict = {}
    for entity in pc.unique(asked.column("entity_id")).drop_null().to_pylist():
        own = asked.filter(pc.equal(asked.column("entity_id"), entity))
        blocks = [own.slice(at, QUESTIONS).combine_chunks() for at in range(0, len(own), QUESTIONS)]
        of[entity] = [(b.select(["question_id", "top_k"]), vectors.matrix(b.column("vector"), DIMENSION)) for b in blocks]
    most = 2 * int(pc.sum(asked.column("top_k")).as_py() or 0) + 100_000

    def mapped(batches):
        held: list[pa.Table] = []
        for batch in batches:
            for at, n in vectors.runs(batch.column("text")):
                part = batch.slice(at, n)
                table = np.zeros((n, DIMENSION))
                row, bucket, weight = vectors.hashed_places(part.column("text"), DIMENSION)
                table[row, bucket] = weight
                entities = part.column("entity_id").dictionary_encode()
                codes = pc.fill_null(entities.indices, -1).to_numpy()
                for code, entity in enumerate(entities.dictionary.to_pylist()):
                    rows = np.flatnonzero(codes == code)
                    ids = part.column("id").take(pa.array(rows))
                    order = pc.rank(ids, tiebreaker="first").to_numpy()
                    for questions, matrix in of.get(entity, []):
                        scores = vectors.cosines(matrix, table[rows])
                        q, r = vectors.nearest(scores, order, questions.column("top_k").to_numpy())
                        held.append(pa.table({"question_id": questions.column("question_id").take(pa.array(q)), "id": ids.take(pa.array(r)), "top_k": questions.column("top_k").take(pa.array(q)), "score": scores[q, r]}))
                if sum(map(len, held)) > most:
                    held = [_best(pa.concat_tables(held))]
        if held:
            yield from _best(pa.concat_tables(held)).to_batches()

    return chunks.mapInArrow(mapped, f"question_id {kind}, id {chunks.schema['id'].dataType.simpleString()}, top_k int, score double")


def knn_sparse(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same over hashed tokens of questions (question_id, entity_id, top_k, question) and chunks (id, entity_id, text). Chunk ids are distinct; chunks without a common token score 0.

    Up to SENT questions go to the tasks that read the chunks; more meet them in cells.
    """
    asked = hash_places(questions.select("question_id", "entity_id", "top_k", "question"), "question").withColumnRenamed("places", "vector")
    rows = chunks.select("id", "entity_id", "text")
    if questions.count() <= SENT:
        known = rows.join(F.broadcast(questions.select("entity_id").distinct()), "entity_id", "left_semi")
        found = _found_here(asked.toArrow(), asked.schema["question_id"].dataType.simpleString(), known.select("id", "entity_id", F.lower(or_empty(F.col("text"))).alias("text")))
        return rank_hits(found, most_hits(questions)).select("question_id", "id", "score", "rank")
    index = hash_places(rows, "text", normal=True).withColumnRenamed("places", "vector")
    return knn_dense(asked, index, rows)


def collect_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunks): the hits of each question in order, with all that the index holds of them but vectors. The chunks are read where they are, unless there are very many hits."""
    hit = F.struct("rank", "score", "id", "document_id", "entity_id", "file_url", "chunk_index", "text", "metadata")
    hits = folders.settled(hits)
    few = hits.count() <= BROADCAST_ROWS
    return chunks.join(F.broadcast(hits) if few else hits, "id").groupBy("question_id").agg(F.array_sort(F.collect_list(hit)).alias("chunks"))
