"""Ranked lexical search: the best documents of each item of a query set, by integer scores.

Documents are restricted to the items' vocabulary. What is left of a document is its bag: its terms with their
frequencies, and a number m for its length. Equal bags are one class, found by hash and verified by content, whose score is
worked out once for each item; its members follow by ascending id.

The vocabulary goes to the tasks, so items are taken in blocks whose pairs of item and term are counted and bounded. A task
scores all items of a block against a run of classes at a time and keeps the best of each item only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .words import slices

TOP = 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Pairs of item and term that a task holds, on average over the blocks; one more block for each so many.
HELD = 200_000
#: Classes, and pairs of item and term, that are scored at once.
RUN, PAIRS = 512, 8192
#: Stands for a null id in a task, behind all others.
LAST = 2**63 - 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 in which only terms are left, in lower case, between spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: Column) -> Column:
    """array<string>: the terms of a text, in order; none if it is null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, bag) per row: n counts all terms; bag has a pair of 32-bit integers, number and frequency, for each term of the vocabulary, in order."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sizes, found, held = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().translate(_TERMS).split()
                own = [k for k in map(vocabulary.get, words) if k is not None]
                sizes.append(len(words))
                held.append(len(own))
                found += own
            keys = np.repeat(np.arange(len(held), dtype=np.int64) << 32, held) | np.array(found, np.int64)
            keys, counts = np.unique(keys, return_counts=True)
            pairs = np.stack([keys & 0xFFFFFFFF, counts], axis=1).astype("<i4")
            edges = np.searchsorted(keys >> 32, np.arange(len(held) + 1))
            own = [pairs[low:high].tobytes() for low, high in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(own, pa.binary())], ["id", "n", "bag"])

    return rows.mapInArrow(made, "id long, n long, bag binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of a column of bags."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // 8
    pairs = np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), pairs[:, 0], pairs[:, 1]


def document_counts(found: DataFrame) -> DataFrame:
    """(term, df): the documents that hold each term; pre-aggregated in each batch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, df = np.unique(_pairs(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df, pa.int64())], ["term", "df"])

    return found.select("bag").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def classes_of(found: DataFrame, top: int) -> DataFrame:
    """(m, bag, ids) of found (id, m, bag): a row for each different bag that isn't empty, with its top smallest ids."""
    keyed = found.where(F.length("bag") > 0).withColumn("h", F.xxhash64("m", "bag"))
    kind = ["h", "m", "bag"]  # the hash finds the class, m and bag verify it
    nth = F.row_number().over(Window.partitionBy(*kind).orderBy(F.col("id").asc_nulls_last()))
    firsts = keyed.withColumn("nth", nth).where(F.col("nth") <= top).select(*kind, F.coalesce("id", F.lit(LAST)).alias("id"))
    return firsts.groupBy(*kind).agg(F.sort_array(F.collect_list("id")).alias("ids")).drop("h")


class _Best:
    """The best (score, id) of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, np.int64)
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.id, doc])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        self.item, self.score, self.id = item[nth < self.top], score[nth < self.top], doc[nth < self.top]
        last = np.flatnonzero(nth == self.top - 1)
        self.least[item[last]] = score[last]


def best_of(classes: DataFrame, weights: np.ndarray, of_items: list[np.ndarray], top: int) -> DataFrame:
    """(nth, score, id): from each task the top documents of every item with a score above 0; nth is the item's place in of_items, its terms' numbers."""
    sizes = np.array([len(t) for t in of_items])
    owner, asked = np.repeat(np.arange(len(of_items)), sizes), np.concatenate(of_items)
    cuts = [0, *[k for k in range(1, len(owner)) if owner[k] != owner[k - 1]], len(owner)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(of_items), top)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                m, ids = part.column(0).to_numpy(), part.column(2)
                row, term, tf = _pairs(part.column(1))
                used, place = np.unique(term, return_inverse=True)
                table = np.zeros((len(used) + 1, len(m)), np.int64)  # the last row is of terms that no class here has
                table[place, row] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                where = np.minimum(np.searchsorted(used, asked), len(used) - 1)
                where[used[where] != asked] = len(used)
                first = 0
                while first < len(cuts) - 1:  # whole items, of about PAIRS terms
                    last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + PAIRS, side="right")) - 1)
                    low, high = cuts[first], cuts[last]
                    sums = np.add.reduceat(table[where[low:high]], np.array(cuts[first:last]) - low, axis=0)
                    own = owner[np.array(cuts[first:last])]
                    floor = np.maximum(best.least[own], 1)
                    if len(m) > top:
                        floor = np.maximum(floor, np.partition(sums, len(m) - top, axis=1)[:, len(m) - top])
                    item, column = np.nonzero(sums >= floor[:, None])
                    score = sums[item, column]
                    chosen = ids.take(pa.array(column))
                    n = pc.list_value_length(chosen).to_numpy(zero_copy_only=False)
                    best.add(np.repeat(own[item], n), np.repeat(score, n), chosen.flatten().to_numpy(zero_copy_only=False))
                    first = last
        columns = [pa.array(best.item.astype(np.int32)), pa.array(best.score), pa.array(best.id)]
        yield pa.RecordBatch.from_arrays(columns, ["nth", "score", "id"])

    return classes.select("m", "bag", "ids").mapInArrow(scored, "nth int, score long, id long")


def _searched(docs: DataFrame, asked: list[tuple], schema: str, top: int, id_col: str, text_col: str) -> DataFrame:
    """One block of items: asked has (item, its terms)."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t.encode() for _, words in asked for t in words}))}
    found = settle(bags(docs, vocabulary, id_col, text_col))
    n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_terms:
        return spark.createDataFrame([], f"{schema}, rank int, id long, score long")
    weights = np.zeros(len(vocabulary), np.int64)
    for r in document_counts(found).collect():  # one row for each term of the block
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    m = F.expr(f"cast(10 + (90 * n * {n_docs}L) div {n_terms}L as long)")
    classes = classes_of(found.select("id", m.alias("m"), "bag"), top)
    scored = best_of(classes, weights, [np.array(sorted(vocabulary[t.encode()] for t in words), np.int64) for _, words in asked], top)
    order = Window.partitionBy("nth").orderBy(F.col("score").desc(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(asked)], f"nth int, {schema}")
    shown = F.when(F.col("id") != LAST, F.col("id")).alias("id")
    return ranked.join(F.broadcast(names), "nth").select(names.columns[1], "rank", shown, "score")  # at most HELD items or so


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the top documents of each item, equal scores by ascending id, null ids last.

    Ids are integers below LAST. Rows of one item are one item with the terms of all their texts, once each; items without a
    scoring document (null or empty texts, unknown terms) have no rows. Repeated rows of documents are documents of their own. Documents with a
    null or empty text hold no term. No documents or no items give no rows. Other columns are ignored.
    """
    pairs = settle(items.select(items[item_col].alias("item"), F.explode(terms(items[item_text_col])).alias("term")).distinct())
    blocks = -(-pairs.count() // HELD)
    schema = f"{item_col} {items.schema[item_col].dataType.simpleString()}"
    out = docs.sparkSession.createDataFrame([], f"{schema}, rank int, id long, score long")
    for k in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).groupBy("item").agg(F.collect_list("term").alias("terms"))
        asked = [(r["item"], r["terms"]) for r in block.collect()]  # HELD terms on average
        if asked:
            found = _searched(docs, asked, schema, top, id_col, text_col)
            out = found if blocks == 1 else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS l FROM documents
), g AS (
  SELECT count(*) FILTER (len(l) > 0) AS n_docs, sum(len(l))::BIGINT AS n_terms FROM d
), f AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(l) AS term FROM d) GROUP BY ALL
), v AS (
  SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM f, g GROUP BY term
), s AS (
  SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(l) * n_docs) // n_terms))))::BIGINT AS score
  FROM v JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), g GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""
QUERIES = {"op13_lexical_search": (op13_lexical_search, ORACLE_SQL)}
