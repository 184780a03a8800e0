"""Mixing sources to target weights: token totals per source, repetition rates, hash-seeded copies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, n_words, ranked, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(src, source_size, target) from (src, size): weights repeat over the sources by code point, null last.

    A target is min(most * source_size, level * weight); the level at which the targets add up to share * all sizes is
    found by rounds that set the sources above their bound aside and share the rest anew. The driver holds three
    numbers a round.
    """
    table = ranked(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), [F.col("src")], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    table = settle(table.select("src", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * most).alias("bound")))
    wanted = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, aside = 0.0, -1
    while True:
        full = F.col("bound") <= F.lit(level) * F.col("weight")
        got = table.agg(F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("aside")).first()
        if got["aside"] == aside or not got["free"]:
            break
        aside, level = got["aside"], (wanted - got["held"]) / got["free"]
    return table.select("src", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("bound").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def draw(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the id alone, so reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **targets) -> DataFrame:
    """docs as struct column doc, with size, source_size, target and copies: floor(rate), and one more if the draw is below the fraction.

    Null text: size 0. Null source: a source of its own, the last. A source of size 0 gives no copies. Rows repeated with
    one id share one draw. Other columns stay inside doc, whatever their names.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[source_col].alias("of"), n_words(docs[text_col]).alias("size"))
    table = settle(source_targets(docs.select(docs[source_col].alias("src"), n_words(docs[text_col]).alias("size")), **targets))
    rows = join_counted(rows, table, F.col("of").eqNullSafe(F.col("src")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate)
    extra = F.when(draw(F.col("doc")[id_col], seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.select("doc", "size", "source_size", "target", (F.floor("rate") + extra).cast("int").alias("copies"))


def mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as it is taken."""
    return with_copies(docs, **kwargs).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = with_copies(docs)
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 2 * source_size AS bound, 2 * source_size / weight AS ratio, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k FROM s
), l AS (
  SELECT o.*, (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(bound) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  SELECT source, source_size, least(bound::DOUBLE, (SELECT min_by(level, k) FROM l WHERE level < ratio) * weight) AS target FROM o
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken FROM r
"""
QUERIES = {"op3_mixing": (op3_mixing, ORACLE_SQL)}
