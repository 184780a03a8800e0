"""What several operators share: checkpoints, integer ranks, joins with a side of checked size."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words everywhere in this subpackage.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows up to which a side that has been counted is broadcast.
BROADCAST_ROWS = 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a temporary one if Spark runs in this one process, as in tests; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that the cluster shares and read it from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df, whose keys are distinct, with each row's rank from 0 by keys as column name.

    A range sort places the rows, rows are numbered inside each partition, and the driver adds up one count per
    partition. The sorted rows are checkpointed first: the ranges of two runs may differ.
    """
    order = [k.asc_nulls_last() for k in keys]
    n = shuffle_partitions(df.sparkSession)
    rows = settle(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part, row = F.shiftright(F.col(name), 33), F.col(name).bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["c"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()}
    before, starts = 0, []
    for p in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(p, 0)
    if not starts:
        return rows
    return rows.withColumn(name, F.element_at(F.array(*map(F.lit, starts)), part.cast("int") + 1).cast("long") + row)


def join_counted(df: DataFrame, side: DataFrame, on: Column, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a settled side: broadcast if it has at most BROADCAST_ROWS rows, else left to Spark's shuffle join."""
    if (side.count() if rows is None else rows) <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, on, how)


def n_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null and empty text: 0. Split pieces, less an empty one at either end."""
    edge = lambda c: F.when(c.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0)
    pieces = F.size(F.split(text, SPACES)) - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(pieces).cast("long")
