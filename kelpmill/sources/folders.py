"""The folder that all executors share, and tables written there once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder if Spark runs in this one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"


def written_once(df: DataFrame) -> DataFrame:
    """df by way of the shared folder, for tables that are read several times: executors that are lost take nothing along. Its partitions are
    evened out first: a few rows of the input may have become most of the table."""
    return settled(df.repartition(partitions(df.sparkSession)))


def settled(df: DataFrame) -> DataFrame:
    """df by way of the shared folder, partitioned as it is."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
