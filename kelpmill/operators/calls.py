"""Calls of outside models: prompts answered side by side, and a table of answers from which a later run goes on."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "http_status int, body string, transport_error string, attempts int"
#: Seconds that a call may take.
TIME_LIMIT = 120.0
#: Calls that a task has open at once, further attempts after a failure, and prompts whose answers are written together.
AT_ONCE, RETRIES, SLICE = 8, 0, 100_000


def answered(status: Column, error: Column) -> Column:
    """Whether an answer stands; others, and those that the server may give differently later, are asked again."""
    return error.isNull() & ((status < 500) & (status != 429))


def _asked(complete: Callable, messages: list[dict], retries: int) -> tuple[int | None, str | None, str | None, int]:
    """(status, body, error, attempts) of one prompt; complete gives a body, or a status with it."""
    for attempt in range(1, retries + 2):
        try:
            given = complete(messages)
        except Exception as error:  # the row's result, not a failure of the job
            found = (None, None, str(error) or type(error).__name__, attempt)
        else:
            status, body = given if isinstance(given, tuple) else (200, given)
            found = (status, body, None, attempt)
            if status < 500 and status != 429:
                break
    return found


def complete_prompts(prompts: DataFrame, complete: Callable, id_col: str = "request_id", partitions: int | None = None, at_once: int = AT_ONCE, time_limit: float = TIME_LIMIT, retries: int = RETRIES) -> DataFrame:
    """(request_id, http_status, body, transport_error, attempts): complete is called for each row's messages; what it raises is the row's error.

    A task has at most at_once calls open. A call that isn't back after time_limit seconds from its start, attempts included, is the row's error; its
    thread is left to end by itself.
    """
    rows = prompts.select(F.col(id_col).alias("request_id"), "messages")

    def called(frames: Iterator) -> Iterator:
        import pandas as pd

        pool = ThreadPoolExecutor(at_once)
        for frame in frames:
            began: dict[int, float] = {}

            def run(k: int, given: list, began: dict = began) -> tuple:
                began[k] = time.monotonic()
                return _asked(complete, [dict(m) if isinstance(m, dict) else m.asDict() for m in given], retries)

            waiting = [pool.submit(run, k, given) for k, given in enumerate(frame["messages"])]
            out = []
            for k, (key, future) in enumerate(zip(frame["request_id"], waiting, strict=True)):
                while not future.done() and time.monotonic() < began.get(k, time.monotonic()) + time_limit:
                    time.sleep(0.001)
                if future.done():
                    out.append((key, *future.result()))
                else:
                    out.append((key, None, None, f"no answer in {time_limit:g} seconds", 1))
                    pool, late = ThreadPoolExecutor(at_once), pool  # threads that hang don't hold up the rest
                    late.shutdown(wait=False, cancel_futures=True)
                    waiting[k + 1 :] = [f if f.done() or not f.cancelled() else pool.submit(run, n, frame["messages"].iloc[n]) for n, f in enumerate(waiting[k + 1 :], k + 1)]
            yield pd.DataFrame(out, columns=["request_id", "http_status", "body", "transport_error", "attempts"]).astype({"http_status": "Int32", "attempts": "int32"})
        pool.shutdown(wait=False)

    return (rows.repartition(partitions) if partitions else rows).mapInPandas(called, f"request_id string, {ANSWER}")


class Answers:
    """A table of answers by the hash of the messages, in a folder that Spark can read and write; every run and slice of it has its own part."""

    SCHEMA = f"prompt string, {ANSWER}, run int, slice int"

    def __init__(self, path: str):
        self.path = path

    def _all(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.SCHEMA)

    def read(self, spark: SparkSession) -> DataFrame:
        """The last answer of each prompt, with how many attempts all runs took."""
        rest = ["http_status", "body", "transport_error"]
        return self._all(spark).groupBy("prompt").agg(F.max_by(F.struct(*rest), "run").alias("a"), F.sum("attempts").cast("int").alias("attempts")).select("prompt", "a.*", "attempts")

    def resume(self, prompts: DataFrame, complete: Callable, id_col: str = "request_id", slice_rows: int = SLICE, **how) -> DataFrame:
        """complete_prompts for what has no answer yet, each different prompt once; then (request_id, ANSWER) of all prompts.

        Answers are written slice by slice, so a run that breaks off keeps the slices that were through. Prompts whose
        answer doesn't stand are asked again.
        """
        spark = prompts.sparkSession
        hashed = prompts.select(F.col(id_col).cast("string").alias("request_id"), F.sha2(F.to_json("messages"), 256).alias("prompt"), "messages")
        known = self.read(spark).where(answered(F.col("http_status"), F.col("transport_error"))).select("prompt")
        missing = hashed.groupBy("prompt").agg(F.first("messages").alias("messages")).join(known, "prompt", "left_anti")
        n, last = missing.count(), self._all(spark).agg(F.max("run")).first()[0]
        run, slices = 0 if last is None else last + 1, -(-n // slice_rows)
        for k in range(slices):
            part = missing.where(F.pmod(F.xxhash64("prompt"), F.lit(slices)) == k)
            given = complete_prompts(part, complete, "prompt", **how).withColumnRenamed("request_id", "prompt")
            given.write.mode("overwrite").parquet(f"{self.path}/run={run}/slice={k}")
        return hashed.join(self.read(spark), "prompt").select("request_id", *[c.split()[0] for c in ANSWER.split(", ")])
