"""Session helpers: tables that cut lineage, and jobs that run side by side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; made up only for a local session without any.

    The setting alone is read where there is one, so that a remote session works too. A local folder is not
    visible to other machines, so a cluster session that names none is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sigscreen-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    A lost executor then costs no earlier step, later readers scan only the columns they
    need, and Spark knows the size of the table when it picks a join.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, steps: Sequence[Callable[[], object]]) -> list:
    """Run independent steps at the same time, so that the short stages of one fill the gaps of another."""
    with ThreadPoolExecutor(max_workers=max(1, len(steps))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]
        return [r.result() for r in running]
