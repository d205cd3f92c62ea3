"""Shared scratch tables: how lineage is cut so that a lost executor costs one stage, not the job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession



def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where `spark.checkpoint.dir` is unset, a folder is made only in local mode, in which driver and executors are
    one process; on a cluster that is an error, as a machine-local folder would be invisible to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="lodestar-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


#: Tables written by this process, by application, for `release`.
_WRITTEN: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the scratch tables that this process has written for this application; how many there were.

    Results that were not yet read or written rest on them, so call it when these are done with.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, label: str = "table", batch_rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder as Parquet and return the table read back, with its lineage cut.

    With batch_rows, Python workers get at most so many rows at once while the table is written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(_BATCH)
    if batch_rows:
        spark.conf.set(_BATCH, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)
