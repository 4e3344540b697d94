"""Where intermediate tables live.

Lineage is cut only through reliable storage: the folder the cluster names in
``spark.checkpoint.dir``. Only a local-mode session without that setting gets a
temporary folder, as in the tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rowmend import errors


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise errors.DataError(
                    errors.INVALID_INPUT,
                    "set spark.checkpoint.dir to a folder every executor can reach",
                    field="spark.checkpoint.dir",
                )
            folder = tempfile.mkdtemp(prefix="rowmend-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def give_back(spark: SparkSession, *paths: str) -> None:
    """Free the space of written tables that nothing reads any more."""
    for path in paths:
        spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise reliably; later plans read the files, not the steps behind them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
