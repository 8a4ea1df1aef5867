"""Session helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Rows of a batch for Python workers, unless the session says otherwise: texts of a few kilobytes then take a few megabytes.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application, and batches of bounded size."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":  # the default
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir). Only a local master may do without the setting: it gets a
    folder under the temp directory; on a cluster that would be a folder of one machine, so it raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master or "").split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = os.path.join(tempfile.gettempdir(), "checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own in the shared checkpoint folder, deleted at the end."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system with all in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
