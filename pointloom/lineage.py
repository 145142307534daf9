"""Cutting the lineage of iterative operators in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession, name: str) -> str:
    """A new path for files in the folder that driver and executors share."""
    return f"{_shared(session)}/{name}-{uuid.uuid4().hex}"


def _shared(session: SparkSession) -> str:
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        shared = session.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pointloom-"))
    return context.getCheckpointDir()


#: The folder of written tables of each application.
_roots: dict[str, str] = {}


def _drop(session: SparkSession, root: str) -> None:
    try:
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may already be gone at exit
        pass


def cut(df: DataFrame) -> DataFrame:
    """df, computed and held as a table in the shared folder of spark.checkpoint.dir until the end of the application; where
    that is unset, sessions whose executors run in the driver's process take a folder of this machine, and others must name one.

    A table and not checkpoint(): a checkpointed plan carries the size estimate of the plan that it replaces, a product of
    its joins' sizes, so that over many rounds the estimate becomes a number of megabytes, with which every later plan
    reckons. A table's size is that of its files, by which joins with small tables become broadcasts."""
    session = df.sparkSession
    application = session.sparkContext.applicationId
    if application not in _roots:
        _roots[application] = shared_folder(session, "cut")
        atexit.register(_drop, session, _roots[application])
    path = f"{_roots[application]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)
