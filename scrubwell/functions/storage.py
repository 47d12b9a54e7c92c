"""Where intermediate results may be written, and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach.

    It is the one named in ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary
    folder, which goes when the process ends; on a cluster such a folder would be invisible to the other machines, so
    there the setting is required, and cleaning it is left to its owner.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        made = tempfile.mkdtemp(prefix="scrubwell-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context.setCheckpointDir(made)
        current = context.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
