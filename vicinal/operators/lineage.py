"""Cut a DataFrame's lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_dirs: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, on one machine, one
    of our own."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not context.getCheckpointDir():
        one_machine = context.master == "local" or context.master.startswith("local[")
        if not base and not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="vicinal-"))
    return base or context.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A URI of our own below the shared folder, deleted when the interpreter ends."""
    base = shared(spark)
    uri = f"{(base if '://' in base or base.startswith('file:') else f'file://{base}').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _dirs.append(uri)
    return uri


@atexit.register
def _clean() -> None:
    while _dirs:
        with suppress(Exception):
            fs, path = pafs.FileSystem.from_uri(_dirs.pop().replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))
            fs.delete_dir(path)


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and stored: what follows reads it as often as it likes
    and survives the loss of any executor."""
    shared(df.sparkSession)
    return df.checkpoint()
