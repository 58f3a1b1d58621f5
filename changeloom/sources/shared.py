"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, with its file system.

    Where it is unset, a session of one machine (``local[...]``) gets a folder of its own, and any other an error: what
    executors write to their own disks, others can't read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='changeloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if "://" not in path:
        path = path.removeprefix("file:")
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        path = f"{'file://' if default.startswith('file:') else default.rstrip('/')}{path}"
    return path.rstrip("/")


_written: list[str] = []


@atexit.register
def _clean_up() -> None:
    """Intermediate files go with the driver's process, where their store is one that it can reach."""
    for path in _written:
        try:
            store, root = pafs.FileSystem.from_uri(path)
            if store.get_file_info(root).type == pafs.FileType.Directory:
                store.delete_dir(root)
        except (pa.ArrowException, OSError):
            continue


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    _written.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _written[-1]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


class Scratch:
    """Intermediate tables by name, in the shared folder. Writing cuts the lineage, so a lost executor loses nothing."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, what: str) -> DataFrame:
        """Write and read back; a table of the same name that was there before is deleted after."""
        path, before = new_path(self.spark, what), self.paths.get(what)
        df.write.parquet(path)
        self.paths[what] = path
        if before:
            delete(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for what in names or list(self.paths):
            if path := self.paths.pop(what, None):
                delete(self.spark, path)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back, for as long as the driver runs."""
    return Scratch(df.sparkSession).write(df, what)
