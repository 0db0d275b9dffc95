"""Staged tables: intermediate results written once to the folder that all executors share.

Lineage is cut by writing Parquet and reading it back, so that a lost executor costs a reread and never
a recomputation of everything before. The folder is ``spark.checkpoint.dir`` of the session; only where
that is unset on a single machine (tests) a temporary folder is used instead; on a cluster that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="laminar-stage-"))
    return _LOCAL[0]


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from there.

    The shuffle files of the write go with its end; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/laminar-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _plain(path: str) -> str:
    """``path`` without its scheme and repeated slashes."""
    return re.sub(r"/+", "/", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", path)).rstrip("/")


def discard(*tables: DataFrame) -> None:
    """Remove the files of staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        root = _plain(shared_dir(spark)) + "/laminar-"
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if _plain(folder).startswith(root):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
