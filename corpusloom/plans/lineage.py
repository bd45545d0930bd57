"""Cutting a plan's lineage in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    ``spark.checkpoint.dir`` wins.  Only a single-process session (``local`` or
    ``local[n]``) that names none gets a temporary one; on a cluster that is an
    error, because a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder, read from there after."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; plans that read it can't run any more."""
    sc = df.sparkSession.sparkContext
    written = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if written.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(written.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
