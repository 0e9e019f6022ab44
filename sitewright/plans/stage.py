"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is only made where none
    is set and all executors are this machine's, as in tests. Partitioning and the order inside partitions stay.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the import path of the session's Python workers.

    Workers on this machine, or on others that see the folder under the same path, then need no installation. Elsewhere
    install the package or ship it with ``addPyFile``.
    """
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, known) if x)
