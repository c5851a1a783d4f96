"""Session helpers: where shared intermediate files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's checkpoint directory.

    The folder named by ``spark.checkpoint.dir`` is used when the session has
    one. Only a ``local`` master may fall back to a temporary folder: on a
    cluster executors could not see it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="sparkwarden-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that owns a checkpoint; it stays when the query is started again."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, in whatever store Spark finds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
