"""Where intermediate tables go, so that all executors see them and none is worked out twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir`` that all executors share; a local master without one has a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pressloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read from there: later uses start from the files and know their size."""
    path = new_path(rows.sparkSession, "kept")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
