"""Where intermediate results go so that a lost executor costs no rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three numbers that may be broadcast, some 16 to 32 MB.
LOOKUP_ROWS = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    ``spark.checkpoint.dir`` wins. Only where it is unset is one chosen: a
    temporary folder on a local master, a folder beside the warehouse elsewhere.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rsplit("/", 1)[0]
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        local = context.master.startswith("local") and "cluster" not in context.master
        folder = tempfile.mkdtemp(prefix="pressloom-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    context.setCheckpointDir(folder)
    return folder


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read from there."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a few numbers for each ``key``, or nulls.

    The table of ``n`` rows, or of as many as are counted, is broadcast if these
    are ``LOOKUP_ROWS`` at most; a larger one meets the rows in a shuffled join,
    whose large keys adaptive execution splits.
    """
    if n is None:
        table = checkpointed(table)
        n = table.count()
    return rows.join(F.broadcast(table) if n <= LOOKUP_ROWS else table, key, "left")
