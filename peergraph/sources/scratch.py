"""Tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured row count is at most this.
BROADCAST_ROWS = 20_000


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder given to ``setCheckpointDir``.

    Where neither is set, a session in one JVM (tests, a laptop) makes a temporary folder
    of its own; a cluster fails with a message.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_peergraph_scratch", None):
        sc._peergraph_scratch = "file://" + tempfile.mkdtemp(prefix="peergraph-")
    return sc._peergraph_scratch


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table, marked for broadcast when its row count proves it small."""
    kept = table(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
