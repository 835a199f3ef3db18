"""Helpers shared by the operators: scratch tables, measured broadcasts, words."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only when its measured row count is at most this.
BROADCAST_ROWS = 20_000


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words; null text counts as empty.

    Collapsing every word to one mark and dropping the white space is cheaper
    than materialising the words as an array.
    """
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(marks, " \t\n\u000b\f\r", "")).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the folder given to ``SparkContext.setCheckpointDir``; where
    there is neither, a session in one JVM (tests, a laptop) makes a temporary folder of
    its own, and a cluster fails with a message.
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


#: Bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches end at ``BATCH_BYTES``: a batch is held several times, in the JVM and as Python objects.

    A setting of the session, as plans are run after the operator has returned; a smaller one stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower()
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = now.rstrip("bkmg")
    unit = now[len(digits) :].rstrip("b")
    if int(digits) * scale.get(unit, 1) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that this worker has freed to the system, where the C library can: an idle worker otherwise keeps it."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Free the disk of shuffles whose results have been written down.

    Spark removes a shuffle's files when the driver's collector finds that nothing refers
    to it, which a driver with little to do may put off until the job is over.
    """
    for _ in range(2):  # what the first pass frees may have held what the second one finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when its measured row count proves it small."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``'s columns, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{stem}{n}"
    return name


#: Keys that hold more than this share of a table's rows are dealt over several tasks; there are at most 1 / share of them.
HOT_SHARE = 1 / 2_000
SALTS = 64


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str, total: int, deal: list[str]) -> DataFrame:
    """Inner join on the columns ``keys``, which both sides have, with hot keys dealt over ``SALTS`` tasks.

    ``small`` is a written table with one row to a key; its column ``rows`` (dropped here) is
    the number of rows that ``big`` has of the key, out of ``total``.  The hot keys are at
    most ``1 / HOT_SHARE``, whatever the input, and are sent to every task; their rows of
    ``big`` are dealt by a hash of the columns ``deal`` and their rows of ``small`` repeated.
    """
    hot = small.where(F.col(rows) > F.lit(max(total * HOT_SHARE, 100.0)))
    salt, flag = "__salt_of_join", "__hot_of_join"
    marked = big.join(F.broadcast(hot.select(*keys, F.lit(True).alias(flag))), keys, "left").withColumn(
        salt, F.when(F.col(flag), F.pmod(F.xxhash64(*deal), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    ).drop(flag)
    copies = F.when(F.col(rows) > F.lit(max(total * HOT_SHARE, 100.0)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(small.withColumn(salt, F.explode(copies)).drop(rows), [*keys, salt]).drop(salt)
