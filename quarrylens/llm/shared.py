"""Helpers shared by the corpus operators: shared-folder tables and table readers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_root(spark: SparkSession) -> str:
    """Folder all executors and the driver see; only a local session where none is configured (tests) gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quarrylens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quarrylens/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        if at := getattr(df, "stored_at", None):
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(at)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced, else they stay until a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that a batch of very long texts stays small in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def held_out(column: Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus`` is 1; rows without an id (null) are held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == 1, F.lit(True))


def word_count(column: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts 0."""
    squeezed = F.regexp_replace(F.coalesce(column, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.length(squeezed) == 0, 0).otherwise(F.size(F.split(squeezed, r"[\x20\x09-\x0D]+"))).cast("long")
