"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's reader alone touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by a key to ``spark.sql.shuffle.partitions`` tasks, for work that costs far more than its rows are large.

    Few bytes would else be one task: a small file is one split, and adaptive execution joins small partitions.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *key)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only in a local session without it, as in tests."""
    found = spark.conf.get(SHARED_CONF, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_CONF} to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="leafmark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(SHARED_CONF, own)
    return own


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/leafmark-{uuid.uuid4().hex}/{name}"
    _delete_at_exit(spark, path.rsplit("/", 1)[0])
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table written by ``materialize`` once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Cuts the lineage: what follows starts from committed files, so a lost
    executor costs the tasks it was running and no more.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table that ``materialize`` gave, once nothing reads it any more."""
    remove(df.sparkSession, df.written_to)
