"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and the master is local.

    On a cluster a folder of the driver's machine would be no shared one, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder once and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, made: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """made(df dealt by key) written once to the shared folder in a bucket a shuffle partition, and read back: joins by key don't move it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/leafmill-{mark}/{name}", f"leafmill_{mark}"
    made(df.repartition(parts, key)).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(table)
    atexit.register(remove, spark, path)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # forgets the name; the files are outside the warehouse and stay
    return found


def drop_scratch(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def exists(df: DataFrame) -> bool:
    """Whether all files of a scratch table are still there."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return all(p.getFileSystem(conf).exists(p) for p in paths)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch
        pass
