"""What the operators share: the shared folder, tables that cut lineage, and columns under safe names."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quaymark-')}"
    return f"{base.rstrip('/')}/quaymark-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Spark removes the shuffle files of what is run inside as soon as it ends, instead of whenever the driver's memory is
    collected. Only for what is written: a result that is read later still needs them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(df: DataFrame, at: str, name: str) -> DataFrame:
    """Writes df as Parquet below the folder and reads it back: later plans start from files that every executor can read."""
    path = f"{at}/{name}"
    with tidy(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, at: str, *names: str) -> None:
    """Removes tables of the folder that nothing reads any more: what was made of them has been written."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
