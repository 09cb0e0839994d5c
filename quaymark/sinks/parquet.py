"""Typed Parquet writing and verification. Spark's committer publishes a folder only when every task has committed."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.config import ConfigError
from quaymark.functions.exprs import col, override


class DatasetNotFound(RuntimeError):
    pass


@dataclass(frozen=True)
class WriteResult:
    path: str
    rows: int
    columns: list[str]
    schema: dict[str, str]


def with_overrides(df: DataFrame, overrides: dict[str, str] | None) -> DataFrame:
    overrides = overrides or {}
    if gone := [c for c in overrides if c not in df.columns]:
        raise ConfigError(f"overrides for unknown columns {gone}")
    return df.select(*[override(c, overrides[c]) if c in overrides else col(c) for c in df.columns])


def write(df: DataFrame, path: str, overrides: dict[str, str] | None = None, compression: str = "snappy") -> WriteResult:
    """Writes with the casts applied; columns without a type become text. Rows are counted while they are written."""
    typed = with_overrides(df, overrides)
    typed = typed.select(*[col(c).cast("string").alias(c) if t == "void" else col(c) for c, t in typed.dtypes])
    from pyspark.sql import Observation

    seen = Observation()
    typed.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", compression).parquet(path)
    return WriteResult(path, int(seen.get["n"]), typed.columns, dict(typed.dtypes))


def open_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Lazy scan; a missing path is an error at once."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        raise DatasetNotFound(f"Dataset not found: {path}")
    return spark.read.parquet(path)


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted SHA-256 of the dataset's files, which executors read in pieces. Names, which change from write
    to write, don't matter."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(name)
                h = hashlib.sha256()
                with files.open_input_stream(at) as f:
                    while part := f.read(8 << 20):
                        h.update(part)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["sha256"])

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return names.mapInArrow(run, "sha256 string").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256)).head()[0]  # a line a file


def verify(spark: SparkSession, path: str, expected_rows: int | None = None, expected_columns=None, digest: bool = True) -> dict:
    """Row count from the footers, the set of column names and a digest; the first two against what was expected (None: anything)."""
    df = open_dataset(spark, path)
    n = df.count()
    return {
        "sha256": checksum(spark, path) if digest else None,
        "rows": n,
        "columns": df.columns,
        "rows_matched": expected_rows is None or n == expected_rows,
        "columns_matched": expected_columns is None or set(df.columns) == set(expected_columns),
    }


def save_metadata(spark: SparkSession, path: str, meta: dict) -> None:
    """One JSON record in a folder of its own, published whole."""
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, pattern: str) -> list[dict]:
    """All readable records below a glob; malformed ones are left out."""
    out = []
    for (value,) in spark.read.text(pattern).collect():  # one short line a dataset
        try:
            out.append(json.loads(value))
        except ValueError:
            continue
    return out
