"""File and dataset lifecycles as data: a transition table, and DataFrame operators over an append-only state log.

The log has (file_id, seq, status, error); the state of a file is its row with the largest seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States and their legal successors.
FILE_TRANSITIONS = {
    "DISCOVERED": ("DOWNLOAD_QUEUED",),
    "DOWNLOAD_QUEUED": ("DOWNLOADING",),
    "DOWNLOADING": ("DOWNLOAD_VERIFIED", "DOWNLOAD_FAILED"),
    "DOWNLOAD_VERIFIED": ("DETECTING",),
    "DETECTING": ("AWAITING_APPROVAL", "PARSING", "DETECTION_FAILED", "DECOMPRESSION_FAILED"),
    "AWAITING_APPROVAL": ("PARSING", "DETECTING", "DETECTION_FAILED"),
    "PARSING": ("PARQUET_WRITING", "PARSE_FAILED", "DECOMPRESSION_FAILED"),
    "PARQUET_WRITING": ("DATASET_VERIFYING", "WRITE_FAILED"),
    "DATASET_VERIFYING": ("COMPLETE", "VERIFICATION_FAILED"),
    "COMPLETE": ("RAW_CLEANUP",),
    "RAW_CLEANUP": ("RAW_DELETED", "CLEANUP_FAILED"),
    "RAW_DELETED": (),
    "DOWNLOAD_FAILED": ("DOWNLOAD_QUEUED",),
    "DECOMPRESSION_FAILED": ("DOWNLOAD_VERIFIED",),
    "DETECTION_FAILED": ("DOWNLOAD_VERIFIED",),
    "PARSE_FAILED": ("DOWNLOAD_VERIFIED",),
    "WRITE_FAILED": ("DOWNLOAD_VERIFIED",),
    "VERIFICATION_FAILED": ("DOWNLOAD_VERIFIED",),
    "CLEANUP_FAILED": ("RAW_CLEANUP",),
}
DATASET_TRANSITIONS = {"CREATED": ("WRITING",), "WRITING": ("VERIFYING", "FAILED"), "VERIFYING": ("COMPLETE", "FAILED"), "COMPLETE": (), "FAILED": ()}

#: Where files go that were in flight when the process ended.
RECOVERY = {
    "DISCOVERED": "DOWNLOAD_QUEUED",
    "DOWNLOADING": "DOWNLOAD_QUEUED",
    "DETECTING": "DOWNLOAD_VERIFIED",
    "PARSING": "DOWNLOAD_VERIFIED",
    "PARQUET_WRITING": "DOWNLOAD_VERIFIED",
    "DATASET_VERIFYING": "DOWNLOAD_VERIFIED",
}

FAILURES = tuple(s for s in FILE_TRANSITIONS if s.endswith("_FAILED"))
#: Where a retry puts a failed file.
RETRY = {s: FILE_TRANSITIONS[s][0] for s in FAILURES}

LOG = "file_id string, seq bigint, status string, error string"


class IllegalTransition(ValueError):
    pass


def check(old: str, new: str, table: dict[str, tuple] = FILE_TRANSITIONS) -> str:
    if new not in table.get(old, ()):
        raise IllegalTransition(f"{old} to {new}")
    return new


def is_terminal(status: str) -> bool:
    return status in FAILURES or status == "RAW_DELETED"


def _mapped(c: F.Column, mapping: dict[str, str]) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


def transition_table(spark: SparkSession, table: dict[str, tuple] = FILE_TRANSITIONS) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in table.items() for b in bs], "from_status string, to_status string")


def latest(log: DataFrame) -> DataFrame:
    """file_id and its last row. max of a struct aggregates before the shuffle, unlike a window."""
    return log.groupBy("file_id").agg(F.max(F.struct("seq", "status", "error")).alias("s")).select("file_id", "s.*")


def illegal_transitions(log: DataFrame, table: dict[str, tuple] = FILE_TRANSITIONS) -> DataFrame:
    """file_id, seq, from_status, to_status of moves that the table doesn't have."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("seq")
    moves = log.select("file_id", "seq", F.lag("status").over(w).alias("from_status"), F.col("status").alias("to_status")).where("from_status is not null")
    return moves.join(F.broadcast(transition_table(log.sparkSession, table)), ["from_status", "to_status"], "left_anti").select("file_id", "seq", "from_status", "to_status")  # some thirty fixed rows


def recovered(states: DataFrame) -> DataFrame:
    """file_id, old, status of in-flight files after a restart."""
    to = _mapped(F.col("status"), RECOVERY)
    return states.where(to.isNotNull()).select("file_id", F.col("status").alias("old"), to.alias("status"))


def retried(states: DataFrame) -> DataFrame:
    to = _mapped(F.col("status"), RETRY)
    return states.where(to.isNotNull()).select("file_id", F.col("status").alias("old"), to.alias("status"))


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
