"""Presence analyses: which stores or UPCs are on one side only. One full join on distinct keys answers both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions.exprs import col, key, strip, text


def store_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct normalised store keys (column key)."""
    return df.where(col(column).isNotNull()).select(key(col(column)).alias("key")).distinct()


def upc_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct stripped UPCs (column upc); case is kept."""
    return df.where(col(column).isNotNull()).select(strip(text(col(column))).alias("upc")).distinct()


def missing(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys of left that right lacks."""
    return left.join(right, on, "left_anti")


def _presence(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), on, "full")


def _listed(cond, name: str):
    return F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col(name)))), ", ")


def store_metrics(bau: DataFrame, test: DataFrame, bau_col: str, test_col: str, lists: bool = True) -> DataFrame:
    """The eight metrics as rows (ord, metric, value as text). lists=False leaves the two key lists out, for key sets of any size."""
    both = _presence(store_keys(bau, bau_col), store_keys(test, test_col), "key")
    aggs = [
        F.count("in_a").alias("ua"), F.count("in_b").alias("ub"),
        F.count(F.when(F.col("in_a").isNull(), 1)).alias("mb"), F.count(F.when(F.col("in_b").isNull(), 1)).alias("mt"),
    ]
    if lists:
        aggs += [_listed(F.col("in_a").isNull(), "key").alias("lb"), _listed(F.col("in_b").isNull(), "key").alias("lt")]
    one = (
        both.agg(*aggs)
        .crossJoin(bau.agg(F.count(F.lit(1)).alias("na")))  # each side is one row
        .crossJoin(test.agg(F.count(F.lit(1)).alias("nb")))
    )
    rows = [
        ("Total number of records (BAU)", "na"),
        ("Total number of unique stores in BAU", "ua"),
        ("Total number of records (TEST)", "nb"),
        ("Total number of unique stores in TEST", "ub"),
        ("Stores present in TEST (missing in BAU)", "mb"),
        ("Stores present in BAU (missing in TEST)", "mt"),
    ] + ([("Missing store numbers in BAU", "lb"), ("Missing store numbers in TEST", "lt")] if lists else [])
    return metric_rows(one, rows)


def metric_rows(one: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """A single row turned into (ord, metric, value) rows."""
    items = [F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), F.col(c).cast("string").alias("value")) for i, (m, c) in enumerate(rows, 1)]
    return one.select(F.explode(F.array(*items)).alias("m")).select("m.*")


def upc_metrics(bau: DataFrame, test: DataFrame, bau_col: str, test_col: str) -> DataFrame:
    one = _presence(upc_keys(bau, bau_col), upc_keys(test, test_col), "upc").agg(
        F.count("in_a").alias("ua"), F.count("in_b").alias("ub"),
        F.count(F.when(F.col("in_b").isNull(), 1)).alias("mt"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("mb"),
    )
    return metric_rows(one, [("Unique UPCs in BAU", "ua"), ("Unique UPCs in TEST", "ub"), ("UPCs missing in TEST", "mt"), ("UPCs missing in BAU", "mb")])
