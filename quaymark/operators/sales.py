"""Sales per store, the two-sided comparison, its metrics and its rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.config import ColumnMapping, MoneyFlags
from quaymark.functions.exprs import col, dollars, effective_units, exact_sum, guarded_pct, strip, text
from quaymark.operators.stores import metric_rows

#: Output names of the comparison, in order.
REPORT_NAMES = {
    "store_number": "STORE_NUMBER",
    "bau_units": "BAU UNITS",
    "bau_dollars": "BAU TOTAL DOLLARS",
    "test_units": "TEST UNITS_SOLD",
    "test_dollars": "TEST TOTAL_DOLLARS",
    "units_type": "Units Type",
    "units_difference": "UNITS DIFFERENCE",
    "dollar_difference": "DOLLAR DIFFERENCE",
    "unit_pct_difference": "Unit % Difference",
    "dollar_pct_difference": "Dollar % Difference",
}


def per_store(df: DataFrame, side: ColumnMapping, money: MoneyFlags = MoneyFlags()) -> DataFrame:
    """store, records, dollars (if a price is mapped), units and unit_type (if units or weighted are mapped).

    The store is only cast to text; a null store is a group of its own. Partial sums are made before the shuffle, so a
    hot store costs one row a task.
    """
    aggs = [F.count(F.lit(1)).alias("records")]
    if side.price:
        aggs.append(exact_sum(dollars(df, side, money)).alias("dollars"))
    if side.units or side.weighted:
        aggs.append(exact_sum(effective_units(df, side, money)).alias("units"))
    out = df.groupBy(text(col(side.store)).alias("store")).agg(*aggs)
    return out.withColumn("unit_type", F.lit(side.units_type.value)) if side.units or side.weighted else out


def _filled(df: DataFrame, name: str) -> F.Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double").alias(name)


def comparison(bau: DataFrame, test: DataFrame, units_type: str = "qty") -> DataFrame:
    """Full join of two per_store frames. Both sides are already partitioned by store, so the join adds no shuffle."""
    a = bau.select(F.col("store").alias("store_number"), _filled(bau, "units").alias("bu"), _filled(bau, "dollars").alias("bd"))
    b = test.select(F.col("store").alias("store_number"), _filled(test, "units").alias("tu"), _filled(test, "dollars").alias("td"))
    zero = F.lit(0.0)
    both = a.join(b, "store_number", "full").select(
        "store_number",
        F.coalesce("bu", zero).alias("bau_units"),
        F.coalesce("bd", zero).alias("bau_dollars"),
        F.round(F.coalesce("tu", zero), 2).alias("test_units"),
        F.round(F.coalesce("td", zero), 2).alias("test_dollars"),
        F.lit(units_type).alias("units_type"),
    )
    return both.select(
        "*",
        (F.col("bau_units") - F.col("test_units")).alias("units_difference"),
        F.round(F.col("bau_dollars") - F.col("test_dollars"), 2).alias("dollar_difference"),
    ).select(
        "*",
        guarded_pct(F.col("units_difference"), F.col("bau_units")).alias("unit_pct_difference"),
        guarded_pct(F.col("dollar_difference"), F.col("bau_dollars")).alias("dollar_pct_difference"),
    )


def report(comp: DataFrame) -> DataFrame:
    """The comparison under its report names, largest dollar percentage first."""
    ordered = comp.orderBy(F.col("dollar_pct_difference").desc(), F.col("store_number").asc())
    return ordered.select(*[F.col(a).alias(b) for a, b in REPORT_NAMES.items()])


def unique_store_count(comp: DataFrame) -> DataFrame:
    name = strip(F.col("store_number"))
    return comp.agg(F.countDistinct(F.when(name != "", name)).alias("unique_stores"))


def totals(comp: DataFrame) -> DataFrame:
    """One row of typed totals."""
    name = strip(F.col("store_number"))
    one = comp.agg(
        F.countDistinct(F.when(name != "", name)).alias("unique_stores"),
        exact_sum(F.col("bau_dollars")).alias("bau_sales"), exact_sum(F.col("test_dollars")).alias("test_sales"),
        exact_sum(F.col("bau_units")).alias("bau_units"), exact_sum(F.col("test_units")).alias("test_units"),
    )
    pct = lambda d, b: F.when(F.col(b) != 0, F.round(F.col(d) / F.col(b) * 100, 2)).otherwise(F.lit(float("nan")))
    return (
        one.withColumn("dollar_difference", F.round(F.col("bau_sales") - F.col("test_sales"), 8))
        .withColumn("unit_difference", F.round(F.col("bau_units") - F.col("test_units"), 8))
        .withColumn("dollar_pct", pct("dollar_difference", "bau_sales"))
        .withColumn("unit_pct", pct("unit_difference", "bau_units"))
    )


def metrics(comp: DataFrame) -> DataFrame:
    """The nine metrics as (ord, metric, value as text)."""
    return metric_rows(
        totals(comp),
        [
            ("Unique Store Count", "unique_stores"),
            ("Total BAU Sales", "bau_sales"),
            ("Total Test Sales", "test_sales"),
            ("Total Dollar Difference", "dollar_difference"),
            ("Dollar % Difference", "dollar_pct"),
            ("Total BAU Units", "bau_units"),
            ("Total Test Units", "test_units"),
            ("Total Unit Difference", "unit_difference"),
            ("Units % Difference", "unit_pct"),
        ],
    )


def top(comp: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n largest, listed descending; ties by store."""
    return comp.orderBy(F.col(by).desc(), F.col("store_number").asc()).limit(n)


def bottom(comp: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n last of the descending order, still listed descending. No full sort: the smallest are taken first."""
    return comp.orderBy(F.col(by).asc(), F.col("store_number").desc()).limit(n).orderBy(F.col(by).desc(), F.col("store_number").asc())
