"""Item (UPC and description) summaries, their comparison, the presence summary, metrics and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.config import ColumnMapping, MoneyFlags
from quaymark.functions.exprs import col, exact_sum, item_dollars, item_units, strip, text
from quaymark.operators.stores import metric_rows

BOTH, BAU_ONLY, TEST_ONLY = "Present in Both", "Present only in BAU", "Present only in TEST"

#: Output names of the comparison, in order.
REPORT_NAMES = {
    "item_key": "UPC|DESC",
    "upc": "UPC",
    "bau_description": "BAU Description",
    "test_description": "TEST Description",
    "bau_units": "BAU Units",
    "test_units": "TEST Units",
    "bau_dollars": "BAU Dollars",
    "test_dollars": "TEST Dollars",
    "unit_type": "Unit Type",
    "present_in": "Present In",
    "units_difference": "Units Difference",
    "dollar_difference": "Dollar Difference",
}


def summary(df: DataFrame, side: ColumnMapping, money: MoneyFlags = MoneyFlags(), units_type: str = "qty") -> DataFrame:
    """item_key, upc, description, total_units, total_dollars, unit_type. A null UPC gives a null key; those rows are one group."""
    upc = strip(text(col(side.upc)))
    desc = strip(F.coalesce(text(col(side.desc)), F.lit("")))
    rows = df.select(
        F.concat(upc, F.lit("|"), desc).alias("item_key"),
        F.struct(upc.alias("upc"), desc.alias("description")).alias("item"),
        item_units(df, side).alias("u"),
        item_dollars(df, side, money).alias("d"),
    )
    return (
        rows.groupBy("item_key")
        .agg(F.min("item").alias("item"), exact_sum(F.col("u")).alias("total_units"), exact_sum(F.col("d")).alias("total_dollars"))
        .select("item_key", "item.upc", "item.description", "total_units", "total_dollars", F.lit(units_type).alias("unit_type"))
    )


def comparison(bau: DataFrame, test: DataFrame, units_type: str = "qty") -> DataFrame:
    """Full join of two summaries; null keys match nothing and stay as rows of their own side."""
    a = bau.select("item_key", F.col("upc").alias("bupc"), F.col("description").alias("bau_description"), F.col("total_units").alias("bu"), F.col("total_dollars").alias("bd"))
    b = test.select("item_key", F.col("upc").alias("tupc"), F.col("description").alias("test_description"), F.col("total_units").alias("tu"), F.col("total_dollars").alias("td"))
    zero = F.lit(0.0)
    present = F.when(F.col("bau_description").isNull(), TEST_ONLY).when(F.col("test_description").isNull(), BAU_ONLY).otherwise(BOTH)
    return a.join(b, "item_key", "full").select(
        "item_key",
        F.coalesce("bupc", "tupc").alias("upc"),
        "bau_description",
        "test_description",
        F.coalesce("bu", zero).alias("bau_units"),
        F.coalesce("tu", zero).alias("test_units"),
        F.coalesce("bd", zero).alias("bau_dollars"),
        F.coalesce("td", zero).alias("test_dollars"),
        F.lit(units_type).alias("unit_type"),
        present.alias("present_in"),
        F.round(F.coalesce("bu", zero) - F.coalesce("tu", zero), 8).alias("units_difference"),
        F.round(F.coalesce("bd", zero) - F.coalesce("td", zero), 8).alias("dollar_difference"),
    )


def report(comp: DataFrame) -> DataFrame:
    return comp.select(*[F.col(a).alias(b) for a, b in REPORT_NAMES.items()])


def presence_summary(comp: DataFrame) -> DataFrame:
    """A row for each presence class and a Grand Total row, which is there for empty input as well."""
    classes = comp.groupBy("present_in").agg(
        F.count(F.lit(1)).alias("count"), F.min("unit_type").alias("unit_type"),
        exact_sum(F.col("units_difference")).alias("units_difference"), exact_sum(F.col("dollar_difference")).alias("dollar_difference"),
    )
    grand = classes.agg(
        F.lit("Grand Total").alias("present_in"), F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"), F.min("unit_type").alias("unit_type"),
        exact_sum(F.col("units_difference")).alias("units_difference"), exact_sum(F.col("dollar_difference")).alias("dollar_difference"),
    )
    return classes.unionByName(grand)


def metrics(comp: DataFrame) -> DataFrame:
    """The nine metrics as (ord, metric, value double)."""
    one = comp.agg(
        F.count("bau_description").alias("nb"), F.count("test_description").alias("nt"),
        exact_sum(F.col("bau_dollars")).alias("bd"), exact_sum(F.col("test_dollars")).alias("td"),
        exact_sum(F.col("bau_units")).alias("bu"), exact_sum(F.col("test_units")).alias("tu"),
    )
    r = lambda c: F.round(c, 2)
    one = one.select(
        "nb", "nt", (F.col("nb") - F.col("nt")).alias("new"), r(F.col("td")).alias("td"), r(F.col("bd")).alias("bd"), r(F.col("bd") - F.col("td")).alias("dd"),
        r(F.col("tu")).alias("tu"), r(F.col("bu")).alias("bu"), r(F.col("bu") - F.col("tu")).alias("ud"),
    )
    rows = [
        ("Unique UPC BAU", "nb"), ("Unique UPC TEST", "nt"), ("New UPC indicator", "new"),
        ("Total Test Sales", "td"), ("Total BAU Sales", "bd"), ("Dollar Difference", "dd"),
        ("Total Units Test", "tu"), ("Total Units BAU", "bu"), ("Units Difference", "ud"),
    ]
    return metric_rows(one, rows).withColumn("value", F.col("value").cast("double"))


_SALES = ["item_key", "upc", "bau_description", "test_description", "bau_dollars", "test_dollars", "dollar_difference"]
_UNITS = ["item_key", "upc", "bau_description", "test_description", "bau_units", "test_units", "units_difference"]


def ranked(comp: DataFrame, what: str = "sales", largest: bool = True, n: int = 5) -> DataFrame:
    """Top (descending) or bottom (ascending) n items by dollar or unit difference; ties by key."""
    cols = _SALES if what == "sales" else _UNITS
    by = F.col(cols[-1])
    return comp.select(*cols).orderBy(by.desc() if largest else by.asc(), F.col("item_key").asc()).limit(n)
