"""Entry points: validate() for store, sales and UPC analyses, item_report() for the item artifacts."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quaymark.config import ItemConfig, ValidationConfig
from quaymark.operators import items, sales, stores
from quaymark.sinks.parquet import open_dataset
from quaymark.sinks.xlsx import write_workbook


@dataclass
class Result:
    """metrics and frames by analysis; all lazy."""

    metrics: dict[str, DataFrame] = field(default_factory=dict)
    frames: dict[str, dict[str, DataFrame]] = field(default_factory=dict)


def store_analysis(bau: DataFrame, test: DataFrame, c: ValidationConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    a, b = stores.store_keys(bau, c.bau.store), stores.store_keys(test, c.test.store)
    frames = {n: stores.missing(x, y, "key").select(x["key"].alias("store")).orderBy("store") for n, x, y in (("missing_in_bau", b, a), ("missing_in_test", a, b))}
    return stores.store_metrics(bau, test, c.bau.store, c.test.store), frames


def sales_analysis(bau: DataFrame, test: DataFrame, c: ValidationConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    a, b = sales.per_store(bau, c.bau, c.bau_money), sales.per_store(test, c.test, c.test_money)
    comp = sales.comparison(a, b, c.bau.units_type.value)
    frames = {"bau": a.orderBy("store"), "test": b.orderBy("store"), "comparison": sales.report(comp)}
    for name, by in (("sales", "dollar_pct_difference"), ("units", "unit_pct_difference")):
        frames |= {f"top_5_{name}": sales.top(comp, by), f"bottom_5_{name}": sales.bottom(comp, by)}
    return sales.metrics(comp), frames


def upc_analysis(bau: DataFrame, test: DataFrame, c: ValidationConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    a, b = stores.upc_keys(bau, c.bau.upc), stores.upc_keys(test, c.test.upc)
    return stores.upc_metrics(bau, test, c.bau.upc, c.test.upc), {"missing_in_test": stores.missing(a, b, "upc"), "missing_in_bau": stores.missing(b, a, "upc")}


def validate(spark: SparkSession, bau_path: str, test_path: str, config: ValidationConfig) -> Result:
    config.validate()
    bau, test = open_dataset(spark, bau_path), open_dataset(spark, test_path)
    out = Result()
    for name in config.enabled():
        out.metrics[name], out.frames[name] = {"store": store_analysis, "sales": sales_analysis, "upc": upc_analysis}[name](bau, test, config)
    return out


@dataclass
class ItemReport:
    artifacts: dict[str, str]
    metrics: DataFrame
    top_5_sales: DataFrame
    bottom_5_sales: DataFrame
    top_5_units: DataFrame
    bottom_5_units: DataFrame
    elapsed_s: float


def item_report(spark: SparkSession, bau_path: str, test_path: str, config: ItemConfig, output_dir: str, prefix: str = "item_report", workbook: bool = True) -> ItemReport:
    """Writes the two summaries, then builds everything else from what was written: the inputs are scanned once."""
    config.validate()
    began, at = time.time(), {n: f"{output_dir.rstrip('/')}/{prefix}_{n}.parquet" for n in ("bau_summary", "test_summary", "comparison", "summary")}
    for side, path, name in (("bau", bau_path, "bau_summary"), ("test", test_path, "test_summary")):
        items.summary(open_dataset(spark, path), getattr(config, side), getattr(config, f"{side}_money"), config.units_type.value).write.mode("overwrite").parquet(at[name])
    read = spark.read.parquet
    items.comparison(read(at["bau_summary"]), read(at["test_summary"]), config.units_type.value).write.mode("overwrite").parquet(at["comparison"])
    comp = read(at["comparison"])
    items.presence_summary(comp).coalesce(1).write.mode("overwrite").parquet(at["summary"])
    if workbook:
        at["workbook"] = f"{output_dir.rstrip('/')}/{prefix}.xlsx"
        write_workbook(at["workbook"], {"BAU Summary": read(at["bau_summary"]), "TEST Summary": read(at["test_summary"]), "Comparison": items.report(comp), "Summary": read(at["summary"])})
    ranked = [items.ranked(comp, what, largest) for what in ("sales", "units") for largest in (True, False)]
    return ItemReport(at, items.metrics(comp), *ranked, time.time() - began)
