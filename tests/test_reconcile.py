import zipfile

import pytest

from quaymark.config import ColumnMapping, ConfigError, ItemConfig, MoneyFlags, PriceType, UnitsType, ValidationConfig
from quaymark.operators import items, sales, stores
from quaymark.plans.reconcile import item_report, validate
from quaymark.sinks.parquet import DatasetNotFound

M = ColumnMapping(store="STORE", units="UNITS", price="PRICE")
I = ColumnMapping(upc="UPC", desc="DESC", units="UNITS", price="PRICE")


@pytest.fixture(scope="module")
def pair(spark):
    s = "STORE string, UNITS int, PRICE int"
    return spark.createDataFrame([("1001", 2, 10), ("1001", 3, 10), ("1002", 5, 20)], s), spark.createDataFrame([("1001", 1, 10), ("1003", 7, 5)], s)


@pytest.fixture(scope="module")
def item_pair(spark):
    s = "UPC string, DESC string, UNITS int, PRICE int"
    a = spark.createDataFrame([("11111", "aaa", 2, 10), ("11111", "aaa", 3, 10), ("22222", "bbb", 5, 20)], s)
    return a, spark.createDataFrame([("11111", "aaa", 1, 10), ("33333", "ccc", 7, 5)], s)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_store_metrics(pair):
    got = {r["metric"]: r["value"] for r in stores.store_metrics(*pair, "STORE", "STORE").collect()}
    assert got["Total number of records (BAU)"] == "3" and got["Total number of records (TEST)"] == "2"
    assert got["Missing store numbers in TEST"] == "1002" and got["Missing store numbers in BAU"] == "1003"


def test_keys_are_normalised(spark):
    a = spark.createDataFrame([(" 1001 ",), ("1001",), ("AbC",), ("\tabc ",), (None,)], "STORE string")
    assert sorted(r[0] for r in stores.store_keys(a, "STORE").collect()) == ["1001", "abc"]


@pytest.mark.parametrize(
    "money,units,dollars",
    [
        (MoneyFlags(), [5, 5], [20, 20]),
        (MoneyFlags(PriceType.UNIT_PRICE, implied_dollars=True), [5, 5], [0.5, 1.0]),
        (MoneyFlags(PriceType.UNIT_PRICE, implied_units=True), [0.05, 0.05], [0.5, 1.0]),
    ],
)
def test_per_store(pair, money, units, dollars):
    rows = sales.per_store(pair[0], M, money).orderBy("store").collect()
    assert [r["units"] for r in rows] == units and [r["dollars"] for r in rows] == dollars and [r["records"] for r in rows] == [2, 1]


def test_weighted(spark):
    m = ColumnMapping(store="STORE", units="UNITS", price="PRICE", weighted="WTD", units_type=UnitsType.WEIGHT)
    a = spark.createDataFrame([("1001", 2, 10, 12.0), ("1001", 3, 10, 13.0), ("1002", 5, 20, 15.0)], "STORE string, UNITS int, PRICE int, WTD double")
    b = spark.createDataFrame([("1001", 1, 10, None), ("1003", 7, 5, 90)], "STORE string, UNITS int, PRICE int, WTD int")
    x, y = by(sales.per_store(a, m, MoneyFlags(PriceType.UNIT_PRICE)), "store"), by(sales.per_store(b, m), "store")
    assert (x["1001"]["units"], x["1002"]["units"], x["1001"]["dollars"], x["1002"]["dollars"]) == (25.0, 15.0, 250.0, 300.0)
    assert (y["1001"]["units"], y["1003"]["units"], y["1001"]["unit_type"]) == (1.0, 90.0, "weight")


def test_comparison_and_metrics(pair):
    comp = sales.comparison(*(sales.per_store(x, M) for x in pair)).cache()
    r = by(comp, "store_number")
    assert (r["1001"]["units_difference"], r["1001"]["dollar_difference"], r["1001"]["unit_pct_difference"], r["1001"]["dollar_pct_difference"]) == (4, 10, 80.0, 50.0)
    assert (r["1002"]["unit_pct_difference"], r["1003"]["unit_pct_difference"], r["1003"]["dollar_difference"]) == (100.0, -100.0, -5)
    m = {x["metric"]: x["value"] for x in sales.metrics(comp).collect()}
    assert (m["Unique Store Count"], m["Total BAU Sales"], m["Total Test Sales"], m["Total Unit Difference"]) == ("3", "40.0", "15.0", "2.0")
    assert [x["store_number"] for x in sales.top(comp, "dollar_pct_difference").collect()] == ["1002", "1001", "1003"]
    assert [x["store_number"] for x in sales.bottom(comp, "dollar_pct_difference", 2).collect()] == ["1001", "1003"]
    assert sales.report(comp).columns == list(sales.REPORT_NAMES.values())


def test_swap_negates(pair):
    a, b = (sales.per_store(x, M) for x in pair)
    x, y = by(sales.comparison(a, b), "store_number"), by(sales.comparison(b, a), "store_number")
    assert all(x[k]["dollar_difference"] == -y[k]["dollar_difference"] for k in x)
    assert all(r["units_difference"] == 0 for r in sales.comparison(a, a).collect())


def test_null_store_stays_apart(spark):
    s = "STORE string, UNITS int, PRICE int"
    a, b = (sales.per_store(spark.createDataFrame([(None, 1, 1)], s), M) for _ in range(2))
    assert sales.comparison(a, b).count() == 2


def test_lenient_numbers(spark):
    a = spark.createDataFrame([("s", "1d", "x"), ("s", " 12 ", "3.5"), ("s", "2", None)], "STORE string, UNITS string, PRICE string")
    r = sales.per_store(a, M).head()
    assert (r["units"], r["dollars"]) == (2.0, 3.5)


def test_items(item_pair):
    a, b = (items.summary(x, I) for x in item_pair)
    assert by(a, "upc")["11111"]["total_units"] == 5.0 and by(a, "upc")["11111"]["total_dollars"] == 20.0
    comp = items.comparison(a, b).cache()
    r = by(comp, "upc")
    assert [r[u]["present_in"] for u in ("11111", "22222", "33333")] == [items.BOTH, items.BAU_ONLY, items.TEST_ONLY]
    assert (r["11111"]["units_difference"], r["11111"]["dollar_difference"]) == (4, 10)
    p = by(items.presence_summary(comp), "present_in")
    assert len(p) == 4 and p["Grand Total"]["count"] == 3
    m = {x["metric"]: x["value"] for x in items.metrics(comp).collect()}
    assert (m["Unique UPC BAU"], m["Unique UPC TEST"], m["New UPC indicator"], m["Total BAU Sales"], m["Units Difference"]) == (2, 2, 0, 40.0, 2.0)
    assert items.ranked(comp, "sales").count() == 3
    assert items.presence_summary(comp.limit(0)).collect()[0]["count"] == 0


def test_item_weighted(spark):
    m = ColumnMapping(upc="UPC", desc="DESC", units="UNITS", price="PRICE", weighted="WTD")
    a = spark.createDataFrame([("1", "a|b", 2, 10, None), ("1", "a|b", 3, 10, 10)], "UPC string, DESC string, UNITS int, PRICE int, WTD int")
    r = items.summary(a, m, MoneyFlags(PriceType.UNIT_PRICE)).head()
    assert (r["item_key"], r["total_units"], r["total_dollars"]) == ("1|a|b", 12.0, 120.0)


def test_validate_and_report(spark, tmp_path, pair, item_pair):
    paths = [str(tmp_path / n) for n in "abcd"]
    for df, p in zip((*pair, *item_pair), paths):
        df.write.parquet(p)
    out = validate(spark, paths[0], paths[1], ValidationConfig(bau=M, test=M, store_analysis=True, sales_analysis=True))
    assert set(out.metrics) == {"store", "sales"} and out.frames["sales"]["comparison"].count() == 3
    assert validate(spark, paths[0], paths[1], ValidationConfig()).metrics == {}
    with pytest.raises(ConfigError):
        validate(spark, paths[0], paths[1], ValidationConfig(bau=M, test=M, upc_analysis=True))
    with pytest.raises(DatasetNotFound):
        validate(spark, str(tmp_path / "none"), paths[1], ValidationConfig(bau=M, test=M, store_analysis=True))
    rep = item_report(spark, paths[2], paths[3], ItemConfig(I, I), str(tmp_path / "out"))
    assert rep.top_5_sales.count() == 3 and spark.read.parquet(rep.artifacts["comparison"]).count() == 3
    with zipfile.ZipFile(rep.artifacts["workbook"]) as z:
        assert z.read("xl/workbook.xml").decode().count("<sheet ") == 4 and "UPC|DESC" in z.read("xl/worksheets/sheet3.xml").decode()
