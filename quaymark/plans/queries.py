"""The registered queries: every operator over the whole driver tables, each beside its DuckDB SQL.

The two sides are derived from lineitem and part: suppliers are stores, parts are items, line numbers deal rows to the
sides and a tenth of the stores and items is missing on each.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.config import ColumnMapping, FieldSpec, Layout, MoneyFlags, ParseConfig, PriceType, UnitsType
from quaymark.functions.exprs import OVERRIDE_TYPES
from quaymark.operators import items, sales, stores
from quaymark.sinks.parquet import verify, with_overrides, write
from quaymark.sources import detect as det
from quaymark.sources.records import counters, issue_counts, parse, rows
from quaymark.streaming import lifecycle as lc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MAP = ColumnMapping(store="STORE", units="UNITS", price="PRICE", upc="UPC", desc="DESC")
WEIGHTED = ColumnMapping(store="STORE", units="UNITS", price="PRICE", weighted="WTD", upc="UPC", desc="DESC", units_type=UnitsType.WEIGHT)

_BAU = "l_linenumber <= 3 AND l_suppkey % 10 <> 3 AND l_partkey % 10 <> 4"
_TEST = "l_linenumber >= 3 AND l_suppkey % 10 <> 7 AND l_partkey % 10 <> 6"
_PAIR = f"""base AS (SELECT CAST(l_suppkey AS VARCHAR) AS STORE, CAST(l_partkey AS VARCHAR) AS UPC, p_name AS "DESC", l_quantity AS UNITS,
 l_extendedprice AS PRICE, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 2 END AS WTD, l_linenumber, l_suppkey, l_partkey
 FROM lineitem JOIN part ON l_partkey = p_partkey),
bau AS (SELECT * FROM base WHERE {_BAU}), test AS (SELECT * FROM base WHERE {_TEST})"""


def pair(spark: SparkSession, sf_dir: str, described: bool = False) -> tuple[DataFrame, DataFrame]:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if described:
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
        li = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    out = []
    for cond in (_BAU, _TEST):
        out.append(
            li.where(cond).select(
                F.col("l_suppkey").cast("string").alias("STORE"), F.col("l_partkey").cast("string").alias("UPC"), *([F.col("p_name").alias("DESC")] if described else []),
                F.col("l_quantity").alias("UNITS"), F.col("l_extendedprice").alias("PRICE"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 2).alias("WTD"),
            )
        )
    return out[0], out[1]


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# --- stores and UPCs -------------------------------------------------------------------------------------------------

_KEYS = f"WITH {_PAIR}, ks AS (SELECT DISTINCT lower(trim(STORE)) AS key FROM bau), kt AS (SELECT DISTINCT lower(trim(STORE)) AS key FROM test)"
_UPCS = f"WITH {_PAIR}, ub AS (SELECT DISTINCT trim(UPC) AS upc FROM bau), ut AS (SELECT DISTINCT trim(UPC) AS upc FROM test)"


def _store_keys(spark, d):
    a, b = pair(spark, d)
    return stores.store_keys(a, "STORE").withColumn("side", F.lit("bau")).unionByName(stores.store_keys(b, "STORE").withColumn("side", F.lit("test")))


def _missing(kind, test_side):
    def run(spark, d):
        a, b = pair(spark, d)
        keys, name, on = (stores.store_keys, "STORE", "key") if kind == "store" else (stores.upc_keys, "UPC", "upc")
        a, b = keys(a, name), keys(b, name)
        return stores.missing(a, b, on) if test_side else stores.missing(b, a, on)

    return run


add("store_keys", _store_keys, f"{_KEYS} SELECT key, 'bau' AS side FROM ks UNION ALL SELECT key, 'test' AS side FROM kt")
add("store_missing_in_test", _missing("store", True), f"{_KEYS} SELECT key FROM ks ANTI JOIN kt USING (key)")
add("store_missing_in_bau", _missing("store", False), f"{_KEYS} SELECT key FROM kt ANTI JOIN ks USING (key)")
add("upc_missing_in_test", _missing("upc", True), f"{_UPCS} SELECT upc FROM ub ANTI JOIN ut USING (upc)")
add("upc_missing_in_bau", _missing("upc", False), f"{_UPCS} SELECT upc FROM ut ANTI JOIN ub USING (upc)")
add(
    "store_metrics",
    lambda s, d: stores.store_metrics(*pair(s, d), "STORE", "STORE"),
    f"""{_KEYS}, mt AS (SELECT key FROM ks ANTI JOIN kt USING (key)), mb AS (SELECT key FROM kt ANTI JOIN ks USING (key))
SELECT 1 AS ord, 'Total number of records (BAU)' AS metric, CAST((SELECT count(*) FROM bau) AS VARCHAR) AS value
UNION ALL SELECT 2, 'Total number of unique stores in BAU', CAST((SELECT count(*) FROM ks) AS VARCHAR)
UNION ALL SELECT 3, 'Total number of records (TEST)', CAST((SELECT count(*) FROM test) AS VARCHAR)
UNION ALL SELECT 4, 'Total number of unique stores in TEST', CAST((SELECT count(*) FROM kt) AS VARCHAR)
UNION ALL SELECT 5, 'Stores present in TEST (missing in BAU)', CAST((SELECT count(*) FROM mb) AS VARCHAR)
UNION ALL SELECT 6, 'Stores present in BAU (missing in TEST)', CAST((SELECT count(*) FROM mt) AS VARCHAR)
UNION ALL SELECT 7, 'Missing store numbers in BAU', coalesce((SELECT string_agg(key, ', ' ORDER BY key) FROM mb), '')
UNION ALL SELECT 8, 'Missing store numbers in TEST', coalesce((SELECT string_agg(key, ', ' ORDER BY key) FROM mt), '')""",
)
add(
    "upc_metrics",
    lambda s, d: stores.upc_metrics(*pair(s, d), "UPC", "UPC"),
    f"""{_UPCS} SELECT 1 AS ord, 'Unique UPCs in BAU' AS metric, CAST((SELECT count(*) FROM ub) AS VARCHAR) AS value
UNION ALL SELECT 2, 'Unique UPCs in TEST', CAST((SELECT count(*) FROM ut) AS VARCHAR)
UNION ALL SELECT 3, 'UPCs missing in TEST', CAST((SELECT count(*) FROM (SELECT upc FROM ub ANTI JOIN ut USING (upc))) AS VARCHAR)
UNION ALL SELECT 4, 'UPCs missing in BAU', CAST((SELECT count(*) FROM (SELECT upc FROM ut ANTI JOIN ub USING (upc))) AS VARCHAR)""",
)

# --- sales -----------------------------------------------------------------------------------------------------------

_X = "CAST(sum(CAST({} AS DECIMAL(28,8))) AS DOUBLE)"


def _money_sql(unit_price: bool, cents: bool, hundredths: bool, weighted: bool) -> tuple[str, str]:
    u = "coalesce(WTD, UNITS)" if weighted else "UNITS"
    u = f"({u} / 100)" if hundredths else u
    p = "(PRICE / 100)" if cents else "PRICE"
    return (f"{p} * {u}" if unit_price else p), u


def _per_store(mapping, money):
    def run(spark, d):
        a, b = (sales.per_store(x, mapping, money) for x in pair(spark, d))
        return a.withColumn("side", F.lit("bau")).unionByName(b.withColumn("side", F.lit("test")))

    return run


def _per_store_sql(dollars: str, units: str, kind: str) -> str:
    one = "SELECT STORE AS store, count(*) AS records, {} AS dollars, {} AS units, '{}' AS unit_type, '{}' AS side FROM {} GROUP BY STORE"
    return f"WITH {_PAIR} " + " UNION ALL ".join(one.format(_X.format(dollars), _X.format(units), kind, s, s) for s in ("bau", "test"))


for _unit in (False, True):
    for _cents in (False, True):
        for _hund in (False, True):
            for _w in (False, True):
                _name = "sales_per_store" + "".join(f"_{n}" for n, on in (("unit_price", _unit), ("implied_dollars", _cents), ("implied_units", _hund), ("weighted", _w)) if on)
                _m = MoneyFlags(PriceType.UNIT_PRICE if _unit else PriceType.TOTAL_PRICE, _cents, _hund)
                add(_name, _per_store(WEIGHTED if _w else MAP, _m), _per_store_sql(*_money_sql(_unit, _cents, _hund, _w), "weight" if _w else "qty"))


def compared(spark: SparkSession, d: str) -> DataFrame:
    a, b = pair(spark, d)
    return sales.comparison(sales.per_store(a, MAP), sales.per_store(b, MAP))


_COMP = f"""WITH {_PAIR}, a AS (SELECT STORE AS k, {_X.format("UNITS")} AS u, {_X.format("PRICE")} AS d FROM bau GROUP BY 1),
b AS (SELECT STORE AS k, {_X.format("UNITS")} AS u, {_X.format("PRICE")} AS d FROM test GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS store_number, coalesce(a.u, 0.0) AS bau_units, coalesce(a.d, 0.0) AS bau_dollars,
 round(coalesce(b.u, 0.0), 2) AS test_units, round(coalesce(b.d, 0.0), 2) AS test_dollars, 'qty' AS units_type FROM a FULL JOIN b ON a.k = b.k),
k AS (SELECT *, bau_units - test_units AS units_difference, round(bau_dollars - test_dollars, 2) AS dollar_difference FROM j),
comp AS (SELECT *, CASE WHEN bau_units <> 0 THEN round(units_difference / bau_units * 100, 2) ELSE -100.0 END AS unit_pct_difference,
 CASE WHEN bau_dollars <> 0 THEN round(dollar_difference / bau_dollars * 100, 2) ELSE -100.0 END AS dollar_pct_difference FROM k)"""
_NAMED = ", ".join(f'{a} AS "{b}"' for a, b in sales.REPORT_NAMES.items())

add("sales_comparison", compared, f"{_COMP} SELECT * FROM comp")
add("sales_report", lambda s, d: sales.report(compared(s, d)), f"{_COMP} SELECT {_NAMED} FROM comp")
add("unique_store_count", lambda s, d: sales.unique_store_count(compared(s, d)), f"{_COMP} SELECT count(DISTINCT trim(store_number)) AS unique_stores FROM comp WHERE trim(store_number) <> ''")
_TOTALS = f"""{_COMP}, t AS (SELECT count(DISTINCT CASE WHEN trim(store_number) <> '' THEN trim(store_number) END) AS unique_stores, {_X.format("bau_dollars")} AS bau_sales,
 {_X.format("test_dollars")} AS test_sales, {_X.format("bau_units")} AS bau_units, {_X.format("test_units")} AS test_units FROM comp),
v AS (SELECT *, round(bau_sales - test_sales, 8) AS dollar_difference, round(bau_units - test_units, 8) AS unit_difference FROM t)"""
add(
    "sales_totals",
    lambda s, d: sales.totals(compared(s, d)),
    f"{_TOTALS} SELECT *, CASE WHEN bau_sales <> 0 THEN round(dollar_difference / bau_sales * 100, 2) ELSE 'nan'::DOUBLE END AS dollar_pct, CASE WHEN bau_units <> 0 THEN round(unit_difference / bau_units * 100, 2) ELSE 'nan'::DOUBLE END AS unit_pct FROM v",
)
_METRIC_COLS = ["unique_stores", "bau_sales", "test_sales", "dollar_difference", "dollar_pct", "bau_units", "test_units", "unit_difference", "unit_pct"]
_METRIC_NAMES = ["Unique Store Count", "Total BAU Sales", "Total Test Sales", "Total Dollar Difference", "Dollar % Difference", "Total BAU Units", "Total Test Units", "Total Unit Difference", "Units % Difference"]
add(
    "sales_metrics",
    lambda s, d: sales.metrics(compared(s, d)).withColumn("value", F.round(F.col("value").cast("double"), 6)),
    f"{_TOTALS}, m AS (SELECT *, round(dollar_difference / bau_sales * 100, 2) AS dollar_pct, round(unit_difference / bau_units * 100, 2) AS unit_pct FROM v) "
    + " UNION ALL ".join(f"SELECT {i} AS ord, '{n}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM m" for i, (n, c) in enumerate(zip(_METRIC_NAMES, _METRIC_COLS), 1)),
)
for _n, _by in (("dollars", "dollar_pct_difference"), ("units", "unit_pct_difference")):
    add(f"sales_top5_{_n}", lambda s, d, by=_by: sales.top(compared(s, d), by), f"{_COMP} SELECT * FROM comp ORDER BY {_by} DESC, store_number ASC LIMIT 5")
    add(f"sales_bottom5_{_n}", lambda s, d, by=_by: sales.bottom(compared(s, d), by), f"{_COMP} SELECT * FROM comp ORDER BY {_by} ASC, store_number DESC LIMIT 5")

# --- items -----------------------------------------------------------------------------------------------------------


def _summary(side, mapping=MAP, money=MoneyFlags()):
    return lambda s, d: items.summary(pair(s, d, True)[side], mapping, money)


def _summary_sql(table: str, units: str = "UNITS", dollars: str = "PRICE") -> str:
    return f"""SELECT trim(UPC) || '|' || trim(coalesce("DESC", '')) AS item_key, min(trim(UPC)) AS upc, min(trim(coalesce("DESC", ''))) AS description,
 {_X.format(units)} AS total_units, {_X.format(dollars)} AS total_dollars, 'qty' AS unit_type FROM {table} GROUP BY 1"""


add("item_summary_bau", _summary(0), f"WITH {_PAIR} {_summary_sql('bau')}")
add("item_summary_test", _summary(1), f"WITH {_PAIR} {_summary_sql('test')}")
add("item_summary_weighted", _summary(0, WEIGHTED), f"WITH {_PAIR} {_summary_sql('bau', 'coalesce(WTD, UNITS)')}")
add(
    "item_summary_weighted_unit_price_implied_dollars",
    _summary(0, WEIGHTED, MoneyFlags(PriceType.UNIT_PRICE, True)),
    f"WITH {_PAIR} {_summary_sql('bau', 'coalesce(WTD, UNITS)', 'PRICE * coalesce(WTD, UNITS) / 100')}",
)


def item_compared(spark: SparkSession, d: str) -> DataFrame:
    a, b = pair(spark, d, True)
    return items.comparison(items.summary(a, MAP), items.summary(b, MAP))


_ICOMP = f"""WITH {_PAIR}, a AS ({_summary_sql("bau")}), b AS ({_summary_sql("test")}),
comp AS (SELECT coalesce(a.item_key, b.item_key) AS item_key, coalesce(a.upc, b.upc) AS upc, a.description AS bau_description, b.description AS test_description,
 coalesce(a.total_units, 0.0) AS bau_units, coalesce(b.total_units, 0.0) AS test_units, coalesce(a.total_dollars, 0.0) AS bau_dollars, coalesce(b.total_dollars, 0.0) AS test_dollars,
 'qty' AS unit_type, CASE WHEN a.description IS NULL THEN 'Present only in TEST' WHEN b.description IS NULL THEN 'Present only in BAU' ELSE 'Present in Both' END AS present_in,
 round(coalesce(a.total_units, 0.0) - coalesce(b.total_units, 0.0), 8) AS units_difference, round(coalesce(a.total_dollars, 0.0) - coalesce(b.total_dollars, 0.0), 8) AS dollar_difference
 FROM a FULL JOIN b ON a.item_key = b.item_key)"""
_IROUND = "* REPLACE (round(units_difference, 4) AS units_difference, round(dollar_difference, 4) AS dollar_difference)"


def _r4(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("units_difference", "dollar_difference") if c in df.columns})


add("item_comparison", lambda s, d: _r4(item_compared(s, d)), f"{_ICOMP} SELECT {_IROUND} FROM comp")
_PRES = f"""{_ICOMP}, p AS (SELECT present_in, count(*) AS count, min(unit_type) AS unit_type, {_X.format("units_difference")} AS units_difference, {_X.format("dollar_difference")} AS dollar_difference FROM comp GROUP BY 1)
SELECT {_IROUND} FROM (SELECT * FROM p UNION ALL SELECT 'Grand Total', CAST(sum(count) AS BIGINT), min(unit_type), {_X.format("units_difference")}, {_X.format("dollar_difference")} FROM p)"""
add("item_presence_summary", lambda s, d: _r4(items.presence_summary(item_compared(s, d))), _PRES)
_IM = f"""{_ICOMP}, m AS (SELECT count(bau_description) AS nb, count(test_description) AS nt, {_X.format("bau_dollars")} AS bd, {_X.format("test_dollars")} AS td,
 {_X.format("bau_units")} AS bu, {_X.format("test_units")} AS tu FROM comp) """
_IMR = [("Unique UPC BAU", "nb"), ("Unique UPC TEST", "nt"), ("New UPC indicator", "nb - nt"), ("Total Test Sales", "round(td, 2)"), ("Total BAU Sales", "round(bd, 2)"), ("Dollar Difference", "round(bd - td, 2)"), ("Total Units Test", "round(tu, 2)"), ("Total Units BAU", "round(bu, 2)"), ("Units Difference", "round(bu - tu, 2)")]
add("item_metrics", lambda s, d: items.metrics(item_compared(s, d)), _IM + " UNION ALL ".join(f"SELECT {i} AS ord, '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM m" for i, (n, e) in enumerate(_IMR, 1)))
for _what, _cols in (("sales", items._SALES), ("units", items._UNITS)):
    for _end, _dir in (("top5", "DESC"), ("bottom5", "ASC")):
        add(
            f"item_{_end}_{_what}",
            lambda s, d, w=_what, e=_end: _r4(items.ranked(item_compared(s, d), w, e == "top5")),
            f"{_ICOMP} SELECT {', '.join(_cols[:-1])}, round({_cols[-1]}, 4) AS {_cols[-1]} FROM comp ORDER BY comp.{_cols[-1]} {_dir}, item_key ASC LIMIT 5",
        )

# --- typed writes ----------------------------------------------------------------------------------------------------

_TOKENS = "CASE CAST(l_linenumber AS INT) WHEN 1 THEN 'true' WHEN 2 THEN 'F' WHEN 3 THEN 'on' WHEN 4 THEN '' WHEN 5 THEN 'maybe' WHEN 6 THEN '12.5' ELSE '7' END"


def _override(kind):
    def run(spark, d):
        src = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.expr(_TOKENS.replace("VARCHAR", "STRING")).alias("v"))
        return with_overrides(src, {"v": kind})

    return run


for _kind, _sql in (
    ("Int64", "CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(v AS BIGINT) END"),
    ("Int32", "CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(v AS INT) END"),
    ("Float64", "CASE WHEN regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?') THEN CAST(v AS DOUBLE) END"),
    ("Boolean", "CASE WHEN lower(v) IN ('true','t','yes','y','1','on') THEN true WHEN lower(v) IN ('false','f','no','n','0','off','') THEN false END"),
):
    _short = {"Int64": "int", "Int32": "int32", "Float64": "float", "Boolean": "bool"}[_kind]
    add(f"override_{_short}", _override(_kind), f"SELECT l_orderkey, l_linenumber, {_sql} AS v FROM (SELECT l_orderkey, l_linenumber, {_TOKENS} AS v FROM lineitem)")


def scratch(spark: SparkSession) -> str:
    """A folder of the shared kind: the checkpoint folder if one is set, else a local one, which only a local session may use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quaymark-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _verify(spark, d):
    src, path = pair(spark, d)[0], scratch(spark)
    done = write(src.select(*[F.col(c).cast("string") for c in src.columns]), path, {"UNITS": "Float64"})
    seen = verify(spark, path, done.rows, src.columns)
    return spark.createDataFrame([(seen["rows"], len(seen["columns"]), seen["rows_matched"], seen["columns_matched"])], "row_count bigint, column_count bigint, rows_matched boolean, columns_matched boolean")


add("dataset_verify", _verify, f"WITH {_PAIR} SELECT count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, true AS rows_matched, true AS columns_matched FROM bau")

# --- parsing and detection: text is made from lineitem, one file for each supplier -------------------------------------


def _files(spark, d, line, head=None) -> DataFrame:
    """(file, content): a supplier's lines in order."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    one = li.groupBy(F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("file")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", line.alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    return one.select("file", (F.concat(F.lit(head + "\n"), body) if head else body).alias("content"))


def _s(name):
    return F.col(name).cast("string")


def _quoted_flags():
    return F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit('"'), "l_returnflag", F.lit(","), "l_linestatus", F.lit('"'))).otherwise(F.col("l_returnflag"))


_DELIM = ParseConfig(columns=("ORDER", "LINE", "PART", "FLAGS"), delimiter=",")


def _delimited(spark, d):
    extra = F.when(F.col("l_linenumber") == 7, F.lit(",extra")).otherwise(F.lit(""))
    return parse(_files(spark, d, F.concat(F.concat_ws(",", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _quoted_flags()), extra), "ORDER,LINE,PART,FLAGS"), _DELIM)


_FIXED = ParseConfig(layout=Layout((FieldSpec("ORDER", 0, 12), FieldSpec("LINE", 12, 14), FieldSpec("PART", 14, 26), FieldSpec("FLAG", 26, 28))), header=False)


def _fixed(spark, d):
    pad = lambda c, n: F.rpad(_s(c), n, " ")
    flag = F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(F.rpad("l_returnflag", 2, " "))
    return parse(_files(spark, d, F.concat(pad("l_orderkey", 12), pad("l_linenumber", 2), pad("l_partkey", 12), flag)), _FIXED)


_FLAGS = "CASE WHEN l_suppkey % 2 = 0 THEN l_returnflag || ',' || l_linestatus ELSE l_returnflag END"
_CAST3 = 'CAST(l_orderkey AS VARCHAR) AS "ORDER", CAST(l_linenumber AS VARCHAR) AS LINE, CAST(l_partkey AS VARCHAR) AS PART'
add("parse_delimited_roundtrip", lambda s, d: rows(_delimited(s, d), _DELIM), f"SELECT {_CAST3}, {_FLAGS} AS FLAGS FROM lineitem")
add("parse_fixed_roundtrip", lambda s, d: rows(_fixed(s, d), _FIXED), f"SELECT {_CAST3}, CASE WHEN l_linenumber = 7 THEN '' ELSE l_returnflag END AS FLAG FROM lineitem")
add(
    "parse_issue_counts",
    lambda s, d: issue_counts(_delimited(s, d)),
    "SELECT issue, count(*) AS n FROM (SELECT 'column_mismatch' AS issue FROM lineitem WHERE l_linenumber = 7 UNION ALL SELECT 'quoted_delimiter' FROM lineitem WHERE l_suppkey % 2 = 0) GROUP BY 1",
)
add(
    "parse_fixed_issue_counts",
    lambda s, d: issue_counts(_fixed(s, d)),
    "SELECT 'short_line' AS issue, count(*) AS n FROM lineitem WHERE l_linenumber = 7 HAVING count(*) > 0",
)
add(
    "parse_counters",
    lambda s, d: counters(_delimited(s, d), _DELIM),
    "SELECT count(*) + count(DISTINCT l_suppkey) AS total_records, count(*) AS parsed_records, CAST(sum(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS BIGINT) AS bad_rows FROM lineitem",
)


def _lines(spark, d):
    """(file, line_no, line): the delimiter changes with the supplier, some lines have a quoted delimiter and some an extra field."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    sep = F.element_at(F.array(*map(F.lit, det.DELIMITERS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    parts = [_s("l_orderkey"), _s("l_linenumber"), F.concat(F.lit('"'), "l_returnflag", F.lit(',"')), F.col("l_linestatus")]
    line = F.concat(parts[0], sep, parts[1], sep, parts[2], sep, parts[3], F.when(F.col("l_linenumber") == 7, F.concat(sep, F.lit("x"))).otherwise(F.lit("")))
    return li.select(_s("l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), line.alias("line"))


add(
    "detect_delimiter",
    lambda s, d: det.delimiter_stats(_lines(s, d)),
    """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, l_suppkey % 4 AS k, CASE WHEN l_linenumber = 7 THEN 4 ELSE 3 END AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT file, k, c, n, sum(n) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY n DESC, c) AS rk FROM c)
SELECT file, CASE k WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END AS delimiter, c AS most_common, n AS occurrences, round(n / total, 4) AS consistency FROM m WHERE rk = 1 AND total >= 2""",
)


def _csv_lines(spark, d, *cols):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(_s("l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), F.concat_ws(",", *cols).alias("line"))


add(
    "detect_header",
    lambda s, d: det.header_flags(_csv_lines(s, d, "l_returnflag", "l_linestatus", F.when(F.col("l_orderkey") % 2 == 0, F.lit("name")).otherwise(_s("l_partkey")), F.when(F.col("l_orderkey") % 2 == 0, F.lit("x")).otherwise(_s("l_linenumber"))), ","),
    "WITH f AS (SELECT l_suppkey, arg_min(l_orderkey % 2, l_orderkey * 8 + l_linenumber) AS odd FROM lineitem GROUP BY 1) SELECT CAST(l_suppkey AS VARCHAR) AS file, odd = 0 AS header FROM f",
)
add(
    "detect_record_typed",
    lambda s, d: det.record_typed(_csv_lines(s, d, "l_returnflag", _s("l_orderkey"), F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 2 == 0), F.lit("more,fields"))), ","),
    "SELECT CAST(l_suppkey AS VARCHAR) AS file, l_suppkey % 2 = 0 AND count(DISTINCT l_returnflag = 'R') = 2 AS record_typed FROM lineitem GROUP BY l_suppkey",
)
add(
    "detect_fixed_width",
    lambda s, d: det.fixed_width_share(_csv_lines(s, d, F.rpad(_s("l_orderkey"), 10, "x"), F.when((F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") <= 3), F.lit("abc")).otherwise(F.lit("ab")))),
    """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, CASE WHEN l_suppkey % 3 = 0 AND l_linenumber <= 3 THEN 14 ELSE 13 END AS w, count(*) AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY n DESC, w) AS rk FROM c)
SELECT file, w AS width, round(n / total, 4) AS share, n / total >= 0.95 AS fixed_width FROM m WHERE rk = 1""",
)
add(
    "detect_preamble",
    lambda s, d: det.preamble_lines(_csv_lines(s, d, "l_returnflag", F.when(F.col("l_returnflag") == "R", F.lit("p,q"))).groupBy("file", "line_no").agg(F.max("line").alias("line")), ",", 2),
    """WITH l AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, l_orderkey * 8 + l_linenumber AS line_no, bool_or(l_returnflag = 'R') AS fits FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, lead(fits) OVER (PARTITION BY file ORDER BY line_no) AS nxt FROM l) SELECT file, min(line_no) AS data_start FROM w WHERE fits AND nxt GROUP BY 1""",
)

# --- lifecycle: a log made from events --------------------------------------------------------------------------------

_STATES = list(lc.FILE_TRANSITIONS)


def _log(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select(_s("user_id").alias("file_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") * 7 % len(_STATES) + 1).cast("int")).alias("status"), F.lit(None).cast("string").alias("error"))


_SLIST = "[" + ", ".join(f"'{s}'" for s in _STATES) + "]"
_LOG = f"log AS (SELECT CAST(user_id AS VARCHAR) AS file_id, event_id AS seq, {_SLIST}[CAST(event_id * 7 % {len(_STATES)} + 1 AS BIGINT)] AS status FROM events), latest AS (SELECT file_id, max(seq) AS seq, arg_max(status, seq) AS status FROM log GROUP BY 1)"
_VALUES = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)
add("lifecycle_latest", lambda s, d: lc.latest(_log(s, d)).select("file_id", "seq", "status"), f"WITH {_LOG} SELECT * FROM latest")
add(
    "lifecycle_illegal_transitions",
    lambda s, d: lc.illegal_transitions(_log(s, d)),
    f"""WITH {_LOG}, t(a, b) AS (VALUES {_VALUES((a, b) for a, bs in lc.FILE_TRANSITIONS.items() for b in bs)}),
m AS (SELECT file_id, seq, lag(status) OVER (PARTITION BY file_id ORDER BY seq) AS from_status, status AS to_status FROM log)
SELECT * FROM m WHERE from_status IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE a = from_status AND b = to_status)""",
)
for _n, _f, _map in (("recovery", lc.recovered, lc.RECOVERY), ("retry", lc.retried, lc.RETRY)):
    add(f"lifecycle_{_n}", lambda s, d, f=_f: f(lc.latest(_log(s, d))), f"WITH {_LOG}, t(a, b) AS (VALUES {_VALUES(_map.items())}) SELECT file_id, status AS old, b AS status FROM latest JOIN t ON a = status")
add("lifecycle_status_counts", lambda s, d: lc.status_counts(lc.latest(_log(s, d))), f"WITH {_LOG} SELECT status, count(*) AS n FROM latest GROUP BY 1")

assert set(OVERRIDE_TYPES) >= {"Int64", "Int32", "Float64", "Boolean"}
