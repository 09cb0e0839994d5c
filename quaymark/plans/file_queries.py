"""Registered queries whose inputs are files: they write files made from the driver's tables, run the operators on them
and return what came of it, beside the SQL that says what should have.

Files are written by executors where their number grows with the tables. Shares, downloads and workbooks belong to the
driver's machine; their files are as many as there are regions or nations.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.config import ColumnMapping, ConfigError, FieldSpec, ItemConfig, Layout, ParseConfig, ValidationConfig
from quaymark.functions.exprs import key, lenient_double, numeric_like, scrub, strip
from quaymark.plans import queries as core
from quaymark.plans.queries import add, scratch
from quaymark.plans.reconcile import item_report, validate
from quaymark.sinks.parquet import DatasetNotFound, load_metadata, open_dataset, save_metadata, verify, with_overrides, write
from quaymark.sinks.xlsx import write_workbook
from quaymark.sources import detect as det
from quaymark.sources import files as fl
from quaymark.sources.layout import layout_warnings, load_layout
from quaymark.sources.records import issues, parse, read_report, report_lines, rows
from quaymark.streaming import lifecycle as lc
from quaymark.streaming.ingest import Ingest, file_name


def put_files(files: DataFrame, folder: str) -> str:
    """Writes (file, content as bytes) below folder, on the executors."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("file", "content").mapInArrow(run, "n long").agg(F.sum("n")).head()
    return folder


def here(prefix: str = "quaymark-") -> Path:
    """A folder of the driver's machine."""
    return Path(tempfile.mkdtemp(prefix=prefix))


def _table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- expressions on awkward text ----------------------------------------------------------------------------------------

_AWKWARD = "CASE CAST(l_linenumber AS INT) WHEN 1 THEN '12.5' WHEN 2 THEN ' 7' WHEN 3 THEN '1d' WHEN 4 THEN '' WHEN 5 THEN '-3' WHEN 6 THEN '1e3' ELSE 'abc' END"


def _lenient(spark, d):
    t = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_AWKWARD).alias("v"))
    return t.select("l_orderkey", "l_linenumber", lenient_double(t, "v").alias("v"))


add("lenient_cast", _lenient, "SELECT l_orderkey, l_linenumber, CASE CAST(l_linenumber AS INT) WHEN 1 THEN 12.5 WHEN 5 THEN -3.0 WHEN 6 THEN 1000.0 END AS v FROM lineitem")


def _keys(spark, d):
    raw = F.concat(F.lit(" \t Store-"), _s("l_suppkey"), F.lit("É  \n"))
    return _table(spark, d, "lineitem").select(key(raw).alias("key"), strip(raw).alias("stripped")).distinct()


add("strip_and_lower", _keys, "SELECT DISTINCT 'store-' || l_suppkey || 'é' AS key, 'Store-' || l_suppkey || 'É' AS stripped FROM lineitem")
add(
    "scrub_control",
    lambda s, d: _table(s, d, "part").select("p_partkey", scrub(F.concat(F.lit("a\x01\x08"), "p_name", F.lit("\t\x0b\x1f\r\nz\x0c"))).alias("v")),
    "SELECT p_partkey, 'a' || p_name || chr(9) || chr(13) || chr(10) || 'z' AS v FROM part",
)
_LIKE = "CASE CAST(l_linenumber AS INT) WHEN 1 THEN '1-2' WHEN 2 THEN '12.5' WHEN 3 THEN '-7' WHEN 4 THEN '' WHEN 5 THEN '1.2.3' WHEN 6 THEN '--1' ELSE '9.' END"
add(
    "numeric_like",
    lambda s, d: _table(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg(numeric_like(F.expr(_LIKE)).cast("int")).alias("share")).select("l_suppkey", F.round("share", 6).alias("share")),
    "SELECT l_suppkey, round(avg(CASE WHEN l_linenumber IN (1, 2, 3, 7) THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1",
)
for _kind, _short, _sql in (("Float32", "float32", "CAST(CASE CAST(l_linenumber AS INT) WHEN 6 THEN 12.5 WHEN 7 THEN 7 END AS FLOAT)"), ("Utf8", "text", core._TOKENS)):
    add(
        f"override_{_short}",
        lambda s, d, k=_kind: with_overrides(_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(core._TOKENS).alias("v")), {"v": k}),
        f"SELECT l_orderkey, l_linenumber, {_sql} AS v FROM lineitem",
    )

# --- listing, archives, shares --------------------------------------------------------------------------------------------


def _nation_files(spark, d) -> DataFrame:
    """A file for each nation: plain, gzip, zip, or broken; zips have a second member that nobody reads."""

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            names, data = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                if k % 5 == 1:
                    names.append(f"nation-{k}.csv.GZ")
                    data.append(gzip.compress(raw))
                elif k % 5 == 2:
                    out = io.BytesIO()
                    with zipfile.ZipFile(out, "w") as z:
                        z.mkdir("folder")
                        z.writestr("first.csv", raw)
                        z.writestr("second.csv", b"never read")
                    names.append(f"nation-{k}.zip")
                    data.append(out.getvalue())
                elif k % 5 == 3:
                    names.append(f"nation-{k}.gzip")
                    data.append(b"no archive")
                elif k % 5 == 4:
                    names.append(f"nation-{k}.txt")
                    data.append(b"\xef\xbb\xbf" + raw)
                else:
                    names.append(f"nation-{k}.csv")
                    data.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], ["file", "content"])

    return _table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("t")).mapInArrow(packed, "file string, content binary")


_NFILE = "'nation-' || n_nationkey || CASE n_nationkey % 5 WHEN 1 THEN '.csv.GZ' WHEN 2 THEN '.zip' WHEN 3 THEN '.gzip' WHEN 4 THEN '.txt' ELSE '.csv' END"


def _listing(spark, d):
    path = put_files(_nation_files(spark, d), scratch(spark))
    # numbered as they come: the listing is in the order of names
    return fl.listing(spark, path, "*.csv").coalesce(1).select((F.monotonically_increasing_id() + 1).alias("pos"), "name", "size")


add("listing", _listing, f"SELECT row_number() OVER (ORDER BY {_NFILE}) AS pos, {_NFILE} AS name, octet_length(encode(n_name)) AS size FROM nation WHERE n_nationkey % 5 = 0")


def _expanded(spark, d):
    path = put_files(_nation_files(spark, d), scratch(spark))
    return fl.contents(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("file"), "content")


add("expand_archives", _expanded, f"SELECT {_NFILE} AS file, CASE WHEN n_nationkey % 5 <> 3 THEN n_name END AS content FROM nation")


def _compressed(spark, d):
    names = [(r[0], fl.is_compressed(r[0])) for r in _nation_files(spark, d).select("file").collect()]  # the nations
    return spark.createDataFrame(names, "file string, compressed boolean")


add("is_compressed", _compressed, f"SELECT {_NFILE} AS file, n_nationkey % 5 IN (1, 2, 3) AS compressed FROM nation")


def _expanded_files(spark, d):
    """The same by paths, as the driver does it before it detects: what fails leaves nothing behind."""
    at, out = here(), []
    for name, data in _nation_files(spark, d).collect():  # the nations
        (at / name).write_bytes(data)
        if fl.is_compressed(name):
            try:
                out.append((name, fl.expand(at / name, at / "out").read_text(), False))
            except fl.SourceError:
                out.append((name, None, (at / "out").exists()))
            (at / "out").unlink(missing_ok=True)
    return spark.createDataFrame(out, "file string, content string, left_behind boolean")


add("expand_files", _expanded_files, f"SELECT {_NFILE} AS file, CASE WHEN n_nationkey % 5 <> 3 THEN n_name END AS content, false AS left_behind FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)")


class FolderSession:
    """What SftpTransport needs of an SFTP session, over a folder."""

    def __init__(self, root):
        self.root = Path(root)

    def listdir_attr(self, folder):
        class Entry:
            def __init__(self, p):
                self.filename, self.st_size, self.st_mode = p.name, p.stat().st_size, p.stat().st_mode

        return [Entry(p) for p in (self.root / folder.lstrip("/")).iterdir()]

    def stat(self, path):
        return os.stat(self.root / path.lstrip("/"))

    def get(self, path, target):
        Path(target).write_bytes((self.root / path.lstrip("/")).read_bytes())

    def close(self):
        pass


def _downloads(sftp: bool):
    def run(spark, d):
        at, out = here(), []
        share = at / "share" / "drop"
        (share / "nested").mkdir(parents=True)
        for name, text in _table(spark, d, "nation").select("n_name", F.concat_ws(" ", F.lit("of nation"), F.col("n_nationkey").cast("string"), F.lit("é")).alias("t")).collect():  # the nations
            (share / f"{name}.txt").write_text(text)
        t = fl.SftpTransport("host", connect=lambda *_: FolderSession(at / "share")) if sftp else fl.LocalTransport(at / "share")
        for i, (name, size) in enumerate(fl.discover(t, "/drop", "*.txt")):
            text = (share / name).read_bytes()
            wrong = i % 5
            try:
                # another size than announced, another digest, a digest in capitals
                got = fl.download(t, f"/drop/{name}", at / "in" / name, size + (wrong == 1), "0" * 32 if wrong == 2 else fl.file_digest(share / name).upper() if wrong == 3 else None)
                out.append((i, name, size, fl.file_digest(got, "md5"), fl.file_digest(got, "sha256"), got.read_bytes() == text))
            except fl.SourceError:
                out.append((i, name, size, None, None, (at / "in" / name).exists() or (at / "in" / f"{name}.part").exists()))
        t.close()
        return spark.createDataFrame(out, "pos int, name string, size bigint, md5 string, sha256 string, ok boolean")

    return run


_DOWN = """WITH n AS (SELECT CAST(row_number() OVER (ORDER BY n_name || '.txt') - 1 AS INT) AS pos, n_name || '.txt' AS name, 'of nation ' || n_nationkey || ' é' AS n_comment FROM nation)
SELECT pos, name, octet_length(encode(n_comment)) AS size, CASE WHEN pos % 5 NOT IN (1, 2) THEN md5(n_comment) END AS md5, CASE WHEN pos % 5 NOT IN (1, 2) THEN sha256(n_comment) END AS sha256, pos % 5 NOT IN (1, 2) AS ok FROM n"""
add("download_local", _downloads(False), _DOWN)
add("download_sftp", _downloads(True), _DOWN)
add(
    "file_digests",
    lambda s, d: fl.listing(s, put_files(_nation_files(s, d), scratch(s)), "*.csv").join(
        s.read.format("binaryFile").load(put_files(_nation_files(s, d), scratch(s))).select(F.element_at(F.split("path", "/"), -1).alias("name"), *[fl.digest(F.col("content"), a).alias(a) for a in ("md5", "sha256")]), "name"
    ).select("name", "md5", "sha256"),
    f"SELECT {_NFILE} AS name, md5(n_name) AS md5, sha256(n_name) AS sha256 FROM nation WHERE n_nationkey % 5 = 0",
)


def _swept(spark, d):
    at, made = here(), 0
    for (k,) in _table(spark, d, "nation").select("n_nationkey").collect():  # the nations
        for folder in ("raw", "datasets", f"datasets/{k}", f"datasets/{k}/deep"):
            (at / folder).mkdir(parents=True, exist_ok=True)
            for end in ("part", "decompressed", "parquet"):
                (at / folder / f"{k}.{end}").touch()
                made += 1
    gone = fl.sweep_parts(at)
    return spark.createDataFrame([(gone, sum(p.is_file() for p in at.rglob("*")))], "gone bigint, left_over bigint")


add("sweep_leftovers", _swept, "SELECT count(*) * 4 AS gone, count(*) * 8 AS left_over FROM nation")


def _layout(spark, d):
    at, n = here() / "layout.csv", _table(spark, d, "nation").select("n_name", "n_nationkey").orderBy(F.desc("n_nationkey")).collect()  # the nations
    lines = ["From , FIELD,Length,Note", *(f"{10 * k + 1},{name} é,{k % 9 + 1},x" for name, k in n), "5, ,1,no name"]
    at.write_bytes("\n".join(lines).encode("cp1252") + b"\x81")
    return spark.createDataFrame([(i, f.name, f.start, f.end) for i, f in enumerate(load_layout(at).fields)], "pos int, name string, start int, stop int")


add("layout_csv", _layout, "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS pos, n_name || ' é' AS name, CAST(10 * n_nationkey AS INT) AS start, CAST(10 * n_nationkey + n_nationkey % 9 + 1 AS INT) AS stop FROM nation")

# --- detection over files made from customers, in twelve shapes ---------------------------------------------------------

#: Customers of a file, and what is special about file f by f % 12.
PER_FILE, SHAPES = 8, 12
_LAYOUT = Layout((FieldSpec("KEY", 0, 8), FieldSpec("NATION", 8, 12), FieldSpec("SEGMENT", 12, 24)))
_HEADS = {0: "KEY,NATION,SEGMENT\n", 2: "a note\nKEY;NATION;SEGMENT\n", 3: "a note\nanother note\nKEY\tNATION\tSEGMENT\n", 5: "KEY,NATION,SEGMÉNT\n", 6: "KEY,NATION,SEGMENT\n", 7: "KEY,NATION,SEGMENT\n", 11: "KEY,NATION,SEG\x81MENT\n"}


def _shaped(spark, d) -> DataFrame:
    c = _table(spark, d, "customer")
    no = F.floor(F.col("c_custkey") / PER_FILE)
    v, k, n, s = no % SHAPES, _s("c_custkey"), _s("c_nationkey"), F.col("c_mktsegment")
    line = F.when(v == 1, F.concat_ws("|", k, n, s)).when(v == 2, F.concat_ws(";", k, n, s)).when(v == 3, F.concat_ws("\t", k, n, s))
    line = line.when(v == 4, F.concat(F.rpad(k, 8, " "), F.rpad(n, 4, " "), F.rpad(s, 12, " ")))
    line = line.when((v == 7) & (F.col("c_custkey") % 2 == 0), F.concat(k, F.lit(","), n, F.lit(",\\\n"), s))
    line = line.when(v == 8, F.when(F.col("c_custkey") % 8 == 0, F.concat(F.lit("H,"), k)).otherwise(F.concat_ws(",", F.lit("D"), k, n, s)))
    line = line.when(v == 9, F.when(F.col("c_custkey") % 8 == 0, F.concat(F.lit("AB"), F.lpad(k, 14, "0"))).otherwise(F.concat(F.lit("AB"), F.lpad(k, 6, "0"))))
    line = line.otherwise(F.concat_ws(",", k, n, s))
    one = c.groupBy(no.alias("no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda r: r["line"]), "\n").alias("body"))
    v = F.col("no") % SHAPES
    head = F.coalesce(F.create_map(*[F.lit(x) for kv in _HEADS.items() for x in kv])[v.cast("int")], F.lit(""))
    text = F.concat(head, "body")
    data = F.when(v == 10, F.lit("").cast("binary")).when(v.isin(5, 11), F.encode(text, "ISO-8859-1")).when(v == 6, F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))).otherwise(text.cast("binary"))
    return one.select(F.concat(F.lit("c"), _s("no"), F.lit(".txt")).alias("file"), data.alias("content"))


_SHAPED = f"""WITH c AS (SELECT *, c_custkey // {PER_FILE} AS no, (c_custkey // {PER_FILE}) % {SHAPES} AS v FROM customer),
f AS (SELECT 'c' || no || '.txt' AS file, v, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even, CAST(sum(CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS eighth,
 sum(length(c_custkey::VARCHAR) + length(c_nationkey::VARCHAR) + length(c_mktsegment)) AS chars FROM c GROUP BY 1, 2)"""


def _detected(*cols, layout=None):
    def run(spark, d):
        found = det.detect_files(spark, put_files(_shaped(spark, d), scratch(spark)), layout)
        return found.selectExpr("element_at(split(file, '/'), -1) AS file", *cols)

    return run


add(
    "detect_format",
    _detected("format", "structure", "delimiter"),
    f"""{_SHAPED} SELECT file, CASE WHEN v IN (4, 9) THEN 'FIXED_WIDTH' WHEN v = 10 THEN 'UNSUPPORTED' ELSE 'DELIMITED' END AS format,
 CASE WHEN v = 7 AND even > 0 THEN 'MULTILINE' WHEN v = 8 AND n > 1 THEN 'RECORD_TYPED' WHEN v = 9 AND n > 1 AND eighth > 0 THEN 'MULTILINE' ELSE 'FLAT' END AS structure,
 CASE v WHEN 1 THEN '|' WHEN 2 THEN ';' WHEN 3 THEN chr(9) WHEN 4 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL ELSE ',' END AS delimiter FROM f""",
)
add(
    "detect_encoding",
    _detected("encoding", "encoding_method"),
    f"{_SHAPED} SELECT file, CASE v WHEN 5 THEN 'cp1252' WHEN 11 THEN 'latin-1' ELSE 'utf-8' END AS encoding, CASE v WHEN 5 THEN 'cp1252' WHEN 6 THEN 'utf-8-bom' WHEN 11 THEN 'latin-1-fallback' ELSE 'utf-8' END AS encoding_method FROM f",
)
_PRE = "CASE v WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END"
add(
    "detect_preamble_and_header",
    _detected("preamble", "header", "CAST(get_json_object(stats, '$.data_start_line') AS INT) AS data_start"),
    f"{_SHAPED} SELECT file, {_PRE} AS preamble, CASE WHEN v IN (4, 9, 10) THEN NULL ELSE v NOT IN (1, 8) END AS header, {_PRE} + 1 AS data_start FROM f",
)
_CONF = "CASE v WHEN 3 THEN 0.7 WHEN 2 THEN 0.85 WHEN 4 THEN 0.4 WHEN 7 THEN CASE WHEN even > 0 THEN 0.7 ELSE 1.0 END WHEN 8 THEN round(1.0 - 0.5 * eighth / n - 0.3, 2) WHEN 9 THEN CASE WHEN n > 1 AND eighth > 0 THEN 0.1 ELSE 0.4 END WHEN 10 THEN 0.0 WHEN 11 THEN 0.9 ELSE 1.0 END"
add(
    "detect_gates",
    _detected("confidence", "parseable", "needs_approval", "automatic"),
    f"{_SHAPED}, g AS (SELECT *, CAST({_CONF} AS DOUBLE) AS confidence, v NOT IN (4, 8, 9, 10) AS parseable FROM f) SELECT file, confidence, parseable, confidence < 0.8 AS needs_approval, parseable AND confidence >= 0.8 AS automatic FROM g",
)
_COLS = "CASE v WHEN 1 THEN 'COL_1,COL_2,COL_3' WHEN 4 THEN '' WHEN 5 THEN 'KEY,NATION,SEGMÉNT' WHEN 8 THEN 'COL_1,COL_2' WHEN 9 THEN '' WHEN 10 THEN '' WHEN 11 THEN 'KEY,NATION,SEG' || chr(129) || 'MENT' ELSE 'KEY,NATION,SEGMENT' END"
add("detect_columns", _detected("array_join(columns, ',') AS columns"), f"{_SHAPED} SELECT file, {_COLS} AS columns FROM f")
add(
    "detect_types",
    _detected("array_join(map_values(types), ',') AS types"),
    f"{_SHAPED} SELECT file, CASE WHEN v IN (4, 9, 10) THEN '' WHEN v = 7 AND even > 0 THEN 'String,Int64,String' WHEN v = 8 THEN 'String,Int64' ELSE 'Int64,Int64,String' END AS types FROM f",
)
_BYTES = "CASE v WHEN 4 THEN 24 * n + n - 1 WHEN 8 THEN chars8 WHEN 9 THEN 8 * n + 8 * eighth + n - 1 WHEN 10 THEN 0 ELSE chars + 2 * n + n - 1 + CASE v WHEN 0 THEN 19 WHEN 2 THEN 26 WHEN 3 THEN 39 WHEN 5 THEN 19 WHEN 6 THEN 22 WHEN 7 THEN 19 + 2 * even WHEN 11 THEN 20 ELSE 0 END END"
add(
    "detect_sample",
    _detected("CAST(get_json_object(stats, '$.bytes_read') AS BIGINT) AS bytes_read", "CAST(get_json_object(stats, '$.lines_sampled') AS BIGINT) AS lines_sampled"),
    f"""{_SHAPED}, g AS (SELECT 'c' || no || '.txt' AS file, sum(CASE WHEN c_custkey % 8 = 0 THEN 2 + length(c_custkey::VARCHAR) ELSE 4 + length(c_custkey::VARCHAR) + length(c_nationkey::VARCHAR) + length(c_mktsegment) END) + count(*) - 1 AS chars8 FROM c GROUP BY 1)
SELECT file, CAST({_BYTES} AS BIGINT) AS bytes_read, CASE v WHEN 10 THEN 0 WHEN 1 THEN n WHEN 4 THEN n WHEN 8 THEN n WHEN 9 THEN n WHEN 2 THEN n + 2 WHEN 3 THEN n + 3 WHEN 7 THEN n + 1 + even ELSE n + 1 END AS lines_sampled FROM f JOIN g USING (file)""",
)
add(
    "detect_with_layout",
    _detected("confidence", "automatic", "size(warnings) AS warnings", layout=_LAYOUT),
    f"""{_SHAPED} SELECT file, CAST(CASE v WHEN 4 THEN 0.8 WHEN 9 THEN CASE WHEN n > 1 AND eighth > 0 THEN 0.5 ELSE 0.8 END ELSE {_CONF} END AS DOUBLE) AS confidence,
 CASE WHEN v = 9 THEN n = 1 OR eighth = 0 WHEN v = 4 THEN true WHEN v IN (8, 10) THEN false ELSE {_CONF} >= 0.8 END AS automatic, CASE v WHEN 9 THEN 1 ELSE 0 END AS warnings FROM f""",
)


def _bounded(spark, d):
    out = []
    for (k,) in _table(spark, d, "region").select("r_regionkey").collect():  # the regions
        for name, content in (("short lines", b"x,y\n" * 30_000 * (k + 1)), ("long lines", (b"z" * 199 + b"\n") * 3_000 * (k + 1))):
            lines, _, _, n = det.sample(content)
            out.append((f"{name} {k}", n, len(lines), det.detect_encoding(b"a" * (det.ENCODING_BYTES - 1) + "é".encode())[0]))
    return spark.createDataFrame(out, "file string, bytes_read bigint, lines bigint, cut_at_the_edge string")


add(
    "bounded_sample",
    _bounded,
    """SELECT 'short lines ' || r_regionkey AS file, least(120000 * (r_regionkey + 1), 1000000) AS bytes_read, CAST(20000 AS BIGINT) AS lines, 'cp1252' AS cut_at_the_edge FROM region
UNION ALL SELECT 'long lines ' || r_regionkey, least(600000 * (r_regionkey + 1), 1000000), least(3000 * (r_regionkey + 1), 5000), 'cp1252' FROM region""",
)
add(
    "layout_fit",
    lambda s, d: s.createDataFrame([(r[0], len(layout_warnings(_LAYOUT, ["x" * 24] * (100 - r[0]) + ["x"] * r[0])), len(layout_warnings(_LAYOUT, ["", " "]))) for r in _table(s, d, "nation").select(F.col("n_nationkey").cast("int")).collect()], "short int, warnings int, of_nothing int"),
    "SELECT CAST(n_nationkey AS INT) AS short, CASE WHEN n_nationkey > 5 THEN 1 ELSE 0 END AS warnings, 1 AS of_nothing FROM nation",
)

# --- parsing of records with everything odd about them --------------------------------------------------------------------

_ODD = ParseConfig(columns=("K", "K", "A", "B"), delimiter=",", skip_rows=2)


def _odd(spark, d):
    o, ln = _s("l_orderkey"), F.col("l_linenumber")
    tail = F.when(ln == 1, ",a,b").when(ln == 2, ',"x\ny",b').when(ln == 3, ",a,b\n   ").when(ln == 4, ",a\\,b,c").when(ln == 5, ",one\\\ntwo,z").when(ln == 6, ",a\\,b").otherwise(',"a,b",c,d')
    return parse(core._files(spark, d, F.concat(o, F.lit(","), _s("l_linenumber"), tail), "before\nand, so on\nK,K,A,B"), _ODD)


add(
    "parse_odd_rows",
    lambda s, d: rows(_odd(s, d), _ODD),
    """SELECT CAST(l_orderkey AS VARCHAR) AS "K", CAST(l_linenumber AS VARCHAR) AS "K_2", CASE CAST(l_linenumber AS INT) WHEN 2 THEN 'x' || chr(10) || 'y' WHEN 5 THEN 'onetwo' WHEN 1 THEN 'a' WHEN 3 THEN 'a' ELSE 'a,b' END AS "A",
 CASE CAST(l_linenumber AS INT) WHEN 4 THEN 'c' WHEN 5 THEN 'z' WHEN 6 THEN '' WHEN 7 THEN 'c' ELSE 'b' END AS "B" FROM lineitem""",
)
_ODDS = """WITH l AS (SELECT 'supplier-' || l_suppkey AS file, CAST(l_orderkey AS VARCHAR) AS o, CAST(l_linenumber AS INT) AS ln,
 CAST(4 + coalesce(sum(CASE WHEN l_linenumber IN (2, 3, 5) THEN 2 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS line_number FROM lineitem),
i AS (SELECT file, line_number, 0 AS ord, 'escaped_delimiter' AS issue, CASE ln WHEN 4 THEN '4' ELSE '3' END AS found_columns, o || CASE ln WHEN 4 THEN ',4,a\\,b,c' ELSE ',6,a\\,b' END AS raw_data FROM l WHERE ln IN (4, 6)
 UNION ALL SELECT file, line_number, 1, 'column_mismatch', '3', o || ',6,a\\,b' FROM l WHERE ln = 6
 UNION ALL SELECT file, line_number, 0, 'quoted_delimiter', '5', o || ',7,"a,b",c,d' FROM l WHERE ln = 7
 UNION ALL SELECT file, line_number, 1, 'column_mismatch', '5', o || ',7,"a,b",c,d' FROM l WHERE ln = 7)"""
_ISSUE_COLS = ["file", "line_number", "ord", "issue", "expected_columns", "found_columns", "raw_data"]
add("parse_odd_issues", lambda s, d: issues(_odd(s, d)).select(*_ISSUE_COLS), f"{_ODDS} SELECT *, '4' AS expected_columns FROM i")


def _reported(part):
    def run(spark, d):
        path = scratch(spark)
        report_lines(_odd(spark, d), _ODD).write.text(path)
        return read_report(spark.read.text(path))[part]

    return run


add("parse_report_issues", lambda s, d: _reported(1)(s, d).select(*_ISSUE_COLS), f"{_ODDS} SELECT *, '4' AS expected_columns FROM i")
add(
    "parse_report_files",
    _reported(0),
    """SELECT 'supplier-' || l_suppkey AS file, count(*) + 1 AS total_records, count(*) AS parsed_records, count_if(l_linenumber >= 6) AS bad_rows, count_if(l_linenumber >= 6) AS column_mismatch, CAST(0 AS BIGINT) AS parse_error,
 CAST(0 AS BIGINT) AS short_line, count_if(l_linenumber = 7) AS quoted_delimiter, count_if(l_linenumber IN (4, 6)) AS escaped_delimiter FROM lineitem GROUP BY 1""",
)


def _broken(spark, d):
    """Fields longer than csv rules allow."""
    config = ParseConfig(columns=("A", "B"), delimiter=",")
    files = _table(spark, d, "region").select(F.col("r_name").alias("file"), F.concat(F.lit("A,B\n1,2\n"), F.repeat(F.lit('"'), 1), F.repeat(F.lit("x"), 140_000), _s("r_regionkey")).alias("content"))
    rec = parse(files, config)
    return issues(rec).select("file", "line_number", "issue", "found_columns", F.length("raw_data").alias("n")).join(rows(rec, config, True).where("_line = 3").select(F.col("_file").alias("file"), F.length("A").alias("first"), "B"), "file")


add("parse_error_records", _broken, """SELECT r_name AS file, 3 AS line_number, 'parse_error' AS issue, 'N/A' AS found_columns, 140002 AS n, 140002 AS first, '' AS "B" FROM region""")


def _encodings(spark, d):
    path = put_files(_table(spark, d, "nation").select(F.concat("n_name", F.lit(".txt")).alias("file"), F.encode(F.concat("n_name", F.lit("é")), "ISO-8859-1").alias("content")), scratch(spark))
    out = None
    for e in ("utf-8", "cp1252", "latin-1"):
        one = fl.contents(spark, path, e).select(F.element_at(F.split("file", "/"), -1).alias("file"), F.lit(e).alias("encoding"), "content")
        out = one if out is None else out.unionByName(one)
    return out


add("read_encodings", _encodings, "SELECT n_name || '.txt' AS file, e AS encoding, n_name || CASE e WHEN 'utf-8' THEN chr(65533) ELSE 'é' END AS content FROM nation, unnest(['utf-8', 'cp1252', 'latin-1']) AS t(e)")

# --- sinks ---------------------------------------------------------------------------------------------------------------


def _artifacts(spark, d):
    a, b = core.pair(spark, d, True)
    at, out = scratch(spark), here()
    for df, name in ((a, "bau"), (b, "test")):
        write(df, f"{at}/{name}")
    side = ColumnMapping(units="UNITS", price="PRICE", upc="UPC", desc="DESC")
    done = item_report(spark, f"{at}/bau", f"{at}/test", ItemConfig(side, side), f"file://{out}", workbook=False)
    return spark.createDataFrame([(n, spark.read.parquet(p).count(), len(spark.read.parquet(p).columns)) for n, p in done.artifacts.items()], "artifact string, n bigint, columns bigint")


add(
    "item_report_artifacts",
    _artifacts,
    f"""{core._ICOMP} SELECT 'bau_summary' AS artifact, (SELECT count(*) FROM a) AS n, CAST(6 AS BIGINT) AS columns UNION ALL SELECT 'test_summary', (SELECT count(*) FROM b), 6
 UNION ALL SELECT 'comparison', (SELECT count(*) FROM comp), 12 UNION ALL SELECT 'summary', (SELECT count(DISTINCT present_in) + 1 FROM comp), 5""",
)


def read_workbook(path) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of all cells that hold something."""
    out = []
    with zipfile.ZipFile(path) as z:
        names = re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        for i, name in enumerate(names, 1):
            sheet = z.read(f"xl/worksheets/sheet{i}.xml").decode()
            for r, row in enumerate(re.findall(r"<row>(.*?)</row>", sheet, re.S), 1):
                for c, cell in enumerate(re.findall(r"<c/>|<c(?: [^>]*)?>.*?</c>", row, re.S), 1):
                    if text := "".join(re.findall(r">([^<]*)</(?:v|t)>", cell)):
                        out.append((name, r, c, text.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")))
    return out


def _workbook(spark, d):
    path = here() / "book.xlsx"
    sheets = {"Regions": _table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Nations": _table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(" <&>\x01")).alias("n_name"), F.when(F.col("n_nationkey") > 3, F.col("n_regionkey")).alias("r")).orderBy("n_nationkey")}
    write_workbook(str(path), sheets)
    return spark.createDataFrame(read_workbook(path), "sheet string, r int, c int, v string")


add(
    "workbook_cells",
    _workbook,
    """SELECT 'Regions' AS sheet, 1 AS r, c, v FROM (VALUES (1, 'r_regionkey'), (2, 'r_name')) AS t(c, v) UNION ALL SELECT 'Nations', 1, c, v FROM (VALUES (1, 'n_nationkey'), (2, 'n_name'), (3, 'r')) AS t(c, v)
UNION ALL SELECT 'Regions', CAST(r_regionkey + 2 AS INT), 1, CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'Regions', CAST(r_regionkey + 2 AS INT), 2, r_name FROM region
UNION ALL SELECT 'Nations', CAST(n_nationkey + 2 AS INT), 1, CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'Nations', CAST(n_nationkey + 2 AS INT), 2, n_name || ' <&>' FROM nation
UNION ALL SELECT 'Nations', CAST(n_nationkey + 2 AS INT), 3, CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey > 3""",
)


def _metadata(spark, d):
    at = scratch(spark)
    for k, name in _table(spark, d, "region").select("r_regionkey", "r_name").collect():  # the regions
        save_metadata(spark, f"{at}/{k}", {"dataset": name, "rows": k, "nested": {"a": [k]}})
    spark.createDataFrame([("{not json",)], "value string").write.text(f"{at}/broken")
    return spark.createDataFrame([(m["dataset"], m["rows"], m["nested"]["a"][0]) for m in load_metadata(spark, f"{at}/*")], "dataset string, n bigint, first bigint")


add("metadata_roundtrip", _metadata, "SELECT r_name AS dataset, CAST(r_regionkey AS BIGINT) AS n, CAST(r_regionkey AS BIGINT) AS first FROM region")


def _verified(spark, d):
    """Expected and found, for right, wrong and no expectations; a second write of the same rows has the same digest."""
    src, out = _table(spark, d, "region").select("r_regionkey", "r_name").coalesce(1), []
    paths = scratch(spark), scratch(spark)
    done = [write(src, p) for p in paths]
    for case, n, cols in (("as written", done[0].rows, done[0].columns), ("other rows", done[0].rows + 1, None), ("other columns", None, ["r_name"]), ("anything", None, None)):
        seen = [verify(spark, p, n, cols) for p in paths]
        out.append((case, seen[0]["rows_matched"], seen[0]["columns_matched"], seen[0]["sha256"] == seen[1]["sha256"] and len(seen[0]["sha256"]) == 64))
    try:
        open_dataset(spark, f"{paths[0]}-none")
    except DatasetNotFound as e:
        out.append((str(e).split(":")[0], False, False, False))
    return spark.createDataFrame(out, "expected string, rows_matched boolean, columns_matched boolean, same_digest boolean")


add("verify_cases", _verified, "SELECT * FROM (VALUES ('as written', true, true, true), ('other rows', false, true, true), ('other columns', true, false, true), ('anything', true, true, true), ('Dataset not found', false, false, false)) AS t(expected, rows_matched, columns_matched, same_digest)")


def _sorted_stores(spark, d):
    a, b = core.pair(spark, d)
    at = scratch(spark)
    write(a, f"{at}/bau")
    write(b, f"{at}/test")
    side = ColumnMapping(store="STORE", units="UNITS", price="PRICE")
    frames = validate(spark, f"{at}/bau", f"{at}/test", ValidationConfig(side, side, sales_analysis=True)).frames["sales"]
    # numbered as they come
    return frames["bau"].coalesce(1).select((F.monotonically_increasing_id() + 1).alias("pos"), "store")


add("sales_sorted_by_store", _sorted_stores, f"WITH {core._PAIR} SELECT row_number() OVER (ORDER BY STORE) AS pos, STORE AS store FROM (SELECT DISTINCT STORE FROM bau)")

# --- configuration ---------------------------------------------------------------------------------------------------------


def _refused(make) -> bool:
    try:
        made = make()
        if hasattr(made, "validate"):
            made.validate()
        return False
    except ConfigError:
        return True


def _configs(spark, d):
    c, full = ("A",), ColumnMapping("S", "U", "P", None, "C", "D")
    cases = {
        "delimited": lambda: ParseConfig(c, ","), "two characters": lambda: ParseConfig(c, ",,"), "no columns": lambda: ParseConfig((), ","), "neither": lambda: ParseConfig(c),
        "both": lambda: ParseConfig(c, ",", _LAYOUT), "fixed": lambda: ParseConfig(layout=_LAYOUT), "negative": lambda: ParseConfig(c, ",", skip_rows=-1), "overlap": lambda: Layout((FieldSpec("A", 0, 4), FieldSpec("B", 3, 5))),
        "empty layout": lambda: Layout(()), "backwards": lambda: FieldSpec("A", 3, 3), "item": lambda: ItemConfig(full, full), "item without description": lambda: ItemConfig(full, ColumnMapping("S", "U", "P", None, "C")),
    }
    return spark.createDataFrame([(n, _refused(f)) for n, f in cases.items()], "what string, refused boolean")


add("config_rules", _configs, "SELECT what, what NOT IN ('delimited', 'fixed', 'item') AS refused FROM (SELECT unnest(['delimited', 'two characters', 'no columns', 'neither', 'both', 'fixed', 'negative', 'overlap', 'empty layout', 'backwards', 'item', 'item without description']) AS what)")


def _requirements(spark, d):
    out, full = [], ColumnMapping("S", "U", "P", None, "C", "D")
    for name in ("store", "sales", "upc"):
        gone = ValidationConfig(ColumnMapping(), full, **{f"{name}_analysis": True}).missing_columns()
        out += [(name, x) for x in gone.get(name, [])]
    return spark.createDataFrame(out, "analysis string, missing string")


add("analysis_requirements", _requirements, "SELECT * FROM (VALUES ('store', 'bau.store'), ('store', 'bau.units'), ('store', 'bau.price'), ('sales', 'bau.store'), ('upc', 'bau.upc'), ('upc', 'bau.desc'), ('upc', 'bau.units'), ('upc', 'bau.price')) AS t(analysis, missing)")

# --- lifecycle ---------------------------------------------------------------------------------------------------------------

_DSTATES = list(lc.DATASET_TRANSITIONS)
_DLIST = "[" + ", ".join(f"'{x}'" for x in _DSTATES) + "]"


def _dataset_log(spark, d):
    ev = _table(spark, d, "events")
    return ev.select(_s("user_id").alias("file_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, _DSTATES)), (F.col("event_id") * 3 % len(_DSTATES) + 1).cast("int")).alias("status"), F.lit(None).cast("string").alias("error"))


add(
    "dataset_illegal_transitions",
    lambda s, d: lc.illegal_transitions(_dataset_log(s, d), lc.DATASET_TRANSITIONS),
    f"""WITH log AS (SELECT CAST(user_id AS VARCHAR) AS file_id, event_id AS seq, {_DLIST}[CAST(event_id * 3 % {len(_DSTATES)} + 1 AS BIGINT)] AS status FROM events),
t(a, b) AS (VALUES {core._VALUES((a, b) for a, bs in lc.DATASET_TRANSITIONS.items() for b in bs)}), m AS (SELECT file_id, seq, lag(status) OVER (PARTITION BY file_id ORDER BY seq) AS from_status, status AS to_status FROM log)
SELECT * FROM m WHERE from_status IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE a = from_status AND b = to_status)""",
)
add(
    "lifecycle_terminal_states",
    lambda s, d: s.createDataFrame([(x, lc.is_terminal(x)) for x in lc.FILE_TRANSITIONS], "status string, terminal boolean"),
    f"SELECT status, status = 'RAW_DELETED' OR status LIKE '%FAILED' AS terminal FROM (SELECT unnest({core._SLIST}) AS status)",
)


def _registry(spark, d):
    """A log with a malformed entry, read back."""
    at = scratch(spark)
    core._log(spark, d).write.json(f"{at}/log")
    spark.createDataFrame([('{"file_id": "x", "seq":',), ("null",)], "value string").write.mode("append").text(f"{at}/log")
    none = Ingest(spark, at, f"{at}/none").states().count()
    return Ingest(spark, at, at).states().select("file_id", "seq", "status", F.lit(none).alias("states_without_a_log"))


add("registry_states", _registry, f"WITH {core._LOG} SELECT *, 0 AS states_without_a_log FROM latest")


def _ingested(spark, d):
    """Files of the regions go through all of it: a share, a pass, an approval, a crash, a retry, a clean-up, a second pass."""
    at = here()
    (at / "share").mkdir()
    for k, name in _table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect():  # the regions
        text = f"KEY,NAME\n{k},{name}\n{k + 1},{name}\n".encode()
        data = {1: gzip.compress(text), 2: b"no gzip", 3: b"a note\nanother\n" + text}.get(k, text)
        (at / "share" / f"{k}.csv{'.gz' if k in (1, 2) else ''}").write_bytes(data)
    job = Ingest(spark, f"{at}/raw", f"file://{at}/root")
    (at / "raw").mkdir()
    fetched = job.fetch(fl.LocalTransport(at / "share"), "/")
    job.process()
    by = {file_name(r["file_id"]): r["file_id"] for r in job.states().collect()}
    job.approve(by["3.csv"], ParseConfig(columns=("KEY", "NAME"), delimiter=",", skip_rows=2, overrides={"KEY": "Int64"}))
    job._append([(by["4.csv"], "PARSING", None)])  # as if the process had ended there
    resumed = job.resume()
    (at / "raw" / "2.csv.gz").write_bytes(gzip.compress(b"KEY,NAME\n2,x\n3,x\n"))
    retried = job.retry_failed()
    (at / "raw" / "0.csv.part").touch()
    job.cleanup(by["0.csv"])
    again = job.fetch(fl.LocalTransport(at / "share"), "/")
    job.process()
    rows_of = {m["dataset"]: job.open(m["dataset"]).count() for m in job.datasets()}
    datasets = {r["file_id"]: r["status"] for r in job.dataset_states().collect()}
    out = []
    for r in job.states().collect():  # the regions
        n = file_name(r["file_id"])
        out.append((n, r["status"], rows_of[n], datasets[n], (at / "raw" / n).exists() or (at / "raw" / f"{n}.part").exists(), fetched, resumed, retried, again))
    return spark.createDataFrame(out, "file string, status string, n bigint, dataset string, raw boolean, fetched int, resumed int, retried int, again int")


add(
    "ingest_passes",
    _ingested,
    """SELECT r_regionkey || CASE WHEN r_regionkey IN (1, 2) THEN '.csv.gz' ELSE '.csv' END AS file, CASE WHEN r_regionkey = 0 THEN 'RAW_DELETED' ELSE 'COMPLETE' END AS status, CAST(2 AS BIGINT) AS n, 'COMPLETE' AS dataset,
 r_regionkey <> 0 AS raw, 5 AS fetched, 1 AS resumed, 1 AS retried, 0 AS again FROM region""",
)

