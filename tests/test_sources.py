import gzip
import zipfile

import pytest

from quaymark.config import ConfigError, FieldSpec, Layout, ParseConfig
from quaymark.sinks.parquet import verify, with_overrides, write
from quaymark.sources import detect as det
from quaymark.sources import files as fl
from quaymark.sources.layout import load_layout
from quaymark.sources.records import counters, issue_counts, issues, parse, rows, unique_names

C3 = ("STORE", "UNITS", "PRICE")
HEAD = "STORE,UNITS,PRICE\n"


def run(spark, text, **kw):
    c = ParseConfig(**({"columns": C3, "delimiter": ","} | kw))
    rec = parse(spark.createDataFrame([("f", text)], "file string, content string"), c)
    data = [tuple(r)[2:] for r in rows(rec, c, True).orderBy("_line").collect()]
    return data, {r["issue"]: r["n"] for r in issue_counts(rec).collect()}, tuple(counters(rec, c).head()), [r["line_number"] for r in issues(rec).orderBy("line_number").collect()]


@pytest.mark.parametrize(
    "text,kw,data,found,count",
    [
        (HEAD + "1001,45,500\n1002,60,700", {}, [("1001", "45", "500"), ("1002", "60", "700")], {}, (3, 2, 0)),
        ("1001,45,500\n1002,60,700\n", {"header": False}, [("1001", "45", "500"), ("1002", "60", "700")], {}, (2, 2, 0)),
        (HEAD + '1001,"45,000",500', {}, [("1001", "45,000", "500")], {"quoted_delimiter": 1}, (2, 1, 0)),
        (HEAD + "1001,45\\,000,500", {}, [("1001", "45,000", "500")], {"escaped_delimiter": 1}, (2, 1, 0)),
        (HEAD + '1,"multi\nline value",2\n3,4,5', {}, [("1", "multi\nline value", "2"), ("3", "4", "5")], {}, (3, 2, 0)),
        ("A,B\none,two\\\nthree\nfive,six", {"columns": ("A", "B")}, [("one", "twothree"), ("five", "six")], {}, (3, 2, 0)),
        ("A,B\none,t\\\nw\\\no\nend,x\\", {"columns": ("A", "B")}, [("one", "two"), ("end", "x")], {}, (3, 2, 0)),
        ("\n  \n" + HEAD + "1,2,3\n\n4,5,6", {}, [("1", "2", "3"), ("4", "5", "6")], {}, (3, 2, 0)),
        ("a note\nanother\n" + HEAD + "1,2,3", {"skip_rows": 2}, [("1", "2", "3")], {}, (2, 1, 0)),
        (HEAD + "1,2\n3,4,5,6\n7,8,9", {}, [("1", "2", ""), ("3", "4", "5"), ("7", "8", "9")], {"column_mismatch": 2}, (4, 3, 2)),
        (HEAD + "a\x01b,  c,d", {}, [("ab", "c", "d")], {}, (2, 1, 0)),
        (HEAD + '1,"a"b,2', {}, [("1", "ab", "2")], {}, (2, 1, 0)),
    ],
)
def test_delimited(spark, text, kw, data, found, count):
    got, iss, cnt, _ = run(spark, text, **kw)
    assert got == data and iss == found and cnt == count


def test_fixed(spark):
    lay = Layout((FieldSpec("A", 0, 4), FieldSpec("B", 4, 8)))
    data, iss, cnt, lines = run(spark, "1001AAAA\n100\n9999BBBB", columns=(), delimiter=None, layout=lay, header=False)
    assert data == [("1001", "AAAA"), ("100", ""), ("9999", "BBBB")] and iss == {"short_line": 1} and lines == [2] and cnt == (3, 3, 1)
    assert run(spark, "BANNER\nA   B\n1001AAAA", columns=(), delimiter=None, layout=lay, header=True, skip_rows=1)[2] == (2, 2, 0)


def test_names_and_config():
    assert unique_names(["A", "A", "B"]) == ["A", "A_2", "B"]
    for bad in ({"delimiter": ",,", "columns": C3}, {"delimiter": ","}, {}, {"delimiter": ",", "columns": C3, "skip_rows": -1}):
        with pytest.raises(ConfigError):
            ParseConfig(**bad).validate()
    with pytest.raises(ConfigError):
        Layout((FieldSpec("A", 0, 4), FieldSpec("B", 3, 8)))


def test_overrides(spark):
    df = spark.createDataFrame([("12", "true"), ("3.5", "false"), ("x", "0"), ("100", ""), (None, "maybe")], "p string, f string")
    got = with_overrides(df, {"p": "Float64", "f": "Boolean"}).collect()
    assert [r["p"] for r in got] == [12.0, 3.5, None, 100.0, None] and [r["f"] for r in got] == [True, False, False, False, None]
    assert [r["p"] for r in with_overrides(df, {"p": "Int64"}).collect()] == [12, None, None, 100, None]
    for bad in ({"none": "Int64"}, {"p": "List"}):
        with pytest.raises(ConfigError):
            with_overrides(df, bad)


def test_write_and_verify(spark, tmp_path):
    df = spark.sql("select 'a' as x, null as y")
    done = write(df, str(tmp_path / "d"))
    assert done.rows == 1 and done.schema["y"] == "string"
    seen = verify(spark, str(tmp_path / "d"), 2, ["x"])
    assert not seen["rows_matched"] and not seen["columns_matched"]


def test_files(spark, tmp_path):
    (tmp_path / "share").mkdir()
    (tmp_path / "share/sales.txt").write_text("abc")
    (tmp_path / "share/other.csv").write_text("x")
    (tmp_path / "share/nested").mkdir()
    t = fl.LocalTransport(tmp_path / "share")
    assert fl.discover(t, "/") == [("other.csv", 1), ("sales.txt", 3)] and fl.discover(t, "/", "*.csv") == [("other.csv", 1)]
    with pytest.raises(fl.SourceError):
        fl.download(t, "/sales.txt", tmp_path / "in/s", expected_size=9)
    with pytest.raises(fl.SourceError):
        fl.download(t, "/sales.txt", tmp_path / "in/s", md5="0" * 32)
    assert not list((tmp_path / "in").iterdir())
    got = fl.download(t, "/sales.txt", tmp_path / "in/s", md5="900150983CD24FB0D6963F7D28E17F72")
    assert got.read_text() == "abc"
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.txt", "first")
        z.writestr("b.txt", "second")
    assert fl.expand(tmp_path / "two.zip", tmp_path / "out").read_text() == "first"
    (tmp_path / "bad.gz").write_bytes(b"nope")
    (tmp_path / "empty.gz").write_bytes(gzip.compress(b""))
    for bad in ("bad.gz", "empty.gz"):
        with pytest.raises(fl.SourceError):
            fl.expand(tmp_path / bad, tmp_path / "x")
        assert not (tmp_path / "x").exists()
    (tmp_path / "enc").mkdir()
    (tmp_path / "enc/u.csv").write_bytes("﻿é".encode())
    (tmp_path / "enc/z.gz").write_bytes(gzip.compress("ü".encode()))
    assert sorted(r["content"] for r in fl.contents(spark, str(tmp_path / "enc")).collect()) == ["é", "ü"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.part").touch()
    (tmp_path / "raw/b.decompressed").touch()
    assert fl.sweep_parts(tmp_path) == 2


def d(text, **kw):
    return det.detect(text if isinstance(text, bytes) else text.encode(), **kw)


def test_detect(tmp_path):
    x = d("STORE|UNITS\n1|2\n3|4\n5|6\n")
    assert (x.delimiter, x.structure, x.header, x.confidence, x.columns) == ("|", "FLAT", True, 1.0, ["STORE", "UNITS"]) and x.auto_config()
    assert d("1,2,3\n4,5,6\n").columns == ["COL_1", "COL_2", "COL_3"] and d("a\tb\n1\t2\n").delimiter == "\t"
    (tmp_path / "l.csv").write_text("Field,From,Length\nSTORE,1,4\nUNITS,5,4\nPRICE,9,6\n")
    lay = load_layout(tmp_path / "l.csv")
    fixed = "10010045000500\n10020060000700\n"
    assert d(fixed).format == "FIXED_WIDTH" and d(fixed).needs_approval and d(fixed).confidence == 0.4
    assert d(fixed, layout=lay).confidence == 0.8 and d(fixed, layout=lay).auto_config() and not d(fixed, layout=lay).warnings
    assert d("12345678\n12345679\n", layout=lay).warnings
    assert d("a,b\n1,x\\\ny\n2,z\n").structure == "MULTILINE" and d('a,b\n1,"x\n2,z\n').needs_approval
    h = d("H,20240101\nD,1,2,3\nD,4,5,6\nD,7,8,9\n")
    assert h.structure == "RECORD_TYPED" and not h.parseable and h.preamble == 0
    m = d("AB1234\nAB1234567890\nAB5678\n")
    assert m.structure == "MULTILINE" and not m.parseable
    assert (d("").format, d("").confidence) == ("UNSUPPORTED", 0.0)
    assert d("one\ntwo\nthree\na,b\n1,2\n3,4\n").preamble == 3 and d("x, y\nz, w\na,b,c\n1,2,3\n4,5,6\n").preamble == 2
    assert d("note\na,b\n1,2\n3,4\n").confidence == 0.85 and d("n\nm\na,b\n1,2\n3,4\n").confidence == 0.7
    assert d("a,b\né,1\né,2\n".encode("cp1252")).encoding == "cp1252" and d("﻿a,b\n1,2\n2,3\n".encode()).encoding_method == "utf-8-bom"
    assert len(det.sample(b"x\n" * 100_000, max_lines=1000)[0]) == 1000
