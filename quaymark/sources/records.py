"""Delimited and fixed-width text to rows of strings, with an issue for every odd record.

Files without quotes and backslashes never leave the JVM. The others go, file by file, through Python's csv state
machine, because a quoted line break can only be told from the start of the file. Both ways give the same frame:
file, line_number, fields, issues, is_header.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.config import ParseConfig
from quaymark.functions.exprs import scrub, strip

ISSUE = "struct<line_number:int,issue:string,expected_columns:string,found_columns:string,raw_data:string>"
RECORD = f"file string, line_number int, fields array<string>, issues array<{ISSUE}>, is_header boolean"

#: Issues that make a record bad; the others only inform.
BLOCKING = ("column_mismatch", "parse_error", "short_line")

_GUARD = ""
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def unique_names(names: list[str]) -> list[str]:
    """A, A becomes A, A_2."""
    count: dict[str, int] = {}
    out = []
    for n in names:
        count[n] = count.get(n, 0) + 1
        out.append(n if count[n] == 1 else f"{n}_{count[n]}")
    return out


def physical_lines(content: str) -> list[str]:
    lines = re.split("\r\n|\n|\r", content)
    return lines[:-1] if lines and lines[-1] == "" else lines


def _logical(lines: list[str], delimiter: str):
    """(start line, raw text) of each record: quoted line breaks belong to the record."""
    taken: list[str] = []

    def feed():
        for line in lines:
            taken.append(line)
            yield line.replace("\0", "") + "\n"

    reader, start = csv.reader(feed(), delimiter=delimiter, skipinitialspace=True), 0
    while True:
        try:
            next(reader)
        except StopIteration:
            if taken[start:]:
                yield start + 1, "\n".join(taken[start:])
            return
        except csv.Error:
            pass
        yield start + 1, "\n".join(taken[start:])
        start = len(taken)


def _joined(records):
    """Pieces that end in a backslash are merged with what follows; a chain is merged whole and a last piece is kept."""
    held, at = "", 0
    for start, raw in records:
        at = at or start
        if raw.rstrip().endswith("\\"):
            held += raw.rstrip()[:-1]
            continue
        yield at, held + raw
        held, at = "", 0
    if at:
        yield at, held


def split_record(raw: str, delimiter: str) -> tuple[list[str], bool, bool]:
    """Fields, whether an escaped delimiter was met, whether the record could not be parsed."""
    escaped = "\\" + delimiter in raw
    try:
        rows = list(csv.reader([raw.replace("\\" + delimiter, _GUARD)], delimiter=delimiter, skipinitialspace=True)) if "\n" not in raw else [next(csv.reader((x + "\n" for x in raw.replace("\\" + delimiter, _GUARD).split("\n")), delimiter=delimiter, skipinitialspace=True))]
        return [f.rstrip("\n").replace(_GUARD, delimiter) if i == len(rows[0]) - 1 else f.replace(_GUARD, delimiter) for i, f in enumerate(rows[0])], escaped, False
    except (csv.Error, IndexError, StopIteration):
        return [raw], escaped, True


def delimited_records(content: str, config: ParseConfig):
    """(line number, fields, issues, is header) of one file, in order."""
    d, n = config.delimiter, len(config.columns)
    records = ((at, raw) for at, raw in _logical(physical_lines(content), d) if raw.strip() and at > config.skip_rows)
    first = config.header
    for at, raw in _joined(records):
        if first:
            first = False
            yield at, [], [], True
            continue
        fields, escaped, broken = split_record(raw, d)
        fields = [_CONTROL.sub("", f) for f in fields]
        clean, issues = _CONTROL.sub("", raw), []
        if broken:
            issues.append((at, "parse_error", str(n), "N/A", clean))
        if escaped:
            issues.append((at, "escaped_delimiter", str(n), str(len(fields)), clean))
        if '"' in raw and "\n" not in raw and not broken and len(raw.split(d)) != len(fields):
            issues.append((at, "quoted_delimiter", str(n), str(len(fields)), clean))
        if not broken and len(fields) != n:
            issues.append((at, "column_mismatch", str(n), str(len(fields)), clean))
        yield at, (fields + [""] * n)[:n], issues, False


def _numbered(skip: int, keep_blank: bool) -> F.Column:
    """Array of (no, line) of a file's content, without skipped and, unless kept, blank lines."""
    parts = F.split(F.col("content"), "\r\n|\n|\r", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    lines = F.transform(parts, lambda x, i: F.struct((i + 1).cast("int").alias("no"), x.alias("line")))
    return F.filter(lines, lambda s: (s["no"] > skip) & (F.lit(True) if keep_blank else strip(s["line"]) != ""))


def _issue(no, name: str, expected, found, raw) -> F.Column:
    return F.struct(no.alias("line_number"), F.lit(name).alias("issue"), F.lit(str(expected)).alias("expected_columns"), found.cast("string").alias("found_columns"), raw.alias("raw_data"))


def _exploded(files: DataFrame, config: ParseConfig, keep_blank: bool) -> DataFrame:
    return files.select("file", F.posexplode(_numbered(config.skip_rows, keep_blank)).alias("pos", "rec")).select(
        "file", F.col("rec.no").alias("line_number"), F.col("rec.line").alias("line"), (F.lit(config.header) & (F.col("pos") == 0)).alias("is_header")
    )


def parse_delimited(files: DataFrame, config: ParseConfig) -> DataFrame:
    """Records of delimited files; files has (file, content)."""
    config.validate()
    n = len(config.columns)
    odd = F.coalesce(F.col("content").contains('"') | F.col("content").contains("\\"), F.lit(False))
    pieces = F.transform(F.split(F.col("line"), re.escape(config.delimiter), -1), lambda x: scrub(F.regexp_replace(x, "^ +", "")))
    no_issues = F.array().cast(f"array<{ISSUE}>")
    plain = _exploded(files.where(~odd), config, False).withColumn("f", pieces)
    plain = plain.select(
        "file",
        "line_number",
        F.when(F.col("is_header"), F.array().cast("array<string>")).otherwise(F.slice(F.concat("f", F.array_repeat(F.lit(""), n)), 1, n)).alias("fields"),
        F.when(
            ~F.col("is_header") & (F.size("f") != n), F.array(_issue(F.col("line_number"), "column_mismatch", n, F.size("f"), scrub(F.col("line"))))
        ).otherwise(no_issues).cast(f"array<{ISSUE}>").alias("issues"),
        "is_header",
    )

    def slow(batches):
        import pandas as pd

        names = ("line_number", "issue", "expected_columns", "found_columns", "raw_data")
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                rows = []
                for at, fields, issues, head in delimited_records(content, config):
                    rows.append((file, at, fields, [dict(zip(names, x)) for x in issues], head))
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=["file", "line_number", "fields", "issues", "is_header"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "line_number", "fields", "issues", "is_header"])

    return plain.unionByName(files.where(odd).select("file", "content").mapInPandas(slow, RECORD))


def parse_fixed(files: DataFrame, config: ParseConfig) -> DataFrame:
    """Records of fixed-width files: every physical line is one, blank lines included; short lines are reported."""
    config.validate()
    width = config.layout.width
    fields = F.array(*[scrub(strip(F.substring("line", f.start + 1, f.end - f.start))) for f in config.layout.fields])
    short = ~F.col("is_header") & (F.length("line") < width)
    return _exploded(files, config, True).select(
        "file",
        "line_number",
        F.when(F.col("is_header"), F.array().cast("array<string>")).otherwise(fields).alias("fields"),
        F.when(short, F.array(_issue(F.col("line_number"), "short_line", width, F.length("line"), scrub(F.col("line"))))).otherwise(F.array().cast(f"array<{ISSUE}>")).cast(f"array<{ISSUE}>").alias("issues"),
        "is_header",
    )


def parse(files: DataFrame, config: ParseConfig) -> DataFrame:
    config.validate()
    return parse_fixed(files, config) if config.layout else parse_delimited(files, config)


def column_names(config: ParseConfig) -> list[str]:
    return unique_names(config.layout.names if config.layout else list(config.columns))


def rows(records: DataFrame, config: ParseConfig, keep_position: bool = False) -> DataFrame:
    """The data rows, all columns text. keep_position adds _file and _line."""
    names = column_names(config)
    extra = [F.col("file").alias("_file"), F.col("line_number").alias("_line")] if keep_position else []
    return records.where(~F.col("is_header")).select(*extra, *[F.col("fields")[i].alias(n) for i, n in enumerate(names)])


def issues(records: DataFrame) -> DataFrame:
    """file, ord and the issue columns, in each record's order of checks."""
    return records.select("file", F.posexplode("issues").alias("ord", "i")).select("file", "ord", "i.*")


def issue_counts(records: DataFrame) -> DataFrame:
    return issues(records).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


KINDS = ("column_mismatch", "parse_error", "short_line", "quoted_delimiter", "escaped_delimiter")


def totals(config: ParseConfig) -> list[F.Column]:
    """Aggregates over records: those of counters(), and how many issues of each kind there are."""
    parsed = F.count(F.lit(1)) if config.layout else F.count(F.when(~F.col("is_header"), 1))

    def found(*kinds: str) -> F.Column:
        return F.coalesce(F.sum(F.size(F.filter("issues", lambda i: i["issue"].isin(*kinds)))), F.lit(0)).cast("bigint")

    return [F.count(F.lit(1)).alias("total_records"), parsed.alias("parsed_records"), found(*BLOCKING).alias("bad_rows"), *(found(k).alias(k) for k in KINDS)]


def report_lines(records: DataFrame, config: ParseConfig) -> DataFrame:
    """The parse report as JSON lines (value): one with the counts of each file, and one for each issue."""
    head = records.groupBy("file").agg(*totals(config)).select(F.to_json(F.struct(F.lit("file").alias("kind"), "*")).alias("value"))
    each = issues(records).select(F.to_json(F.struct(F.lit("issue").alias("kind"), "*")).alias("value"))
    return head.unionByName(each)


def read_report(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, issues) of report_lines(), with the types they had; a malformed line is left out."""
    kind = F.get_json_object("value", "$.kind")
    counts = "file string, total_records bigint, parsed_records bigint, bad_rows bigint, " + ", ".join(f"{k} bigint" for k in KINDS)
    found = "file string, ord int, line_number int, issue string, expected_columns string, found_columns string, raw_data string"
    return tuple(lines.where(kind == k).select(F.from_json("value", s).alias("r")).select("r.*") for k, s in (("file", counts), ("issue", found)))


def counters(records: DataFrame, config: ParseConfig) -> DataFrame:
    """One row: total_records (with header), parsed_records, bad_rows. A fixed-width header counts as parsed."""
    return records.agg(*totals(config)[:3])
