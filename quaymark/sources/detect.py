"""What kind of file is this: encoding, delimiter, preamble, header, structure, and how sure we are.

A file is judged from a bounded sample of its head, so the work a file needs doesn't grow with the file. detect_files()
runs it for a whole folder on the executors; delimiter_stats() is the same delimiter rule as a DataFrame plan.
"""

from __future__ import annotations

import codecs
import csv
import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.config import Layout, ParseConfig
from quaymark.functions.exprs import numeric_like
from quaymark.sources.files import empty_files, expand_bytes
from quaymark.sources.layout import layout_warnings
from quaymark.sources.records import physical_lines, split_record, unique_names

#: Fixed values of the rules.
DELIMITERS = (",", ";", "|", "\t")
MAX_BYTES, MAX_LINES, ENCODING_BYTES = 1_000_000, 20_000, 256 * 1024
SAME_LENGTH, APPROVAL_BELOW, SCHEMA_ROWS = 0.95, 0.8, 2_000

import re

_QUOTED = re.compile('"[^"]*"')


def detect_encoding(head: bytes) -> tuple[str, str]:
    """(encoding, how it was found)."""
    head = head[:ENCODING_BYTES]
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8", "utf-8-bom"
    for name in ("utf-8", "cp1252"):
        try:
            head.decode(name)
            return name, name
        except UnicodeDecodeError:
            pass
    return "latin-1", "latin-1-fallback"


def sample(content: bytes, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> tuple[list[str], str, str, int]:
    """Lines of the head, encoding, how it was found, bytes read."""
    encoding, how = detect_encoding(content)
    head = content[:max_bytes]
    text = head.decode(encoding, "replace").removeprefix("﻿")
    return physical_lines(text)[:max_lines], encoding, how, len(head)


def numeric_share(values: list[str]) -> float:
    if not values:
        return 0.0
    return sum(v.replace(".", "", 1).replace("-", "", 1).isdigit() for v in values if v) / len(values)


def _fields(line: str, delimiter: str | None) -> list[str]:
    """Quote-aware; a line that csv rules can't read is split plainly."""
    if not delimiter:
        return [line]
    fields, _, broken = split_record(line, delimiter)
    return line.split(delimiter) if broken else fields


def _count(line: str, delimiter: str) -> int:
    return _QUOTED.sub("", line).count(delimiter)


def _mode(values) -> tuple:
    return Counter(values).most_common(1)[0]


@dataclass
class Detection:
    format: str
    structure: str
    delimiter: str | None
    encoding: str
    encoding_method: str
    header: bool | None
    preamble: int
    columns: list[str]
    schema: dict[str, str]
    confidence: float
    layout: Layout | None = None
    warnings: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    @property
    def parseable(self) -> bool:
        if self.format == "UNSUPPORTED" or self.structure == "RECORD_TYPED":
            return False
        if self.format == "DELIMITED":
            return self.delimiter is not None
        return self.layout is not None and self.structure == "FLAT"

    @property
    def needs_approval(self) -> bool:
        return self.confidence < APPROVAL_BELOW

    def auto_config(self) -> ParseConfig | None:
        """The configuration to parse with, if no person has to look first."""
        if not self.parseable or self.needs_approval or self.confidence <= 0:
            return None
        if self.format == "FIXED_WIDTH":
            return ParseConfig(layout=self.layout, header=bool(self.header), encoding=self.encoding, skip_rows=self.preamble)
        if self.header is None or not self.columns:
            return None
        return ParseConfig(columns=tuple(self.columns), delimiter=self.delimiter, header=self.header, encoding=self.encoding, skip_rows=self.preamble)


def find_delimiter(lines: list[str]) -> tuple[str | None, dict]:
    """Most consistent candidate: share of its lines that have its modal count, then how many those are; earlier wins ties."""
    rows = [x for x in lines if x.strip()]
    best, best_score, stats = None, (0.0, 0), {}
    for d in DELIMITERS:
        counts = [_count(x, d) for x in rows]
        some = [c for c in counts if c]
        if len(some) < 2:
            continue
        modal, n = _mode(some)
        if (score := (n / len(some), n)) > best_score:
            best, best_score = d, score
            stats = {"per_line_counts": counts[:20], "most_common": modal, "occurrences": n, "consistency": round(n / len(some), 4), "raw": n / len(some)}
    return best, stats


def find_preamble(lines: list[str], delimiter: str | None, modal: int) -> int:
    """Lines before the first two consecutive lines with the modal count, unless they are one odd record."""
    if delimiter is None or not modal:
        return 0
    fits = [bool(x.strip()) and _count(x, delimiter) == modal for x in lines]
    start = next((i for i in range(len(fits) - 1) if fits[i] and fits[i + 1]), 0)
    shapes = [len(_fields(x, delimiter)) for x in lines[:start] if x.strip()]
    return 0 if len(shapes) == 1 and shapes[0] >= 2 else start


def _record_typed(lines: list[str], delimiter: str | None) -> bool:
    shapes: dict[str, Counter] = {}
    for x in lines:
        if x.strip():
            f = _fields(x, delimiter)
            shapes.setdefault((f[0] if delimiter else x[:2]).strip() if f else "", Counter())[len(f)] += 1
    return len(shapes) >= 2 and len({c.most_common(1)[0][0] for c in shapes.values()}) >= 2


def _multiline_fixed(rows: list[str]) -> bool:
    if len(rows) < 2:
        return False
    modal, n = _mode(map(len, rows))
    longest = max(map(len, rows))
    if n / len(rows) < 0.5 or longest <= modal or longest % modal:
        return False
    return _mode(x[:2] for x in rows)[1] / len(rows) >= 0.6


def _schema(lines: list[str], delimiter: str, header: bool | None, columns: list[str]) -> dict[str, str]:
    """Advisory types from the first rows; parsing ignores them."""
    if header is None:
        return {}
    rows = [_fields(x, delimiter) for x in lines[bool(header) :][:SCHEMA_ROWS] if x.strip()]
    out = {}
    for i, name in enumerate(columns):
        values = [r[i] for r in rows if i < len(r) and r[i] != ""]
        kind = "String"
        for label, pattern in (("Int64", r"[+-]?\d+"), ("Float64", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), ("Boolean", "true|false")):
            if values and all(re.fullmatch(pattern, v) for v in values):
                kind = label
                break
        out[name] = kind
    return out


def detect(content: bytes, layout: Layout | None = None) -> Detection:
    lines, encoding, how, n_bytes = sample(content)
    rows = [x for x in lines if x.strip()]
    delimiter, stats = find_delimiter(lines)
    preamble = find_preamble(lines, delimiter, stats.get("most_common", 0))
    data = lines[preamble:]
    modal, modal_n = _mode(map(len, rows)) if rows else (0, 0)
    if delimiter:
        kind = "DELIMITED"
    elif not rows:
        kind = "UNSUPPORTED"
    else:
        kind = "FIXED_WIDTH" if modal_n / len(rows) >= SAME_LENGTH else "DELIMITED"
    if delimiter and any(x.rstrip().endswith("\\") or x.count('"') % 2 for x in data):
        structure = "MULTILINE"
    elif _record_typed(data, delimiter):
        structure = "RECORD_TYPED"
    elif delimiter is None and _multiline_fixed(rows):
        structure = "MULTILINE"
    else:
        structure = "FLAT"
    if structure == "MULTILINE" and delimiter is None:
        kind = "FIXED_WIDTH"
    header, columns, warnings, schema = None, [], [], {}
    if kind == "DELIMITED" and delimiter:
        content_rows = [x for x in data if x.strip()]
        first = [f.strip() for f in _fields(content_rows[0], delimiter)] if content_rows else None
        if first is not None:
            header = any(first) and numeric_share(first) < 0.5
        line = data[0] if data else ""
        if header:
            columns = unique_names([c.strip() for c in line.split(delimiter) if c.strip()])
        else:
            columns = [f"COL_{i + 1}" for i in range(len(line.split(delimiter)) if line else 0)]
        schema = _schema(data, delimiter, header, columns)
    elif kind == "FIXED_WIDTH":
        warnings = layout_warnings(layout, lines) if layout else ["a fixed-width file needs a layout"]
        columns = layout.names if layout else []
        schema = dict.fromkeys(columns, "String")
    score = 1.0
    if kind == "DELIMITED":
        score -= 0.5 * (1 - stats["raw"]) if delimiter else 0.5
    if kind == "FIXED_WIDTH" and not layout:
        score -= 0.4
    score -= 0.3 * (structure != "FLAT") + 0.1 * (how == "latin-1-fallback") + 0.2 * (header is None) + 0.15 * min(preamble, 2)
    confidence = 0.0 if kind == "UNSUPPORTED" else round(max(0.0, min(1.0, score)), 2)
    meta = {k: v for k, v in stats.items() if k != "raw"}
    meta = {"bytes_read": n_bytes, "lines_sampled": len(lines), "delimiter_stats": meta, "data_start_line": preamble + 1, "length_mode": modal, "length_consistency": round(modal_n / len(rows), 4) if rows else 0.0}
    return Detection(kind, structure, delimiter, encoding, how, header, preamble, columns, schema, confidence, layout if kind == "FIXED_WIDTH" else None, warnings, meta)


def detect_files(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """A row for each file below path: its format, structure, delimiter, encoding, header, preamble, columns, confidence and gates."""
    schema = "file string, format string, structure string, delimiter string, encoding string, header boolean, preamble int, columns array<string>, confidence double, parseable boolean, needs_approval boolean, stats string, error string, encoding_method string, types map<string,string>, warnings array<string>, automatic boolean"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    d = detect(expand_bytes(name, bytes(data)), layout)
                    out.append((name, d.format, d.structure, d.delimiter, d.encoding, d.header, d.preamble, d.columns, d.confidence, d.parseable, d.needs_approval, json.dumps(d.stats), None, d.encoding_method, d.schema, d.warnings, d.auto_config() is not None))
                except Exception as e:
                    out.append((name, None, None, None, None, None, None, None, 0.0, False, True, None, str(e), None, None, None, False))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    # the reader leaves out files of no bytes
    if none := empty_files(spark, path):
        found = found.unionByName(spark.createDataFrame([(p, b"") for p in none], "path string, content binary"))
    return found.mapInPandas(run, schema)


# --- the same rules over a frame of (file, line_no, line) -----------------------------------------------------------


def delimiter_stats(lines: DataFrame) -> DataFrame:
    """file, delimiter, most_common, occurrences, consistency: the winning candidate of each file. Ties for the modal
    count go to the smaller count."""
    stripped = F.regexp_replace("line", '"[^"]*"', "")
    per = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(d).alias("delimiter"), (F.length(stripped) - F.length(F.replace(stripped, F.lit(d), F.lit("")))).alias("c")) for i, d in enumerate(DELIMITERS)])
    counts = lines.where(F.trim("line") != "").select("file", F.explode(per).alias("p")).select("file", "p.*").where("c > 0")
    by_count = counts.groupBy("file", "ord", "delimiter", "c").agg(F.count(F.lit(1)).alias("n"))
    per_delim = by_count.groupBy("file", "ord", "delimiter").agg(F.sum("n").alias("some"), F.max(F.struct("n", (-F.col("c")).alias("neg"))).alias("m")).where("some >= 2")
    scored = per_delim.select("file", F.struct((F.col("m.n") / F.col("some")).alias("consistency"), F.col("m.n").alias("occurrences"), (-F.col("ord")).alias("neg_ord"), "delimiter", (-F.col("m.neg")).alias("most_common")).alias("s"))
    best = scored.groupBy("file").agg(F.max("s").alias("s"))
    return best.select("file", "s.delimiter", "s.most_common", "s.occurrences", F.round("s.consistency", 4).alias("consistency"))


def header_flags(lines: DataFrame, delimiter: str) -> DataFrame:
    """file, header: whether the first line with content looks like names."""
    first = lines.where(F.trim("line") != "").groupBy("file").agg(F.min(F.struct("line_no", "line")).alias("f"))
    fields = F.transform(F.split(F.col("f.line"), re.escape(delimiter), -1), lambda x: F.trim(x))
    numeric = F.size(F.filter(fields, numeric_like))
    return first.select("file", (F.exists(fields, lambda x: x != "") & (numeric / F.size(fields) < 0.5)).alias("header"))


def record_typed(lines: DataFrame, delimiter: str) -> DataFrame:
    """file, record_typed: whether records with different first fields differ in their modal number of fields."""
    parts = F.split("line", re.escape(delimiter), -1)
    shapes = lines.where(F.trim("line") != "").groupBy("file", F.trim(parts[0]).alias("k"), F.size(parts).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    modal = shapes.groupBy("file", "k").agg(F.max(F.struct("n", (-F.col("shape")).alias("neg"))).alias("m"))
    return modal.groupBy("file").agg((F.count_distinct("m.neg") >= 2).alias("record_typed"))


def fixed_width_share(lines: DataFrame) -> DataFrame:
    """file, width, share, fixed_width: modal line length and the share of lines that have it."""
    by = lines.where(F.trim("line") != "").groupBy("file", F.length("line").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    m = by.groupBy("file").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("w")).alias("neg"))).alias("m"))
    return m.select("file", (-F.col("m.neg")).alias("width"), F.round(F.col("m.n") / F.col("all"), 4).alias("share"), (F.col("m.n") / F.col("all") >= SAME_LENGTH).alias("fixed_width"))


def preamble_lines(lines: DataFrame, delimiter: str, modal: int) -> DataFrame:
    """file, data_start: number of the first of two consecutive lines that have the modal delimiter count."""
    c = F.length("line") - F.length(F.replace(F.col("line"), F.lit(delimiter), F.lit("")))
    w = Window.partitionBy("file").orderBy("line_no")
    runs = lines.withColumn("fits", c == modal).withColumn("next", F.lead("fits").over(w))
    return runs.where("fits and next").groupBy("file").agg(F.min("line_no").alias("data_start"))
