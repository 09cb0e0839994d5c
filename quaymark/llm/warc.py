"""WARC derivatives: from every response a metadata record and a plain-text conversion record, linked to it.

Records are rows (warc_type, record_id, refers_to, target_uri, date, content_type, headers, block). Derived identifiers
are name-based UUIDs of the response's, so a rerun gives the same files. Both derived records refer to the response and
carry its date and URI; the metadata record keeps the source's headers and digests, and the conversion record has the
text with digests of its own.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import partitions, shared_dir, table
from quaymark.llm.token_store import _fs

RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, block binary"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
NO_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^>]*>|<![^>]*>")


def html_text(page: str) -> str:
    """Visible text: a line for each block, white space collapsed, entities resolved."""
    t = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(t).split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in their order (names can repeat) and body of an HTTP message; one without a blank line is all body."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def _charset(headers: list[tuple[str, str]], body: bytes) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    m = re.search(r"charset=[\"']?([\w-]+)", kind) or re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", body[:4096].decode("latin-1"), re.I)
    return m[1] if m else "utf-8"


def decoded(headers: list[tuple[str, str]], body: bytes) -> str:
    """The body by the charset that headers or page name; UTF-8 where there is none, or none that can read these bytes."""
    try:
        return body.decode(_charset(headers, body), "replace")
    except (LookupError, ValueError):  # no such charset, or one of no text
        return body.decode("utf-8", "replace")


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response. An empty body gives an empty text and still both records. WARC
    wants a date in every record, so a response without one passes NO_DATE on."""
    block = response["block"] or b""
    status, http, body = split_http(block)
    text = html_text(decoded(http, body)).encode("utf-8", "replace")
    rid, uri, date = response["record_id"], response["target_uri"], response["date"] or NO_DATE
    source = {k: v for k, v in (response["headers"] or {}).items() if v is not None}
    block_digest, payload_digest = source.get("WARC-Block-Digest") or digest(block), source.get("WARC-Payload-Digest") or digest(body)
    fields = [("source-status", status), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-payload-length", str(len(body))), ("conversion-record-id", record_id(f"{rid} conversion"))]
    fields += [(f"source-header-{k}", v) for k, v in http] + [(f"source-warc-{k}", v) for k, v in sorted(source.items())]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    out = []
    for kind, data, content in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain")):
        headers = {"WARC-Block-Digest": digest(data), "WARC-Refers-To": rid, "WARC-Source-Block-Digest": block_digest, "WARC-Source-Payload-Digest": payload_digest}
        out.append({"warc_type": kind, "record_id": record_id(f"{rid} {kind}"), "refers_to": rid, "target_uri": uri, "date": date, "content_type": content, "headers": headers, "block": data})
    return out


def serialise(r: dict) -> bytes:
    """One WARC/1.1 record."""
    block = r["block"] or b""
    head = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"] or NO_DATE), ("WARC-Target-URI", r["target_uri"]), ("Content-Type", r["content_type"])]
    head += sorted((r["headers"] or {}).items()) + [("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_records(data):
    """Records of an uncompressed WARC file, from bytes or a file; one record at a time is in memory."""
    f = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip()] = v.strip()
        block = f.read(int(head.pop("Content-Length")))
        take = lambda k: head.pop(k, None)
        r = {"warc_type": take("WARC-Type"), "record_id": take("WARC-Record-ID"), "refers_to": head.get("WARC-Refers-To"), "target_uri": take("WARC-Target-URI"), "date": take("WARC-Date"), "content_type": take("Content-Type")}
        yield r | {"headers": head, "block": block}


def _slices(batches, rows: int = 256):
    """Batches of few rows, as pages can be long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _numbered(known: DataFrame) -> DataFrame:
    """known (page_id, url, html) with nth: a row's number where equal rows exist, else null.

    Equal rows are found by two hashes, counted with partial sums. Only keys are shuffled; the join back is planned by the
    size of the table of repeated keys, and adaptive execution splits a hot key.
    """
    hashes = [F.xxhash64("page_id", "url", "html").alias("h1"), F.xxhash64("html", "url", "page_id", F.lit(1)).alias("h2")]
    often = known.select(*hashes).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = table(often, shared_dir(known.sparkSession), "repeated")
    numbered = known.select("*", *hashes, F.monotonically_increasing_id().alias("no"))
    return numbered.join(often, ["h1", "h2"], "left").select(*known.columns, F.when(F.col("n") > 1, F.col("no")).alias("nth"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """Response records (with the page's id) for a table of pages. Null html is an empty body; null ids and URLs are allowed.

    Identifiers are made of id, URL and page, so they don't depend on how the table is read. As no two records may share
    one, those of equal rows hold the row's number as well, which is the same as long as the table is read in the same splits.
    """
    body = F.col("html").cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    known = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = _numbered(known).select("page_id", "url", F.concat(head.cast("binary"), body).alias("block"), "nth")

    names = ["page_id", *_NAMES]

    def run(batches):
        import pyarrow as pa

        text, long = pa.string(), pa.int64()
        types = pa.schema(list(zip(names, [long, text, text, text, text, text, text, pa.map_(text, text), pa.binary()])))
        for batch in _slices(batches):
            ids, urls, blocks, nth = (batch.column(i).to_pylist() for i in range(4))
            digests = [(digest(b), digest(split_http(b)[2])) for b in blocks]
            record_ids = [record_id(f"response {i} {url} {d}" + ("" if k is None else f" {k}")) for i, url, (d, _), k in zip(ids, urls, digests, nth)]
            heads = [[("WARC-Block-Digest", d), ("WARC-Payload-Digest", p)] for d, p in digests]
            n = len(ids)
            cols = [ids, ["response"] * n, record_ids, [None] * n, urls, [date] * n, ["application/http; msgtype=response"] * n, heads, batch.column(2)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, types)], schema=types)

    return rows.mapInArrow(run, f"page_id long, {RECORD}")


def derivatives(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep columns and the two derived records of each response row; other record types give none."""
    keep = keep or []
    names = _NAMES
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in records.select(*keep).schema] + [RECORD]) if keep else RECORD

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            types = pa.schema([batch.schema.field(n) for n in [*keep, *names]])
            rows = batch.select(names).to_pylist()
            two = [derive(r | {"headers": dict(r["headers"] or [])}) for r in rows]
            derived = [d | {"headers": list(d["headers"].items())} for pair in two for d in pair]
            twice = pa.array([i for i in range(len(rows)) for _ in range(2)], pa.int64())
            cols = [batch.column(k).take(twice) for k in range(len(keep))] + [pa.array([d[n] for d in derived], types.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(cols, schema=types)

    return records.where("warc_type = 'response'").select(*keep, *names).mapInArrow(run, schema)


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes a gzip member for each record, a file for each partition, with a .warc.gz name. Returns (file, records, bytes)."""

    def run(batches):
        import gzip

        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        temp, n, size = f"{base}/.{name}-{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(temp, compression=None) as f:
            for batch in _slices(batches):
                for r in batch.to_pylist():
                    data = gzip.compress(serialise(r | {"headers": dict(r["headers"] or [])}), mtime=0)
                    f.write(data)
                    n, size = n + 1, size + len(data)
        fs.move(temp, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    done = records.select(*_NAMES).mapInArrow(run, "file string, records long, bytes long")
    return records.sparkSession.createDataFrame(done.collect(), "file string, records long, bytes long")  # one row a file


def _arrow(rows, types):
    import pyarrow as pa

    columns = ([list(r[n].items()) if n == "headers" else r[n] for r in rows] for n in _NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)


def read_warc(spark, folder: str, files: DataFrame) -> DataFrame:
    """Records (RECORD columns) of the files that write_warc() names, a task for each few files, a record at a time."""

    def run(batches):
        import gzip

        import pyarrow as pa

        text = pa.string()
        types = pa.schema(list(zip(_NAMES, [text] * 6 + [pa.map_(text, text), pa.binary()])))
        fs, base = _fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as raw, gzip.open(raw, "rb") as f:
                    rows = []
                    for r in read_records(f):
                        rows.append(r)
                        if len(rows) == 256:
                            yield _arrow(rows, types)
                            rows = []
                    if rows:
                        yield _arrow(rows, types)

    return files.select("file").repartition(max(1, min(partitions(spark), files.count())), "file").mapInArrow(run, RECORD)
