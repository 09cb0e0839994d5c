"""A minimal workbook writer: rows are streamed from the cluster into a zip file, nothing is collected whole."""

from __future__ import annotations

import math
import os
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
MAX_ROWS = 1_048_576  # of the file format

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def _cell(v) -> str:
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>'


def write_workbook(path, sheets: dict[str, DataFrame]) -> None:
    """Sheets in order, each a header row and its rows. A sheet beyond the format's row limit is an error."""
    part = f"{path}.part"
    try:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            n = range(1, len(sheets) + 1)
            z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
            z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(name[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, sheets)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
            for i, df in zip(n, sheets.values()):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                    f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData><row>{"".join(map(_cell, df.columns))}</row>'.encode())
                    for k, row in enumerate(df.toLocalIterator(prefetchPartitions=False), 2):
                        if k > MAX_ROWS:
                            raise ValueError(f"more than {MAX_ROWS} rows for one sheet")
                        f.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                    f.write(b"</sheetData></worksheet>")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)
