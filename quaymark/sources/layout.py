"""Fixed-width layouts from CSV files with the columns Field, From (1-based) and Length."""

from __future__ import annotations

import csv
from pathlib import Path

from quaymark.config import ConfigError, FieldSpec, Layout


def load_layout(path) -> Layout:
    try:
        text = Path(path).read_bytes().decode("cp1252", "ignore").lstrip("ï»¿﻿")
    except OSError as e:
        raise ConfigError(f"layout {path}: {e}") from e
    reader = csv.DictReader(text.splitlines())
    names = {(n or "").strip().lower(): n for n in reader.fieldnames or []}
    if not {"field", "from", "length"} <= set(names):
        raise ConfigError(f"layout {path}: needs the columns Field, From, Length")
    fields = []
    for row in reader:
        if not (name := (row[names["field"]] or "").strip()):
            continue
        try:
            start, length = int(row[names["from"]]) - 1, int(row[names["length"]])
        except (TypeError, ValueError) as e:
            raise ConfigError(f"layout {path}: field {name!r} needs whole numbers") from e
        fields.append(FieldSpec(name, start, start + length))
    return Layout(tuple(fields))


def layout_warnings(layout: Layout, lines: list[str], tolerance: float = 0.95) -> list[str]:
    rows = [x for x in lines if x.strip()]
    if not rows:
        return ["the sample is empty"]
    fit = sum(len(x) >= layout.width for x in rows) / len(rows)
    return [] if fit >= tolerance else [f"only {fit:.0%} of the sample lines reach the layout's width of {layout.width}"]
