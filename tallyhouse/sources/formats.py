"""Results as text."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame


def cell(v: Any) -> Any:
    """A value as JSON shows it: decimals with their places, times without a zone, keys as they are."""
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() and v.as_tuple().exponent >= 0 else str(v)
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    return v


def render(df: DataFrame, fmt: str = "JSON") -> str:
    """The rows as text in one of the output formats; rows come to the caller one partition at a time."""
    names = df.columns
    rows = ([cell(v) for v in r] for r in df.toLocalIterator())
    if fmt == "JSON":
        data = [dict(zip(names, r, strict=True)) for r in rows]
        return json.dumps({"meta": [{"name": n} for n in names], "data": data, "rows": len(data)}, ensure_ascii=False)
    if fmt == "JSONCompact":
        data = list(rows)
        return json.dumps({"meta": [{"name": n} for n in names], "data": data, "rows": len(data)}, ensure_ascii=False)
    out = io.StringIO()
    if fmt in ("CSV", "CSVWithNames"):
        writer = csv.writer(out, lineterminator="\n")
        if fmt == "CSVWithNames":
            writer.writerow(names)
        writer.writerows([["\\N" if v is None else v for v in r] for r in rows])
        return out.getvalue()
    escape = lambda v: "\\N" if v is None else str(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
    if fmt in ("TSVWithNames", "TabSeparatedWithNames"):
        out.write("\t".join(names) + "\n")
    for r in rows:
        out.write("\t".join(map(escape, r)) + "\n")
    return out.getvalue()


def write(df: DataFrame, path: str, fmt: str = "CSVWithNames") -> None:
    """The rows as files in a folder, written by the tasks."""
    if fmt.startswith("JSON"):
        df.write.json(path)
    else:
        df.write.csv(path, sep="," if fmt.startswith("CSV") else "\t", header=fmt.endswith("WithNames"))
