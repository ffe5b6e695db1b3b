"""Order-free comparison of two result tables; used by tests and check.py."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import pandas as pd


def register_views(con, path: str) -> None:
    for f in sorted(Path(path).glob("*.parquet")):
        con.sql(f"CREATE OR REPLACE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")


def spark_rows(df) -> pd.DataFrame:
    """A result as objects, cell by cell: pandas itself would turn a null integer into not-a-number."""
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def duck_rows(relation) -> pd.DataFrame:
    return pd.DataFrame(relation.fetchall(), columns=relation.columns, dtype=object)


def _cell(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, dict):
        v = tuple(v.values())
    if isinstance(v, float) and math.isnan(v):
        return "NaN"  # not a number is not a missing one
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        v = pd.Timestamp(v)
        return v.date().isoformat() if v == v.normalize() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    data = [tuple(_cell(v) for v in r) for r in zip(*(pdf[c].tolist() for c in cols))]
    return sorted(data, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def _whole(values) -> bool | None:
    """True for a column of integers, False for one of fractions, None if it has neither."""
    kinds = {isinstance(v, int) for v in values if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool)}
    return kinds == {True} if kinds else None


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    """None when both tables (of spark_rows and duck_rows) hold the same rows, else a short description."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} <> {sorted(b.columns)}"
    if len(a) != len(b):
        return f"row count {len(a)} <> {len(b)}"
    ra, rb = rows_of(a), rows_of(b)
    diff = [(x, y) for x, y in zip(ra, rb) if x != y]
    if diff:
        return f"{len(diff)} rows differ, first: {diff[0][0]} <> {diff[0][1]} ({sorted(a.columns)})"
    kinds = {c: (x, y) for c in a.columns for x, y in [(_whole(a[c]), _whole(b[c]))] if x is not None and y is not None and x != y}
    if kinds:
        return f"integer type on one side only: {kinds}"
    return None
