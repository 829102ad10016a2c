"""Choices made on column names while a plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date and value column names, in order of preference.
DATE_NAMES = [
    "Date", "date", "Datetime", "datetime", "timestamp", "time", "Time", "ds", "Index", "index", "Unnamed: 0", "_c0",
]
VALUE_NAMES = [
    "GC=F_close", "Close", "close", "Adj Close", "adj_close", "Price", "price", "yhat", "value", "Value",
]
# Name parts of the columns a vector autoregression uses.
VAR_PARTS = ["close", "sma", "rsi", "macd"]


def clean_header(name: str) -> str:
    """Strip blanks and byte order marks from a column name."""
    return name.strip().lstrip("﻿").strip()


def pick_column(columns: Sequence[str], names: Sequence[str], containing: str | None = None) -> str | None:
    """The first listed name that exists, else the first column whose lower-case name contains a key."""
    found = [n for n in names if n in columns]
    if not found and containing:
        found = [c for c in columns if containing in c.lower()]
    return found[0] if found else None


def columns_with(columns: Sequence[str], parts: Sequence[str] = VAR_PARTS, limit: int | None = None) -> list[str]:
    """Columns whose name contains any part, in order, at most `limit`."""
    hits = [c for c in columns if any(p in c for p in parts)]
    return hits[:limit]


def split_xy(columns: Sequence[str], targets: Sequence[str], exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(features, targets): every column that is neither a target nor excluded is a feature."""
    out = {*targets, *exclude}
    return [c for c in columns if c not in out], [c for c in targets if c in columns]


def cells_where(key: str, values: Sequence[str], inner: Sequence[str], name: str = "{value}_{inner}") -> list[Column]:
    """Aggregates that turn rows into columns: the value of each inner column where `key` has each value.

    Written as SQL text, because a panel has hundreds of them and a parsed text is built faster than a tree of calls.
    """
    out = []
    for v in values:
        literal = v.replace("\\", "\\\\").replace("'", "\\'")
        for c in inner:
            label = name.format(value=v, inner=c)
            out.append(F.expr(f"max(CASE WHEN `{key}` = '{literal}' THEN `{c}` END) AS `{label}`"))
    return out
