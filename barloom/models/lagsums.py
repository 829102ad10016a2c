"""Sums of products of lagged rows, kept by lag difference.

A regression on the last T rows of K columns needs the products of every lag with every other one, (T K)^2 numbers. But rows are
shared: the products of lags a and b are, but for at most T rows at either end of a window, those of lags a - b and 0. So each piece of
a series keeps one K x K matrix for each lag difference 0 .. T, and each window its first and last rows. `lag_gram` puts the whole
matrix of a window together from them, exactly, for any number of lags up to T; models with different lags share one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.models.design import Design
from barloom.models.windows import END, VALID, Cutter
from barloom.operators.blocks import BLOCK, BLOCK_ROWS, HALO, POS, to_blocks

FIRST = -3  # slot of a series' first rows, beside those of `windows`


def piece_sums(rows: DataFrame, columns: Sequence[str], lags: int, *, by: Sequence[str], block: int = BLOCK_ROWS) -> DataFrame:
    """(by, piece, d, values) for rows with `piece`: the summed products of the row d before and the row itself, K x K flat.

    Both rows are [1, columns...]; the later one belongs to the piece. A task holds one block of rows and its halo. A piece that
    spans blocks has a row for each.
    """
    by, k = list(by), 1 + len(columns)
    vector = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns]).alias("v")
    blocks = to_blocks(rows.select(*by, POS, "piece", vector), halo=lags, rows=block)
    schema = T.StructType([blocks.schema[c] for c in by] + [
        T.StructField("piece", T.LongType()), T.StructField("d", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by(POS).combine_chunks()
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        own = np.flatnonzero(~group.column(HALO).to_numpy(zero_copy_only=False))
        if not len(own):
            nothing = [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.list_(pa.float64()))]
            return pa.Table.from_arrays([*(group.column(c).slice(0, 0) for c in by), *nothing], names=schema.names)
        piece = group.column("piece").to_numpy(zero_copy_only=False)[own]
        begin = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        pieces, ds, values = [], [], []
        for i, j in zip(own[begin], np.append(own[begin[1:]], own[-1] + 1)):
            for d in range(lags + 1):
                start = max(i, d)
                pieces.append(int(piece[i - own[0]]))
                ds.append(d)
                values.append((v[start - d : max(j - d, 0)].T @ v[start:j]).ravel() if start < j else np.zeros(k * k))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * k * k), pa.array(np.concatenate(values)))
        head = [pa.repeat(group.column(c)[0], len(values)) for c in by]
        return pa.Table.from_arrays([*head, pa.array(pieces, pa.int64()), pa.array(ds, pa.int32()), flat], names=schema.names)

    return blocks.groupBy(*by, BLOCK).applyInArrow(add, schema)


def running(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sums over all pieces up to each one; a task streams one lag difference of a series, a matrix at a time."""
    by = list(by)
    keys = [*by, "d"]
    sorted_ = pieces.repartition(*keys).sortWithinPartitions(*keys, "piece")
    names = sorted_.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key and piece of the sum that may still grow
        total: np.ndarray | None = None
        for b in batches:
            values = b.column(names.index("values"))
            flat = values.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0))
            rows = list(zip(*(b.column(names.index(c)).to_pylist() for c in [*keys, "piece"])))
            out = []
            for row, v in zip(rows, flat):
                if held is not None and held != row:
                    out.append((*held, total.tolist()))
                total = v.copy() if held is None or held[:-1] != row[:-1] else total + v
                held = row
            if out:
                yield _batch(out, b.schema, [*keys, "piece", "values"])
            schema = b.schema
        if held is not None:
            yield _batch([(*held, total.tolist())], schema, [*keys, "piece", "values"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (sorted_.schema[c] for c in [*keys, "piece", "values"]))
    return sorted_.mapInArrow(stream, kinds)


def _batch(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    kinds = [schema.field(n).type for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def lagged_sums(
    rows: DataFrame, design: Design, windows: DataFrame, lags: int, cutter: Cutter, *, validation: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Sums (by, fold, slot, at, d, values) and one state row (by, fold, train_rows, ts, first, last, valid) for each window.

    `first` holds the first `lags` rows of the series, `last` and `valid` the `lags` + 1 rows up to the end of the window and up to
    where its validation part starts, as flat [1, columns...]; ts is the time of the last row.
    """
    by = list(design.by)
    slots = [END, VALID] if validation else [END]
    cut = cutter.cut(rows, windows, by)
    places = cutter.places(windows, by).filter(F.col("slot").isin(slots))
    sums = running(piece_sums(cut, design.columns, lags, by=by), by)
    sums = places.join(sums, [*by, "piece"]).select(*by, "fold", "slot", "at", "d", "values")
    first = windows.select(*by, "fold", F.lit(FIRST).alias("slot"), F.lit(1).alias("a"), F.lit(lags).alias("b"))
    spans = places.select(*by, "fold", "slot", (F.col("at") - lags).alias("a"), F.col("at").alias("b")).unionByName(first)
    each = F.explode(F.sequence(F.greatest(F.col("a").cast("long"), F.lit(1)), F.col("b").cast("long")))
    wanted = spans.filter("b >= 1").select(*by, "fold", "slot", each.alias(POS))
    vector = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in design.columns])
    met = wanted.join(rows.select(*by, POS, "ts", vector.alias("v")), [*by, POS])
    edge = lambda s: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == s, F.struct(POS, "v")))), lambda x: x["v"]))
    edges = met.groupBy(*by, "fold").agg(
        F.max(F.when(F.col("slot") == END, F.col("ts"))).alias("ts"), edge(FIRST).alias("first"), edge(END).alias("last"), edge(VALID).alias("valid")
    )
    return sums, windows.select(*by, "fold", "train_rows").join(edges, [*by, "fold"])


def lag_gram(differences: Sequence[np.ndarray], first: np.ndarray, last: np.ndarray, rows: int, lags: int) -> np.ndarray:
    """Products of [1, row `lags` back, ..., row] summed over the rows after the first `lags` of a window of `rows` rows.

    `differences[d]` are the sums of lag difference d over the whole window, `first` its first rows, `last` its last ones.
    """
    k = len(differences[0])
    c = k - 1
    out = np.zeros((1 + (lags + 1) * c,) * 2)
    if rows <= lags:
        return out
    out[0, 0] = rows - lags
    place = lambda lag: slice(1 + (lags - lag) * c, 1 + (lags - lag + 1) * c)
    for d in range(lags + 1):
        # the pairs that end in the first `lags` rows, and, as b grows, the pairs that end in the last b rows
        total = differences[d] - first[: lags - d].T @ first[d:lags]
        for b in range(lags - d + 1):
            if b:
                total = total + np.outer(first[lags - b - d], first[lags - b]) - np.outer(last[-b - d], last[-b])
            a = b + d
            out[place(a), place(b)] = total[1:, 1:]
            out[place(b), place(a)] = total[1:, 1:].T
            if d == 0:
                out[0, place(b)] = out[place(b), 0] = total[0, 1:]
    return out


def window_gram(sums: pd.DataFrame, state: pd.DataFrame, lags: int, slot: int = END) -> np.ndarray:
    """The matrix of one window from its rows of `lagged_sums`."""
    part = sums[sums["slot"] == slot]
    by_d = dict(zip(part["d"], part["values"]))
    k = int(round(np.sqrt(len(by_d[0]))))
    differences = [np.asarray(by_d[d]).reshape(k, k) for d in range(lags + 1)]
    first, last = (np.asarray(state[c].iloc[0], dtype=float).reshape(-1, k) for c in ("first", "last" if slot == END else "valid"))
    return lag_gram(differences, first, last, int(part["at"].iloc[0]), lags)


def last_vector(state: pd.DataFrame, columns: int, lags: int) -> np.ndarray:
    """[1, row `lags` back, ..., row] of a window's last row."""
    last = np.asarray(state["last"].iloc[0], dtype=float).reshape(-1, columns + 1)
    return np.concatenate([[1.0], last[-(lags + 1) :, 1:].ravel()])
