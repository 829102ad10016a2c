"""Sums of products, the only pass over the data that the least-squares models need.

X'X of any number of series comes from one pass: every task adds up the products of its own rows, and only those sums
are shuffled. Cut by pieces of the timeline and summed up over the pieces, the same table yields X'X of every growing
training window, so a walk-forward backtest reads its rows once however many folds it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.blocks import POS, over_blocks

_FLUSH_BYTES = 64 * 1024 * 1024


def lag_vectors(
    df: DataFrame, cols: Sequence[str], lags: int, *, by: Sequence[str], step_seconds: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows as vectors [1, row `lags` back, ..., row before, this row]; rows with fewer rows before them are dropped."""

    def build(d: DataFrame, w) -> DataFrame:
        row = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
        return d.withColumn("_rows", F.collect_list(row).over(w.rowsBetween(-lags, 0)))

    needed = df.select(*by, "ts", POS, *[F.col(f"`{c}`") for c in dict.fromkeys([*cols, *keep])])
    out = over_blocks(needed, build, by=by, step_seconds=step_seconds, halo=lags)
    vector = F.concat(F.array(F.lit(1.0)), F.flatten("_rows"))
    return out.filter(F.size("_rows") == lags + 1).select(*by, "ts", POS, *keep, vector.alias("v"))


def vectors(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows as vectors [1, columns...]."""
    return df.select(*keys, F.concat(F.array(F.lit(1.0)), F.array(*[F.col(f"`{c}`").cast("double") for c in cols])).alias("v"))


def gram(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, cell, value): the upper triangle of the summed products of column `v`, cell = i * size + j."""
    keys = list(keys)
    upper = np.triu_indices(size)
    cells = (upper[0] * size + upper[1]).astype("int32")
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("cell", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray | slice]]:
        """Key values and row numbers of the groups in a batch."""
        if not keys:
            yield (), slice(None)
            return
        labels = batch.select(keys).to_pandas()
        for index in labels.groupby(keys, sort=False, dropna=False).indices.values():
            yield tuple(batch.column(k)[int(index[0])].as_py() for k in keys), index

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for key, total in sums.items():
                columns = [pa.repeat(pa.scalar(part, type=t), len(cells)) for part, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cells), pa.array(total[upper])], names=[*keys, "cell", "value"])
            sums.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.column(k).type for k in keys]
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for label, index in groups(batch):
                part = x[index]
                total = sums.get(label)
                sums[label] = part.T @ part if total is None else total + part.T @ part
            if len(sums) * size * size * 8 > _FLUSH_BYTES:
                yield from flush()
        yield from flush()

    added = rows.select(*keys, "v").mapInArrow(partial, schema)
    return added.groupBy(*keys, "cell").agg(F.sum("value").alias("value"))


def running_gram(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over all pieces up to and including each one; a window holds one cell's value per piece."""
    w = Window.partitionBy(*by, "cell").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.select(*by, "piece", "cell", F.sum("value").over(w).alias("value"))


def matrix(pdf: pd.DataFrame, size: int) -> np.ndarray:
    """The full symmetric matrix of one group's cells."""
    out = np.zeros((size, size))
    i, j = np.divmod(pdf["cell"].to_numpy(), size)
    out[i, j] = pdf["value"].to_numpy()
    out[j, i] = out[i, j]
    return out


def solve(xx: np.ndarray, xy: np.ndarray, *, ridge: np.ndarray | float = 0.0) -> np.ndarray:
    """Least squares from normal equations: columns scaled to one size, directions without information left out."""
    scale = np.sqrt(np.clip(np.diag(xx), 1e-300, None))
    a = xx / np.outer(scale, scale) + np.diag(np.broadcast_to(ridge, scale.shape))
    b = xy / (scale if xy.ndim == 1 else scale[:, None])
    values, basis = np.linalg.eigh(a)
    use = values > values.max(initial=0.0) * 1e-11
    inner = basis[:, use].T @ b
    solved = basis[:, use] @ (inner / (values[use] if inner.ndim == 1 else values[use][:, None]))
    return solved / (scale if xy.ndim == 1 else scale[:, None])


def dot(coefficients: Column, values: Column) -> Column:
    """Scalar product of two array columns."""
    return F.aggregate(F.zip_with(coefficients, values, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def finite_or_none(x: float) -> float | None:
    return float(x) if np.isfinite(x) else None


def per_window(sums: DataFrame, state: DataFrame, keys: Sequence[str], fit, schema: T.StructType) -> DataFrame:
    """Call `fit(cells, state)` for each window; both hold a few thousand rows at most, whatever the series' length."""
    fresh = state.toDF(*state.columns)
    return sums.toDF(*sums.columns).groupBy(*keys).cogroup(fresh.groupBy(*keys)).applyInPandas(fit, schema)
