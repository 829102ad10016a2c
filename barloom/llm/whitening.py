"""Whitening of embeddings by spectrum slicing.

1. Each task keeps the count, the exact sums and the centred sums of products of its rows; centred sums of tasks are added up with the
   part between their means. One pass gives the covariance.
2. `leading` finds the leading eigenpairs of this d x d matrix: the LDL^T factors of V - s I have as many positive pivots as V has
   eigenvalues above s. Bisection on these counts isolates eigenvalue k, Rayleigh quotient iteration from inside the interval converges
   cubically, and counts just below and above the result certify its number. Eigenvalues that counts cannot tell apart (equal to rounding)
   are numbered in the order found, with orthonormal vectors.
3. A second pass takes the covariance of the whitened rows, a third returns them.

Rows whose vector is null or holds a null, NaN or infinite entry are left out. All other vectors must have one length, else ValueError.
Repeated rows count as often as they occur. Without rows the result is empty. Fewer dimensions than components give as many components as
dimensions. A component without variance (eigenvalue within rounding of zero) has null `whitened`, and `identity_error` is null then;
without any variance `explained` is null. `deviation` is null where it exceeds 63 bits. Extra columns are not carried, names may clash.
Only numbers that grow with d^2 reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.registry import query, table
from barloom.llm.scratch import kept

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
EPS = np.finfo(float).eps
_MOMENTS = "i INT, n BIGINT, total DECIMAL(38, 0), mean ARRAY<DOUBLE>, products ARRAY<DOUBLE>"


def grid(batch: pa.RecordBatch, scale: int, offset: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number vectors floor(scale * c) + offset of the usable rows of a batch (id, vector)."""
    ids, vectors = batch.column(0), batch.column(1)
    present = pc.is_valid(vectors)
    ids, vectors = ids.filter(present), vectors.filter(present)
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    entries = pc.list_flatten(vectors)
    values = pc.fill_null(entries.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.zeros(len(sizes), bool)
    bad[owner[~np.isfinite(values)]] = True
    sizes, values = sizes[~bad], values[~bad[owner]]
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of different lengths: {sorted(set(sizes.tolist()))[:5]}")
    scaled = np.floor(scale * values)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("an entry is too large for a 64-bit number")
    return ids.filter(pa.array(~bad)), scaled.astype(np.int64).reshape(len(sizes), -1 if len(scaled) else 0) + offset


def moments(frames: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each dimension of a task's rows: their number, sum (exact for whole numbers), all means and the centred products with all."""
    n, mean, products, total = 0, None, None, None
    for x in frames:
        if not x.size:
            continue
        base = x[0]  # so that means of large numbers keep their digits
        y = (x - base).astype(float)
        at = y.mean(axis=0)
        centred = y - at
        gram, m, k = centred.T @ centred, base + at, len(x)
        exact = np.array([sum(map(int, c)) for c in x.T] if x.dtype == np.int64 and np.abs(x).max() > 2**62 // k else x.sum(axis=0).tolist(), object)
        if n == 0:
            n, mean, products, total = k, m, gram, exact
            continue
        if len(m) != len(mean):
            raise ValueError(f"vectors of different lengths: {len(mean)}, {len(m)}")
        apart = m - mean
        products = products + gram + np.outer(apart, apart) * (n * k / (n + k))
        mean = mean + apart * (k / (n + k))
        n, total = n + k, total + exact
    if n:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(mean), dtype=np.int32)), pa.array(np.full(len(mean), n)),
                pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
                pa.array([mean.tolist()] * len(mean), pa.list_(pa.float64())), pa.array(products.tolist(), pa.list_(pa.float64())),
            ],
            ["i", "n", "total", "mean", "products"],
        )


def covariance(parts: DataFrame) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """Count, exact sums, means and covariance from the written `moments` of all tasks."""
    whole = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.sum(F.col("n") * F.col("mean")[F.col("i")]).alias("m"))
    rows = sorted(whole.collect())
    if not rows:
        return 0, [], np.empty(0), np.empty((0, 0))
    n = rows[0]["n"]
    if any(r["n"] != n for r in rows):
        raise ValueError("vectors of different lengths")
    means = [r["m"] / n for r in rows]
    centre = F.array(*(F.lit(m) for m in means))
    apart = lambda j: F.element_at("mean", j + 1) - F.element_at(centre, j + 1)
    full = F.transform("products", lambda p, j: p + F.col("n") * apart(F.col("i")) * apart(j))
    cells = parts.select("i", F.posexplode(full).alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    v = np.zeros((len(rows), len(rows)))
    for i, j, value in cells.collect():
        v[i, j] = value / n
    return n, [int(r["total"]) for r in rows], np.array(means), (v + v.T) / 2


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed `shift`: positive pivots of L D L^T = V - shift I.

    Pivots are the largest entries left, single or in blocks of two; such a block has one eigenvalue of each sign.
    """
    a = v - shift * np.eye(len(v))
    found = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal().copy()
        np.fill_diagonal(size, -1.0)
        r = int(diagonal.argmax())
        s, t = divmod(int(size.argmax()), len(a))
        if max(diagonal[r], size[s, t]) == 0:
            break
        if diagonal[r] >= 0.6404 * size[s, t]:  # (1 + sqrt 17) / 8
            pivot, found = [r], found + int(a[r, r] > 0)
        else:
            pivot, found = [s, t], found + 1
        keep = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(keep, pivot)]
        a = a[np.ix_(keep, keep)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return found


def _solved(v: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    """(V - shift I)^-1 x; a shift that is an eigenvalue to the last digit is moved by a few roundings."""
    for nudge in (0.0, 8 * EPS * scale):
        try:
            found = np.linalg.solve(v - (shift + nudge) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            break
    return found / np.abs(found).max()


def _rayleigh(v: np.ndarray, shift: float, before: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """An eigenpair near `shift`, with its vector orthogonal to the rows of `before`."""
    x = np.random.default_rng(17).normal(size=len(v))
    value, best = shift, np.inf
    for step in range(40):
        x = x - before.T @ (before @ x)
        x = x / np.linalg.norm(x)
        if step:
            rest = np.linalg.norm(v @ x - (x @ v @ x) * x)
            if step > 3 and (rest <= 4 * EPS * scale or rest >= best):
                break
            best = rest
            value = shift if step < 3 else float(x @ v @ x)
        x = _solved(v, value, x, scale)
    x = x / np.linalg.norm(x)
    return float(x @ v @ x), x


def leading(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows (largest entry positive)."""
    d = len(v)
    count = min(count, d)
    scale = (float(np.abs(v).sum(axis=1).max()) if d else 0.0) or 1.0
    counts: dict[float, int] = {-scale - 1.0: d, scale + 1.0: 0}
    values, vectors = np.zeros(count), np.zeros((0, d))
    narrow = 64 * EPS * scale

    def count_above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(v, shift)
        return counts[shift]

    for k in range(1, count + 1):
        low = max(s for s, c in counts.items() if c >= k)
        high = min(s for s, c in counts.items() if c < k)
        while True:
            alone = counts[low] == k and counts[high] == k - 1
            if alone or high - low <= narrow:
                value, x = _rayleigh(v, (low + high) / 2, vectors, scale)
                if high - low <= narrow or (low < value <= high and count_above(value - narrow) >= k and count_above(value + narrow) < k):
                    break
            middle = (low + high) / 2
            if count_above(middle) >= k:
                low = middle
            else:
                high = middle
        x = x / np.linalg.norm(x)
        values[k - 1] = value
        vectors = np.vstack([vectors, x * np.sign(x[np.abs(x).argmax()])])
    return values, vectors


def whitened(
    vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """For each usable row and component: id, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    source = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    parts = kept(source.mapInArrow(lambda batches: moments(grid(b, scale, offset)[1] for b in batches), _MOMENTS), "moments")
    n, sums, _, v = covariance(parts)
    values, units = leading(v, components)
    usable = values > len(v) * 4 * EPS * (values[0] if len(values) else 0.0)
    base = [round(s / n) for s in sums] if n else []
    rest = [s - b * n for s, b in zip(sums, base)]  # S - base * n, small
    factors = np.where(usable[:, None], units / np.sqrt(np.where(usable, values, 1.0))[:, None], np.nan)

    def project(x: np.ndarray) -> np.ndarray:
        """x - S / n on the components."""
        return ((x - np.array(base)).astype(float) - np.array(rest, float) / n) @ factors.T

    shown = [b for b in range(len(values)) if usable[b]]
    error = None
    if n and len(shown) == len(values) > 0:
        again = kept(source.mapInArrow(lambda batches: moments(project(x) for _, x in (grid(b, scale, offset) for b in batches) if len(x)), _MOMENTS), "moments")
        error = float(np.abs(covariance(again)[3] - np.eye(len(values))).max())
    trace = float(np.trace(v))
    explained = [float(e / trace) if trace > 0 else None for e in values]
    limit = 2**63 - 1

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - np.array(base)
        reach = n * int(np.abs(y).max()) + max(map(abs, rest))
        if reach * reach * x.shape[1] <= limit:
            apart = n * y - np.array(rest)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((n * int(c) - r) ** 2 for c, r in zip(row, rest)) for row in y]
        return [e if e <= limit else None for e in exact]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = grid(b, scale, offset)
            if not x.size:
                continue
            k = len(values)
            w = project(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)), pa.array([d for d in deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(w, mask=np.isnan(w)), pa.array(explained * len(x), pa.float64()), pa.array([error] * (len(x) * k), pa.float64()),
                    pa.array(np.tile(values, len(x))),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
            )

    kind = source.schema["id"].dataType.simpleString()
    fields = f"id {kind}, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE, eigenvalue DOUBLE"
    return source.mapInArrow(rows, fields).withColumnRenamed("id", id_column)


@query("op13_spectrum_slicing")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on the eight leading components of their covariance."""
    return whitened(table(spark, folder, "embeddings"))
