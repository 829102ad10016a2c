"""Training windows: the whole series, or the growing windows of a walk-forward backtest, cut into pieces.

Sums over pieces, added up along the series, give the sums over any window that ends at a piece. Both kinds of windows
offer the same three things: the windows of each series, the piece of each row, and the places where a window ends,
where its validation part starts and where its trend may bend.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.models.folds import with_test_folds
from barloom.operators.blocks import POS

CHANGEPOINTS = 25
CHANGEPOINT_SHARE = 0.8
VALIDATION_SHARE = 0.2
END, VALID = -1, -2  # slots that are no changepoints


def _places(pieces: Column) -> Column:
    """Slots of a window of so many pieces, as structs (slot, count of pieces before the place)."""
    room = F.floor(pieces * CHANGEPOINT_SHARE).cast("long")
    count = F.least(room, F.lit(CHANGEPOINTS)).cast("int")
    bends = F.when(
        count >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda j: F.struct((j - 1).alias("slot"), F.floor(j * room / count).cast("long").alias("count")),
        ),
    ).otherwise(F.array().cast("array<struct<slot: int, count: bigint>>"))
    start = F.greatest(F.floor(pieces * (1 - VALIDATION_SHARE)), F.lit(1)).cast("long")
    fixed = F.array(
        F.struct(F.lit(END).alias("slot"), pieces.cast("long").alias("count")),
        F.struct(F.lit(VALID).alias("slot"), start.alias("count")),
    )
    return F.concat(bends, fixed)


@dataclass(frozen=True)
class Folds:
    """Fold f trains on the first min_train + f * step rows and tests the next `test` rows."""

    min_train: int
    test: int
    step: int

    @property
    def first_pieces(self) -> int:
        """Pieces of the first window. A piece has `step` rows, the very first one what is left over, so that every
        window ends with a piece and a series has few pieces."""
        return math.ceil(self.min_train / self.step)

    def _rows(self, count: Column) -> Column:
        """Rows of the first `count` pieces."""
        return F.lit(self.min_train) - (F.lit(self.first_pieces) - count) * self.step

    def windows(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """(by, fold, train_rows): the folds each series is long enough for."""
        size = rows.groupBy(*by).agg(F.max(POS).alias("_n"))
        last = F.floor((F.col("_n") - 1 - self.min_train) / self.step).cast("int")
        numbers = F.when(F.col("_n") > self.min_train, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
        return size.select(*by, F.explode(numbers).alias("fold")).withColumn(
            "train_rows", (F.lit(self.min_train) + F.col("fold") * self.step).cast("long")
        )

    def cut(self, rows: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
        piece = F.floor((F.col(POS) - 1 - self.min_train) / self.step) + self.first_pieces
        return rows.withColumn("piece", piece.cast("long"))

    def places(self, windows: DataFrame, by: Sequence[str]) -> DataFrame:
        """(by, fold, slot, piece, at): the last piece before each place and the number of rows up to there."""
        each = F.explode(_places(F.col("fold") + self.first_pieces)).alias("s")
        return windows.select(*by, "fold", each).select(
            *by, "fold", "s.slot", (F.col("s.count") - 1).alias("piece"), self._rows(F.col("s.count")).alias("at")
        )

    def tests(self, rows: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
        """Test rows of every fold with their number `k` in the test window."""
        tests = with_test_folds(rows, min_train=self.min_train, test=self.test, step=self.step)
        return tests.join(windows.select(*by, "fold"), [*by, "fold"], "left_semi")


def _sized(rows: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the `train_rows` of their series."""
    if by:
        return rows.join(windows.select(*by, "train_rows"), list(by))
    return rows.withColumn("train_rows", windows.select("train_rows").scalar())


@dataclass(frozen=True)
class Whole:
    """One window per series that holds all its rows, as fold 0; at most `pieces` pieces however long it is."""

    pieces: int = 125

    def windows(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.max(POS).cast("long").alias("train_rows")).withColumn("fold", F.lit(0))

    def _count(self) -> Column:
        return F.least(F.lit(self.pieces), F.col("train_rows"))

    def cut(self, rows: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
        piece = F.floor((F.col(POS) - 1) * self._count() / F.col("train_rows"))
        inside = _sized(rows, windows, by).filter(F.col(POS) <= F.col("train_rows"))
        return inside.withColumn("piece", piece.cast("long")).drop("train_rows")

    def places(self, windows: DataFrame, by: Sequence[str]) -> DataFrame:
        each = F.explode(_places(self._count())).alias("s")
        at = F.ceil(F.col("s.count") * F.col("train_rows") / self._count())
        return windows.select(*by, "fold", "train_rows", each).select(
            *by, "fold", "s.slot", (F.col("s.count") - 1).alias("piece"), at.alias("at")
        )


@dataclass(frozen=True)
class Holdout(Whole):
    """One window per series that holds the first `share` of its rows; the rest tests."""

    share: float = 0.8

    def windows(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        size = F.floor(F.max(POS) * F.lit(self.share)).cast("long")
        return rows.groupBy(*by).agg(size.alias("train_rows")).filter("train_rows > 0").withColumn("fold", F.lit(0))

    def tests(self, rows: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
        """Held-out rows of every series with their number `k` after the training rows."""
        sized = _sized(rows, windows, by).filter(F.col(POS) > F.col("train_rows"))
        return sized.withColumns({"k": F.col(POS) - F.col("train_rows"), "fold": F.lit(0)}).drop("train_rows")


Cutter = Folds | Whole


def pick(running: DataFrame, places: DataFrame, by: Sequence[str]) -> DataFrame:
    """The running sums at the places of each window: (by, fold, slot, at, cell, value)."""
    return places.join(running, [*by, "piece"]).select(*by, "fold", "slot", "at", "cell", "value")
