"""Joins whose key may be held by a large share of all rows, and row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.scratch import kept

#: A key with more than this share of all rows is hot; there are fewer than 1 / share such keys, however large the input.
SHARE = 1 / 1000


def split(left: DataFrame, right: DataFrame, key: list[str], rows: str) -> tuple[DataFrame, DataFrame]:
    """Inner and anti join of a written `left` with a written `right`, which has one row a key and says in `rows` how many rows of
    `left` it meets.

    Hot keys, fewer than a thousand, are broadcast, so their rows stay where they are; all other keys are shuffled, and none of them
    holds more than a thousandth of the rows. The inner join has the columns of both, without `rows`.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.filter(F.col(rows) > total * SHARE)
    cold = right.filter(F.col(rows) <= total * SHARE)
    rest = left.join(F.broadcast(hot.select(*key)), key, "left_anti")
    met = left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key)).drop(rows)
    return met, rest.join(cold, key, "left_anti")


def joined(left: DataFrame, right: DataFrame, key: list[str], rows: str) -> DataFrame:
    """The inner join of `split`."""
    return split(left, right, key, rows)[0]


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Add `name`, the place (from 0) of each row among those with the same whole number `by`, in ascending `order`, nulls first.

    Rows are range-partitioned, so a group may span partitions; each partition counts its own rows. Only groups that reach the start
    of a partition go on from partitions before, at most one a partition; their sizes are broadcast. Rows that are equal in all these
    columns come in any order.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order).withColumn("_part", F.spark_partition_id())
    names = ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, head = None, 0, True  # the run that goes on, its rows so far, whether it began with the partition
        for b in batches:
            if b.num_rows == 0:
                continue
            key = b.column(names.index(by)).to_numpy()
            new = np.append(key[0] != last, key[1:] != key[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            place = np.arange(len(key)) - begin + np.where(begin < 0, seen - 1, 0)
            head = head and (last is None or not new[0])
            heads = head & (np.cumsum(new) == (1 if new[0] else 0))
            last, seen, head = key[-1], int(place[-1]) + 1, bool(heads[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place.astype(np.int64)), pa.array(heads)], [*names, name, "_head"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    local = kept(ranged.mapInArrow(run, f"{fields}, {name} BIGINT, _head BOOLEAN"), "places")
    over = local.filter("_head").select(by).distinct()
    sizes = local.join(F.broadcast(over), by).groupBy(by, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "_part", F.sum("_size").over(before).alias("_before")).filter("_before IS NOT NULL")
    found = local.join(F.broadcast(offsets), [by, "_part"], "left")
    return found.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_head", "_before")
