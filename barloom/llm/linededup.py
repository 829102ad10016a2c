"""Exact line dedup: keys in hash order, documents in descending order within a key, one streaming pass.

1. `line_ledger` gives a row for each distinct key of a document: 128-bit hash of the key, document, line numbers.
2. The ledger is range-partitioned and sorted by (hash, document descending, text). A key may span partitions, so a key that
   a third of all documents share is dealt out like any other rows.
3. `stream` walks each partition with the run of the current key: the first document of a run keeps its lines, the rest lose
   them once three documents are seen. Runs that touch the start of a partition, and unfinished ones at its end, go out
   undecided. At most two keys a partition are concerned; their totals are broadcast and settle them.
4. The dropped line numbers of a document become a compressed keep bitmap; `apply` cuts the texts by it.

Each row counts as a document, also where ids are repeated; rows that share the largest id all keep their lines. A null id is
smaller than any other. A null or empty text is one empty line. An empty table gives an empty result. Extra columns of any name
pass through `deduped`. Keys are compared by 128 bits of a BLAKE2b digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import texts
from barloom.llm.registry import query, table
from barloom.llm.scratch import kept

MIN_POINTS = 20
MIN_DOCS = 3
_STREAMED = "h1 BIGINT, h2 BIGINT, doc BIGINT, row BIGINT, at ARRAY<INT>, n BIGINT, open BOOLEAN"


def _row_key(id_column: str, text_column: str) -> list:
    least = F.lit(-(2**63)).cast("long")
    return [F.coalesce(F.col(id_column).cast("long"), least).alias("doc"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("row")]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number, start and end of every line, blanks at both ends left out."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owners = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets[1:], breaks, side="right")])
    order = np.lexsort((starts, owners))
    starts, owners = starts[order], owners[order]
    last = np.append(owners[1:] != owners[:-1], True)
    ends = np.where(last, offsets[owners + 1], np.append(starts[1:], 0) - 1)
    first = np.searchsorted(owners, np.arange(len(offsets) - 1))
    solid = np.append(np.flatnonzero(~texts.is_blank()[data]), len(data))
    begin = np.minimum(solid[np.searchsorted(solid, starts)], ends)
    stop = np.where(begin < ends, solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1, begin)
    return owners, np.arange(len(owners)) - first[owners], begin, stop


def line_ledger(docs: DataFrame, *, id_column: str, text_column: str, min_points: int = MIN_POINTS) -> DataFrame:
    """Columns h1, h2, doc, row, at: a row for each distinct key of `min_points` code points or more in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts.chunks(batches, "text"):
            owners, number, begin, stop = _lines(chunk.data, chunk.offsets)
            points = np.concatenate([[0], np.cumsum(texts.code_points(chunk.data))])
            long = points[stop] - points[begin] >= min_points
            owners, number, begin, stop = owners[long], number[long], begin[long], stop[long]
            h1, h2 = texts.digests(chunk.data, begin, stop, True).view(np.int64).T
            order = np.lexsort((number, h2, h1, owners))
            owners, number, h1, h2 = owners[order], number[order], h1[order], h2[order]
            new = np.append(True, (owners[1:] != owners[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(owners)]
            at = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(owners)).astype(np.int32)), pa.array(number.astype(np.int32)))
            who = pa.array(owners[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[at]), pa.array(h2[at]), chunk.column("doc").take(who), chunk.column("row").take(who), lists],
                ["h1", "h2", "doc", "row", "at"],
            )

    source = docs.select(*_row_key(id_column, text_column), F.col(text_column).alias("text"))
    return source.mapInArrow(run, "h1 BIGINT, h2 BIGINT, doc BIGINT, row BIGINT, at ARRAY<INT>")


def stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition in, dropped rows and undecided ones (`open`) out; holds `min_docs` - 1 rows at most."""
    names = ["h1", "h2", "doc", "row", "at", "n", "open"]
    held: pa.Table | None = None
    key, seen, top, opening = None, 0, 0, True  # the current run; opening: it touches the start of the partition

    def out(rows: pa.Table, n: int, undecided: bool) -> list[pa.RecordBatch]:
        full = rows.append_column("n", pa.array(np.full(len(rows), n))).append_column("open", pa.array(np.full(len(rows), undecided)))
        return full.select(names).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
            seen -= len(held)
        h1, h2, doc = (rows.column(c).to_numpy() for c in ("h1", "h2", "doc"))
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        total = np.diff(np.append(begin, len(doc)))
        best = doc[begin].copy()
        undecided = np.zeros(len(begin), bool)
        if key == (h1[0], h2[0]):
            total[0] += seen
            best[0] = top if seen else best[0]
        else:
            opening = opening and key is None
        undecided[0] = opening
        key, seen, top = (h1[-1], h2[-1]), int(total[-1]), best[-1]
        opening = bool(undecided[-1])
        wait = (run == len(begin) - 1) & (seen < min_docs) & (not opening)
        drop = ~undecided[run] & (total[run] >= min_docs) & (doc != best[run])
        held = rows.filter(pa.array(wait)) if wait.any() else None
        yield from out(rows.filter(pa.array(drop)), 0, False)
        yield from out(rows.filter(pa.array(undecided[run])), 1, True)
    if held is not None:
        yield from out(held, 1, True)
    elif key is not None and not opening:
        last = pa.table({
            "h1": pa.array([key[0]]), "h2": pa.array([key[1]]), "doc": pa.array([top]), "row": pa.array([0]),
            "at": pa.array([[]], pa.list_(pa.int32())),
        })
        yield from out(last, seen, True)


def keep_bitmaps(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Columns doc, row, keep: for each text that loses lines a compressed bitmap, bit k set if line k stays."""
    spark = docs.sparkSession
    ledger = kept(line_ledger(docs, id_column=id_column, text_column=text_column, min_points=min_points), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.desc("doc"), "row"]
    ranged = ledger.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    streamed = kept(ranged.mapInArrow(lambda batches: stream(batches, min_docs), _STREAMED), "line-runs")
    open_rows = streamed.filter("open")
    totals = open_rows.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.max("doc").alias("best"))
    settled = open_rows.join(F.broadcast(totals), ["h1", "h2"]).filter((F.col("total") >= min_docs) & (F.col("doc") != F.col("best")) & (F.size("at") > 0))
    dropped = streamed.filter("NOT open").select("doc", "row", "at").unionByName(settled.select("doc", "row", "at"))
    each = dropped.groupBy("doc", "row").agg(F.flatten(F.collect_set("at")).alias("at"))

    @F.pandas_udf("binary")
    def bitmap(at: pd.Series) -> pd.Series:
        return at.map(_packed)

    return each.select("doc", "row", bitmap("at").alias("keep"))


def _packed(at: np.ndarray) -> bytes:
    """All lines up to the last dropped one; lines beyond stay."""
    bits = np.ones(int(max(at)) + 1, bool)
    bits[at] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes() + len(bits).to_bytes(4, "little"))


def cut(text: str | None, keep: bytes | None) -> tuple[str | None, int, int]:
    """The lines that stay, the number of lines and of dropped lines; a text that loses nothing is returned as it is."""
    lines = (text or "").split("\n")
    if keep is None:
        return text, len(lines), 0
    raw = zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw[:-4], np.uint8), bitorder="little")[: int.from_bytes(raw[-4:], "little")]
    stay = [line for line, bit in zip(lines, bits) if bit] + lines[len(bits) :]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def marked(docs: DataFrame, keep: str, id_column: str = "doc_id", text_column: str = "text", **limits: int) -> DataFrame:
    """Documents with their keep bitmap in the new column `keep`, null where nothing is dropped; every input row once."""
    maps = keep_bitmaps(docs, id_column=id_column, text_column=text_column, **limits)
    doc, row = texts.free_name("_doc", docs), texts.free_name("_row", docs)
    left = docs.withColumns(dict(zip((doc, row), _row_key(id_column, text_column))))
    maps = maps.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("keep").alias(keep))
    return left.join(maps, [doc, row], "left").drop(doc, row)


def deduped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits: int) -> DataFrame:
    """Documents with the same columns, texts without their dropped lines."""

    @F.pandas_udf("string")
    def text(t: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([cut(a, b)[0] for a, b in zip(t, keep)], dtype=object)

    keep = texts.free_name("_keep", docs)
    rows = marked(docs, keep, id_column, text_column, **limits)
    changed = F.when(F.col(keep).isNull(), F.col(text_column)).otherwise(text(text_column, keep))
    return rows.withColumn(text_column, changed).select(*docs.columns)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, max(doc_id) AS best FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT k.*, best IS NOT NULL AND best <> doc_id AS gone FROM k LEFT JOIN s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


@query("op7_line_dedup", SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all documents; the digest is of the text that stays."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cut(t, k) for t, k in zip(b.column("text").to_pylist(), b.column("_keep").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                    pa.array([hashlib.sha256((f[0] or "").encode()).hexdigest() for f in found], pa.string()),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = marked(table(spark, folder, "documents").select("doc_id", "text"), "_keep")
    return rows.select("doc_id", "text", "_keep").mapInArrow(digest, "doc_id BIGINT, n_lines BIGINT, n_dropped BIGINT, kept_sha256 STRING")
