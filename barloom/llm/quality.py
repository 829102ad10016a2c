"""Quality rules as a ledger: every rule runs once, its failure is one bit, policies are masks over the bits.

`measure` takes the measurements of whole texts (numpy in Arrow batches), `ledger` turns them into one integer of failure
bits, `decide` applies a versioned policy to the bits, `ablation` counts from the bits alone what each rule adds.

Null and empty texts have no words and fail `few_words`. Repeated rows and ties are measured row by row. An empty table gives
an empty ledger. Extra columns are not carried; names that clash with the measurements do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import texts
from barloom.llm.registry import query, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Bit order is the order here and never changes; new rules are added at the end.
RULES = ["few_words", "repeated_windows", "long_words", "short_words", "many_symbols", "repeated_lines"]

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "long_words", "many_symbols", "repeated_lines"],
    "v2": ["few_words", "repeated_windows", "long_words", "short_words", "many_symbols", "repeated_lines"],
}


def rules() -> dict[str, Column]:
    """True where a document fails; shares are compared as whole numbers."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "long_words": c("word_chars") > 15 * c("n_words"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "many_symbols": 100 * c("n_symbols") > 10 * c("word_chars"),
        "repeated_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
    }


def mask(names: list[str]) -> int:
    """The bits of some rules."""
    return sum(1 << RULES.index(n) for n in names)


def _repeats(hashes: np.ndarray, width: int) -> int:
    """Words covered by windows of `width` words that occur at least twice among these windows."""
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(hashes) + width, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def _again(hashes: np.ndarray) -> int:
    """Values that are equal to an earlier one."""
    return len(hashes) - len(np.unique(hashes))


def measured(chunk: texts.Chunk) -> dict[str, np.ndarray]:
    """The measurements of every text of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    n = len(offsets) - 1
    blank = texts.is_blank()
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    found = texts.words(data, offsets, blank)
    rolling = texts.Rolling(data, lower=False)
    window, begin = texts.windows(rolling.parts(found.starts, found.ends), found.first, WINDOW)
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = texts.words(data, offsets, newline)
    line_hash = rolling.parts(lines.starts, lines.ends)
    wordy = np.searchsorted(found.starts, lines.ends) > np.searchsorted(found.starts, lines.starts)
    owners, line_hash = lines.owners()[wordy], line_hash[wordy]
    line_first = np.searchsorted(owners, np.arange(n + 1))
    return {
        "n_words": np.diff(found.first),
        "word_chars": texts.sums(texts.code_points(data) & ~blank[data], offsets),
        "n_symbols": texts.sums(symbol[data], offsets),
        "n_dup_lines": np.array([_again(line_hash[line_first[i] : line_first[i + 1]]) for i in range(n)], np.int64),
        "n_repeat_words": np.array([_repeats(window[begin[i] : begin[i + 1]], WINDOW) for i in range(n)], np.int64),
        "n_lines": np.diff(line_first),
    }


def measure(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and measurements of every row; memory is bounded by about 1 MB of text or one longer text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts.chunks(batches, "text"):
            found = measured(chunk)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["id", *MEASURES])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fields = f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{m} BIGINT" for m in MEASURES)
    return source.mapInArrow(run, fields).withColumnRenamed("id", id_column)


def ledger(measures: DataFrame) -> DataFrame:
    """Add `failed`, one bit for each rule."""
    bits = F.lit(0).cast("long")
    for name, failed in rules().items():
        bits = bits + F.when(failed, F.lit(mask([name]))).otherwise(0)
    return measures.withColumn("failed", bits.cast("long"))


def decide(rows: DataFrame, policy: str) -> Column:
    """Whether the policy keeps a row of the ledger."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it rejects. One pass over the bits, a row for each rule."""
    names = POLICIES[policy]
    used = F.col("failed").bitwiseAND(F.lit(mask(names)))
    sums = [
        F.struct(
            F.lit(n).alias("rule"),
            F.coalesce(F.sum((used.bitwiseAND(F.lit(mask([n]))) != 0).cast("long")), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum((used == mask([n])).cast("long")), F.lit(0)).alias("n_only"),
        )
        for n in names
    ]
    return rows.agg(F.array(*sums).alias("r")).select(F.inline("r"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM documents
), i AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS p FROM w
), g AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p:p+4]) AS n FROM i
), r AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       (failed & 55) = 0 AS kept, n_lines, failed
FROM f
"""


@query("op9_quality_ledger", SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of all documents, with the verdicts of the base policy and of policy v1."""
    rows = ledger(measure(table(spark, folder, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~decide(rows, "base")).alias("base_failed"), decide(rows, "v1").alias("kept"), "n_lines", "failed",
    )
