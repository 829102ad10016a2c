"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Words are runs of letters and digits in lower case. A seed reads a window of words through a fixed mask and ignores the word
at its gaps, so a substituted word does not hide a leak. Seed hashes of documents and of benchmark items are joined; a hit
fixes how a document and an item are laid against each other. Each such alignment is then verified word by word: it is a leak
if some WINDOW words in a row (the whole item if it is shorter) agree in at least PERCENT of the places. The two masks together
find every window of 13 words with at most two substituted ones. Shorter items have masks of their own (`masks_for`), read only where
the benchmark has items of that length: every substitution that the rule allows leaves one of them whole.

Seeds of the benchmark are broadcast up to BROADCAST_SEEDS rows (counted before), beyond that they are joined by shuffle.
Hits are aggregated where they arise, so an item that very many documents contain costs one row for each document.

Null and empty texts hold no words and leak nothing.
Repeated documents are reported alike, repeated items count once. Rows with a null id are found but a null id cannot name
them: they keep a null in the result. Empty tables give an empty result. Extra columns of any name pass through `clean`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.registry import query, table
from barloom.llm.scratch import kept
from barloom.llm.texts import free_name

MASKS = ("101111", "111011")
WINDOW = 13
PERCENT = 80
BROADCAST_SEEDS = 1_000_000  # about 30 MB


def masks_for(words: int, masks: tuple[str, ...] = MASKS, window: int = WINDOW) -> tuple[str, ...]:
    """The masks for an item of so many words."""
    if words <= 4:
        return ("1" * words,)
    if words < 8:  # one substitution at most
        return tuple("1" * k + "0" + "1" * (words - 1 - k) for k in range(words))
    return (*masks, "1111") if 10 <= words < window else masks


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(h: Column, mask: str) -> Column:
    """The seed hash at every place where the mask fits."""
    places = [k for k, c in enumerate(mask) if c == "1"]
    hashed = lambda i: F.xxhash64(F.lit(mask), *[F.get(h, i + k) for k in places])
    return F.when(F.size(h) >= len(mask), F.transform(F.sequence(F.lit(0), F.size(h) - len(mask)), hashed)).otherwise(F.array().cast("array<bigint>"))


def seeded(rows: DataFrame, keys: list[str], h: str, masks: tuple[str, ...]) -> DataFrame:
    """Columns of `keys`, place, seed: all masks' seeds of a row, from one array.

    The outer explode keeps the planner from testing the array for emptiness beforehand, which would hash every text again.
    """
    each = [seeds(F.col(h), m) for m in masks]
    rows = rows.select(*keys, *[F.greatest(F.size(h) - len(m) + 1, F.lit(0)).alias(f"_n{k}") for k, m in enumerate(masks)], F.concat(*each).alias("_s"))
    rows = rows.select(*keys, *[f"_n{k}" for k in range(len(masks))], F.posexplode_outer("_s").alias("_at", "seed"))
    place, done = F.col("_at"), F.lit(0)
    for k in range(len(masks) - 1):
        done = done + F.col(f"_n{k}")
        place = F.when(F.col("_at") >= done, F.col("_at") - done).otherwise(place)
    return rows.select(*keys, place.alias("place"), "seed").filter("seed IS NOT NULL")


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, percent: int = PERCENT,
) -> DataFrame:
    """Columns id, row (hash of the text), item, start, n_matched, n_words: the best alignment of each document and item."""
    items = benchmark.select(F.col(item_column).alias("item"), word_hashes(F.col(item_text)).alias("ih")).filter(F.size("ih") > 0)
    items = kept(items.dropDuplicates(["item", "ih"]), "items")
    length = F.least(F.size("ih"), F.lit(window))
    by_masks: dict[tuple[str, ...], list[int]] = {masks: []}
    for (n,) in sorted(items.select(length).distinct().collect()):  # `window` numbers at most
        by_masks.setdefault(masks_for(n, masks, window), []).append(n)
    known = items.withColumn("item_row", F.xxhash64("ih"))
    each = [seeded(known.filter(length.isin(ns)), ["item", "item_row"], "ih", ms) for ms, ns in by_masks.items()]
    ours = kept(reduce(DataFrame.unionByName, each), "seeds")
    masks = tuple(dict.fromkeys(m for ms in by_masks for m in ms))
    small = ours.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("row", F.xxhash64("text"))
    theirs = seeded(own.select("id", "row", word_hashes(F.col("text")).alias("h")), ["id", "row"], "h", masks)
    ours = ours.withColumnRenamed("place", "item_place")
    hits = theirs.join(F.broadcast(ours) if small else ours, "seed")
    hits = hits.select("id", "row", "item", "item_row", (F.col("place") - F.col("item_place")).alias("start"))
    hits = kept(hits.groupBy("id", "row", "item", "item_row", "start").agg(F.count("*").alias("n_seeds")), "hits")
    found = hits.select("id", "row").distinct().withColumnRenamed("id", "hid").withColumnRenamed("row", "hrow")
    texts = own.join(found, (F.col("row") == F.col("hrow")) & F.col("id").eqNullSafe(F.col("hid")), "left_semi")
    texts = texts.dropDuplicates(["id", "row"]).select(F.col("id").alias("tid"), F.col("row").alias("trow"), word_hashes(F.col("text")).alias("h"))
    known = items.select(F.col("item").alias("_item"), F.xxhash64("ih").alias("_item_row"), "ih")
    laid = hits.join(known, (F.col("item_row") == F.col("_item_row")) & F.col("item").eqNullSafe(F.col("_item")))
    laid = laid.join(texts, (F.col("row") == F.col("trow")) & F.col("id").eqNullSafe(F.col("tid")))
    same = F.transform("ih", lambda x, k: F.coalesce(F.get(F.col("h"), F.col("start") + k) == x, F.lit(False)).cast("int"))
    laid = laid.select("id", "row", "item", "start", same.alias("same"))
    width = F.least(F.lit(window), F.size("same"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - width + 1), lambda i: total(F.slice("same", i, width))))
    laid = laid.select("id", "row", "item", "start", total(F.col("same")).cast("long").alias("n_matched"), F.size("same").cast("long").alias("n_words"), best.alias("best"), width.alias("width"))
    laid = laid.filter(F.col("best") * 100 >= F.col("width") * percent)
    top = F.max(F.struct("n_matched", (-F.col("start")).alias("first"), "n_words")).alias("top")
    rows = laid.groupBy("id", "row", "item").agg(top)
    return rows.select("id", "row", "item", (-F.col("top.first")).cast("long").alias("start"), "top.n_matched", "top.n_words")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that hold no benchmark passage, all columns as they came."""
    key, row = free_name("_id", docs), free_name("_row", docs)
    bad = leaks(docs, benchmark, id_column=id_column, text_column=text_column).select(F.col("id").alias(key), F.col("row").alias(row)).distinct()
    match = (F.xxhash64(docs[text_column]) == F.col(row)) & docs[id_column].eqNullSafe(F.col(key))
    return docs.join(bad, match, "left_anti")


def _sql() -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM benchmark
), x AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d
), y AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS p, len(ws) AS n_words FROM b
), a AS (
  SELECT doc_id, item_id, n_words, x.p - y.p AS start, list(y.p) AS ps FROM x JOIN y USING (w) GROUP BY ALL
  HAVING count(*) * 100 >= least(n_words, {WINDOW}) * {PERCENT}
), v AS (
  SELECT *, list_max(list_transform(range(0, greatest(n_words - {WINDOW}, 0) + 1),
           lambda i: len(list_filter(ps, lambda q: q >= i AND q < i + {WINDOW})))) AS best
  FROM a
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len(ps) DESC, start) AS k
  FROM v WHERE best * 100 >= least(n_words, {WINDOW}) * {PERCENT}
)
SELECT doc_id, item_id, start::BIGINT AS start, len(ps)::BIGINT AS n_matched, n_words::BIGINT AS n_words FROM r WHERE k = 1
"""


@query("op6_spaced_seeds", _sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with that item."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_matched", "n_words")
