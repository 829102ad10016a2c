"""A trie of conversation prefixes, built by van Emde Boas recursion.

Sequences of up to 2^K turns are cut at half depth: the upper trie holds the first half of each sequence, and every distinct cut prefix
is the root of a lower trie of what follows. Both are cut at half their depth again, all tries of a level in parallel.

1. Going down needs the name of each cut prefix. Names of aligned blocks of 2^k turns are put together from the names of their halves
   (`block_names`), then each block hands its name to the lower half under it (`prefix_names`), level by level. Every level has half
   as many rows as the one below; names are 128 bits of a SHA-256 digest of role and text of each turn.
2. Equal names are one node. A node goes on as its smallest member and its depth.
3. Going up, `totals` grafts: at level k each cut node takes what the lower trie under it sums up to and adds it to its own
   up to 2^k ancestors in its upper trie. After K levels every node has the total of its whole subtree.

Turns are ordered by turn number, nulls first, then by digest; null roles and texts are empty. Rows with a null conversation id belong to
no conversation and are left out; ids are whole numbers. Repeated rows are repeated turns. An empty table has no conversation and so no
root: the result is empty. Extra columns are not carried. Neither a conversation nor a prefix that holds a third of all rows is gathered
in one place: rows are numbered across range partitions, hot prefixes are joined by broadcast, digests of id lists are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.hot import joined, numbered
from barloom.llm.registry import query, table
from barloom.llm.scratch import kept

LONGEST_HEAD = 5
PIECE_CHARS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = (0x5EED, 0x7A1E)


def _name(*parts: Column) -> list[Column]:
    """128 bits in two numbers from the given values."""
    return [F.xxhash64(F.lit(17), *parts).alias("p"), F.xxhash64(F.lit(31), *parts).alias("q")]


def turns(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Columns conv, i (place from 0), p, q (name of role and text), points (code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_column, text_column))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(
        F.col(id_column).cast("long").alias("conv"), F.col(turn_column).alias("turn"), digest.alias("d"), F.length(text).cast("long").alias("points")
    ).filter("conv IS NOT NULL")
    rows = rows.select("conv", "turn", *_name(F.col("d")), "points")
    return numbered(rows, "conv", ["turn", "p", "q"], "i").drop("turn")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation c after its first h = crc32(c) % 6 are put behind the first h turns of conversation c - c % 100.

    Returns the new turns (conv, i, p, q, points, n) and all conversations (conv, n), n being the new number of turns.
    """
    sizes = rows.groupBy("conv").agg(F.count("*").alias("own"))
    heads = rows.filter((F.col("i") < LONGEST_HEAD) & (F.col("conv") % 100 == 0))
    heads = heads.groupBy(F.col("conv").alias("host")).agg(F.sort_array(F.collect_list(F.struct("i", "p", "q", "points"))).alias("head"))
    h = F.crc32(F.col("conv").cast("string")) % 6
    convs = sizes.withColumn("h", h).withColumn("host", F.col("conv") - F.col("conv") % 100).join(heads, "host", "left")
    nothing = F.array().cast("array<struct<i:bigint,p:bigint,q:bigint,points:bigint>>")
    convs = convs.withColumn("head", F.coalesce(F.filter("head", lambda t: t["i"] < F.col("h")), nothing))
    convs = convs.withColumn("m", F.size("head").cast("long"))
    convs = kept(convs.withColumn("n", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("host"), "conversations")
    first = convs.select("conv", F.inline("head"), "n")
    rest = joined(rows, convs.select("conv", "h", "m", "n", "own"), ["conv"], "own").filter("i >= h")
    rest = rest.select("conv", (F.col("i") - F.col("h") + F.col("m")).alias("i"), "p", "q", "points", "n")
    return kept(first.unionByName(rest), "turns"), convs.select("conv", "n")


def block_names(rows: DataFrame, levels: int) -> list[DataFrame]:
    """For each level k the names (conv, j, p, q) of the full blocks of 2^k turns; block j begins at turn j * 2^k."""
    found = [rows.select("conv", F.col("i").alias("j"), "p", "q")]
    for _ in range(1, levels):
        at = lambda side, c: F.max(F.when(F.col("j") % 2 == side, F.col(c))).alias(f"{c}{side}")
        halves = found[-1].groupBy("conv", F.floor(F.col("j") / 2).alias("k")).agg(at(0, "p"), at(0, "q"), at(1, "p"), at(1, "q"))
        full = halves.filter("p0 IS NOT NULL AND p1 IS NOT NULL")
        found.append(kept(full.select("conv", F.col("k").alias("j"), *_name(*(F.col(c) for c in ("p0", "q0", "p1", "q1")))), "blocks"))
    return found


def prefix_names(rows: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """Columns conv, depth, p, q, points, n: the name of every prefix of every conversation, the empty one left out."""
    blocks = block_names(rows, levels)
    tops = convs.filter("n > 0").select("conv", "n", F.lit(0).cast("long").alias("j"), F.lit(_ROOT[0]).cast("long").alias("p"), F.lit(_ROOT[1]).cast("long").alias("q"))
    for k in reversed(range(levels)):
        cut = blocks[k].filter("j % 2 = 0").select("conv", (F.col("j") / 2).cast("long").alias("j"), F.col("p").alias("bp"), F.col("q").alias("bq"))
        below = F.struct((F.col("j") * 2 + 1).alias("j"), *_name(*(F.col(c) for c in ("p", "q", "bp", "bq"))))
        above = F.struct((F.col("j") * 2).alias("j"), F.col("p").alias("p"), F.col("q").alias("q"))
        reaches = F.col("n") > (F.col("j") * 2 + 1) * (1 << k)
        tops = tops.join(cut, ["conv", "j"], "left").select("conv", "n", F.inline(F.when(reaches, F.array(above, below)).otherwise(F.array(above))))
    last = rows.select("conv", F.col("i").alias("j"), F.col("p").alias("bp"), F.col("q").alias("bq"), "points")
    full = tops.join(last, ["conv", "j"])
    return full.select("conv", (F.col("j") + 1).alias("depth"), *_name(*(F.col(c) for c in ("p", "q", "bp", "bq"))), "points", "n")


def totals(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Columns rep, depth, parent, leaves, saved: the own values of `nodes` (same columns) summed over the subtree of each node.

    `paths` names for every conversation the node (rep, depth) at each depth.
    """
    for k in range(levels):
        half = 1 << k
        lower = nodes.filter((F.col("depth") - 1) % (2 * half) == half)
        lower = lower.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("cut")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        spread = lower.select("conv", F.explode(F.sequence(F.col("cut") - (half - 1), F.col("cut"))).alias("depth"), "leaves", "saved")
        grafts = spread.join(paths, ["conv", "depth"]).select("rep", "depth", F.lit(None).cast("long").alias("parent"), "leaves", "saved")
        both = nodes.unionByName(grafts).groupBy("rep", "depth")
        nodes = kept(both.agg(F.max("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "totals", 2)
    return nodes


def list_digests(members: DataFrame) -> DataFrame:
    """Columns rep, depth, ends_sha256: SHA-256 of the ascending ids `conv` of each (rep, depth), joined by commas.

    Range partitions join their ids to pieces of bounded length; the pieces of a list are then digested in order, one at a time.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"rep": node[0], "depth": node[1], "first": first, "ids": ",".join(ids)}], pa.schema(
                [("rep", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

        for b in batches:
            for rep, depth, conv in zip(*(b.column(k).to_pylist() for k in range(3))):
                if ids and (node != (rep, depth) or size > PIECE_CHARS):
                    yield out()
                    ids, size = [], 0
                if not ids:
                    node, first = (rep, depth), conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running, done = None, None, []
        schema = pa.schema([("rep", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
        for b in batches:
            for rep, depth, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                if node == (rep, depth):
                    running.update(b"," + ids.encode())
                    continue
                if node:
                    done.append({"rep": node[0], "depth": node[1], "ends_sha256": running.hexdigest()})
                node, running = (rep, depth), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
        if node:
            yield pa.RecordBatch.from_pylist([{"rep": node[0], "depth": node[1], "ends_sha256": running.hexdigest()}], schema)

    order = ["rep", "depth", "conv"]
    ranged = members.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    short = ranged.mapInArrow(pieces, "rep BIGINT, depth BIGINT, first BIGINT, ids STRING")
    placed = short.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").select("rep", "depth", "ids")
    return placed.mapInArrow(digests, "rep BIGINT, depth BIGINT, ends_sha256 STRING")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of sequences `rows` (conv, i, p, q, points, n) of the conversations `convs` (conv, n)."""
    longest, smallest, many = convs.agg(F.max("n"), F.min("conv"), F.count("*")).first()
    if not many:
        return _result(convs.select(*(F.lit(0).cast("long").alias(c) for c in _NODE), F.lit(EMPTY).alias("ends_sha256")))
    levels = max(longest - 1, 0).bit_length()
    prefixes = kept(prefix_names(rows, convs, levels), "prefixes")
    names = prefixes.groupBy("p", "q").agg(
        F.min("conv").alias("rep"), F.max("depth").alias("depth"), F.max("points").alias("points"), F.count("*").alias("members")
    )
    names = kept(names, "names")
    paths = kept(joined(prefixes.select("p", "q", "conv", "n"), names.drop("points"), ["p", "q"], "members").drop("p", "q"), "paths")
    above = paths.select(F.col("conv").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    nodes = names.join(above, ["rep", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(smallest)))
    children = nodes.groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"))
    nodes = nodes.join(children.filter("depth > 0"), ["rep", "depth"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    nodes = kept(nodes.drop("p", "q"), "nodes")
    own = nodes.select(
        "rep", "depth", "parent", (F.col("children") == 0).cast("long").alias("leaves"), ((F.col("members") - 1) * F.col("points")).alias("saved")
    )
    summed = totals(own, paths.select("conv", "depth", "rep"), levels)
    inner = nodes.join(summed.drop("parent"), ["rep", "depth"])
    inner = inner.select("rep", "depth", "parent", "members", "children", "leaves", "saved")
    tops = summed.filter("depth = 1").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = tops.select(
        F.lit(smallest).alias("rep"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(many).alias("members"),
        "children", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    )
    ends = paths.filter("depth = n").select("rep", "depth", "conv")
    turnless = convs.filter("n = 0").select(F.lit(smallest).alias("rep"), F.lit(0).cast("long").alias("depth"), "conv")
    digests = list_digests(ends.unionByName(turnless))
    found = inner.unionByName(root).join(digests, ["rep", "depth"], "left")
    return _result(found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))


_NODE = ["rep", "depth", "parent", "members", "children", "leaves", "saved"]


def _result(rows: DataFrame) -> DataFrame:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return rows.select(*(F.col(c).cast("long").alias(n) for c, n in zip(_NODE, names)), "ends_sha256")


SQL = r"""
WITH o AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(turn ORDER BY i) AS ts,
         xor(list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''),
               lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM o GROUP BY conv_id
), b AS (
  SELECT c.conv_id, coalesce(g.ts[1:c.h], []) || c.ts[c.h + 1:] AS s
  FROM c LEFT JOIN c AS g ON g.conv_id = c.conv_id - c.conv_id % 100
), m AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM b
), n AS (
  SELECT s[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '')) AS ends_sha256
  FROM m GROUP BY ALL
), k AS (
  SELECT p.path, p.d, p.conv_id, p.n_convs, p.ends_sha256, u.conv_id AS parent,
         (SELECT count(*) FROM n AS x WHERE x.d = p.d + 1 AND x.path[1:p.d] = p.path) AS children,
         CASE WHEN p.d = 0 THEN 0 ELSE (p.n_convs - 1) * length(p.path[p.d]['t']) END AS own
  FROM n AS p LEFT JOIN n AS u ON p.d > 0 AND u.d = p.d - 1 AND u.path = p.path[1:p.d - 1]
)
SELECT a.conv_id, a.d AS depth, any_value(a.parent) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.children) AS n_children,
       (count(*) FILTER (WHERE z.children = 0))::BIGINT AS n_leaves, sum(z.own)::BIGINT AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM k AS a JOIN k AS z ON z.d >= a.d AND z.path[1:a.d] = a.path
GROUP BY a.conv_id, a.d
"""


@query("op12_prefix_trie", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie(*rebuilt(turns(table(spark, folder, "conversations"))))
