"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and connected components.

A document's set holds its distinct shingles of five words (fewer words: the whole sequence as one shingle). Documents with
equal sets are one class and go on as its smallest id. A class's signature has SLOTS values; slot values of an element are
its random permutation's ranks plus random fractions, so the slots are negatively correlated and estimate similarity better
than independent permutations. Ranks are handed out level by level and stop once every slot of the document is filled.

Classes that share a band are compared with the smallest class of the bucket on full sets. Where the other members of a bucket
still are in several components, they are compared with each other in small blocks (`within_groups`), across components only:
members of one component need no more links. All links that can join different components are thus verified. A link at the
threshold is missed if no band agrees, with probability (1 - 0.85^4)^25, about 1e-8 (2e-6 at 0.8).

Null, blank and empty texts have an empty set and are linked with nothing. Rows that share an id count as one document. A null
id is smaller than any other. An empty table gives an empty result. Extra columns pass through `without_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import texts
from barloom.llm.components import components
from barloom.llm.registry import query, table
from barloom.llm.scratch import kept

WIDTH = 5
SLOTS = 100
ROWS = 4
PART = 1 << 15  # elements whose permutations are laid out at once, about
BLOCK = 256  # documents of a block at most
BLOCK_HASHES = 1 << 19  # hashes of a block, about
PERCENT = 85
U64 = np.uint64
_NO_ID = -(2**63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = texts.words(data, offsets, texts.is_blank())
    hashes = texts.Rolling(data, lower=True).parts(found.starts, found.ends)
    window, begin = texts.windows(hashes, found.first, WIDTH)
    out = []
    for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:])):
        if b - a >= WIDTH:
            out.append(np.unique(window[begin[i] : begin[i + 1]]))
        elif b > a:
            with np.errstate(over="ignore"):
                short = (hashes[a:b] * texts.constants(WIDTH, 9)[: b - a]).sum(dtype=U64) + U64(b - a)
            out.append(texts.mix(np.array([short], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` values for each set: rank in the high 32 bits, random fraction in the low ones; all ones if empty."""
    part = np.cumsum([len(s) for s in sets], dtype=np.int64) // PART
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sets)]
    return np.concatenate([_signed(sets[a:b], slots) for a, b in zip(cuts, cuts[1:])])


def _signed(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """The rows of some sets; two bytes are held for each slot and element that goes on beyond the first level."""
    values = np.concatenate([*sets, np.empty(0, U64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * slots, ~U64(0))
    steps = texts.constants(slots, 21)
    place: np.ndarray | None = None
    for level in range(slots):
        with np.errstate(over="ignore"):
            random = texts.mix(values ^ steps[level])
        pick = (level + (((random & U64(0xFFFFFFFF)) * U64(slots - level)) >> U64(32))).astype(np.int64)
        if level == 0:
            slot = pick
        else:
            rows = np.arange(len(values))
            slot = place[rows, pick].astype(np.int64)
            place[rows, pick] = place[:, level]
        np.minimum.at(out, owner * slots + slot, (U64(level) << U64(32)) | (random >> U64(32)))
        open_ = (out.reshape(-1, slots) == ~U64(0)).any(axis=1)[owner]
        if not open_.any():
            break
        if level == 0:
            values, owner, pick = values[open_], owner[open_], pick[open_]
            place = np.tile(np.arange(slots, dtype=np.uint16), (len(values), 1))
            place[np.arange(len(values)), pick] = 0
        elif open_.sum() < len(open_) // 2:
            values, owner, place = values[open_], owner[open_], place[open_]
    return out.reshape(-1, slots)


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each group of `rows` slots."""
    factors = texts.constants(rows, 31)
    parts = signatures.reshape(len(signatures), -1, rows)
    with np.errstate(over="ignore"):
        total = (texts.mix(parts) * factors).sum(axis=2, dtype=U64) + texts.constants(parts.shape[1], 32)
    return texts.mix(total)


def _prints(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    with np.errstate(over="ignore"):
        return tuple(int(texts.mix(s ^ c).sum(dtype=U64).view(np.int64)) for c in texts.constants(2, 41))


def _sources(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_column).alias("text"))


def signatures(sources: DataFrame) -> DataFrame:
    """Columns id, n, p1, p2, bands of every document; bands is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts.chunks(batches, "text"):
            sets = shingle_sets(chunk.data, chunk.offsets)
            n = np.array([len(s) for s in sets])
            prints = [_prints(s) for s in sets]
            hashes = bands(super_minhash(sets)).view(np.int64)
            lists = [h if size else None for h, size in zip(hashes, n)]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("id"), pa.array(n), pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                ],
                ["id", "n", "p1", "p2", "bands"],
            )

    return sources.mapInArrow(run, "id BIGINT, n BIGINT, p1 BIGINT, p2 BIGINT, bands ARRAY<BIGINT>")


def set_table(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Columns id, items of the wanted documents: the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts.chunks(batches, "text"):
            sets = shingle_sets(chunk.data, chunk.offsets)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "items"])

    return sources.join(ids, "id", "left_semi").mapInArrow(run, "id BIGINT, items BINARY")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets of hashes."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(x, y, percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a BIGINT, b BIGINT")


def _near_sizes(m: str, n: str, percent: int) -> Column:
    """Sets of other sizes cannot be similar enough."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def links(sources: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Columns node, root: the component of each class that has a smaller class in its component."""
    classes = signed.filter("n > 0").groupBy("n", "p1", "p2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    banded = kept(classes.select("id", "n", F.explode("bands").alias("band")), "bands", 4)
    full = banded.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band")
    crowd = kept(banded.join(full, "band"), "buckets", 8)
    sets = kept(set_table(sources, crowd.select("id").distinct()), "sets")
    lead = crowd.groupBy("band").agg(F.min(F.struct("id", "n")).alias("lead")).select("band", F.col("lead.id").alias("b"), F.col("lead.n").alias("m"))
    members = kept(crowd.join(lead, "band").filter("id <> b"), "members", 8)
    pairs = members.filter(_near_sizes("n", "m", percent)).select(F.col("id").alias("a"), "b").distinct()
    good = kept(verified(pairs, sets, percent), "links")
    first = components(good)
    named = first.select(F.col("node").alias("id"), F.col("root").alias("comp"))
    members = members.join(named, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = members.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("band")
    left = members.join(mixed, "band", "left_semi")
    more = within_groups(left, sets, percent)
    return components(good.unionByName(more))


def within_groups(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components within the buckets of `members` (band, b, id, n, comp).

    Documents connected through shared buckets are a group, and a group's sizes are cut into classes, of which only equal and
    neighbouring ones can be similar enough. Each class is dealt into blocks of a bounded number of hashes; each pair of blocks is
    one small task that counts common hashes by matrix products and returns a spanning forest of the links it finds. No pair
    of documents is ever a row, and no bucket is gathered anywhere.
    """
    nodes = members.groupBy("id").agg(F.max("n").alias("n"), F.max("comp").alias("comp"))
    heads = members.groupBy("band").agg(F.min("id").alias("a"))
    group = components(members.join(heads, "band").select("a", F.col("id").alias("b")).filter("a <> b").distinct())
    nodes = nodes.join(group, F.col("id") == F.col("node"), "left").withColumn("grp", F.coalesce("root", "id")).drop("node", "root")
    nodes = kept(nodes.withColumn("size", F.floor(F.log("n") / (F.log(F.lit(100 / percent)) + 1e-6)).cast("int")), "groups", 16)
    counts = nodes.groupBy("grp", "size").agg(F.count("*").alias("k"), F.max("n").alias("largest"))
    per_block = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_HASHES) / F.col("largest"))))
    counts = kept(counts.select("grp", "size", F.ceil(F.col("k") / per_block).cast("int").alias("blocks")), "blocks", 16)
    own = nodes.join(counts, ["grp", "size"])
    for step, name in ((1, "up"), (-1, "down")):
        beside = counts.select("grp", (F.col("size") - step).alias("size"), F.col("blocks").alias(name))
        own = own.join(beside, ["grp", "size"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    at = F.col("block")
    cell = lambda s, i, t, j, side: F.struct(s.alias("s"), i.alias("i"), t.alias("t"), j.alias("j"), F.lit(side).alias("side"))
    size, one = F.col("size"), F.lit(1)
    cells = F.concat(
        F.transform(span(at, F.col("blocks") - 1), lambda j: cell(size, at, size, j, 0)),
        F.transform(span(F.lit(0), at - 1), lambda i: cell(size, i, size, at, 1)),
        F.transform(span(F.lit(0), F.col("up") - 1), lambda j: cell(size, at, size + one, j, 0)),
        F.transform(span(F.lit(0), F.col("down") - 1), lambda i: cell(size - one, i, size, at, 1)),
    )
    dealt = own.select("grp", "id", "comp", F.inline(cells))
    dealt = dealt.join(sets, "id").select("grp", "s", "i", "t", "j", "side", "id", "comp", "items")

    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        ids, comps = rows.column("id").to_numpy(), rows.column("comp").to_numpy()
        items = [np.frombuffer(x, U64) for x in rows.column("items").to_pylist()]
        x = np.flatnonzero(side == 0)
        y = x if not (side == 1).any() else np.flatnonzero(side == 1)
        a, b = forest([items[k] for k in x], [items[k] for k in y], ids[x], ids[y], comps[x], comps[y], percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("grp", "s", "i", "t", "j").applyInArrow(run, "a BIGINT, b BIGINT")


def common_counts(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets in x with all in y; only hashes that occur in both are laid out, a few at a time."""
    xs, ys = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(xs, ys)
    out = np.zeros((len(x), len(y)), np.float32)
    xo, yo = (np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y))
    xp, yp = np.searchsorted(shared, xs), np.searchsorted(shared, ys)
    for values, owner, place in ((xs, xo, xp), (ys, yo, yp)):
        place[shared[np.minimum(place, max(len(shared) - 1, 0))] != values if len(shared) else slice(None)] = -1
    for at in range(0, len(shared), width):
        tables = []
        for owner, place, z in ((xo, xp, x), (yo, yp, y)):
            table_ = np.zeros((len(z), min(width, len(shared) - at)), np.float32)
            inside = (place >= at) & (place < at + width)
            table_[owner[inside], place[inside] - at] = 1
            tables.append(table_)
        out += tables[0] @ tables[1].T
    return out


def forest(
    x: list[np.ndarray], y: list[np.ndarray], x_ids: np.ndarray, y_ids: np.ndarray, x_comps: np.ndarray, y_comps: np.ndarray, percent: int
) -> tuple[list[int], list[int]]:
    """Links between x and y that join components, each only where it joins two trees."""
    if not x or not y:
        return [], []
    common = common_counts(x, y).astype(np.int64)
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    good = (100 * common >= percent * (nx[:, None] + ny[None, :] - common)) & (x_comps[:, None] != y_comps[None, :])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    a, b = [], []
    for i, j in zip(*(k.tolist() for k in np.nonzero(good))):
        p, q = root(int(x_comps[i])), root(int(y_comps[j]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            a.append(int(x_ids[i]))
            b.append(int(y_ids[j]))
    return a, b


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row for each document: id, n_shingles, class_id (smallest id with an equal set), component_id, kept."""
    sources = _sources(docs, id_column, text_column)
    signed = kept(signatures(sources), "signatures")
    roots = links(sources, signed, percent)
    slim = signed.select("id", "n", "p1", "p2")
    classes = slim.filter("n > 0").groupBy("n", "p1", "p2").agg(F.min("id").alias("class_id"))
    classes = classes.join(roots, F.col("class_id") == F.col("node"), "left")
    rows = slim.join(classes, ["n", "p1", "p2"], "left")
    class_id = F.coalesce("class_id", "id")
    component = F.coalesce("root", class_id)
    known = lambda c: F.when(c != _NO_ID, c)
    return rows.select(
        known(F.col("id")).alias(id_column), F.col("n").alias("n_shingles"), known(class_id).alias("class_id"),
        known(component).alias("component_id"), (F.col("id") == component).alias("kept"),
    )


def without_copies(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = 80) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, all columns as they came."""
    stay = near_duplicates(docs, id_column=id_column, text_column=text_column, percent=percent).filter("kept")
    name = texts.free_name("_stays", docs)
    stay = stay.select(F.col(id_column).alias(name)).distinct()
    return docs.join(stay, docs[id_column].eqNullSafe(F.col(name)), "left_semi")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), i AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p+4], ' ')) END) AS s FROM w
), s AS (SELECT DISTINCT doc_id, s FROM i
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM e JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.root
), m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
), q AS (
  SELECT doc_id, min(other) AS class_id FROM (
    SELECT doc_id, doc_id AS other FROM documents
    UNION ALL SELECT x, y FROM e JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c = a.n AND c = b.n) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept, class_id
FROM m JOIN q USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op4_super_minhash", SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
