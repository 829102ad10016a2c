"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-case words of a text (runs of letters) and their first four and five bytes, hashed into 2^18 buckets; a
text has a bucket or has not. The score is the logistic of

    bias + sum w_i + sum_{i<j} <v_i, v_j>

over the buckets of the text, so pairs of terms count beyond the sum of both. The model is fitted on a bounded sample of
labelled rows (`SAMPLE_PER_LABEL` expected rows of each label, weighted back to their shares) over the FEATURES buckets that
differ most between the labels; the counts that choose them are aggregated by Spark, the fit itself runs in one task on the
bounded sample. Every whole text is scored.

Null, empty and wordless texts get the score of the bias. Rows without a label are only scored; a label's repeated rows count
repeatedly. With no labelled rows every score is 0. An empty table gives an empty result. Only id and text are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import texts
from barloom.llm.registry import query, table
from barloom.llm.scratch import kept

BUCKETS = 1 << 18
PREFIXES = (4, 5)
SAMPLE_PER_LABEL = 12_000
FEATURES = 4096
LEAST_TEXTS = 5  # sampled texts a bucket must be in
LEAST_Z = 3.0  # standard errors of its log odds ratio
FACTORS = 8
EPOCHS = 15
RATE = 0.15
RIDGE = 1e-5
THRESHOLD = 0.3


@dataclass
class Machine:
    """Weights by place; `place` maps a bucket to its place, -1 where it has none."""

    bias: float
    place: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """`x`: a row of 0 and 1 for each text."""
        pairs = ((x @ self.factors) ** 2 - x @ self.factors**2).sum(axis=1) / 2
        return self.bias + x @ self.linear + pairs


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and buckets of all terms of a chunk, repeats included."""
    found = texts.words(data, offsets, texts.is_not_letter())
    rolling, owners = texts.Rolling(data, lower=True), found.owners()
    whole = rolling.parts(found.starts, found.ends)
    parts, who = [whole], [owners]
    for k, size in enumerate(PREFIXES):
        long = found.ends - found.starts > size
        parts.append(rolling.parts(found.starts[long], found.starts[long] + size) ^ texts.constants(len(PREFIXES), 51)[k])
        who.append(owners[long])
    return np.concatenate(who), (texts.mix(np.concatenate(parts)) % np.uint64(BUCKETS)).astype(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """Columns label, weight, buckets of about `per_label` sampled rows of each label.

    Docs: id, text; labels: id, label. The sample is bounded by `per_label`, so it is broadcast.
    """
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, per_label / n) for k, n in sizes.items()}
    taken = F.lit(False)
    weight = F.lit(None).cast("double")
    for k, s in share.items():
        taken = taken | ((F.col("label") == k) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * s)))
        weight = F.when(F.col("label") == k, F.lit(1 / s)).otherwise(weight)
    sample = labels.filter(taken).withColumn("weight", weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts.chunks(batches, "text", lower=True):
            owners, terms = buckets(chunk.data, chunk.offsets)
            codes = np.unique(owners * BUCKETS + terms)
            at = np.searchsorted(codes // BUCKETS, np.arange(len(chunk.offsets)))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((codes % BUCKETS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([chunk.column("label"), chunk.column("weight"), lists], ["label", "weight", "buckets"])

    rows = docs.join(F.broadcast(sample), "id").select("label", "weight", "text")
    return rows.mapInArrow(run, "label INT, weight DOUBLE, buckets ARRAY<INT>")


def choose(rows: DataFrame, limit: int = FEATURES) -> DataFrame:
    """Buckets whose texts differ most in label: one column, bucket."""
    totals = rows.agg(F.sum(F.col("label").cast("long")).alias("p"), F.count("*").alias("n")).first()
    p, q = totals["p"] or 0, (totals["n"] or 0) - (totals["p"] or 0)
    each = rows.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.sum(F.col("label").cast("long")).alias("a"), F.count("*").alias("k")
    ).withColumn("b", F.col("k") - F.col("a"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = F.lit(p + 0.5) - F.col("a"), F.lit(q + 0.5) - F.col("b")
    z = F.abs(F.log(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return each.filter(F.col("k") >= LEAST_TEXTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(limit).select("bucket")


def fit(x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the weighted logistic loss; x: places of each row."""
    rng = np.random.default_rng(seed)
    share = float((weight * y).sum() / weight.sum())
    bias = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    w, v = np.zeros(size, np.float32), rng.normal(0, 0.01, (size, FACTORS)).astype(np.float32)
    gw, gv, gb = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32), 1e-2
    weight = weight / weight.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            rows = np.zeros((len(part), size), np.float32)
            for i, k in enumerate(part):
                rows[i, x[k]] = 1
            both = rows @ v
            margin = bias + rows @ w + ((both**2 - rows @ v**2).sum(axis=1)) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) * weight[part] / len(part)
            error = error.astype(np.float32)
            dw = rows.T @ error + RIDGE * w
            dv = rows.T @ (error[:, None] * both) - v * (rows.T @ error)[:, None] + RIDGE * v
            db = error.sum()
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv)
            bias -= RATE * db / np.sqrt(gb)
    return float(bias), w, v


def learn(docs: DataFrame, labels: DataFrame, *, per_label: int = SAMPLE_PER_LABEL, limit: int = FEATURES) -> Machine | None:
    """Fit on labelled rows; docs: id, text; labels: id, label (0 or 1). The driver receives the model only."""
    rows = kept(training_rows(docs, labels, per_label), "toxic-sample")
    chosen = sorted(r["bucket"] for r in choose(rows, limit).collect())
    if rows.isEmpty():
        return None
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    size = len(chosen)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x: list[np.ndarray] = []
        y: list[int] = []
        weight: list[float] = []
        for f in frames:
            for terms in f["buckets"]:
                at = place[np.asarray(terms, np.int64)]
                x.append(at[at >= 0])
            y += f["label"].tolist()
            weight += f["weight"].tolist()
        if y:
            bias, w, v = fit(x, np.array(y, float), np.array(weight), size)
            yield pd.DataFrame({"k": range(-1, size), "w": [bias, *w], "v": [np.zeros(FACTORS), *v]})

    model = rows.repartition(1).sortWithinPartitions(F.xxhash64("buckets"), "label").mapInPandas(run, "k INT, w DOUBLE, v ARRAY<DOUBLE>").collect()
    model.sort(key=lambda r: r["k"])
    return Machine(model[0]["w"], place, np.array([r["w"] for r in model[1:]]), np.array([r["v"] for r in model[1:]]).reshape(size, FACTORS))


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Columns id, score of every row; about 1 MB of text, or one longer text, in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in texts.chunks(batches, "text", lower=True):
            n = len(chunk.offsets) - 1
            score = np.zeros(n)
            if machine:
                owners, terms = buckets(chunk.data, chunk.offsets)
                at = machine.place[terms]
                x = np.zeros((n, len(machine.linear)), np.float32)
                x[owners[at >= 0], at[at >= 0]] = 1
                score = 1 / (1 + np.exp(-np.clip(machine.margins(x), -30, 30)))
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(score.astype(np.float64))], ["id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score DOUBLE")


@query("op1_factorization_machine")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    machine = learn(docs, labels.filter(~held & F.col("label").isin(0, 1)))
    rows = scored(docs, machine)
    return rows.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
