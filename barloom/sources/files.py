"""Readers for the CSV and JSON files that forecasts and charts come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import DATE_NAMES, VALUE_NAMES, clean_header, pick_column
from barloom.functions.scalar import numeric, parse_time_smart, utc_time

# Fixed value: the columns of a forecast file, whose own header may be one field short.
FORECAST_COLUMNS = ["Date", "close", "high", "low"]


def scan_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV as (ts, value), sorted by time: columns are found by name, unreadable rows dropped."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[clean_header(c) for c in raw.columns])
    date = pick_column(raw.columns, DATE_NAMES)
    if date is None:
        raise ValueError(f"no date column among {raw.columns}")
    value = pick_column(raw.columns, VALUE_NAMES, containing="close")
    value = value or next(c for c in raw.columns if c != date)
    pair = raw.select(F.col(f"`{date}`").alias("_time"), F.col(f"`{value}`").alias("_value"))
    out = parse_time_smart(pair, "_time", "ts").withColumn("value", numeric("_value"))
    return out.select("ts", "value").dropna().orderBy("ts")


def scan_csv_fixed(spark: SparkSession, path: str) -> DataFrame:
    """A forecast CSV under forced column names, whatever its header says."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FORECAST_COLUMNS])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(utc_time(F.col("Date")).alias("ts"), *[numeric(c).alias(c) for c in FORECAST_COLUMNS[1:]])



def rows_from_specs(specs: DataFrame, files: DataFrame, row_type: str) -> DataFrame:
    """The row array of nested chart documents `(name, text)`.

    Looked for in this order: the document's own `data.values`, the first layer that has values, and the file behind
    the first `data.url`, taken from `files(url, text)` as a list or as its `data`.
    """
    node = f"STRUCT<data: STRUCT<values: ARRAY<{row_type}>, url: STRING>>"
    spec = F.from_json("text", f"STRUCT<data: STRUCT<values: ARRAY<{row_type}>, url: STRING>, layer: ARRAY<{node}>>")
    parsed = specs.withColumn("_spec", spec)
    layers = F.col("_spec.layer")
    with_values = F.filter(layers, lambda n: n["data"]["values"].isNotNull())
    with_url = F.filter(layers, lambda n: n["data"]["url"].isNotNull())
    own = F.coalesce(F.col("_spec.data.values"), F.get(with_values, 0)["data"]["values"])
    url = F.coalesce(F.col("_spec.data.url"), F.get(with_url, 0)["data"]["url"])
    located = parsed.select("name", own.alias("_own"), url.alias("_url"))
    payload = files.select(
        F.col("url").alias("_url"),
        F.coalesce(
            F.from_json("text", f"STRUCT<data: ARRAY<{row_type}>>")["data"],
            F.when(F.ltrim("text").startswith("["), F.from_json("text", f"ARRAY<{row_type}>")),
        ).alias("_file"),
    )
    rows = located.join(payload, "_url", "left")
    return rows.select("name", F.inline(F.coalesce("_own", "_file")))
