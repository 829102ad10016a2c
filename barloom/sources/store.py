"""Stored models and forecasts, addressed by horizon and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted model labels and the names they are stored under.
MODEL_LABELS = {
    "arimax": "arimax", "sarimax": "arimax", "bvar": "var", "bayesian_var": "var", "var": "var",
    "prophet": "additive", "additive": "additive", "lstm": "sequence", "sequence": "sequence", "naive": "naive",
}


#: Display periods that the short horizon serves; all others are the long one's.
SHORT_PERIODS = ("1H", "24H", "1W")
ALL_LABELS = ("all", "all_models")
HORIZON_NAMES = ("short", "long")


def model_key(label: str) -> str:
    """The stored name behind a label; an unknown label is an error."""
    key = label.strip().lower().replace(" ", "_").replace("-", "_")
    if key not in MODEL_LABELS:
        raise ValueError(f"unknown model {label!r}")
    return MODEL_LABELS[key]


def address(period: str | None, label: str | None) -> tuple[str, str | None]:
    """(horizon, model) behind a display period and a label, model None for all models.

    A label may name its horizon itself (`long_prophet`), whatever the period. No label and unknown ones are errors.
    """
    horizon = HORIZON_NAMES[0] if (period or "").strip().upper() in SHORT_PERIODS else HORIZON_NAMES[1]
    key = (label or "").strip().lower().replace(" ", "_").replace("-", "_")
    if key in ALL_LABELS:
        return horizon, None
    for name in HORIZON_NAMES:
        if key.startswith(f"{name}_"):
            horizon, key = name, key.removeprefix(f"{name}_")
    return horizon, model_key(key)


def save_models(table: DataFrame, path: str) -> str:
    """Write models or forecasts by horizon, version (where there is one) and model; only partitions that are written are replaced."""
    parts = [c for c in ("horizon", "version", "model") if c in table.columns]
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return path


def locate(spark: SparkSession, path: str, *, period: str | None, label: str) -> DataFrame:
    """Models or forecasts of a display period and label; partition pruning reads nothing else."""
    horizon, model = address(period, label)
    stored = spark.read.parquet(path).filter(F.col("horizon") == horizon)
    return stored if model is None else stored.filter(F.col("model") == model)


def load_models(spark: SparkSession, path: str, *, horizon: str, version: str | None = None) -> DataFrame:
    """The stored models of a horizon, of one version or the last one."""
    stored = spark.read.parquet(path).filter(F.col("horizon") == horizon).withColumn("version", F.col("version").cast("string"))
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    if version is None:
        raise FileNotFoundError(f"no models of horizon {horizon!r} in {path}")
    return stored.filter(F.col("version") == version)


def selected_features(metadata: DataFrame | None, columns: Sequence[str], targets: Sequence[str]) -> list[str]:
    """Features a stored model was fitted on that still exist; all features where no metadata is stored."""
    names = [r["feature"] for r in metadata.select("feature").collect()] if metadata is not None else []
    kept = [c for c in columns if c in set(names)]
    return kept or [c for c in columns if c not in targets]
