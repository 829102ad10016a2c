"""Session settings, the shared work folder and the code that executors need."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings that results depend on, and give executors this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that their Python workers can import it from anywhere."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # not itself imported from a shipped file
        target = Path(tempfile.mkdtemp(prefix="barloom-code-")) / "barloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
    _shipped.add(application)


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir, else the warehouse.

    The warehouse may be a local folder only where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = "://" not in warehouse or warehouse.startswith("file:")
    master = spark.sparkContext.master
    if local and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share; the warehouse {warehouse} is local")
    return f"{warehouse.rstrip('/')}/_work"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared work folder; what is written there goes when the driver's JVM ends."""
    path = f"{work_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
