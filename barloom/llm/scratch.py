"""Tables kept between jobs in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.session import work_path


def kept(df: DataFrame, label: str, narrow: int = 1) -> DataFrame:
    """Write a table below spark.checkpoint.dir and read it back: a lost executor costs a reread, not a rerun.

    `narrow`: a table whose rows are many times smaller than the texts, for which the number of shuffle partitions is meant,
    is written in so many times fewer files. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    if narrow > 1:
        df = df.coalesce(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // narrow, 2))
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
