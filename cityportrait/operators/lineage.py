"""Tables written to the cluster's shared folder: cutting long lineages where a table is used several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, ending: str = "") -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}{ending}"


def settled(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: computed once, and lost executors don't matter."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
