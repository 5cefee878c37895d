"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir; a temporary one where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = have.get() if have.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lociforge-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows to a task of a deal whose tasks hold what they get.
DEALT_ROWS = 1 << 20


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by the keys in as many partitions as they need to hold DEALT_ROWS each on average, a shuffle's usual number at least."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // DEALT_ROWS)), *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As `checkpointed`, as a table bucketed and sorted by the key, a bucket a shuffle partition: joins on the key read it
    where it is and deal out only the other side."""
    spark, name = df.sparkSession, f"lociforge_step_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
