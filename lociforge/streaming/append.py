"""Incremental forms of two batch operators, for tables that grow: appending unseen keys, and running merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import append_new


def append_unseen(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Every batch's rows with keys that the table lacks are appended to it; a repeated batch appends nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df.dropDuplicates(keys), path, keys)).trigger(availableNow=True).start()


def running_ivw(stream: DataFrame, keys: list[str], beta: str = "beta", se: str = "se") -> DataFrame:
    """The inverse-variance merge as a streaming aggregation: two sums and a count of each key."""
    w = 1 / (F.col(se) * F.col(se))
    g = stream.where(F.col(se) > 0).groupBy(*keys).agg(F.count("*").alias("n_merged"), F.sum(F.col(beta) * w).alias("bw"), F.sum(w).alias("w"))
    return g.select(*keys, "n_merged", (F.col("bw") / F.col("w")).alias("beta"), F.sqrt(1 / F.col("w")).alias("se"))
