"""Tables that a job writes once and reads many times, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that never sends it whole to the driver and all tasks. Sizes are guessed from those of the input, which say nothing of
    texts that are made of it or rows that it is taken apart into."""
    return df.hint("merge")


def written(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read back: cuts the lineage, survives lost executors, and later reads take the columns
    and partitions they need. The folder's owner deletes it with the session's other checkpoints."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
