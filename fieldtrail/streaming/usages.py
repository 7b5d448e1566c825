"""Usage sites of new files as they arrive: the same narrow plan as for a table, on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldtrail.operators.discover import find_usages
from fieldtrail.profiles import Layer


def stream_usages(spark: SparkSession, source: str, sink: str, checkpoint: str, keyword: str, extras: Sequence[str] = (), layers: Sequence[Layer] = ()) -> StreamingQuery:
    """Start a query from Parquet files of (repo, path, text) in ``source`` to Parquet in ``sink``; it takes what is there, then stops."""
    files: DataFrame = spark.readStream.schema("repo string, path string, text string").parquet(source)
    sites = find_usages(files, keyword, extras, layers)
    return sites.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
