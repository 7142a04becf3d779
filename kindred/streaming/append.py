"""An index that grows with a stream of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.index import BUCKET_SIZE, cap, limit_pushed, postings_of
from kindred.operators.parsing import Dimensions


def append_postings(queries: DataFrame, dims: Dimensions, path: str, checkpoint: str) -> StreamingQuery:
    """Write the postings of each micro-batch of ``queries`` (query_id, query), a folder for each;
    a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        postings_of(batch, dims).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark, path: str, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """All batches' postings with the cap applied anew."""
    limit_pushed(spark, bucket_size)
    return cap(spark.read.parquet(path).drop("batch"), bucket_size)
