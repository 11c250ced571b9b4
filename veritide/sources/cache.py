"""A response cache that streams write: newest entry of a key wins, entries expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from veritide.sources.buckets import Buckets

SCHEMA = StructType().add("key", "string").add("response", "string").add("cached_at", "timestamp_ntz")


class ResponseCache(Buckets):
    def __init__(self, spark: SparkSession, path: str, hours: int = 24, buckets: int = 32):
        super().__init__(spark, path, SCHEMA, "key", buckets, newest=("cached_at",))
        self.hours = hours

    def sink(self, responses: DataFrame) -> DataStreamWriter:
        """A stream's writer that puts each micro-batch once, whether it comes again or not."""
        return responses.writeStream.foreachBatch(lambda rows, batch: self.put(rows, batch) and None)

    def old(self, as_of: str):
        return F.col("cached_at") + F.expr(f"interval {self.hours} hours") < F.lit(as_of).cast("timestamp_ntz")

    def fresh(self, as_of: str) -> DataFrame:
        return self.read().filter(~self.old(as_of))

    def expire(self, as_of: str) -> list[int]:
        """Take expired entries out; only buckets that have any are written anew."""
        buckets = [r["bucket"] for r in self.merged().filter(self.old(as_of)).select("bucket").distinct().collect()]
        return self.rewrite(buckets, keep=~self.old(as_of))
