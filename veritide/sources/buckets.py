"""Tables that change: rows in buckets by a hash of their key, changes merged on read.

    <path>/rows/batch=N/bucket=K     rows that batch N adds
    <path>/gone/batch=N/bucket=K     keys that batch N deletes
    <path>/base/version=V/bucket=K   buckets as rewriting V left them
    <path>/state/V.json              for each rewritten bucket its version and the last batch in it

A batch is written once: a folder that is complete is left alone, so a stream's batch that
comes again changes nothing. Deleting writes keys and no rows. Reading joins what is there;
the filter on batch, version and bucket is on folders, so what is replaced is never opened.
Rewriting reads and writes the buckets it is given and no others, into a version of their
own; readers see it once its state file has its name, and two rewritings that get the same
number can't both have it.

Keys of any type; a null key has a bucket of its own hash and is deleted by a null key.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType


class Buckets:
    """``newest``: columns by which the newest row of a key counts; without them all rows of a key stay."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 32, newest: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.key, self.buckets, self.newest = spark, path.rstrip("/"), schema, key, buckets, newest
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._name = hadoop.Path
        self._files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Folders and state

    def _there(self, path: str) -> bool:
        return self._files.exists(self._name(f"{self.path}/{path}"))

    def _folders(self, pattern: str) -> list[dict[str, int]]:
        """The numbers in the names of folders, as {"batch": 3, "bucket": 17}."""
        found = self._files.globStatus(self._name(f"{self.path}/{pattern}")) or []
        return [{k: int(v) for k, v in (p.split("=") for p in s.getPath().toString().split("/") if p.count("=") == 1 and p.split("=")[1].isdigit())} for s in found]

    def state(self) -> tuple[int, dict[int, tuple[int, int]]]:
        """The last rewriting, and the version and last batch of each bucket that was ever rewritten."""
        found = [s.getPath() for s in self._files.globStatus(self._name(f"{self.path}/state/*.json")) or []]
        if not found:
            return 0, {}
        last = max(found, key=lambda p: int(p.getName()[:-5]))
        text = self.spark.read.option("wholetext", True).text(last.toString()).first()[0]
        return int(last.getName()[:-5]), {int(k): tuple(v) for k, v in json.loads(text).items()}

    def _enter(self, version: int, state: dict[int, tuple[int, int]]) -> None:
        new = self._name(f"{self.path}/state/.{version}.new")
        out = self._files.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._there(f"state/{version}.json") or not self._files.rename(new, self._name(f"{self.path}/state/{version}.json")):
            raise RuntimeError(f"another rewriting {version} was faster")

    # Changes

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, batch: int) -> bool:
        if self._there(f"{kind}/batch={batch}/_SUCCESS"):
            return False
        rows = rows.withColumn("bucket", self.bucket(F.col(self.key)))
        # Even with one hot key: Spark splits what is too large.
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/batch={batch}")
        return True

    def put(self, rows: DataFrame, batch: int) -> bool:
        """Add rows; False if the batch was there already."""
        return self._write(rows.select(*self.schema.names), "rows", batch)

    def delete(self, keys: DataFrame, batch: int) -> bool:
        """Delete all rows whose key is in ``keys`` and that came with this batch or before."""
        return self._write(keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).distinct(), "gone", batch)

    # Reading

    def _changes(self, kind: str, schema: StructType, done: Column) -> DataFrame:
        folders = StructType([*schema.fields]).add("batch", LongType()).add("bucket", IntegerType())
        if not self._folders(f"{kind}/batch=*"):
            return self.spark.createDataFrame([], folders)
        return self.spark.read.schema(folders).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}").filter(F.col("batch") > done)

    def merged(self, only: Iterable[int] | None = None) -> DataFrame:
        """Rows as they are now, with their bucket; of some buckets only if these are named."""
        _, state = self.state()
        upto = lambda k: F.coalesce(F.get(F.array(*(F.lit(state.get(b, (0, -1))[k]).cast("long") for b in range(self.buckets))), F.col("bucket")), F.lit(-1))
        rows = self._changes("rows", self.schema, upto(1))
        gone = self._changes("gone", StructType([self.schema[self.key]]), upto(1))
        if any(v for v, _ in state.values()) and self._folders("base/version=*/bucket=*"):
            kept = self.spark.read.schema(StructType([*self.schema.fields]).add("version", LongType()).add("bucket", IntegerType())).option("basePath", f"{self.path}/base").parquet(f"{self.path}/base")
            kept = kept.filter(F.col("version") == upto(0)).withColumn("batch", upto(1)).drop("version")
            rows = kept.select(*rows.columns).unionAll(rows)
        if only is not None:
            rows, gone = (x.filter(F.col("bucket").isin(list(only))) for x in (rows, gone))
        last = gone.groupBy("bucket", F.col(self.key).alias("_key")).agg(F.max("batch").alias("_gone"))
        rows = rows.join(last.withColumnRenamed("bucket", "_bucket"), (F.col("bucket") == F.col("_bucket")) & F.col(self.key).eqNullSafe(F.col("_key")), "left")
        rows = rows.filter("_gone is null or batch > _gone").drop("_gone", "_key", "_bucket")
        if self.newest:
            # The newest row of each key by aggregation, so that one key's many rows are combined before they are sent.
            whole = F.struct(*(F.col(c) for c in self.newest), "batch", *(F.col(c) for c in self.schema.names if c not in self.newest))
            rows = rows.groupBy("bucket", F.col(self.key).alias("_key")).agg(F.max(whole).alias("row")).select("row.*", "bucket")
        return rows.select(*self.schema.names, "bucket")

    def read(self) -> DataFrame:
        return self.merged().drop("bucket")

    # Rewriting

    def touched(self) -> list[int]:
        """Buckets that have changes which no rewriting has taken in."""
        _, state = self.state()
        found = [f for kind in ("rows", "gone") for f in self._folders(f"{kind}/batch=*/bucket=*")]
        return sorted({f["bucket"] for f in found if f["batch"] > state.get(f["bucket"], (0, -1))[1]})

    def rewrite(self, only: Iterable[int] | None = None, keep: Column | None = None) -> list[int]:
        """Write buckets anew (those with changes if none are named), without rows that aren't to be kept."""
        which = self.touched() if only is None else sorted(set(only))
        if not which:
            return []
        version, state = self.state()
        batches = [f["batch"] for kind in ("rows", "gone") for f in self._folders(f"{kind}/batch=*") if self._there(f"{kind}/batch={f['batch']}/_SUCCESS")]
        rows = self.merged(which)
        if keep is not None:
            rows = rows.filter(keep)
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/version={version + 1}")
        self._enter(version + 1, state | {b: (version + 1, max(batches, default=-1)) for b in which})
        return which


def cascade(keys: DataFrame, chain: list[tuple[Buckets, str]], batch: int) -> None:
    """Delete rows by their parents' keys down a chain of tables.

    Each table is in buckets by its parent's key; the name with it is that of its own key,
    by which the next table's rows are known.
    """
    for table, own in chain:
        below = table.merged().join(keys.toDF("_parent").distinct(), F.col(table.key) == F.col("_parent"), "left_semi").select(F.col(own))
        table.delete(keys, batch)
        keys = below
