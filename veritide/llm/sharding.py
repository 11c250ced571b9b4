"""Proportional stratified interleaving: shards of equal row counts that all match the mixture.

Rows are shuffled by a seeded hash and ranked within their source; the rank as a
fraction of the source's rows orders all rows, so each stretch of that order holds
every source in proportion. Equal stretches are the shards (law ``rows``).

Ranks come from Spark's range sort: a row's number is its place in its partition plus
the counts of the partitions before. Each row has a number of its own at the end of the
sort key, so one source, one id or one text may hold any share of the rows, and sources
may be as many as rows: partitions stay even. Only counts of partitions meet in one
task. DataFrame functions only.

Defined results: null text has size 1 and the checksum of no bytes; a null source is
a source of its own; rows with a null id or with one that repeats are placed each;
fully equal rows are interchangeable; an empty table gives none; other columns are
left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.scratch import written

ORDER = ["place", "doc_id", "size", "text_crc32", "rid"]


def ranked(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 in this order, which must not have ties."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_own": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), tag)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition of the sort
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(counts), "_part").withColumn("rank", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def seeded(seed: int, *columns: str) -> Column:
    """A hash of 63 bits: the place in the seeded shuffle."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, row): the rows in a table of their own, each with a number that stays."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "shard-input")


def placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """rid, doc_id, size, text_crc32, shard and slot of rows with rid, doc_id, source and text."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    few = rows.select(
        "rid", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    )
    few = written(few.withColumn("place", seeded(seed, "doc_id", "text_hash")).drop("text_hash"), "shard-rows")
    within = ranked(few, ["source", *ORDER], "shard-sources")
    # A source is one stretch of that order, so its first rank and its size give the ranks within it.
    sources = written(within.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("in_source")), "shard-sizes")
    within = within.join(sources, "source").withColumn("fraction", (2 * (F.col("rank") - F.col("first")) + 1) / (2 * F.col("in_source")))
    all_rows = ranked(within.drop("rank", "first", "in_source"), ["fraction", "source", *ORDER], "shard-ranks")
    n = max(1, few.count())
    out = all_rows.withColumn("shard", F.expr(f"rank * {shards}L div {n}L").cast("int"))
    return out.select("rid", "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")).alias("slot"))


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 20_240_501) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text")
    return placed(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 20_240_501) -> None:
    """The documents as Parquet, a folder ``shard=k`` each, in slot order; every row once, whatever its id.

    A column named shard gives way to the shard's number.
    """
    rows = numbered(docs)
    places = placed(rows.select("rid", "row.doc_id", "row.source", "row.text"), shards, seed).select("rid", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = rows.join(places, "rid").repartition("_shard", F.expr("_slot div 100000")).sortWithinPartitions("_shard", "_slot")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "shard"]
    out.select(*kept, F.col("_slot").alias("slot"), F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
