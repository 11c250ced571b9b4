"""Mixing sources to target weights: Sainte-Laguë apportionment of blocks of equal length.

1. Targets. Sources share a multiple of all words by weight, and none gets more than a
   number of times what it has; the excess goes to the others by weight until nobody is
   above. Each round is one aggregate over the table of sources, of which two sums meet
   on the driver.
2. Quotas. The mix is made of blocks of so many words. Blocks go to sources by the highest
   quotients target / (2k + 1), and each shard takes an equal stretch of that sequence, so
   every shard has integer quotas in the mixture's proportions. The first N blocks of the
   sequence needn't be listed: with m sources, the divisors targets / (N + m/2) and
   targets / (N - m/2) bound each quota from above and below, and only the blocks between
   these bounds, a few for each source, are ranked by their quotients.
3. Selection. A source's documents stand in a line in seeded order; its blocks are cut from
   that line, which comes again when it is used up. The source's shards take their quotas of
   blocks from it one after another. So a document is whole but at the ends of a shard's
   stretch, and its words are taken at most as often as the line is repeated.

Places in the lines come from a range sort without ties, sums over chunks of a thousand
ranks and sums within chunks, so a source may hold any share of the rows. DataFrame
functions only.

Defined results: null text has no words and nothing is taken of it; a null source is a
source of its own, the last; rows with a null id or with one that repeats are taken each;
fully equal rows are interchangeable; sources without words have the target 0; an empty
table gives none; other columns are left out, whatever their names. A source whose target
is less than half a block may get none: targets are met within a block, unless thousands of
sources are smaller than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritide.llm.quality import words
from veritide.scratch import counted, written
from veritide.llm.sharding import ranked

WEIGHTS = (5, 2, 1)
BLOCK = 16
CHUNK = 1000
SEED = 20_240_511


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> tuple[DataFrame, float]:
    """``sources`` (source, source_size) with nth (place by code point, null last) and target; and the sum of targets."""
    known = F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name"))  # strings compare by bytes, which is by code points
    order = ranked(sources.withColumn("known", known), ["known"], "mix-sources").withColumnRenamed("rank", "nth").drop("known")
    weight = F.get(F.array(*(F.lit(w) for w in weights)), (F.col("nth") % len(weights)).cast("int"))
    order = written(order.withColumns({"weight": weight, "limit": F.col("source_size") * most}), "mix-weights")
    total = (order.agg(F.sum("source_size")).first()[0] or 0) * share
    level, above = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("limit")
        s = order.agg(F.sum(F.when(over, F.col("limit")).otherwise(0)).alias("held"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(over).alias("above")).first()
        if s["above"] == above or not s["weight"]:
            break
        above, level = s["above"], (total - s["held"]) / s["weight"]
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level))
    return order.select("source", "source_size", "nth", target.alias("target")), min(total, order.agg(F.sum(target)).first()[0] or 0.0)


def quotas(sources: DataFrame, total: float, shards: int, block: int) -> DataFrame:
    """``sources`` with ``upto``: for each shard, how many blocks the source gives to it and those before."""
    n, m = round(total / block), sources.count()
    if not n:
        return sources.withColumn("upto", F.array_repeat(F.lit(0).cast("long"), shards))
    seats = [k * n // shards for k in range(1, shards + 1)]
    quota = lambda seat, by: F.floor(F.col("target") / F.lit(total / by) + 0.5)
    bounds = F.array(*(
        F.struct(
            F.lit(k).alias("shard"), F.lit(seat).cast("long").alias("seats"),
            # One less and one more than the divisors say: rounding can't hide a block.
            (F.greatest(quota(seat, seat - m / 2) - 1, F.lit(0)) if 2 * seat > m else F.lit(0)).cast("long").alias("sure"),
            F.when(F.col("target") > 0, quota(seat, seat + m / 2) + 1).otherwise(0).cast("long").alias("most"),
        )
        for k, seat in enumerate(seats)
    ))
    bounded = written(sources.select("nth", "target", F.explode(bounds).alias("b")).select("nth", "target", "b.*"), "mix-bounds")
    left = bounded.groupBy("shard").agg((F.first("seats") - F.sum("sure")).alias("left"))
    some = bounded.filter("most > sure").select("shard", "nth", F.explode(F.sequence("sure", F.col("most") - 1)).alias("k"), "target")
    some = some.withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    placed = ranked(some.withColumn("less", -F.col("quotient")), ["shard", "less", "nth", "k"], "mix-quotients")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first")).join(left, "shard")  # a row for each shard
    won = placed.join(F.broadcast(first), "shard").filter("rank - first < left").groupBy("nth", "shard").agg(F.count("*").alias("won"))
    each = bounded.join(won, ["nth", "shard"], "left").select("nth", "shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("q"))
    upto = each.groupBy("nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "q"))), lambda x: x["q"]).alias("upto"))  # one for each shard
    return written(sources.join(upto, "nth"), "mix-quotas")


def lined_up(rows: DataFrame) -> DataFrame:
    """``rows`` (source, place, doc_id, size, rid) with chunk, before (words before it in its chunk); and the chunks with theirs."""
    order = ["source", "place", "doc_id", "size", "rid"]
    placed = ranked(rows, order, "mix-lines").withColumn("chunk", F.expr(f"rank div {CHUNK}"))
    within = Window.partitionBy("source", "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, shards: int = 8, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and parts of every row.

    ``parts`` says what each shard takes of the document: (shard, first word, words), in the
    order of the line, so a document that is taken twice has two parts or more.
    """
    if shards < 1 or block < 1 or most < 1 or share < 0 or min(weights) < 1:
        raise ValueError("shards, block, most and weights must be positive, share not negative")
    doc_id = F.col("doc_id").cast("long")
    # A letter before each name keeps null apart from all names.
    few = docs.select(
        doc_id.alias("doc_id"), F.col("source").cast("string").alias("name"), F.size(words(F.coalesce(F.col("text").cast("string"), F.lit("")))).cast("long").alias("size"),
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 16).alias("place"), F.monotonically_increasing_id().alias("rid"),
    )
    few = written(few.withColumn("source", F.coalesce(F.concat(F.lit("s"), "name"), F.lit(""))).drop("name"), "mix-rows")
    sizes = few.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = F.when(F.col("source") != "", F.col("source"))
    shares, total = targets(sizes.withColumn("source", named), weights, share, most)
    each = quotas(shares, total, shards, block).withColumn("source", F.coalesce("source", F.lit("")))
    lines = written(lined_up(few), "mix-places")
    own = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = lines.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    chunks = chunks.withColumn("chunk_before", F.coalesce(F.sum("n").over(own), F.lit(0))).drop("n").join(each, "source")
    rows = lines.join(chunks, ["source", "chunk"]).withColumn("at", F.col("chunk_before") + F.col("before"))

    def cut(turn: int):
        begin = F.col("at") + turn * F.col("source_size")

        def part(upto, k):
            low = F.greatest(begin, F.when(k > 0, F.get("upto", k - 1)).otherwise(0) * block)
            high = F.least(begin + F.col("size"), upto * block)
            return F.struct(k.alias("shard"), (low - begin).alias("first"), F.greatest(high - low, F.lit(0)).alias("words"))

        return F.filter(F.transform("upto", part), lambda p: p["words"] > 0)

    rows = rows.withColumn("parts", F.concat(*(cut(turn) for turn in range(most))))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "parts")
