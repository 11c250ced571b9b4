"""Hard negatives for pairs of an anchor and a positive, by dual-tree search.

1. A tree over the vectors' space is made from a bounded sample (``SAMPLE`` rows; it only
   shapes the tree): each node splits its sample at the median along its widest line. Every
   row goes down the tree to a leaf. A leaf is a ball: the mean of its sample, and the
   largest distance of any of its rows, anchors and candidates apart; balls of inner nodes
   enclose those of their children.
2. Pairs of an anchor node and a candidate node are looked at from the roots down. The
   centres' product and the radii bound all inner products of the pair from both sides. A
   pair is dropped, with all anchors below it, if its interval meets nothing that any of
   them still looks for. The tree has at most ``2 ** DEEPEST`` leaves, so this is a bounded
   number of balls; the surviving pairs of leaves say where Spark sends each anchor.
3. A leaf's rows lie in chunks of about ``CHUNK`` rows. A task gets a chunk and the anchors
   that were sent to it, makes both into small trees of its own, drops pairs of their nodes
   by the same intervals, and scores what is left exactly.
4. Each anchor is first compared with its own leaf. What it finds there bounds what it still
   looks for elsewhere: the positives search asks for scores of at least the last one kept,
   the negatives search for each positive asks for a band of scores, from the last one kept
   there (or the band's lower end) to the band's upper end.

A leaf may hold any share of the rows, and rows may be alike: chunks and groups of anchors
are cut by hashes of row numbers. Nothing is approximate: what is dropped can't be among
the results.

Components become ``floor(scale * x)``, and scores are integer inner products; shorter
vectors are taken as filled with zeros. Products below 2**53 are summed in doubles, exactly;
larger ones in Python's integers, and a score beyond 64 bits counts as the largest or
smallest one there is.

Defined results: rows with a null label, a null vector or a component that is null or not
finite take no part; a row without an id can be found, and comes after all others of its
score; rows with ids that repeat are rows each; a positive with a negative score has no
negatives; an empty table gives none; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.scratch import written

SAMPLE = 4096
SAMPLE_VALUES = 1 << 20  # of the sample, whatever the vectors' length
LEAF = 4096  # rows for which a leaf is made
DEEPEST = 10
CHUNK = 4096
TOGETHER = 8192  # anchors that meet a chunk in one task, about
AT_ONCE = 512
SMALL_A, SMALL_C = 16, 128  # rows of the smallest nodes within a task
NO_ID = (1 << 63) - 1
FARTHEST = NO_ID  # no bound: so large, or so small, may stand for any score beyond
POINT = "rid long, vec_id long, label long, anchor boolean, code int, away double, data binary"
FOUND = "arid long, slot int, vec_id long, score long, rid long"
PLACED = ["code", "chunk", "part", "kind"]


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's whole numbers, in four bytes if they fit."""
    small = np.abs(x).max(initial=0) < 1 << 31
    return [row.tobytes() for row in x.astype("<i4" if small else "<f8")]


def unpacked(data: pa.Array, dim: int) -> np.ndarray:
    rows = data.to_pylist()
    out = np.zeros((len(rows), dim))
    if dim and {len(r) for r in rows} == {4 * dim}:
        return np.frombuffer(b"".join(rows), "<i4").reshape(-1, dim).astype(float)
    for i, r in enumerate(rows if dim else []):
        out[i] = np.frombuffer(r, "<i4" if len(r) == 4 * dim else "<f8")
    return out


def longs(column: pa.Array, null: int = NO_ID) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)


@dataclass
class Tree:
    """Splits in heap order: node i has the children 2i + 1 and 2i + 2; leaves are numbered from left to right."""

    depth: int
    line: np.ndarray  # of each inner node
    split: np.ndarray
    centre: np.ndarray  # of each node

    def codes(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", x, self.line[node]) > self.split[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def balls(self, radius: dict[int, float]) -> np.ndarray:
        """A radius for each node, from those of the leaves that have rows; below 0: none has."""
        first, n = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        out = np.full(n, -1.0)
        for code, r in radius.items():
            out[first + code] = r
        for i in range(first - 1, -1, -1):
            for child in (2 * i + 1, 2 * i + 2):
                if out[child] >= 0:
                    out[i] = max(out[i], out[child] + np.linalg.norm(self.centre[i] - self.centre[child]))
        return out


def widest(x: np.ndarray) -> np.ndarray:
    """The line between two far points, found in two steps."""
    one = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    other = x[np.argmax(((x - one) ** 2).sum(axis=1))]
    line = other - one
    return line / (np.linalg.norm(line) or 1.0)


def tree_of(sample: np.ndarray, depth: int) -> Tree:
    inner, dim = 2**depth - 1, sample.shape[1]
    tree = Tree(depth, np.zeros((inner, dim)), np.zeros(inner), np.zeros((2 * inner + 1, dim)))
    own = {0: sample}
    for i in range(2 * inner + 1):
        x = own.pop(i)
        if len(x):
            tree.centre[i] = x.mean(axis=0)
        elif i:
            tree.centre[i] = tree.centre[(i - 1) // 2]
        if i < inner:
            if len(x):
                tree.line[i] = widest(x)
                tree.split[i] = np.median(x @ tree.line[i])
            right = x @ tree.line[i] > tree.split[i]
            own[2 * i + 1], own[2 * i + 2] = x[~right], x[right]
    return tree


def intervals(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between balls around ``a`` and ``b``, whose centres have this product."""
    reach = np.linalg.norm(a, axis=-1) * rb + np.linalg.norm(b, axis=-1) * ra + ra * rb
    reach += 1 + 1e-9 * (np.abs(product) + reach)
    return product - reach, product + reach


def bounds(low: int, high: int) -> tuple[float, float]:
    return (-np.inf if low <= -FARTHEST else float(low)), (np.inf if high >= FARTHEST else float(high))


def leaf_pairs(tree: Tree, anchors: dict[int, tuple[float, int, int]], rows: dict[int, float]) -> list[tuple[int, int]]:
    """Pairs of an anchor leaf (radius, least and largest score that is looked for) and another leaf that may hold such scores."""
    first, n = 2**tree.depth - 1, 2 ** (tree.depth + 1) - 1
    ra, rc = tree.balls({code: x[0] for code, x in anchors.items()}), tree.balls(rows)
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    for code, (_, least, most) in anchors.items():
        low[first + code], high[first + code] = bounds(least, most)
    for i in range(first - 1, -1, -1):
        low[i], high[i] = min(low[2 * i + 1], low[2 * i + 2]), max(high[2 * i + 1], high[2 * i + 2])
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(tree.depth + 1):
        if level:
            i, j = (2 * np.repeat(i, 4) + 1 + np.tile([0, 0, 1, 1], len(i))), (2 * np.repeat(j, 4) + 1 + np.tile([0, 1, 0, 1], len(j)))
        there = (ra[i] >= 0) & (rc[j] >= 0)
        i, j = i[there], j[there]
        a, b = tree.centre[i], tree.centre[j]
        least, most = intervals(a, ra[i], b, rc[j], np.einsum("ij,ij->i", a, b))
        alive = (most >= low[i]) & (least <= high[i])
        i, j = i[alive], j[alive]
    return [(int(x) - first, int(y) - first) for x, y in zip(i, j) if x != y]


def small_nodes(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and where its nodes begin: halves of halves along their widest lines."""
    done, open_nodes = [], [np.arange(len(x))]
    while open_nodes:
        rows = open_nodes.pop()
        if len(rows) <= size:
            done.append(rows)
        else:
            order = rows[np.argsort(x[rows] @ widest(x[rows]), kind="stable")]
            open_nodes += [order[len(rows) // 2 :], order[: len(rows) // 2]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)])


class Rows:
    """Rows of one side in a task, in the order of their small tree."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, anchors: bool):
        t = pa.Table.from_batches(batches).combine_chunks()
        x = unpacked(t["data"].combine_chunks(), dim)
        order, self.starts = small_nodes(x, SMALL_A if anchors else SMALL_C)
        self.x = x[order]
        self.rid, self.vec_id, self.label = (longs(t[c].combine_chunks())[order] for c in ("rid", "vec_id", "label"))
        self.slots = [t["slots"][i].as_py() for i in order.tolist()] if anchors else []
        self.centre = np.array([self.x[a:b].mean(axis=0) for a, b in zip(self.starts, self.starts[1:])])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.starts, self.starts[1:], self.centre)])
        self.largest = np.abs(self.x).max(initial=0)


def products(a: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (a @ c.T).astype(np.int64)
    whole = lambda x: np.vectorize(int, otypes=[object])(x)
    return np.clip(whole(a) @ whole(c).T, -FARTHEST, FARTHEST).astype(np.int64)


def best(a: Rows, c: Rows, k: int, same: bool) -> Iterator[tuple[int, int, int | None, int, int]]:
    """For each anchor and slot the first rows of a chunk."""
    exact = max(1, a.x.shape[1]) * a.largest * c.largest < 1 << 53
    low, high = np.array([bounds(min(s["low"] for s in own), max(s["high"] for s in own)) for own in a.slots]).T
    least, most = intervals(a.centre[:, None], a.radius[:, None], c.centre[None], c.radius[None], a.centre @ c.centre.T)
    need_low, need_high = np.minimum.reduceat(low, a.starts[:-1]), np.maximum.reduceat(high, a.starts[:-1])
    alive = (most >= need_low[:, None]) & (least <= need_high[:, None])
    for node, (begin, end) in enumerate(zip(a.starts, a.starts[1:])):
        if not alive[node].any():
            continue
        rows = np.flatnonzero(np.repeat(alive[node], np.diff(c.starts)))
        scores = products(a.x[begin:end], c.x[rows], exact)
        for i, own in zip(range(begin, end), scores):
            fits = (c.label[rows] == a.label[i]) & (c.rid[rows] != a.rid[i]) if same else c.label[rows] != a.label[i]
            for s in a.slots[i]:
                at = np.flatnonzero(fits & (own >= s["low"]) & (own <= s["high"]))
                if len(at) > k:
                    at = at[own[at] >= np.partition(own[at], -k)[-k]]
                for x in at[np.lexsort((c.vec_id[rows[at]], -own[at]))][:k]:
                    row = rows[x]
                    yield int(a.rid[i]), s["slot"], None if c.vec_id[row] == NO_ID else int(c.vec_id[row]), int(own[x]), int(c.rid[row])


def segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in PLACED], axis=1)
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
    for begin, end in zip(cuts, cuts[1:]):
        if begin < end:
            yield tuple(keys[begin].tolist()), batch.slice(begin, end - begin)


class Search:
    """The rows in leaves and chunks, and the two searches over them."""

    def __init__(self, vectors: DataFrame, scale: float, sample: int):
        spark = vectors.sparkSession
        good = "label is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
        rows = vectors.select(
            F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
            F.col("vector").cast("array<double>").alias("vector"), F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor"),
        ).filter(good)
        rows = written(rows, "negatives-rows")
        seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"), F.count_if("anchor").alias("anchors")).first()
        self.n, self.dim, self.anchors = seen["n"], seen["dim"], seen["anchors"]
        if not self.n:
            self.points = spark.createDataFrame([], POINT)
            return
        dim, few = self.dim, min(sample, max(1, SAMPLE_VALUES // max(1, seen["dim"])))
        drawn = rows.select("rid", "vector").orderBy(F.xxhash64("rid"), "rid").limit(few).collect()

        def whole(vectors: list[list[float]]) -> np.ndarray:
            x = np.zeros((len(vectors), dim))
            for i, v in enumerate(vectors):
                x[i, : len(v)] = v
            return np.floor(scale * x)

        depth = min(DEEPEST, max(0, (self.n // LEAF).bit_length()), max(0, len(drawn).bit_length() - 2))
        self.tree = tree = tree_of(whole([r["vector"] for r in drawn]), depth)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = 2**tree.depth - 1
            for batch in batches:
                x = whole(batch.column(3).to_pylist())
                code = tree.codes(x)
                away = np.sqrt(((x - tree.centre[first + code]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(code, pa.int32()), pa.array(away), pa.array(packed(x), pa.binary())], [c.split()[0] for c in POINT.split(", ")])

        self.points = written(rows.mapInArrow(place, POINT), "negatives-points")
        # A row for each leaf, at most 2 ** DEEPEST.
        leaves = self.points.groupBy("code").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max(F.when(F.col("anchor"), F.col("away"))).alias("anchor_away")).collect()
        self.away = {r["code"]: r["away"] for r in leaves}
        self.anchor_away = {r["code"]: r["anchor_away"] for r in leaves if r["anchor_away"] is not None}
        chunks = {r["code"]: -(-r["n"] // CHUNK) for r in leaves}
        self.chunks = F.array(*(F.lit(chunks.get(code, 0)) for code in range(2**depth)))
        self.parts = 1 + self.anchors // TOGETHER

    def scored(self, sent: DataFrame, k: int, same: bool) -> DataFrame:
        """``sent``: anchors (rid, label, data, slots) with the leaf (code) they go to. Every chunk's first rows for each slot."""
        dim = self.dim
        hashed = F.xxhash64("rid")
        chunks = lambda: F.get(self.chunks, F.col("code"))
        part = F.pmod(hashed, F.lit(self.parts))
        go = sent.withColumns({"part": part, "chunk": F.explode(F.sequence(F.lit(0), chunks() - 1))})
        go = go.select("code", "chunk", "part", F.lit(1).alias("kind"), "rid", F.lit(None).cast("long").alias("vec_id"), "label", "data", "slots")
        met = sent.select("code", part.alias("part")).distinct()  # leaves and parts that some anchor goes to
        stay = self.points.select("code", F.pmod(F.xxhash64("rid", F.lit(1)), chunks()).cast("int").alias("chunk"), F.lit(0).alias("kind"), "rid", "vec_id", "label", "data")
        stay = stay.join(met, "code").select("code", "chunk", "part", "kind", "rid", "vec_id", "label", "data", F.lit(None).cast("array<struct<slot:int,low:bigint,high:bigint>>").alias("slots"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, rows, anchors, chunk = None, [], [], None

            def results() -> Iterator[pa.RecordBatch]:
                found = list(zip(*best(Rows(anchors, dim, True), chunk, k, same))) or [()] * 5
                anchors.clear()
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], [c.split()[0] for c in FOUND.split(", ")])

            for batch in batches:
                for (*place, kind), some in segments(batch):
                    if place != key:
                        if anchors:
                            yield from results()
                        key, rows, chunk = place, [], None
                    if not kind:
                        rows.append(some)
                        continue
                    if chunk is None:
                        chunk, rows = Rows(rows, dim, False), []
                    anchors.append(some)
                    if sum(map(len, anchors)) >= AT_ONCE:
                        yield from results()
            if anchors:
                yield from results()

        both = go.unionByName(stay).repartition("code", "chunk", "part").sortWithinPartitions(*PLACED, "rid")
        return both.mapInArrow(run, FOUND)

    def first(self, found: DataFrame, k: int) -> DataFrame:
        """The first k rows of each anchor and slot, with their rank."""
        order = Window.partitionBy("arid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def of(self, anchors: DataFrame, k: int, same: bool, tag: str) -> DataFrame:
        """For each slot (slot, low, high) of each anchor (rid, label, code, data, slots) the first k rows between its bounds."""
        near = written(self.first(self.scored(anchors, k, same), k), f"negatives-{tag}-near")
        kth = near.filter(F.col("rank") == k).select(F.col("arid").alias("rid"), "slot", "score")
        flat = anchors.select("rid", "code", F.explode("slots").alias("s")).select("rid", "code", "s.*").join(kth, ["rid", "slot"], "left")
        flat = flat.withColumn("low", F.greatest("low", "score"))
        still = written(flat.select("rid", "code", "slot", "low", "high"), f"negatives-{tag}-bounds")
        asked = {r["code"]: (self.anchor_away[r["code"]], r["low"], r["high"]) for r in still.groupBy("code").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        pairs = leaf_pairs(self.tree, asked, self.away)
        if not pairs:
            return near
        go_to: dict[int, list[int]] = {}
        for a, c in pairs:
            go_to.setdefault(a, []).append(c)
        # A row for each leaf that anchors are in, with the leaves they go to.
        to = anchors.sparkSession.createDataFrame(list(go_to.items()), "code int, to array<int>")
        slots = still.groupBy("rid").agg(F.collect_list(F.struct("slot", "low", "high")).alias("slots"))
        sent = anchors.drop("slots").join(slots, "rid").join(F.broadcast(to), "code").drop("code").withColumn("code", F.explode("to")).drop("to")
        far = self.scored(sent, k, same)
        return written(self.first(near.drop("rank").unionByName(far), k), f"negatives-{tag}")


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, label (a whole number), vector and anchor (whether the row is one).
    Negatives of a positive are rows of other labels whose score is ``low`` to ``high`` percent
    of the positive's.
    """
    if not (0 < low <= high and positives > 0 and negatives > 0):
        raise ValueError("percentages and numbers must be positive, low at most high")
    search = Search(vectors, scale, sample)
    out = ("anchor_id long", "positive_id long", "rank int", "negative_id long", "positive_score long", "negative_score long")
    if not search.n or not search.anchors:
        return vectors.sparkSession.createDataFrame([], ", ".join(out))
    anchors = search.points.filter("anchor").select("rid", "vec_id", "label", "code", "data")
    everything = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-FARTHEST).cast("long").alias("low"), F.lit(FARTHEST).cast("long").alias("high")))
    found = search.of(anchors.drop("vec_id").withColumn("slots", everything), positives, True, "positives")
    percent = lambda p, up: F.expr(f"(cast(score as decimal(20, 0)) * {p} + {up}) div 100")
    bands = found.filter("score >= 0").select(F.col("arid").alias("rid"), F.struct(F.col("rank").alias("slot"), percent(low, 99).alias("low"), percent(high, 0).alias("high")).alias("s"))
    slots = bands.groupBy("rid").agg(F.collect_list("s").alias("slots"))  # at most one for each positive
    banded = written(anchors.drop("vec_id").join(slots, "rid"), "negatives-bands")
    worse = search.of(banded, negatives, False, "negatives")
    pairs = found.select("arid", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    rows = worse.select("arid", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["arid", "slot"])
    rows = rows.join(anchors.select(F.col("rid").alias("arid"), F.col("vec_id").alias("anchor_id")), "arid")
    return rows.select(*(c.split()[0] for c in out))


def contract_rows(embeddings: DataFrame) -> DataFrame:
    """The query's input: labels of every seventh id moved on by one, every fiftieth id an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor"))
