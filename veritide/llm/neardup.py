"""Near-duplicate components by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles (64-bit hashes of the words,
A-Z lower-cased). Rows get numbers of their own in a written table; rows of equal sets
form one class, named by its smallest row number, so copies cost one row each.

1. Groups of four minima make a class's band keys, as many as it takes for two sets just
   at the threshold to share a band but for four pairs in ten million: 20 keys of 80
   minima at 85 percent, 28 of 112 at 80. Of each minimum four bits are kept, packed
   into longs. They give a pair's similarity, corrected for the 1/16 of chance matches;
   pairs more than five standard errors below the threshold go, as do pairs whose set
   sizes alone rule a link out.
2. Buckets of at most ``SMALL`` classes give all their pairs that bit counts allow, so a
   class meets a bounded number of others there. In larger buckets each class meets
   ``DRAWN`` classes drawn from each of its buckets, is compared with the ``COMPARED`` of
   them that it shares most buckets with, and paired with the two that match best. So a
   large group becomes one component, or nearly one, by a number of pairs that grows with
   its size and not with its square.
3. Pairs wait in a queue. In the first round a class's best pair is confirmed on full
   sets, labels are passed on, and pairs whose ends are known to be connected by then
   leave the queue unread. In the second round the others are confirmed.
4. What is still outside the largest component of a large bucket must be compared with
   all of its bucket, or a link could be lost. That is done in blocks: some of the
   outsiders at a time, copied to parts of the bucket that hold ``PART`` classes each,
   with finer signatures and a bound on the sets' difference as parts of the join's
   condition; components are made anew after each turn. Buckets where that would take more than ``SPLIT_ABOVE`` comparisons are
   first split by bands of many more minima, which texts that share a passage only don't
   meet in. Only groups of texts that are all similar but nowhere by enough are compared
   pair by pair.
5. Links make components by flooding labels two steps and contracting, in a new order
   each turn, until no edge is left.

Defined results: null, empty and blank texts have empty sets, link with nothing and
are their own components; fewer than five words are one shingle; rows with one id that
repeats are judged by their texts, and the component's id is the smallest id in it;
rows without an id link like others and have no say in the component's id, which is
null if no row in it has one; texts may be of any length; other columns are left out,
whatever their names; an empty table gives none. ``keep_one`` keeps exactly one row of
each component: the one with the smallest id, or any one where none has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.scratch import counted, written

SHINGLE, ROWS, BITS = 5, 4, 4
#: The default threshold: shingles shared, in percent of the shingles of either.
PERCENT = 85
#: A finer signature for classes in open buckets: two bits of 1024 minima.
FINE_HASHES, FINE_BITS = 1024, 2
#: And so many bits that tell by how much two sets differ.
ODD_BITS = 2048
#: Odds that a pair just at the threshold shares no band, or has fewer matches than the coarse or the fine filter asks for.
BAND_ODDS, MATCH_ODDS, FINE_ODDS = 4e-7, 2.5e-6, 1e-6
WORDS_KEPT = 200_000
#: Buckets of at most so many classes give all their pairs.
SMALL = 64
#: Classes drawn from each larger bucket, which all its members meet.
DRAWN = 4
#: Of the classes it meets there, a class is compared with so many: those it shares most buckets with.
COMPARED = 8
#: Outsiders of a bucket that are compared with all of it at first; then eight times as many.
MEMBERS_FIRST = 1_024
#: Classes of a bucket in one part of a comparison in blocks.
PART = 2_048
#: Buckets that would take more comparisons are split by finer bands.
SPLIT_ABOVE = 20_000_000
SHINGLES_AT_ONCE = 400_000
#: A table of a few numbers a row may be broadcast up to this count (under 40 MB); beyond it, it is joined by a shuffle.
IDS_BROADCAST = 500_000
#: Two tables of a few numbers a row are joined and grouped in one task up to this count (a few MB), as adaptive plans would do after an exchange.
SHORT = 200_000
SETS_KEPT = 64

_seeds = np.random.default_rng(20_240_502)
MULTIPLIERS = _seeds.integers(1, 1 << 63, FINE_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WEIGHTS = _seeds.integers(1, 1 << 63, FINE_HASHES // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALTS = _seeds.integers(1, 1 << 63, FINE_HASHES, dtype=np.uint64)


def least_matches(percent: int, hashes: int, bits: int, odds: float) -> int:
    """As many matches as a pair at this similarity falls below with these odds at most, chance matches counted."""
    p = percent / 100 + (1 - percent / 100) * 0.5**bits
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if below > odds:
            return k
    return hashes


@dataclass(frozen=True)
class Threshold:
    """What a similarity in percent asks for: bands, minima and matches."""

    percent: int

    def __post_init__(self):
        if not 0 < self.percent <= 100 or self.hashes > FINE_HASHES:
            raise ValueError(f"no bands for a similarity of {self.percent} percent")

    @cached_property
    def bands(self) -> int:
        """A multiple of four, so that the bits fill whole longs."""
        apart = 1 - (self.percent / 100) ** ROWS
        return 4 * math.ceil(math.log(BAND_ODDS) / math.log(apart) / 4) if apart else 4

    @property
    def hashes(self) -> int:
        return self.bands * ROWS

    @cached_property
    def least(self) -> int:
        return least_matches(self.percent, self.hashes, BITS, MATCH_ODDS)

    @cached_property
    def fine_least(self) -> int:
        return least_matches(self.percent, FINE_HASHES, FINE_BITS, FINE_ODDS)

    @cached_property
    def fine_rows(self) -> int:
        """As many minima to a finer band as the odds of sharing none allow."""
        missed = lambda rows: (1 - (self.percent / 100) ** rows) ** (FINE_HASHES // rows)
        return max((rows for rows in range(1, FINE_HASHES // 4) if missed(rows) <= BAND_ODDS), default=1)


HASHES, LEAST_MATCHES = Threshold(PERCENT).hashes, Threshold(PERCENT).least


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits (the public splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if len(_words) > WORDS_KEPT:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * WEIGHTS[k]
    return np.unique(mixed(out))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """A row of minima for each of some sets, none of them empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out, scaled = np.empty((len(sets), hashes), np.uint64), np.empty_like(joined)
    for k in range(hashes):
        np.multiply(joined, MULTIPLIERS[k], out=scaled)
        out[:, k] = np.minimum.reduceat(scaled, starts)
    return out


def band_keys(m: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each group of so many minima; what is left over is in no band."""
    m = m[:, : m.shape[1] // rows * rows]
    weighted = (m.reshape(len(m), -1, rows) * WEIGHTS[:rows]).sum(axis=2, dtype=np.uint64)
    return mixed(weighted + BAND_SALTS[: weighted.shape[1]]).view(np.int64)


def packed_bits(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of mixed minima, as many to a long as fit."""
    each = 64 // bits
    low = (mixed(m) & np.uint64((1 << bits) - 1)).reshape(len(m), -1, each)
    return (low << (np.arange(each, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64).view(np.int64)


SIGNATURE_SCHEMA = "rid long, doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, row): the rows in a table of their own, each with a number that stays."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "near-rows")


def signatures(rows: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Set size, digest, band keys and packed low bits of the minima, for each row."""

    def chunk(numbers: list, ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        bits: list = [None] * len(sets)
        if full:
            m = minima([sets[i] for i in full], hashes)
            for i, x, y in zip(full, band_keys(m), packed_bits(m)):
                bands[i], bits[i] = x, y
        longs = pa.list_(pa.int64())
        columns = [pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(bands, longs), pa.array(bits, longs)]
        return pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n_shingles", "digest", "bands", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ids, sets, size = [], [], [], 0
            for rid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(text.as_py())
                numbers.append(rid)
                ids.append(doc_id)
                sets.append(s)
                size += len(s)
                if size >= SHINGLES_AT_ONCE:
                    yield chunk(numbers, ids, sets)
                    numbers, ids, sets, size = [], [], [], 0
            yield chunk(numbers, ids, sets)
        _words.clear()  # workers are kept, and later steps need their memory

    return rows.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")).mapInArrow(run, SIGNATURE_SCHEMA)


def matches(a: str, b: str, hashes: int, bits: int = BITS) -> Column:
    """How many of the packed minima agree in all their bits."""
    lowest = sum(1 << k for k in range(0, 63, bits))

    def differing(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = reduce(Column.bitwiseOR, [F.shiftrightunsigned(x, s) for s in range(1, bits)], x)
        return F.bit_count(any_bit.bitwiseAND(F.lit(lowest)))

    return F.lit(hashes) - reduce(Column.__add__, [differing(k) for k in range(hashes * bits // 64)])


def odd_bits(s: np.ndarray) -> list[int]:
    """For each of ``ODD_BITS`` places whether an odd number of the set's hashes falls there."""
    place = (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ODD_BITS.bit_length() + 1)
    odd = np.bincount(place.astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def differ_little(a: str, b: str, n_a: str, n_b: str, percent: int) -> Column:
    """Whether two sets might differ by as few members as a link allows.

    Each member that is in one set only changes one of the bits, so as many bits differ as
    members at most: nothing is lost.
    """
    bits = reduce(Column.__add__, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(ODD_BITS // 64)])
    return (100 + percent) * bits <= (100 - percent) * (F.col(n_a) + F.col(n_b))


def sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


@dataclass(frozen=True)
class Table:
    """A written table and its number of rows."""

    frame: DataFrame
    rows: int

    @property
    def light(self) -> DataFrame:
        """To be broadcast if it is short."""
        return F.broadcast(self.frame) if self.rows <= IDS_BROADCAST else self.frame

    def beside(self, most: int | None) -> DataFrame:
        """To be joined with so many rows at most (None: unknown): where both are short, by a merge in one task.

        That takes neither an exchange nor a broadcast, both of which cost the driver memory for each round.
        """
        return self.frame.hint("merge") if short(most) and short(self.rows) else self.light


def short(most: int | None) -> bool:
    return most is not None and most <= SHORT


def together(df: DataFrame, most: int | None) -> DataFrame:
    """So many rows at most (None: unknown), in one partition if they are few."""
    return df.coalesce(1) if short(most) else df


def stored(df: DataFrame, tag: str) -> Table:
    frame, rows = counted(df, f"near-{tag}")
    return Table(together(frame, rows), rows)


def of_classes(pairs: Table, classes: DataFrame, at: Threshold) -> DataFrame:
    """(a, b, m): pairs of class ids that bit counts and set sizes allow, with their matches."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = side("b").join(pairs.light, "b").join(side("a"), "a").withColumn("m", matches("bits_a", "bits_b", at.hashes))
    return both.filter(sizes_fit("n_a", "n_b", at.percent) & (F.col("m") >= at.least)).select("a", "b", "m")


def texts_of(ids: DataFrame, most: int, texts: DataFrame) -> DataFrame:
    """(id, text) of at most so many classes; ids may repeat."""
    return texts.join(F.broadcast(ids) if most <= IDS_BROADCAST else ids, "id", "left_semi")


def fine_signatures(texts: DataFrame, at: Threshold) -> DataFrame:
    """(id, fine, fine_bands, odd): packed bits and band keys of many more minima, and odd bits, for classes in open buckets."""
    band_rows = at.fine_rows

    def chunk(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        m = minima(sets, FINE_HASHES) if sets else np.zeros((0, FINE_HASHES), np.uint64)
        fine, bands = (packed_bits(m, FINE_BITS), band_keys(m, band_rows)) if sets else ((), ())
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(fine), longs), pa.array(list(bands), longs), pa.array(list(map(odd_bits, sets)), longs)], ["id", "fine", "fine_bands", "odd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py())
                ids.append(i)
                sets.append(s)
                size += len(s)
                if size >= SHINGLES_AT_ONCE:
                    yield chunk(ids, sets)
                    ids, sets, size = [], [], 0
            yield chunk(ids, sets)
        _words.clear()  # workers are kept, and later steps need their memory

    return texts.select("id", "text").mapInArrow(run, "id long, fine array<long>, fine_bands array<long>, odd array<long>")


def confirmed(pairs: Table, all_texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are linked."""
    ends = pairs.frame.select(F.col("a").alias("id")).unionByName(pairs.frame.select(F.col("b").alias("id")))
    texts = texts_of(ends, 2 * pairs.rows, all_texts)
    with_a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(pairs.light, "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def set_of(number: int, text: pa.Scalar) -> np.ndarray:
            if number not in sets:
                if len(sets) >= SETS_KEPT:
                    sets.clear()
                sets[number] = shingle_set(text.as_py())
            return sets[number]

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))
            found = [(a, b) for a, b, x, y in rows if linked(set_of(a, x), set_of(b, y), percent)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], ["a", "b"])
        _words.clear()

    return both.mapInArrow(run, "a long, b long")


def flooded(edges: DataFrame, turn: int, most: int | None = None) -> DataFrame:
    """(id, label) of every node with an edge: the first node within two steps, in an order drawn anew each turn; ``most``: of the edges."""
    both = together(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), most)
    placed = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("place"), F.col(c).alias("id"))
    one = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min(placed("b")), F.first(placed("a"))).alias("label")), "step")
    near = both.join(one.beside(most).select(F.col("id").alias("b"), F.col("label").alias("near")), "b").select(F.col("a").alias("id"), F.col("near").alias("label"))
    return together(one.frame.unionByName(near), most).groupBy("id").agg(F.min("label")["id"].alias("label"))


def labelled(pairs: DataFrame, labels: Table, most: int | None = None) -> DataFrame:
    """``pairs`` with the labels x and y of their ends; a class without a label is its own."""
    of = lambda c: labels.beside(most).select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.withColumns({"x": F.coalesce("a_label", "a"), "y": F.coalesce("b_label", "b")})


def contracted(edges: DataFrame, labels: Table, most: int | None = None) -> DataFrame:
    """The edges between labels."""
    return labelled(edges, labels, most).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def first_shared(band: str, keys_a: str, keys_b: str) -> Column:
    """Whether ``band`` is the first key that both lists have at one place, so that a pair counts once."""
    shared = F.zip_with(keys_a, keys_b, lambda x, y: x == y)
    return F.get(keys_a, (F.array_position(shared, True) - 1).cast("int")) == F.col(band)


def bucketed(keys: DataFrame) -> DataFrame:
    """``keys`` (band, id, ...) of buckets with two classes or more, with the bucket's size."""
    sizes = stored(keys.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    return keys.join(sizes.light, "band")


def sides(rows: DataFrame, names: list[str]) -> list[DataFrame]:
    return [rows.select(*(F.col(c).alias(f"{c}_{side}") for c in names)) for side in "ab"]


def small_pairs(small: Table, classes: DataFrame, at: Threshold) -> DataFrame:
    """(a, b, m): all pairs within small buckets that bit counts and sizes allow."""
    rows = classes.select("id", "n", "bits", "bands").join(small.light, "id")
    left, right = sides(rows, ["band", "id", "n", "bits", "bands"])
    m = matches("bits_a", "bits_b", at.hashes)
    fits = (F.col("id_a") < F.col("id_b")) & sizes_fit("n_a", "n_b", at.percent) & (m >= at.least) & first_shared("band_a", "bands_a", "bands_b")
    return left.join(right, (F.col("band_a") == F.col("band_b")) & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), m.alias("m"))


def drawn_pairs(large: DataFrame, classes: DataFrame, at: Threshold) -> DataFrame:
    """(a, b, m): each class of large buckets with the best two of those drawn from its buckets."""
    draws = [F.min(F.struct(F.xxhash64(F.lit(k), "band", "id").alias("place"), "id"))["id"] for k in range(DRAWN)]
    drawn = stored(large.groupBy("band").agg(F.array_distinct(F.array(*draws)).alias("drawn")).select("band", F.explode("drawn").alias("b")), "drawn")
    met = large.join(drawn.light, "band").filter("id <> b").groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("shared"))
    most = Window.partitionBy("a").orderBy(F.desc("shared"), F.xxhash64("a", "b"), "b")
    met = stored(met.withColumn("k", F.row_number().over(most)).filter(F.col("k") <= COMPARED).select("a", "b"), "drawn-pairs")
    best = Window.partitionBy("a").orderBy(F.desc("m"), "b")
    top = of_classes(met, classes, at).withColumn("k", F.row_number().over(best)).filter("k <= 2")
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "m")


def open_rows(members: DataFrame, labels: Table | None, most: int | None = None) -> Table:
    """Members of buckets that hold several components: also component, the largest one, and the number outside it; ``most``: of the members."""
    named = members.withColumn("component", F.col("id")) if labels is None else members.join(labels.beside(most), "id", "left").withColumn("component", F.coalesce("label", "id")).drop("label")
    counts = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    several = counts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("k")).filter("k > 1")
    several = stored(several.select("band", F.col("top.component").alias("main"), (F.col("all") - F.col("top.n")).alias("outside")), "several")
    return stored(named.join(several.beside(most), "band"), "open") if several.rows else several


def block_pairs(rows: DataFrame, chosen: DataFrame, at: Threshold) -> DataFrame:
    """(a, b, m): chosen outsiders against all of their buckets, as far as finer signatures and sizes allow.

    A bucket is dealt to parts, and the chosen ones go to each of them.
    """
    parts = F.expr(f"(size + {PART - 1}) div {PART}")
    names = ["band", "part", "id", "component", "n", "odd", "fine", "keys"]
    left, _ = sides(chosen.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), names)
    _, right = sides(rows.withColumn("part", F.pmod(F.xxhash64("id"), parts)), names)
    m = matches("fine_a", "fine_b", FINE_HASHES, FINE_BITS)
    little = differ_little("odd_a", "odd_b", "n_a", "n_b", at.percent)
    fits = (F.col("component_a") != F.col("component_b")) & sizes_fit("n_a", "n_b", at.percent) & little & (m >= at.fine_least) & first_shared("band_a", "keys_a", "keys_b")
    found = left.join(right, (F.col("band_a") == F.col("band_b")) & (F.col("part_a") == F.col("part_b")) & fits)
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), m.alias("m")).distinct()


class Links:
    """What is known to be connected: labels of classes, and edges between labels that aren't one yet."""

    def __init__(self, texts: DataFrame, percent: int):
        self.texts, self.percent, self.turn = texts, percent, 0
        self.labels: Table | None = None
        self.rest: Table | None = None

    def read(self, pairs: Table) -> None:
        """Confirm these pairs and pass labels on by two steps."""
        found = stored(confirmed(pairs, self.texts, self.percent), "links")
        if found.rows:
            edges = found.frame if self.labels is None else contracted(found.frame, self.labels, found.rows)
            if self.rest is None:
                self.flood(edges, found.rows)
            else:
                self.flood(self.rest.frame.unionByName(edges), self.rest.rows + found.rows)

    def flood(self, edges: DataFrame, most: int) -> None:
        """What is within two steps gets one label and becomes one node.

        The order of nodes is drawn anew each time, so each turn leaves a fraction of the
        edges between labels on any graph, long chains included.
        """
        self.turn += 1
        edges = together(edges, most)
        found = stored(flooded(edges, self.turn, most), "flood")
        if self.labels is None:
            self.labels = found
        else:
            of = found.beside(self.labels.rows).select(F.col("id").alias("label"), F.col("label").alias("new"))
            known = self.labels.frame.join(of, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
            self.labels = stored(known.unionByName(found.frame.join(self.labels.beside(found.rows).select("id"), "id", "left_anti")), "labels")
        self.rest = stored(contracted(edges, found, most), "rest")

    def join_up(self) -> None:
        """Flood until each component has one label."""
        while self.rest is not None and self.rest.rows:
            self.flood(self.rest.frame, self.rest.rows)

    def settle(self, pairs: DataFrame) -> None:
        """Read each class's best pair first, then what is still open."""
        queue = stored(pairs, "queue")
        if queue.rows:
            both = queue.frame.select(F.col("a").alias("id"), "a", "b", "m").unionByName(queue.frame.select(F.col("b").alias("id"), "a", "b", "m"))
            best = stored(together(both, queue.rows).groupBy("id").agg(F.max(F.struct("m", "a", "b")).alias("best")).select("best.a", "best.b").distinct(), "best")
            self.read(best)
            rest = queue.frame.select("a", "b").join(best.beside(queue.rows), ["a", "b"], "left_anti")
            rest = stored(rest if self.labels is None else labelled(rest, self.labels, queue.rows).filter("x <> y").select("a", "b"), "queue")
            if rest.rows:
                self.read(rest)
        self.join_up()


def compare_blocks(opened: Table, classes: DataFrame, links: Links, at: Threshold) -> None:
    """Compare what is outside the largest component of each bucket with all of the bucket."""
    ids = stored(opened.frame.select("id").distinct(), "ids")
    fine = written(fine_signatures(texts_of(ids.frame, ids.rows, links.texts), at), "near-fine")
    wide = (F.col("outside") * F.col("size")) > SPLIT_ABOVE
    narrow, split = stored(opened.frame.filter(~wide).select("band", "id", "size"), "narrow"), stored(opened.frame.filter(wide).select("id").distinct(), "wide")
    rows = classes.select("id", F.col("bands").alias("keys")).join(narrow.light, "id")
    if split.rows:
        keys = split.light.join(fine.select("id", F.col("fine_bands").alias("keys")), "id")
        rows = rows.unionByName(bucketed(keys.select("id", F.explode("keys").alias("band"))).join(keys, "id").select(rows.columns))
    few = rows.select("band", "id", "size", "keys")
    rows = written(few.join(classes.select("id", "n").join(fine.select("id", "fine", "odd"), "id"), "id"), "near-blocks")
    # Without a split the open rows are known already.
    now = open_rows(rows.select("band", "id", "size"), links.labels) if split.rows else opened
    most, turn = MEMBERS_FIRST, 0
    while now.rows:
        # The largest component of a bucket has outsiders to meet, so these are never the whole bucket.
        some = (F.col("component") != F.col("main")) & (F.pmod(F.xxhash64(F.lit(turn), "id"), F.col("outside")) < most)
        chosen = stored(now.frame.filter(some).select("band", "id"), "chosen")
        current = rows.drop("size").join(now.light, ["band", "id"])
        links.settle(block_pairs(current, current.join(chosen.light, ["band", "id"]), at))
        # Who has met all of a bucket has done with it.
        left = now.frame.select("band", "id", "size").join(chosen.beside(now.rows), ["band", "id"], "left_anti")
        now, most, turn = open_rows(left, links.labels, now.rows), most * 8, turn + 1


def classed(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and per class digest its component's smallest id and first row."""
    at = Threshold(percent)
    signed = written(signatures(rows, at.hashes), "near-signatures")
    lo = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("lo")
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("rid").alias("id"), lo, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = written(classes, "near-classes")
    members = written(bucketed(classes.select("id", F.explode("bands").alias("band"))), "near-members")
    met = stored(members.select("id").distinct(), "met")
    # Only classes that share a bucket are ever read again.
    texts = written(texts_of(met.frame, met.rows, rows.select(F.col("rid").alias("id"), F.col("row.text").cast("string").alias("text"))), "near-texts")
    small, large, links = stored(members.filter(F.col("size") <= SMALL).select("band", "id"), "small"), stored(members.filter(F.col("size") > SMALL), "large"), Links(texts, percent)
    queue = small_pairs(small, classes, at)
    if large.rows:
        queue = queue.unionByName(drawn_pairs(large.frame, classes, at)).groupBy("a", "b").agg(F.max("m").alias("m"))
    links.settle(queue)
    if large.rows and (opened := open_rows(large.frame, links.labels, large.rows)).rows:
        compare_blocks(opened, classes, links, at)
    named = classes.select("digest", "id", "lo")
    if links.labels is None:
        return signed, named.select("digest", F.col("lo").alias("least"))
    named = named.join(links.labels.light, "id", "left")
    alone = named.filter("label is null").select("digest", F.col("lo").alias("least"))
    several = named.filter("label is not null").select("digest", "label", "lo")
    least = stored(several.groupBy("label").agg(F.min("lo").alias("least")), "component")
    return signed, alone.unionByName(several.select("digest", "label").join(least.light, "label").select("digest", "least"))


def judged(rows: DataFrame, percent: int) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and first (the row that stands for its component) of every row."""
    signed, of_class = classed(rows, percent)
    # Both sides are written tables, so that adaptive plans can split the rows of one digest.
    out = signed.select("rid", "doc_id", "n_shingles", "digest").join(written(of_class, "near-least"), "digest", "left")
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select("rid", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("least.rid") == F.col("rid"), F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; texts link at this similarity or more."""
    rows = numbered(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return judged(rows, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns; rows without words all stay."""
    rows = numbered(docs)
    dropped = stored(judged(rows, percent).filter("not first").select("rid"), "dropped")
    return rows.join(dropped.light, "rid", "left_anti").select("row.*")
