"""Periodic runs of words: stretches that repeat a block of words three times or more.

Each text is searched by itself. Its words get numbers, and the numbers are held as bit
planes, one big integer for each bit with a bit for each word. For a lag the planes are
shifted by it and XORed with themselves; the OR of these has a zero wherever a word
equals the word a lag later. ANDs of the zeros with themselves, shifted by twice the
distance each time, leave the starts of zero stretches that are long enough. Numbers are
scattered over their bits, so four planes nearly always tell that a lag has no run, and
the others are not looked at.

Lags up to ``DIRECT`` are all tried. A longer lag is tried only if some window of words
has its next equal window at that distance. Nothing is lost by that: a run of period q
holds at least 2q successive words that equal the word q later, so it holds a window of
any length up to 2q and its copy q later; a copy nearer than q would, with a window of q
words or more, give the run a smaller period (Fine and Wilf). So lags between ``low`` and
``1.5 low`` come from windows of ``1.5 low`` words. A true lag shows at ``low / 2`` places
or more, others are passed over; so few lags are left, and a text of a million words needs
a few thousand lags and not a third of a million. The windows are compared exactly, by
ranks of windows of doubled length.

Words are stretches without the six ASCII spaces. A run has a smallest period q and is at
least ``max(least, times * q)`` words long, and no word beside it prolongs it.

Defined results: null and empty texts have no words and no runs; rows that repeat, and
ids that repeat or are null, are read each; texts may be of any length; runs may overlap;
columns other than the two that are read are left out, whatever their names; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT = 64
LEAST, TIMES = 24, 3
ODD = 0x9E3779B1  # an odd number with bits spread evenly
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
FIRST_PLANES = 4
AT_ONCE = 1 << 20

Run = tuple[int, int, int]  # start, length, period


def planes_of(ids: np.ndarray, kinds: int) -> list[int]:
    """A big integer for each bit of the word numbers; bit i belongs to word i."""
    width = max(kinds - 1, 0).bit_length()
    scattered = ids * ODD & (1 << width) - 1  # one to one on numbers of this width
    return [int.from_bytes(np.packbits(scattered >> bit & 1, bitorder="little").tobytes(), "little") for bit in range(width - 1, -1, -1)]


def long_stretches(ones: int, least: int) -> int:
    """The places at which so many ones or more begin."""
    have = 1
    while have < least and ones:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def stretches(starts: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches of ones, from what ``long_stretches`` leaves of them."""
    at = 0
    while starts:
        skip = (starts & -starts).bit_length() - 1
        starts >>= skip
        at += skip
        more = (starts + 1 & ~starts).bit_length() - 1
        yield at, more + least - 1
        starts >>= more
        at += more


def ranked_windows(ids: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, a number for the window of that size at each word) for sizes 1, 2, 4 ... up to a length."""
    size, rank = 1, ids.astype(np.int64)
    while True:
        yield size, rank
        if 2 * size > length or len(rank) <= size:
            return
        rank = np.unique(rank[:-size] * len(ids) + rank[size:], return_inverse=True)[1]
        size *= 2


def repeating(ids: np.ndarray, text_of: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the texts in which some window of this size (a power of two) might occur twice, by hashes."""
    h, power, k = ids.astype(np.uint64) * np.uint64(ODD) + text_of.astype(np.uint64) * np.uint64(ODD << 20), 0x9E3779B97F4A7C15, 1
    while k < size:
        h = h[:-k] * np.uint64(power) + h[k:]  # modulo 2**64
        power, k = power * power % (1 << 64), 2 * k
    order = np.argsort(h)
    return np.unique(text_of[order[1:][h[order[1:]] == h[order[:-1]]]])


def far_lags(ids: np.ndarray, times: int) -> list[int]:
    """The lags of one text beyond ``DIRECT`` that can have a run."""
    most, found = len(ids) // times, []
    low = DIRECT + 1
    windows = ranked_windows(ids, 3 * most)
    size, rank = next(windows)
    while low <= most:
        high = low * 3 // 2  # lags from low up to, but not with, this one
        while 2 * size <= high and (step := next(windows, None)):
            size, rank = step
        if high > len(ids) or 2 * size < high:
            break
        both = rank[: len(ids) - high + 1] * (len(ids) + 1) + rank[high - size : len(ids) - size + 1]
        order = np.argsort(both, kind="stable")
        apart, same = np.diff(order), np.diff(both[order]) == 0
        if not same.any():
            break  # no window of this length occurs twice, so no longer one does
        lags, seen = np.unique(apart[same & (apart >= low) & (apart < high)], return_counts=True)
        # A run of this lag holds 2 * lag matches or more, so this many windows and more lie in it.
        found += lags[seen >= np.maximum(1, (times - 1) * lags - high + 1)].tolist()
        low = high
    return found


def of_lag(planes: list[int], n: int, lag: int, least: int, times: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches with this period that are long enough and that no word beside them prolongs."""
    matches = max(least - lag, (times - 1) * lag)
    if matches > n - lag:
        return
    within = (1 << n - lag) - 1
    differ, equal = 0, within
    for k in range(0, len(planes) or 1, FIRST_PLANES):
        for plane in planes[k : k + FIRST_PLANES]:
            differ |= plane ^ plane >> lag
        equal = long_stretches(~differ & within, matches)
        if not equal:
            return
    for start, length in stretches(equal, matches):
        yield start, length + lag


def runs(ids: np.ndarray, kinds: int, lengths: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each text, by start and then period. Word numbers (from 0, below ``kinds``) of all texts, one behind the other.

    Short lags are tried on all texts at once, with a number behind each text that equals
    no other; so no run crosses from one to the next.
    """
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    n, texts = int(begins[-1]), len(lengths)
    ids = np.insert(ids, np.cumsum(lengths), kinds + np.arange(texts))
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(texts)]
    longest = int(lengths.max(initial=0))
    if longest >= least:
        planes = planes_of(ids, kinds + texts)
        for lag in range(1, min(longest // times, DIRECT) + 1):
            for start, length in of_lag(planes, n, lag, least, times):
                text = int(np.searchsorted(begins, start, "right")) - 1
                found[text].setdefault((start - int(begins[text]), length), lag)  # lags rise, so the smallest period stays
    if longest // times > DIRECT:
        for text in repeating(ids, np.repeat(np.arange(texts), lengths + 1), DIRECT).tolist():
            own = ids[begins[text] : begins[text + 1] - 1]
            lags = far_lags(own, times)
            planes = planes_of(own, kinds) if lags else []
            for lag in lags:
                for span in of_lag(planes, len(own), lag, least, times):
                    found[text].setdefault(span, lag)
    return [sorted(((start, length, period) for (start, length), period in own.items()), key=lambda r: (r[0], r[2])) for own in found]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and how many each text has; Arrow's ASCII white space is the six spaces."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # there are empty ones at a text's ends
    before = np.concatenate([[0], np.cumsum(real)])
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    return flat.filter(pa.array(real)), np.diff(before[offsets])


def groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in slices of about ``AT_ONCE`` bytes, one text at least."""
    at = 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def searched(texts: pa.Array, least: int, times: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs, and text without repeated periods, of each text."""
    words, lengths = words_of(texts)
    coded = words.dictionary_encode()
    found = runs(coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), lengths, least, times)
    begins, keep = np.cumsum(lengths) - lengths, np.ones(len(words), bool)
    for at, own in zip(begins.tolist(), found):
        for start, length, period in own:
            keep[at + start + period : at + start + length] = False
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([begins, [len(words)]])]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep))), " ")
    flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
    spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum([len(own) for own in found])])
    return pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), collapsed


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Each row's id with its number of words, its runs and its text without repeated periods."""
    if times < 3 or least < 1:
        raise ValueError("a run repeats its period three times or more and has at least one word")
    kind = next(f.dataType for f in docs.schema.fields if f.name == id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *searched(texts, least, times)], [id_column, "n_words", "runs", "collapsed"])
                at += len(texts)

    return docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string")).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, {FOUND}")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; one text in ten gets a tail that repeats, as its id's checksum says. A null id changes nothing."""
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    # Only the rows that change are split into words.
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, null)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("transform(sequence(0L, n - 1L), i -> get(w, cast(if(i < a, i, a + (i - a) % p) as int)))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run that repeats most, and digests of ``find_runs``."""
    less = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  x repeats more often

    def best(all_runs: Column) -> Column:
        # Runs come by start and period, so a later one is better only if it repeats more.
        first = F.get(all_runs, F.lit(0))
        return F.aggregate(all_runs, first, lambda a, x: F.when(less(x, a), x).otherwise(a))

    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("best", best(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
