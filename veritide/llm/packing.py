"""Best-fit packing of tokenised documents with a swap-based local search.

1. One pass encodes each document and cuts it into pieces: a piece is at most one
   sequence long, and only the first piece of a cut document may be shorter.
2. What is packed is the histogram of piece lengths. It has at most ``capacity``
   rows for any corpus, so the driver plans on it: pieces of one length are alike.
   Bins that are filled alike form one group with a count. At first every piece has a bin
   of its own; then the local search moves pieces or exchanges one for one or two for one
   between underfull bins whenever the sum of squared fills grows, for whole groups at
   once, until emptied bins bring the plan to the lower bound or no such step is left
   anywhere. Where the bound isn't reached, the search also starts from best fit in two
   orders, and the plan with fewest bins counts. No number of steps or bins is capped.
   ``Search.steps`` counts what it did.
3. Each piece has a rank among the pieces of its length (place in its task plus the
   counts of the tasks before), and the plan says for each range of ranks which
   sequence and offset they take. No task sees more than its own pieces.

Defined results: null text is the empty text, so its one piece is the end id; rows
that repeat, ids that repeat or are null are packed each as its own document; an
empty table gives no pieces; columns other than doc_id and text are left out,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritide.llm.bpe import Vocabulary, encoder
from veritide.scratch import written

END_ID = 0
PIECES_KEPT, PIECE_LENGTH = 200_000, 48
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


class _Irregular(Exception):
    """A space that white space follows, where a text can't be cut."""


class _Packed(dict):
    """The ids of what stands between one space and the next, as little-endian bytes."""

    def __init__(self, path: str):
        self.path = path
        v = Vocabulary(path)
        special = v.special
        ranks = {b: i for b, i in v.id_of.items()}
        self.encoding = tiktoken.Encoding("from_file", pat_str=PRETOKEN_PLAIN, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> bytes:
        if LONG_SPACE.search(text):  # the library's pattern gives up on these
            return np.array(encoder(self.path).encode(text), "<u4").tobytes()
        return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise _Irregular
        ids = self.whole(" " + piece)
        if len(piece) <= PIECE_LENGTH:
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) >= PIECES_KEPT:
            self.clear()
        first, *rest = text.split(" ")
        try:
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        except _Irregular:
            return self.whole(text)


# The Rust side knows \s as Unicode White_Space already.
PRETOKEN_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"(?<!\s)\s{10000}")
_encoders: dict[str, _Packed] = {}


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Every piece of every document with its place among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = _Packed(path)
        own, task, seen = _encoders[path], TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = own.ids(text.as_py()) + end
                n = len(data) // 4
                first = (n - 1) % capacity + 1
                start, length = 0, first
                for k in range(-(-n // capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                    start, length = start + length, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


Bin = tuple[tuple[int, int], ...]  # (length, how many) from long to short


def fill(b: Bin) -> int:
    return sum(n * k for n, k in b)


def changed(b: Bin, out: tuple[int, ...], into: tuple[int, ...]) -> Bin:
    count = Counter(dict(b))
    count.subtract(out)
    count.update(into)
    return tuple(sorted(((n, k) for n, k in count.items() if k), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int, order: list[int]) -> Counter[Bin]:
    """Best fit on lengths, taken in this order: groups of equal bins instead of bins."""
    by_room: dict[int, Counter[Bin]] = {}
    done: Counter[Bin] = Counter()

    def put(b: Bin, times: int) -> None:
        room = capacity - fill(b)
        if room:
            by_room.setdefault(room, Counter())[b] += times
        else:
            done[b] += times

    for length in order:
        left = histogram[length]
        for room in sorted(r for r in by_room if r >= length):
            group = by_room[room]
            for b in list(group):
                each = min(room // length, left)
                if not each:
                    break
                times = min(group[b], left // each)
                group[b] -= times
                if not group[b]:
                    del group[b]
                left -= times * each
                put(changed(b, (), (length,) * each), times)
                if left and group.get(b) and left < each:
                    group[b] -= 1
                    if not group[b]:
                        del group[b]
                    put(changed(b, (), (length,) * left), 1)
                    left = 0
            if not group:
                by_room.pop(room, None)
            if not left:
                break
        each = capacity // length
        if left // each:
            put(((length, each),), left // each)
        if left % each:
            put(((length, left % each),), 1)
    for group in by_room.values():
        done.update(group)
    return done


@dataclass
class Search:
    """The local search over groups of equal bins, with what it has done.

    A step takes one or two pieces out of a source bin and puts back one piece or none
    from a target. It is known by the room the target has without that piece: what comes
    must fit there (``room >= pieces``) and leave the target fuller than the source was
    (``room < pieces + room of the source``), so that squared fill grows. For each such
    room the smallest piece that can be given back is kept, and a step is found by one
    look at a range of rooms.
    """

    capacity: int
    bins: Counter[Bin] = field(default_factory=Counter)
    steps: Counter[str] = field(default_factory=Counter)

    def __post_init__(self):
        self.given: list[list[tuple[int, Bin]]] = [[] for _ in range(self.capacity + 1)]  # by room: (piece given back, bin), smallest first
        self.least = np.full(self.capacity + 1, self.capacity + 1)
        for b in self.bins:
            self._enter(b)

    def _rooms(self, b: Bin) -> Iterator[tuple[int, int]]:
        room = self.capacity - fill(b)
        if room:
            yield room, 0
            for n, _ in b:
                yield room + n, n

    def _enter(self, b: Bin) -> None:
        for room, piece in self._rooms(b):
            heappush(self.given[room], (piece, b))
            self.least[room] = min(self.least[room], piece)

    def _refresh(self, b: Bin) -> None:
        """Forget bins that are used up, where this one stood."""
        for room, _ in self._rooms(b):
            heap = self.given[room]
            while heap and not self.bins[heap[0][1]]:
                heappop(heap)
            self.least[room] = heap[0][0] if heap else self.capacity + 1

    def _take(self, b: Bin, times: int) -> None:
        self.bins[b] -= times
        if not self.bins[b]:
            self._refresh(b)
            del self.bins[b]

    def _put(self, b: Bin, times: int) -> None:
        if b:
            if b not in self.bins:
                self._enter(b)
            self.bins[b] += times

    def step(self, a: Bin) -> bool:
        """One improving step, if there is one, out of the bins that are filled like ``a``."""
        held = self.bins[a]
        self._take(a, 1)
        room = self.capacity - fill(a)
        have = [n for n, _ in a]
        found = None
        for out in [*((n,) for n in have), *combinations(have, 2), *((n, n) for n, k in a if k > 1)]:
            total = sum(out)
            if total <= self.capacity:
                fits = np.flatnonzero(self.least[total : total + room] < total)
                if len(fits) and (found is None or fits[0] < found[0]):
                    found = (int(fits[0]), out, total + int(fits[0]))
                    if not fits[0]:
                        break
        if found is None:
            self._put(a, 1)
            return False
        _, out, at = found
        piece, b = self.given[at][0]
        back = (piece,) if piece else ()
        times = 1 + (self.bins[a] - 1) // 2 if a == b else min(held, self.bins[b])
        if a == b:
            self._take(a, times * 2 - 1)
        else:
            if times > 1:
                self._take(a, times - 1)
            self._take(b, times)
        self._put(changed(a, out, back), times)
        self._put(changed(b, back, out), times)
        self.steps[f"{len(out)} for {len(back)}"] += times
        return True

    def run(self, fullest_first: bool) -> None:
        """Over all underfull bins by fill, again and again, until the lower bound is reached or no bin has a step."""
        least = -(-sum(fill(b) * k for b, k in self.bins.items()) // self.capacity)
        going = True
        while going and self.bins.total() > least:
            going = False
            for a in sorted((b for b in self.bins if fill(b) < self.capacity), key=lambda b: (fill(b), b), reverse=fullest_first):
                while self.bins.get(a) and self.step(a):
                    going = True
                    if self.bins.total() <= least:
                        return


def searched(histogram: dict[int, int], capacity: int) -> Search:
    """The finished search.

    It begins with a bin for each piece. Where it ends above the lower bound, it also begins
    with best fit, on lengths from long to short and in a seeded order; the fewest bins count.
    """
    histogram = {n: k for n, k in histogram.items() if k}
    down = sorted(histogram, reverse=True)
    seeded = np.random.default_rng(20_240_505).permutation(down[::-1]).tolist()
    least, found = -(-sum(n * k for n, k in histogram.items()) // capacity), None
    for order in (None, down, seeded):
        bins = Counter({((n, 1),): k for n, k in histogram.items()}) if order is None else best_fit(histogram, capacity, order)
        search = Search(capacity, Counter({b: k for b, k in bins.items() if b and k}))
        search.run(fullest_first=order is None)
        if found is None or search.bins.total() < found.bins.total():
            found = search
        if found.bins.total() <= least:
            break
    return found


def plan(bins: Counter[Bin]) -> np.ndarray:
    """Rows (length, first rank, sequence of it, per sequence, offset), by length and rank."""
    rank: Counter[int] = Counter()
    rows, sequence = [], 0
    for b, times in sorted(bins.items()):
        at = 0
        for length, each in b:
            rows.append((length, rank[length], sequence, each, at))
            rank[length] += times * each
            at += length * each
        sequence += times
    return np.array(sorted(rows), "int64").reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Every piece with the sequence it is in and its offset there, and how many steps of each kind the search took.

    To the driver goes the histogram of lengths: at most ``capacity`` rows.
    """
    if not 0 < capacity < 1 << 20:
        raise ValueError("capacity must be between 1 and 2**20")
    cut = written(pieces(docs, path, capacity), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    search = searched(histogram, capacity)
    table = docs.sparkSession.sparkContext.broadcast(plan(search.bins))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 42 | rows[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            own = rows[np.searchsorted(keys, length << 42 | rank, "right") - 1] if batch.num_rows else rows[:0]
            nth = rank - own[:, 1]
            each = np.maximum(own[:, 3], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own[:, 2] + nth // each), pa.array(own[:, 4] + nth % each * length)], [x.split()[0] for x in schema.split(", ")])

    ranked = cut.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    steps = {"search_moves": ("1 for 0", "2 for 0"), "search_swaps": ("1 for 1",), "search_pair_swaps": ("2 for 1",)}
    return ranked.mapInArrow(place, schema).withColumns({name: F.lit(sum(search.steps[x] for x in kinds)).cast("long") for name, kinds in steps.items()})
