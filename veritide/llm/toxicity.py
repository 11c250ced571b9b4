"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings counts their common subsequences of four signs within a span
of seven characters, weighted by a decay to the power of the span; of a subsequence that
occurs more than once in a stretch of text the tightest occurrence counts. Signs
are letters and the start of a word; every other character only takes up room. So an
insult is recognised with gaps and inserted characters. Letters are folded: case,
accents and look-alike digits; letters of scripts beyond Latin are numbered by their
code points.

Landmarks are fragments of words, word starts included, that labelled texts show to be
telling: first beginnings of words are counted, then fragments of words with a telling
beginning. They are chosen one by one, and toxic texts that have several of them already
count less, so those of rarer languages and topics get their share. Strings are mapped
to kernel values with the landmarks times the inverse root of the landmarks' own kernel
matrix, and a linear support vector machine is fitted there on windows of about eighty
characters. Windows end at sentence ends and never within a word. Labels are given for
whole texts, so a toxic text is represented by its highest windows, chosen again after
each fit, and by landmarks that clean texts don't have, alone and with gaps; a clean one
by its worst windows. A text's score is the calibrated sum of its three worst windows,
as far as they are beyond the margin of clean ones; windows are laid twice, half a
window apart, and the worse laying counts.

The machine is linear in the subsequences of its landmarks, so it is folded into one
weight for each of them, and a text is scored in one pass over its letters.

Fitted on at most ``TRAINING_TEXTS`` labelled texts, half of either label, taken in the
order of a hash. Executors list their words (at most ``WORDS_A_TEXT`` distinct ones by
hash), count their beginnings and embed their windows (the ``WINDOWS_A_TEXT`` most like
a landmark). To the driver go at most ``STEMS`` beginnings, the words that have one, and
those windows. All texts are scored whole.

Defined results: null and empty texts get the score of a text without any match; rows
with ids that repeat or are null are scored each; for the fit an id labelled 0 and 1
counts as toxic, and of rows with one id the text that sorts first is taken; without
labels of both kinds every score is the share of toxic labels (0 if there are none);
other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions.patterns import any_of
from veritide.scratch import written

LENGTH, SPAN, DECAY = 4, 7, 0.8
LANDMARKS, ROUNDS, WORST = 200, 4, 3
TRAINING_TEXTS, WORDS_A_TEXT, WINDOWS_A_TEXT, STEMS = 5_000, 1_000, 16, 1_000
#: A telling beginning of words: its lengths with the space before it, the share of toxic texts that must have it, and how many times the share of clean ones that must be.
STEM_LENGTHS, SUPPORT, LIFT = (5, 6, 7, 8), 0.015, 4
#: Sure signs alone count as so many of the toxic texts at most when the curve is fitted.
SURE_SHARE = 0.1
HALF_WINDOW = 40  # a window is two halves; a half begins with the first word behind so many characters
OFFSETS = [(0, *c) for c in combinations(range(1, SPAN), LENGTH - 1)]
# Look-alikes of letters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "s"}
GAP, WORD, STOP, CODES = 0, 27, 31, 32


def _code_table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for point in range(0x10000):
        c = unicodedata.normalize("NFKD", LOOK_ALIKES.get(chr(point), chr(point)).lower())[:1]
        if "a" <= c <= "z":
            table[point] = ord(c) - 96
        elif c.isalpha():
            table[point] = 1 + ord(c) % 26
    for c in ".!?\n\r":
        table[ord(c)] = STOP
    return table


CODE = _code_table()


def codes(text: str | None) -> np.ndarray:
    """A letter's number, WORD before a word, STOP where a sentence ends, 0 for what only takes up room."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    c = np.concatenate(([STOP], CODE[np.where(points < len(CODE), points, 32)])).astype(np.uint8)
    letter = (c > GAP) & (c < WORD)
    before = c[:-1]
    before[letter[1:] & (before == GAP)] = WORD
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    run = alone[:-6] & alone[2:-4] & alone[4:-2] & alone[6:] if len(c) > 6 else alone[:0]
    at = np.flatnonzero(run)
    if not len(at):
        return c
    # Four and more single letters with one character between are also read as a word, in a sentence of its own.
    spelt = np.unique(at[:, None] + np.array([0, 2, 4, 6]))
    apart = np.flatnonzero(np.diff(spelt) != 2) + 1
    return np.concatenate((c, [STOP], np.insert(c[spelt], apart, STOP))).astype(np.uint8)


def runs(start: np.ndarray) -> np.ndarray:
    """For each place the last place at or before it that is marked, 0 if none is."""
    return np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))


def halves_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the half window that each character is in, and of each half its place in its sentence.

    A half ends with a sentence or before the first word that begins behind its length.
    """
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = c == STOP
    sentence = runs(stop)
    letter = (c > GAP) & (c < WORD)
    begins = ~letter
    begins[0] = True
    place = (runs(begins) - sentence) // HALF_WINDOW
    new = np.ones(len(c), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (place[1:] != place[:-1])
    half = np.cumsum(new) - 1
    return half, place[new]


def padded(c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(c) + SPAN, np.int32)
    out[: len(c)] = c
    stop = np.flatnonzero(c == STOP)
    following = out[stop + 1]
    out[stop] = np.where((following > GAP) & (following < WORD), WORD, GAP)
    return out


def vector(text: str) -> Counter[int]:
    """The kernel's feature map of a short string: each subsequence's number and weight."""
    c, out = padded(codes(text)).tolist(), Counter()
    if not text.startswith(" "):
        c = [GAP, *c[1:]]
    for i in range(len(c) - SPAN):
        for offsets in OFFSETS:
            letters = [c[i + k] for k in offsets]
            if GAP not in letters:
                out[reduce(lambda x, y: x << 5 | y, letters)] += DECAY ** (offsets[-1] + 1)
    return out


@dataclass
class Model:
    numbers: np.ndarray  # of the subsequences that have a weight, sorted
    weights: np.ndarray
    bias: float
    curve: tuple[float, float, float, float]  # of the worst windows' sum, the text's size and one; then the largest size that was fitted
    share: float

    def __post_init__(self):
        self.row = np.full(CODES**LENGTH, -1, np.int32)
        self.row[self.numbers] = np.arange(len(self.numbers))
        self.pairs, self.triples = np.zeros(CODES**2, bool), np.zeros(CODES**3, bool)
        self.pairs[self.numbers >> 10] = True
        self.triples[self.numbers >> 5] = True

    def found(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each shape of gaps: where known subsequences begin, their rows, and their weight.

        Signs are added one by one; what begins no known subsequence goes at once.
        """
        c = padded(c)
        n = len(c) - SPAN
        for second in range(1, SPAN - 2):
            pair = c[:n] << 5
            pair |= c[second : n + second]
            at = np.flatnonzero(self.pairs[pair])
            pair = pair[at]
            for third in range(second + 1, SPAN - 1):
                triple = pair << 5 | c[at + third]
                kept = np.flatnonzero(self.triples[triple])
                at3, triple = at[kept], triple[kept] << 5
                for fourth in range(third + 1, SPAN):
                    row = self.row[triple | c[at3 + fourth]]
                    hit = np.flatnonzero(row >= 0)
                    if len(hit):
                        yield at3[hit], row[hit], DECAY ** (fourth + 1)

    def occurrences(self, c: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Half, row and weight of each known subsequence, its tightest occurrence in a half only: repeated words count once."""
        hits = sorted(((weight, half[at] * len(self.numbers) + row) for at, row, weight in self.found(c)), key=lambda h: -h[0])
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        keys, first = np.unique(np.concatenate([k for _, k in hits]), return_index=True)
        weight = np.repeat([w for w, _ in hits], [len(k) for _, k in hits])[first]
        return (*np.divmod(keys, len(self.numbers)), weight)

    def worst(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the sum of its worst windows and its size; texts are joined for speed, apart by stops."""
        each = [np.concatenate((codes(t), np.full(SPAN, STOP, np.uint8))) for t in texts]
        c = np.concatenate(each)
        half, place = halves_of(c)
        where, row, weight = self.occurrences(c, half)
        sums = np.bincount(where, self.weights[row] * weight, len(place))
        starts = half[np.cumsum([0, *(len(x) for x in each[:-1])])]
        out = np.zeros(len(texts))
        for shift in (0, 1):
            window = (place + shift) // 2
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] == 0) | (window[1:] != window[:-1])
            number = np.cumsum(new) - 1
            beyond = np.maximum(0, np.bincount(number, sums) + self.bias + 1)
            edges = [*number[starts].tolist(), int(number[-1]) + 1]
            out = np.maximum(out, [top(beyond[a:b]) for a, b in zip(edges, edges[1:])])
        return out, np.log([len(x) / HALF_WINDOW + 1 for x in each])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.numbers) or not texts:
            return np.full(len(texts), self.share)
        worst, size = self.worst(texts)
        a, b, c, largest = self.curve
        return 1 / (1 + np.exp(-np.clip(a * worst + b * np.minimum(size, largest) + c, -30, 30)))


def top(beyond: np.ndarray) -> float:
    """The sum of the largest few."""
    return float((beyond if len(beyond) <= WORST else np.partition(beyond, -WORST)[-WORST:]).sum())


def words_of(text: str | None) -> list[str]:
    """Distinct folded words of four letters and more, a space before each; of very many those with the smallest hashes."""
    c = codes(text)
    found = {w for w in np.where((c > GAP) & (c < WORD), c + 96, 32).astype(np.uint8).tobytes().decode().split() if len(w) > 3}
    if len(found) > WORDS_A_TEXT:
        found = set(sorted(found, key=lambda w: (xxhash.xxh3_64_intdigest(w), w))[:WORDS_A_TEXT])
    return sorted(f" {w}" for w in found)


def beginnings(word: str) -> set[str]:
    return {word[:n] for n in STEM_LENGTHS if len(word) >= n}


def telling(bad_with: float, clean_with: float, bad: int, clean: int) -> bool:
    return bad_with >= max(4, SUPPORT * bad) and bad_with * clean > LIFT * clean_with * bad


def with_telling_stems(bags: list[list[str]], toxic: np.ndarray) -> list[list[str]]:
    """Of each text the words with a telling beginning; ``train`` does the same in Spark."""
    counts: dict[str, list[int]] = {}
    for bag, y in zip(bags, toxic):
        for x in set().union(*map(beginnings, bag)) if bag else ():
            counts.setdefault(x, [0, 0])[int(y)] += 1
    bad, clean = int(toxic.sum()), int((1 - toxic).sum())
    stems = {x for x, (c, b) in counts.items() if telling(b, c, bad, clean)}
    return [[w for w in bag if beginnings(w) & stems] for bag in bags]


def fragments(word: str) -> set[str]:
    return {word[i : i + n] for n in range(5, 10) for i in range(len(word) - n + 1)}


def telling_fragments(bags: list[list[str]], toxic: np.ndarray, most: int) -> tuple[list[str], list[str]]:
    """Fragments of words that toxic texts have and clean ones don't, and those of them that are sure signs.

    Counts are of texts. Each next one is worth what it adds: a toxic text counts less
    for each fragment that it has already; clean texts with it count against it.
    """
    bad, clean = int(toxic.sum()), int((1 - toxic).sum())
    counts: dict[str, list[int]] = {}
    for bag, y in zip(bags, toxic):
        for word in bag:
            counts.setdefault(word, [0, 0])[int(y)] += 1
    hoped: Counter[str] = Counter()
    for word, (_, b) in counts.items():
        if b:
            for x in fragments(word):
                hoped[x] += b
    hoped = Counter({x: n for x, n in hoped.items() if n >= 4})
    against: Counter[str] = Counter()
    for word, (c, _) in counts.items():
        if c:
            for x in fragments(word):
                if x in hoped:
                    against[x] += c
    some = [x for x, n in hoped.items() if n / bad > 4 * against[x] / clean]
    some = sorted(some, key=lambda x: (-(hoped[x] / bad - 4 * against[x] / clean) * len(x) ** 0.5, x))[: 40 * most]
    number = {x: k for k, x in enumerate(some)}
    of_word: dict[str, list[int]] = {}
    has: list[list[int]] = [[] for _ in some]  # texts of each fragment
    for t, bag in enumerate(bags):
        own: set[int] = set()
        for word in bag:
            if word not in of_word:
                of_word[word] = [number[x] for x in fragments(word) if x in number]
            own.update(of_word[word])
        for k in own:
            has[k].append(t)
    left = np.where(toxic == 1, 1 / bad, -1 / clean)
    held = [np.array(h, int) for h in has]
    length = np.array([len(x) ** 0.5 for x in some])
    open_, chosen = np.ones(len(some), bool), []
    worth = np.array([left[h].sum() for h in held]) * length
    while open_.any() and len(chosen) < most:
        # What a fragment is worth only falls, so most of the old figures need not be made anew.
        k = int(np.argmax(np.where(open_, worth, -np.inf)))
        now = float(left[held[k]].sum() * length[k])
        if now < worth[k] - 1e-12:
            worth[k] = now
            continue
        if now <= 0 or sum(toxic[held[k]]) < 4:
            open_[k] = False
            continue
        chosen.append(k)
        open_[k] = False
        for j in np.flatnonzero(open_):
            if some[j] in some[k] or some[k] in some[j]:
                open_[j] = False
        mine = held[k][toxic[held[k]] == 1]
        left[mine] *= 0.8
    # A sure sign begins a word and shares its beginning with next to no clean text.
    stems = Counter(x for bag, y in zip(bags, toxic) if not y for x in {w[:6] for w in bag})
    sure = [k for k in chosen if some[k][0] == " " and toxic[held[k]].sum() >= 8 and stems[some[k][:6]] * 100 * bad <= toxic[held[k]].sum() * clean]
    return [some[k] for k in chosen], [some[k] for k in sure]


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss and balanced classes.

    Newton's method on the primal: each step solves for the rows inside the margin, whose
    products are summed a thousand rows at a time.
    """
    d = x.shape[1] + 1
    bad = y > 0
    c = np.where(bad, cost / max(1, bad.sum()), cost / max(1, (~bad).sum())) * len(y) / 2
    w, inside = np.zeros(d), np.ones(len(y), bool)
    for _ in range(rounds):
        a, b = np.eye(d), np.zeros(d)
        for k in range(0, len(y), 1000):
            some = inside[k : k + 1000]
            own = np.column_stack((x[k : k + 1000][some], np.ones(some.sum()))).astype(float)
            a += own.T @ (own * c[k : k + 1000][some, None])
            b += own.T @ (c[k : k + 1000][some] * y[k : k + 1000][some])
        w = np.linalg.solve(a, b)
        now = y * (x @ w[:-1] + w[-1]) < 1
        if (now == inside).all():
            break
        inside = now
    return w


@dataclass
class Space:
    """The landmarks' space: weights of subsequences in each of its dimensions."""

    numbers: np.ndarray
    weights: np.ndarray
    likeness: np.ndarray  # a direction: likeness to any landmark

    def __post_init__(self):
        self.probe = Model(self.numbers, np.zeros(len(self.numbers)), 0.0, (1.0, 0.0, 0.0, 0.0), 0.0)

    def embedded(self, text: str | None) -> np.ndarray:
        """A row for each window with any known subsequence, the likest ones, and one of zeros besides."""
        c = codes(text)
        half, place = halves_of(c)
        names, cols, vals = self.probe.occurrences(c, half)
        if not len(names):
            return np.zeros((1, self.weights.shape[1]), np.float16)
        names = names - place[names] % 2
        starts = np.flatnonzero(np.diff(names, prepend=-1))
        out = np.zeros((len(starts) + 1, self.weights.shape[1]))
        for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(names)])):
            out[k] = vals[a:b] @ self.weights[cols[a:b]]
        if len(out) > WINDOWS_A_TEXT:
            out = out[np.sort(np.argsort(-(out @ self.likeness), kind="stable")[:WINDOWS_A_TEXT])]
        return out.astype(np.float16)


def space_of(landmarks: list[str]) -> Space:
    maps = [vector(x) for x in landmarks]
    numbers = np.array(sorted(set().union(*maps)))
    of = {x: i for i, x in enumerate(numbers.tolist())}
    dense = np.zeros((len(numbers), len(maps)))
    for j, m in enumerate(maps):
        for x, v in m.items():
            dense[of[x], j] = v
    dense /= np.sqrt((dense**2).sum(axis=0))
    values, vectors = np.linalg.eigh(dense.T @ dense)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    to_space = dense @ root
    return Space(numbers, to_space, to_space.T @ dense.sum(axis=1))


def spelt_out(fragment: str) -> list[str]:
    """A fragment alone, and with gaps and inserted characters."""
    x = fragment.strip()
    return [x, "-".join(x), f"{x[: len(x) // 2]}*{x[len(x) // 2 :]}", f"{x[:1]}.{x[1:]}", f"{x[:-1]}_{x[-1:]}"]


def size_of(text: str | None) -> float:
    """The logarithm of a text's halves, as ``Model.worst`` has it."""
    return float(np.log((len(codes(text)) + SPAN) / HALF_WINDOW + 1))


def fitted(space: Space, bags: list[np.ndarray], sizes: np.ndarray, toxic: np.ndarray, sure: list[str], clean_weight: float = 1.0) -> Model:
    """``clean_weight``: for how many clean texts one in the sample stands, next to a toxic one."""
    alone = [space.embedded(v) for x in sure for v in spelt_out(x)]
    rows = [b[np.argmax(b.astype(float) @ space.likeness)] for b in alone]
    w = np.append(space.likeness, 0.0)  # at first: likeness to any landmark
    for _ in range(ROUNDS):
        x, y = [*rows], [1.0] * len(rows)
        for bag, bad in zip(bags, toxic):
            bag = bag.astype(np.float32)
            s = bag @ w[:-1].astype(np.float32) + w[-1]
            order = np.argsort(-s)[:WORST]
            for k in order[:1] if not bad else [k for k in order if k == order[0] or s[k] > 0]:
                x.append(bag[k])
                y.append(1.0 if bad else -1.0)
            if not bad:
                x += [bag[k] for k in order[1:]]
                y += [-1.0] * (len(order) - 1)
        w = support_vector_machine(np.array(x, np.float32), np.array(y))
    beyond = lambda bag: top(np.maximum(0, bag.astype(float) @ w[:-1] + w[-1] + 1))
    tops = np.array([beyond(b) for b in [*bags, *alone]])
    sizes = np.concatenate((sizes, [size_of(v) for x in sure for v in spelt_out(x)]))
    marks = np.concatenate((toxic, np.ones(len(alone), int)))
    weight = np.where(marks == 1, 1.0, clean_weight)
    weight[len(bags) :] = min(1.0, SURE_SHARE * toxic.sum() / max(1, len(alone)))
    curve = calibrated(np.column_stack((tops, sizes)), marks, weight)
    return Model(space.numbers, space.weights @ w[:-1], float(w[-1]), (*curve, float(sizes.max())), float(toxic.mean()))


def constant(share: float) -> Model:
    return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, (1.0, 0.0, 0.0, 0.0), share)


def fit(texts: list[str], toxic: np.ndarray, clean_weight: float = 1.0) -> Model:
    """The same fit as ``train``, on texts at hand."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    landmarks, sure = telling_fragments(with_telling_stems([words_of(t) for t in texts], toxic), toxic, LANDMARKS) if 0 < share < 1 else ([], [])
    if not landmarks:
        return constant(share)
    space = space_of(landmarks)
    return fitted(space, [space.embedded(t) for t in texts], np.array([size_of(t) for t in texts]), toxic, sure, clean_weight)


def calibrated(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Slopes (the second one held back) and offset of a logistic curve, by Newton's method with step halving.

    Targets are drawn in from 0 and 1 by the size of either class, so separable scores
    have finite slopes too.
    """
    bad = toxic.astype(bool)
    target = np.where(bad, (bad.sum() + 1) / (bad.sum() + 2), 1 / ((~bad).sum() + 2))
    x = np.column_stack((x, np.ones(len(x))))
    penalty = np.array([1e-6, 0.5, 1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    w[-1] = np.log((bad.sum() + 1) / ((~bad).sum() + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (weight * (p - target)) + 2 * penalty * w
        step, scale, now = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(2 * penalty), g), 1.0, loss(w)
        while scale > 1e-6 and loss(w - scale * step) > now - 1e-4 * scale * float(g @ step):
            scale /= 2
        w = w - scale * step
        if np.abs(g).max() < 1e-6 or scale <= 1e-6:
            break
    return tuple(w.tolist())


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on labelled rows that aren't held out, at most ``TRAINING_TEXTS`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # The sample holds toxic texts more often than the labels do; the curve is fitted as if it didn't.
    all_marks = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(20_240_503), "doc_id")
    half = TRAINING_TEXTS // 2
    some = [known.filter(F.col("toxic") == y).withColumn("place", order).orderBy("place", "doc_id").limit(half) for y in (1, 0)]
    chosen = F.broadcast(some[0].unionByName(some[1]).select("doc_id", "toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = written(sample, "toxic-sample").repartition(TRAINING_TEXTS // 200)

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([size_of(t.as_py()) for t in batch.column(2)], pa.float64()), pa.array([words_of(t.as_py()) for t in batch.column(2)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "toxic", "size", "words"])

    listed = written(sample.select("doc_id", "toxic", "text").mapInArrow(list_words, "doc_id long, toxic int, size double, words array<string>"), "toxic-words")
    totals = {r["toxic"]: r["n"] for r in listed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, clean = totals.get(1, 0), totals.get(0, 0)
    share = bad / max(1, bad + clean)
    if not bad or not clean:
        return constant(share)
    of_length = lambda n: F.transform(F.filter("words", lambda w: F.char_length(w) >= n), lambda w: F.substring(w, 1, n))
    counts = listed.select("toxic", F.explode(F.array_distinct(F.concat(*map(of_length, STEM_LENGTHS)))).alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("c"))
    found = counts.filter((F.col("b") >= max(4, SUPPORT * bad)) & (F.col("b") * clean > LIFT * F.col("c") * bad))
    stems = [r["stem"] for r in found.orderBy(F.desc(F.col("b") * clean - LIFT * F.col("c") * bad), "stem").limit(STEMS).collect()]
    begins = lambda w: any_of([F.substring(w, 1, n).isin([x for x in stems if len(x) == n]) for n in STEM_LENGTHS])
    rows = sorted((r["doc_id"], r["toxic"], r["words"], r["size"]) for r in listed.select("doc_id", "toxic", "size", F.filter("words", begins).alias("words")).collect())
    toxic = np.array([r[1] for r in rows], int)
    landmarks, sure = telling_fragments([r[2] for r in rows], toxic, LANDMARKS)
    if not landmarks:
        return constant(share)
    space = space_of(landmarks)
    shared = docs.sparkSession.sparkContext.broadcast((space.numbers, space.weights, space.likeness))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Space(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.embedded(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "rows"])

    # Read part by part, so that the driver holds them once.
    embedded = written(sample.select("doc_id", "text").mapInArrow(embed, "doc_id long, rows binary"), "toxic-windows")
    found = {r["doc_id"]: np.frombuffer(bytes(r["rows"]), np.float16).reshape(-1, len(landmarks)) for r in embedded.toLocalIterator()}
    return fitted(space, [found[r[0]] for r in rows], np.array([r[3] for r in rows]), toxic, sure, (all_marks[0] / clean) / (all_marks[1] / bad))


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


_models: dict[str, Model] = {}


def scorer(spark, model: Model):
    shared, key = spark.sparkContext.broadcast((model.numbers, model.weights, model.bias, model.curve, model.share)), uuid.uuid4().hex

    def score(column: pa.Array) -> np.ndarray:
        own = _models.get(key)
        if own is None:  # built once for each worker and fit
            _models.clear()
            own = _models[key] = Model(*shared.value)
        out, texts, size = [], [], 0
        for t in column:
            text = t.as_py()
            texts.append(text)
            size += len(text or "")
            if size > 200_000:
                out.append(own.scores(texts))
                texts, size = [], 0
        out.append(own.scores(texts))
        return np.concatenate(out)

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's score; ``held_out`` marks rows whose labels the fit never sees."""
    score = scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCORE_SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    score, at = scorer(docs.sparkSession, model), docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots can't be looked up within mapInArrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) < 0.5))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
