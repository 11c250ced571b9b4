"""Mixing, periodic runs and hard negatives against plain versions and SQL, and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritide.llm import mixing, negatives, queries, runs

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "one two", "a"), (4, "one two", "a"), (None, "no id at all here", "b"), (None, "no id at all here", "b"),
    (6, "word " * 30_000, "b"), (7, "  two  spaces \n tabs\t\x1c x é 日本 😀", "c"), (8, "\n\n\n", "d"), (9, "a b c " * 40, "\U0001f600"), (10, "x " * 50, "￿"),
]


def edge(spark, *clashing):
    return spark.createDataFrame(EDGE, DOCS).withColumns({n: F.lit("mine") for n in clashing})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Mixing


def plain_mix(rows, weights=(5, 2, 1), share=Fraction(3, 2), most=2, shards=8, block=mixing.BLOCK):
    """Targets, blocks of each shard and what is taken of each document; all blocks are listed and ranked."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = share * sum(sizes.values()), set()
    while True:
        open_weight = sum(w for s, w in weight.items() if s not in held)
        level = (total - sum(most * sizes[s] for s in held)) / open_weight if open_weight else 0
        above = {s for s in order if s not in held and weight[s] * level > most * sizes[s]}
        if not above:
            break
        held |= above
    target = {s: Fraction(most * sizes[s]) if s in held else weight[s] * level for s in order}
    n = round(float(sum(target.values())) / block)
    seats = sorted((-(target[s] / (2 * k + 1)), i, k) for i, s in enumerate(order) for k in range(int(4 * target[s] / block) + 3 + n) if target[s])[:n]
    quota = {s: [0] * shards for s in order}
    for place, (_, i, _) in enumerate(seats):
        quota[order[i]][next(k for k in range(shards) if place < (k + 1) * n // shards)] += 1
    return sizes, target, quota


def test_mixing_against_a_list_of_all_blocks(spark):
    draw = random.Random(4)
    for many in (False, True):
        rows = [(i, "w " * draw.randint(0, 40 if many else 400), draw.choice(["a", "b", "é", "z", None]) if not many else f"s{draw.randint(0, 40)}") for i in range(150)]
        sizes, target, quota = plain_mix(rows)
        got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
        source = {i: s for i, _, s in rows}
        taken: dict = {}
        for r in got:
            s = source[r.doc_id]
            assert r.size == len((rows[r.doc_id][1]).split()) and r.source_size == sizes[s] and abs(r.target - float(target[s])) < 1e-6
            assert r.taken == sum(p.words for p in r.parts) <= 2 * r.size
            assert all(0 <= p.first and p.first + p.words <= r.size for p in r.parts)
            for p in r.parts:
                taken.setdefault(s, [0] * 8)[p.shard] += p.words
        for s in sizes:
            wanted, left = [], 2 * sizes[s]
            for q in quota[s]:
                wanted.append(min(left, q * mixing.BLOCK))
                left -= wanted[-1]
            assert taken.get(s, [0] * 8) == wanted


def test_mixing_reruns_and_partitions_agree(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.mix(d).drop("parts").collect())) for d in (docs, docs.repartition(7)))
    assert one == two
    diff = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) <= mixing.BLOCK for r in diff.collect())


def test_mixing_edges(spark):
    rows = mixing.mix(edge(spark, "size", "rank", "target", "chunk", "at", "upto", "place"))
    assert rows.columns == ["doc_id", "size", "source_size", "target", "taken", "parts"]
    got = rows.collect()
    assert len(got) == len(EDGE) and sum(r.doc_id is None for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert (by[1].size, by[1].taken, by[8].target) == (0, 0, 0.0) and by[6].size == 30_000
    assert mixing.mix(empty(spark)).collect() == []
    nothing = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mix(edge(spark), block=0)


# Periodic runs


def plain_runs(words, least=24, times=3):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def in_runs(texts):
    return [[(r["start"], r["length"], r["period"]) for r in own] for own in runs.searched(pa.array(texts, pa.string()), 24, 3)[1].to_pylist()]


def test_runs_against_all_lags():
    draw, texts, seen = random.Random(1), [], 0
    for _ in range(700):
        n, kinds = draw.randint(0, 700), draw.choice([1, 2, 3, 5, 50, 500])
        w = [draw.randrange(kinds) for _ in range(n)]
        for _ in range(draw.randint(0, 3) if n > 30 else 0):
            p, at = draw.randint(1, n // 3), draw.randrange(n)
            for i in range(at + p, min(n, at + p * draw.randint(2, 6) + draw.randint(0, p))):
                w[i] = w[i - p]
        if draw.random() < 0.2:  # every window of 40 words occurs twice within a period
            a, b, c = ([draw.randrange(kinds) for _ in range(40)] for _ in range(3))
            w = ((a + b + a + c + b + c + a + b + c + b + a + c) * 4)[: draw.randint(1, 1900)]
        texts.append(" ".join(map(str, w)))
    for k in range(0, len(texts), 50):
        for text, found in zip(texts[k : k + 50], in_runs(texts[k : k + 50])):
            wanted = plain_runs(text.split())
            seen += len(wanted)
            assert found == wanted
    assert seen > 300


def test_runs_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found, keep = plain_runs(w), [True] * n
        for s, length, p in found:
            keep[s + p : s + length] = [False] * (length - p)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None,) * 3
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[r.doc_id] == (
            r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            digest("".join(f"{s},{n},{p}\n" for s, n, p in found)), digest(" ".join(x for x, k in zip(w, keep) if k)),
        )


def test_runs_edges(spark):
    found = runs.find_runs(edge(spark, "runs", "collapsed", "n_words", "a.b"))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = found.collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].runs, by[1].collapsed) == (0, [], "") and by[8].n_words == 0
    assert by[6].collapsed == "word" and [tuple(r) for r in by[6].runs] == [(0, 30_000, 1)]
    assert by[7].collapsed == "two spaces tabs \x1c x é 日本 😀" and by[9].collapsed == "a b c"
    assert runs.find_runs(empty(spark)).collect() == [] and runs.digests(runs.find_runs(empty(spark))).collect() == []
    assert runs.digests(runs.find_runs(runs.with_repeated_tails(edge(spark)))).filter("runs_sha256 is null or collapsed_sha256 is null").count() == 0
    assert {r.id for r in runs.find_runs(spark.createDataFrame([("x", "a " * 30)], "id string, body string"), "id", "body").collect()} == {"x"}
    with pytest.raises(ValueError):
        runs.find_runs(edge(spark), times=2)


def test_long_texts_are_fast():
    import time

    words = [str(x) for x in np.random.default_rng(1).integers(0, 2, 300_000)]
    for text in (" ".join(words), "a " * 300_000, " ".join(words[:100_000] * 3)):
        began = time.perf_counter()
        in_runs([text])
        assert time.perf_counter() - began < 20


# Hard negatives


VECTORS = "vec_id long, label int, vector array<double>, anchor boolean"


def plain_negatives(rows, positives=5, negatives_=3):
    good = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    dim = max((len(r[2]) for r in good), default=0)
    ints = [[int(np.floor(256 * x)) for x in r[2]] + [0] * (dim - len(r[2])) for r in good]
    nth = lambda r: (r[0] is None, r[0] or 0)
    out = []
    for i, a in enumerate(good):
        if not a[3]:
            continue
        score = [sum(x * y for x, y in zip(ints[i], v)) for v in ints]
        same = sorted((j for j in range(len(good)) if j != i and good[j][1] == a[1]), key=lambda j: (-score[j], nth(good[j])))[:positives]
        for p in same:
            fits = [j for j in range(len(good)) if good[j][1] != a[1] and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            for rank, j in enumerate(sorted(fits, key=lambda j: (-score[j], nth(good[j])))[:negatives_], 1):
                out.append((a[0], good[p][0], rank, good[j][0], score[p], score[j]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaf", [4096, 40])
def test_negatives_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "CHUNK", leaf)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 5))
    rows = [(int(i), int(draw.integers(0, 3)), (centres[draw.integers(0, 6)] + 0.3 * draw.normal(size=5)).tolist(), bool(i % 9 == 0)) for i in range(500)]
    rows += [(600 + i, 1, [1.0, 0.5, -0.25, 0.125, 2.0], i % 20 == 0) for i in range(60)]  # one vector, many times
    rows += [(600 + i, 2, [0.8, 0.4, -0.2, 0.1, 1.6], False) for i in range(60)]  # ids that repeat, ties
    rows += [(700, None, [1.0] * 5, True), (701, 1, None, True), (702, 1, [1.0, None, 1.0, 1.0, 1.0], True), (703, 1, [float("nan")] * 5, True), (704, 1, [float("inf")] * 5, False)]
    rows += [(None, 2, [0.7, 0.4, -0.2, 0.1, 1.6], False), (None, 1, [1.0, 0.5, -0.25, 0.125, 2.0], None), (705, 2, [2.0], True), (706, 0, [], True), (-50, 0, centres[0].tolist(), True)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).withColumns({"rank": F.lit(1), "a.b": F.lit(2), "score": F.lit("x"), "code": F.lit(0)}))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_negatives(rows)


def test_negatives_of_large_components(spark):
    """Scores beyond 2**53 are exact; beyond 64 bits they are the largest one, so only ids order them."""
    rows = [(i, i % 2, [float(x) * 2.0**16 + 1 for x in (i + 1, -i, 3)], i % 3 == 0) for i in range(20)]
    assert sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()), key=repr) == plain_negatives(rows)
    rows = [(i, 0, [2.0**60 * (i + 1)], i == 0) for i in range(8)] + [(9, 1, [2.0**-10], False)]
    assert negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect() == []
    vast = negatives.Search(spark.createDataFrame(rows, VECTORS), 256, 100)
    anchors = vast.points.filter("anchor").select("rid", "label", "code", "data", F.expr(f"array(struct(0 as slot, -{negatives.FARTHEST} as low, {negatives.FARTHEST} as high))").alias("slots"))
    assert [(r.vec_id, r.score) for r in vast.of(anchors, 5, True, "t").orderBy("rank").collect()] == [(i, negatives.FARTHEST) for i in range(1, 6)]
    assert negatives.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0]]), False).tolist() == [[2**60 + 1]]
    assert negatives.products(np.array([[2.0**60]]), np.array([[-(2.0**60)]]), False).tolist() == [[-negatives.FARTHEST]]


def test_negatives_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0], False), (2, 2, [1.0], None)], VECTORS)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0], True)], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(none, low=96)


def test_intervals_hold_and_prune():
    draw = np.random.default_rng(5)
    a, c = draw.normal(size=(30, 8)) * 50 + 400, draw.normal(size=(40, 8)) * 50 - 200
    ca, cc = a.mean(axis=0), c.mean(axis=0)
    ra, rc = np.linalg.norm(a - ca, axis=1).max(), np.linalg.norm(c - cc, axis=1).max()
    low, high = negatives.intervals(ca, ra, cc, rc, ca @ cc)
    assert low <= (a @ c.T).min() and (a @ c.T).max() <= high
    x = np.concatenate([draw.normal(size=(200, 8)) * 3 + 100, draw.normal(size=(200, 8)) * 3 - 100])
    tree = negatives.tree_of(x, 3)
    code = tree.codes(x)
    away = {int(k): float(np.linalg.norm(x[code == k] - tree.centre[7 + k], axis=1).max()) for k in set(code.tolist())}
    pairs = negatives.leaf_pairs(tree, {k: (r, 1, negatives.FARTHEST) for k, r in away.items()}, away)
    assert pairs and all((a < 4) == (c < 4) for a, c in pairs)  # the far side is dropped with all its leaves


# Near duplicates: the bound on the sets' difference


def test_odd_bits_never_differ_by_more_than_the_sets():
    from veritide.llm import neardup

    draw = np.random.default_rng(9)
    bits = lambda s: np.array(neardup.odd_bits(s), np.int64).view(np.uint8)
    for size in (0, 1, 5, 160, 5_000):
        for _ in range(30):
            a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.1], draw.integers(0, 1 << 63, size // 12, dtype=np.uint64)]))
            apart = len(np.setxor1d(a, b))
            differ = int(np.unpackbits(bits(a) ^ bits(b)).sum())
            assert differ <= apart and (apart > 100 or differ >= apart - 8)
