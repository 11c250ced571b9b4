"""Operators of the training-data pipeline against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.llm import bpe, chat, html_text, media, neardup, packing, pii, quality, queries, sharding, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
EDGE = [
    (1, None, "en", None, None), (2, "", "en", "a", 0), (3, "one two", None, "a", 7), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (None, "no id at all here", "en", "b", 5),
    (6, LONG, "en", "b", len(LONG)), (7, "  two  spaces \n tabs\t\x1c x <|endoftext|> é 日本 😀", "fr", "c", 1), (8, "\n\n\n", "de", "c", 3),
]


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


def clashing(spark):
    """Extra columns with the names that operators add."""
    names = ["n_words", "failed", "kept", "shard", "slot", "rank", "place", "length", "piece", "component_id", "digest", "bands", "score", "held_out", "media", "spans", "size", "range", "row"]
    return edge(spark).withColumns({n: F.lit("mine") for n in names})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# Packing


def packed(docs, path, capacity=2048):
    return packing.pack(docs, path, capacity).toPandas()


def test_packing(spark, path, library):
    rows = packed(edge(spark), path, 128)
    fill = rows.groupby("sequence_id").length.sum()
    assert fill.max() <= 128 and len(fill) <= -(-fill.sum() // 128) + 1
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    ids = np.array([*library.encode(LONG, add_special_tokens=False).ids, 0], "<u4")
    own = rows[rows.doc_id == 6].sort_values("piece")
    assert own.length.sum() == len(ids) and (own.length[1:] == 128).all()
    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert len(rows[rows.doc_id == 4]) == 2 and rows[rows.doc_id == 1].length.tolist() == [1]
    assert len(packed(empty(spark), path)) == 0
    assert len(packed(clashing(spark), path, 128)) == len(rows)


def test_packing_plan():
    draw = random.Random(3)
    for _ in range(60):
        capacity = draw.choice([10, 50, 97])
        histogram = Counter(draw.randint(1, capacity) for _ in range(draw.randint(0, 300)))
        plan = packing.plan(packing.searched(dict(histogram), capacity).bins)
        bins: dict[int, list[tuple[int, int]]] = {}
        for length, n in histogram.items():
            for rank in range(n):
                row = max((r for r in plan.tolist() if r[0] == length and r[1] <= rank), key=lambda r: r[1])
                nth = rank - row[1]
                bins.setdefault(row[2] + nth // row[3], []).append((row[4] + nth % row[3] * length, length))
        for spans in bins.values():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at <= capacity
        total = sum(k * n for k, n in histogram.items())
        assert len(bins) <= -(-total // capacity) * 11 // 9 + 1


def optimum(items, capacity):
    """The least number of bins, by trying everything."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {f: j for j, f in enumerate(bins) if f + items[i] <= capacity}.values():
            bins[j] += items[i]
            go(i + 1, bins)
            bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_local_search_against_the_optimum():
    draw, missed, mended = random.Random(5), 0, 0
    for _ in range(1200):
        capacity = draw.choice([10, 20, 31])
        items = sorted((draw.randint(2, capacity * 2 // 3) for _ in range(draw.randint(4, 12))), reverse=True)
        histogram = dict(Counter(items))
        search = packing.searched(histogram, capacity)
        least, plain = optimum(items, capacity), packing.best_fit(histogram, capacity, sorted(histogram, reverse=True)).total()
        assert sum((Counter({n: k * times for n, k in b}) for b, times in search.bins.items()), Counter()) == Counter(items)
        assert search.bins.total() <= plain and all(packing.fill(b) <= capacity for b in search.bins)
        missed += search.bins.total() > least
        if plain > least == search.bins.total():
            mended += 1
            assert search.steps.total() > 0
    assert mended >= 25 and missed <= 5


def test_local_search_on_many_copies():
    """A mixture in which best fit decreasing leaves bins that exchanges empty; steps are taken for whole groups."""
    draw = random.Random(8)
    histogram = {draw.randint(1, 100): 1000 + draw.randint(0, 9) for _ in range(60)}
    plain = packing.best_fit(histogram, 101, sorted(histogram, reverse=True)).total()
    search = packing.searched(histogram, 101)
    assert search.bins.total() < plain and {"1 for 1", "2 for 1", "1 for 0"} <= set(search.steps)


def test_steps_of_the_search():
    search = packing.Search(10, Counter({((3, 1),): 1, ((6, 1),): 1}))
    search.run(fullest_first=True)
    assert search.bins == {((6, 1), (3, 1)): 1} and search.steps == {"1 for 0": 1}
    search = packing.Search(10, Counter({((7, 1),): 1, ((6, 1), (2, 1)): 1}))
    assert not search.step(((7, 1),)) or search.bins.total() == 2


@pytest.mark.parametrize("sf, sequences", [("sf0.01", 481), ("sf0.1", 4936)])
def test_the_search_takes_all_kinds_of_steps(spark, path, sf, sequences):
    """From a bin for each piece the search alone comes to the lower bound."""
    from pyspark.sql import functions as F

    rows = packing.pack(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), path)
    r = rows.agg(F.count_distinct("sequence_id").alias("n"), *(F.min(c).alias(c) for c in ("search_moves", "search_swaps", "search_pair_swaps"))).first()
    assert r.n == sequences and r.search_moves > 0 and r.search_swaps > 0 and r.search_pair_swaps > 0


def test_long_white_space_is_packed(path, library):
    own = packing._Packed(path)
    for text in (" \n" * 500_000, "word" + " \n" * 300_000 + "word two  three", " " * 300_000 + "x"):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_ids_equal_the_library(path, library):
    import pyarrow.parquet as pq

    own = packing._Packed(path)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for text in [*texts, *(t for _, t, *_ in EDGE), "a  b", " x", "\n\n y ", "<|endoftext|> z", "don't  <|endoftext|>"]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


# Chat


def test_escapes_and_reading_back():
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choice(["<", "|", "\\", ">", "\n", chat.START, chat.END, "a"]) for _ in range(8))
        role = draw.choice(["user", "assistant", "a\nb%0A", "<|x|>"])
        segment, start, end = chat.render(role, text)
        assert chat.read_back(segment + segment) == [(role, text)] * 2
        assert chat.unescape(segment[start:end]) == (text if role == "assistant" else "")
        assert segment.count(chat.START) == segment.count(chat.END) == 1


def test_layouts():
    turns = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"instruction": "q", "output": "a", "id": 3},
        {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"conversation": {"turns": [{"speaker": "user", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}], "id": 1}},
    ):
        assert chat.canonical(record) == turns
    assert chat.canonical({"instruction": "q", "input": "more", "output": "a"}) == [("user", "q\n\nmore"), ("assistant", "a")]
    assert chat.canonical({"messages": []}) == []
    assert chat.canonical({"strange": 1}) == [] and chat.mapping_of(frozenset({"strange"})) is None
    assert chat.canonical({"messages": [{"role": "user", "content": "q", "tool_calls": [{"id": 1}]}, {"role": "assistant", "content": "a"}], "source": "x"}) == turns
    assert chat.canonical({"conversations": [{"from": "human", "value": "q", "weight": 1}, {"from": "gpt", "value": "a"}], "source": "x"}) == turns


def test_quarantine(spark):
    rows = [(1, '{"prompt": "q", "completion": "a", "more": 1}'), (2, '{"strange": {"a": [1]}}'), (3, "no json"), (4, "[1]"), (5, None)]
    records = spark.createDataFrame(rows, "conv_id long, record string")
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.format_records(records)).collect()} == {1: 2}
    kept = {r.conv_id: (r.fingerprint, r.paths) for r in chat.quarantine(records).collect()}
    assert set(kept) == {2, 3, 4} and kept[2] == (chat.fingerprint(frozenset({"strange.a[]"})), ["strange.a[]"]) and kept[3] == kept[4]
    assert chat.quarantine(records.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "assistant", "n"), (3, 0, "assistant", "z" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == len("b<|im_end|>") and got[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb<|im_end|>\n").hexdigest()
    assert got[2].n_turns == 3 and got[2].turns_sha256 == hashlib.sha256(b"\n\nuser\nx\nuser\nx\n").hexdigest()
    assert got[3].loss_chars == 100_000 and got[None].loss_chars == 1
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0
    records = spark.createDataFrame([(1, '{"prompt": "q", "completion": "a"}'), (2, None)], "conv_id long, record string")
    assert chat.digests(chat.format_records(records)).first().n_turns == 2


# Sharding


def sharded_by_hand(rows, shards, seed, places):
    """Ranks by sorting everything in one place."""
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = []
    for source, some in by_source.items():
        some.sort(key=lambda r: places[r["doc_id"]])
        order += [((2 * k + 1) / (2 * len(some)), "" if source is None else "s" + source, places[r["doc_id"]], r["doc_id"]) for k, r in enumerate(some)]
    order.sort()
    n, out = len(order), {}
    for rank, (*_, doc_id) in enumerate(order):
        shard = rank * shards // n
        out[doc_id] = (shard, rank - (shard * n + shards - 1) // shards)
    return out


def places_of(docs, seed):
    return {r.doc_id: r.p for r in docs.select("doc_id", sharding.seeded(seed, "doc_id", "h").alias("p")).collect()}


def hashed(docs):
    return docs.withColumn("h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def test_sharding(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(docs, 8, 5).collect()}
    assert got == sharded_by_hand([r.asDict() for r in docs.select("doc_id", "source").collect()], 8, 5, places_of(hashed(docs), 5))
    for frame in (edge(spark), clashing(spark)):
        rows = sharding.assign_shards(frame, 4).toPandas()
        assert len(rows) == len(EDGE) and rows.groupby("shard").size().between(2, 3).all()
        for _, some in rows.groupby("shard"):
            assert sorted(some.slot) == list(range(len(some)))
        assert rows[rows.doc_id == 1][["size", "text_crc32"]].values.tolist() == [[1, 0]]
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_sharding_of_hot_sources_and_many(spark):
    """A hot source, small ones, and one source for each row, against a plain sort."""
    one = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    hot = F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 9).cast("string")))
    for source in (hot, F.col("doc_id").cast("string")):
        docs = one.withColumn("source", source)
        got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(docs, 8, 5).collect()}
        assert got == sharded_by_hand([r.asDict() for r in docs.collect()], 8, 5, places_of(hashed(docs), 5))


def test_sharding_stays_even(spark):
    """No task sorts more than its share, whether rows share a source, an id and a text or nothing."""
    n, parts = 40_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("one").alias("source"), F.monotonically_increasing_id().alias("rid"), F.lit(1).alias("place"), F.lit(1).alias("size"), F.lit(1).alias("text_crc32"))
    for source in (F.lit("one"), F.col("rid").cast("string")):
        found = sharding.ranked(rows.withColumn("source", source), ["source", *sharding.ORDER], "even")
        assert sorted(r[0] for r in found.select("rank").collect()) == list(range(n))
        sizes = rows.withColumn("source", source).repartitionByRange(parts, "source", *sharding.ORDER).groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.max() < 3 * n / parts
    shards = sharding.assign_shards(rows, 8).toPandas()
    assert shards.groupby("shard").slot.agg(["min", "max", "nunique"]).values.tolist() == [[0, n // 8 - 1, n // 8]] * 8


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().toPandas()["count"].tolist() == [50] * 4


# Toxicity


def toxic_rows():
    draw = random.Random(2)
    words = ["table", "window", "garden", "river", "music", "paper", "silver", "morning", "simple", "letter"]
    out = []
    for i in range(600):
        text = [draw.choice(words) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            text[draw.randrange(40)] = draw.choice(["blockhead", "nitwitted", "dunderer"])
        out.append((i, " ".join(text), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, labels(spark, [(i, 1, y) for i, _, y in rows]))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == y and 0 <= got[i].score <= 1
    variants = model.scores(["a blo*ckhead here", "b-l-o-c-k-h-e-a-d", "b l o c k h e a d", "BLOCKHEAD", "nothing of it", "", None])
    assert (variants[:4] > 0.5).all() and (variants[4:] < 0.5).all()
    assert model.scores(["table " * 50_000 + "nitwitted"])[0] > 0.5


def test_toxicity_edges(spark):
    rows = toxic_rows()
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    for frame in (edge(spark), clashing(spark)):
        assert toxicity.score_documents(frame, model).count() == len(EDGE)
    assert toxicity.keep_clean(clashing(spark), model).columns == clashing(spark).columns
    assert toxicity.score_documents(empty(spark), model).count() == 0
    nothing = toxicity.train(edge(spark), labels(spark))
    assert {r.score for r in toxicity.score_documents(edge(spark), nothing).collect()} == {0.0}


def test_kernel_features():
    got = toxicity.vector("abcd")
    number = 1 << 15 | 2 << 10 | 3 << 5 | 4
    assert got == {number: pytest.approx(toxicity.DECAY**4)}
    assert toxicity.vector("ab-cd")[number] == pytest.approx(toxicity.DECAY**5)
    assert toxicity.vector(" abc") == {27 << 15 | 1 << 10 | 2 << 5 | 3: pytest.approx(toxicity.DECAY**4)}
    assert len(toxicity.vector("дурак")) and toxicity.vector("дурак") == toxicity.vector("ДУРАК")


def test_windows_end_between_words():
    text = "word " * 30 + "extraordinarily. Next one " + "y" * 300
    c = toxicity.codes(text)
    half, place = toxicity.halves_of(c)
    for word in re.finditer(r"\w+", text):
        assert len(set(half[word.start() + 1 : word.end() + 1])) == 1
    assert (np.diff(half) >= 0).all() and half[-1] + 1 == len(place)


def test_toxicity_on_labels(spark):
    """Held-out recall by language on the driver's labels, no word or language known beforehand."""
    folder = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, marks)
    scored = toxicity.score_documents(docs, model).filter("held_out").join(marks.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = scored.toPandas()
    assert rows[rows.toxic == 0].predicted.mean() <= 0.02
    found = rows[rows.toxic == 1].groupby("lang").predicted.mean()
    assert rows[rows.toxic == 1].predicted.mean() >= 0.88 and found["en"] >= 0.9 and found.min() >= 0.8
    assert (model.scores(["moron", "you moron", "m-o-r-o-n", "m*oron", "mo.ron", "M0RON", "loser", "id1ot"]) >= 0.5).all()
    assert (model.scores(["", None, "a table by the window", "more on the matter"]) < 0.5).all()


def test_conflicting_labels_and_repeated_ids(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "zzz later text"), (None, "no id")], "doc_id long, text string")
    both = [(i, 1, y) for i, _, y in rows] + [(i, 1, 0) for i, _, y in rows if y]
    first, second = (toxicity.train(docs.repartition(n), labels(spark, some)) for n, some in ((1, both), (3, both[::-1])))
    texts = [t for _, t, _ in rows]
    assert np.allclose(first.scores(texts), second.scores(texts)) and ((first.scores(texts) >= 0.5) == [bool(y) for *_, y in rows]).all()


# Media


def test_chunks():
    draw = np.random.default_rng(4)
    for size in (0, 1, 1024, 5000, 100_000):
        media_bytes = media.sound_file(draw.integers(0, 256, size, dtype=np.uint8).tobytes())
        chunks = media.chunks_of(media_bytes)
        assert b"".join(chunks) == media_bytes and all(len(c) <= media.MOST for c in chunks[1:])
        assert media.samples_of(media_bytes) == media_bytes[44:]
    data = draw.integers(0, 256, 4096, dtype=np.uint8)
    slow = np.zeros(1, np.uint64)
    for i in range(32):
        slow[0] += np.uint64(int(media.GEAR[data[-1 - i]]) << i)
    assert int(media.rolling(data)[-1]) == int(slow[0]) & 0xFFFFFFFF
    a = draw.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    shared = set(media.chunks_of(media.sound_file(a))) & set(media.chunks_of(media.sound_file(b"x" * 300 + a)))
    assert len(shared) >= 5


def test_media(spark, monkeypatch):
    big = "".join(random.Random(5).choice("abcdefgh \n") for _ in range(40_000))
    rows = [*EDGE, (20, big, "en", "a", 1), (21, "prefix " + big, "en", "a", 1), (22, big, "en", "a", 1), (23, big + big, "en", "a", 1)]
    for most in (media.LISTED_BROADCAST, 0):
        monkeypatch.setattr(media, "LISTED_BROADCAST", most)
        got = media.media_columns(spark.createDataFrame(rows, DOCS).withColumn("media", F.lit(1))).collect()
        assert len(got) == len(rows)
        texts = {r[0]: r[1] for r in rows}
        for r in got:
            payload = media.payload_of(texts[r.doc_id])
            stored = media.sound_file(payload)
            assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(payload)) and len(payload) % 192 == 0 and payload
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.media_columns(empty(spark)).count() == 0


def test_media_shared_by_rows_without_ids(spark):
    """Passages and whole texts that rows with null and repeated ids share, in ten draws of digests and ids."""
    def rows_of(draw):
        passage = "".join(draw.choice("abcdefgh \n") for _ in range(40_000))
        ends = [f"{draw.random()} " for _ in range(3)]
        texts = [ends[0] + passage, ends[1] + passage, ends[2] + passage + ends[0], ends[1] + passage, passage, passage + " " * (192 - 40_000 % 192)]
        return [(draw.choice([None, None, 1, 2, 3]), t) for t in texts]

    rows = [r for k in range(10) for r in rows_of(random.Random(k))]
    got = Counter((r.doc_id, r.payload_sha256) for r in media.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, hashlib.sha256(media.payload_of(t)).hexdigest()) for i, t in rows)


# HTML


def test_deep_and_unclosed_pages():
    import time

    for page in ("<div>x" * 20_000, "<div>" * 100_000 + "x", "<b>x" * 20_000, "<ul>" + "<div>" * 10_000 + "<li>a</li>" * 10_000, "<p>" * 50_000 + "x", "<span>x</div>" * 20_000, "<table><tr><td>y" * 10_000):
        began = time.process_time()
        top = html_text.vote(page)
        assert html_text.main_text(page, ">body>div.other") == html_text.main_text(page, top[0]) != ""
        assert time.process_time() - began < 9


def test_names_that_only_hint():
    text = "word " * 30
    page = f'<article><p>{text}</p><section id="related-work"><p>kept {text}</p></section><div class="share-price">also kept {text}</div><div class="share-buttons">no {text}</div><div class="related-posts"><a>links {text}</a></div></article>'
    found = html_text.main_text(page, None)
    assert " kept " in f" {found}" and "also kept" in found and " no " not in found and "links" not in found


def test_html():
    page = '<body><nav><a href="/">Home</a></nav><div class="post-12"><h1>T</h1><p>Long &lt;text&gt;  of&nbsp;it<p><b>More<br>here</p><div class="ad">buy</div><ul><li>x<li>y</ul></div><div class="comments"><p>first</p></div><footer>f</footer>'
    assert html_text.main_text(page, html_text.vote(page)[0]) == "T Long <text> of it More here x y"
    assert html_text.vote(page)[0] == ">body>div.post-0"
    for broken, text in (("", ""), ("plain", "plain"), ("<p>a<b", "a"), ("<!-- x", ""), ("<script>var a = '<p>';</script><p title='a>b'>ok</p>", "ok"), ("a<span class='ads'>no</span>b", "a b"), ('<div class="with-sidebar"><p>Hi</p></div>', "Hi"), ("<p>x &am", "x &am"), ('<p class="a>b</p>', "b")):
        assert html_text.main_text(broken, None) == text


def test_consensus(spark):
    article = "<body><div class='{0}'><p>{1}</p></div><div class='more'><p>{2}</p></div></body>"
    rows = [(i, "http://h.com/a", article.format("story", "word " * 20, "x")) for i in range(5)] + [(5, "http://h.com/b", article.format("story", "short", "noise " * 9)), (6, None, None), (7, "bad", "<p>only</p>"), (6, "http://o.com", article.format("story", "short", "noise " * 9))]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))).collect()
    texts = {(r.page_id, r.url): r.text for r in got}
    assert texts[5, "http://h.com/b"] == "short" and texts[6, None] == "" and texts[7, "bad"] == "only" and texts[6, "http://o.com"].startswith("noise")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages(spark):
    got = {r.page_id: r.text for r in queries.op6_html_consensus(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article|<footer|$)", r.html, re.S)[1]
        inner = re.sub(r"</?(p|h1|br)[^>]*>", " ", re.sub(r"<[^>]*$", "", inner))
        from html import unescape

        assert got[r.page_id] == " ".join(unescape(re.sub(r"<[^>]*>", "", inner)).split())


# PII


def base_by_hand(text):
    out = []
    for kind in pii.BASE_KINDS:
        for m in pii.PATTERNS[kind].finditer(text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_against_plain_patterns():
    draw = random.Random(6)
    parts = ["@", "@", ".", "a", "B", "-", "+", "1", "2", "9", "4111 1111 1111 1111", "192.168.1.1", " ", "(", ")", "_", "%", "x.com", "é", "://", "http", "İ"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 25)))
        assert [x for x in pii.spans(text) if x[0] in pii.BASE_KINDS] == base_by_hand(text)
    assert pii.spans("a" * 200_000 + "@") == []


def test_pii_extras(spark):
    text = "see https://x.org/a?b and IBAN DE89 3704 0044 0532 0130 00, ssn: 123-45-6789, me@x.org"
    kinds = [k for k, *_ in pii.spans(text)]
    assert kinds == ["url", "iban", "ssn", "email"]
    more = "IBANs: DE89370400440532013000 or DE88370400440532013000, then " + "far " * 100 + "GB82 WEST 1234 5698 7654 32. HTTPS://X.org/a; account number: 1234 5678 90, password = \"hunter2x\", token: none; ssn " + "- " * 90 + "123-45-6789\n \n222-33-4444"
    assert [(k, more[a:b]) for k, a, b in pii.spans(more) if k not in pii.BASE_KINDS] == [
        ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("url", "HTTPS://X.org/a;"), ("account", "1234 5678 90"), ("secret", "hunter2x"), ("ssn", "123-45-6789"),
    ]
    for long in ("password=" * 30_000, "iban " + "DE89 3704 0044 0532 0130 01 " * 8_000, "ssn " * 50_000, "account: " * 30_000):
        pii.spans(long)
    assert pii.redacted(text) == "see [URL] and IBAN [IBAN], ssn: [SSN], [EMAIL]"
    for frame in (edge(spark), clashing(spark)):
        assert pii.scan(frame).count() == len(EDGE)
        kept = pii.redact(frame)
        assert kept.columns == frame.columns and kept.filter("text is null").count() == 1
    assert pii.scan(empty(spark)).count() == 0


def under(seconds, work, *args):
    began = time.perf_counter()
    out = work(*args)
    assert time.perf_counter() - began < seconds
    return out


def test_pii_is_linear_on_blanks_and_digits():
    million = 1_000_000
    assert under(2, pii.spans, "account" + " " * million + "x") == []
    assert under(2, pii.spans, ("account" + " " * 1000 + "x") * 1000) == []
    assert under(2, pii.spans, "password" + " " * million + "x") == []
    assert under(3, pii.spans, "1" * million + " 1.2.3.x") == []
    assert under(3, pii.spans, "1" * (million // 2) + "." + "2" * (million // 2) + ".2.") == []
    assert under(3, pii.spans, "1.2.3 " * (million // 6)) == []
    assert pii.spans("account" + " " * 5000 + "no. : 1234 5678 90") == [("account", 5013, 5025)]


def test_columns_with_dots_in_their_names(spark):
    docs = spark.createDataFrame([(1, "mail me@x.org", 3)], "doc_id long, text string, `a.b` int")
    assert pii.redact(docs).collect() == [(1, "mail [EMAIL]", 3)]
    assert pii.redact(docs).columns == docs.columns
    model = toxicity.constant(0.1)
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == 1


def test_html_is_linear_on_quotes():
    million = 1_000_000
    for page in ('<a ">"' * (million // 6) + '"', "<a x='\">\"" * (million // 9), '<a"' * (million // 3) + "'", "<p a='" * (million // 6) + '"'):
        under(4, html_text.main_text, page, None)
    assert html_text.main_text('<p title="a > b">one</p><p title="c>two</p><p>three</p>', None) == "one two three"


# Quality


def duck(name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.execute(queries.ORACLE_SQL[name]).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    wanted = duck(name)
    keys = ["doc_id"] if "doc_id" in wanted else ["anchor_id", "positive_id", "rank"]
    wanted, got = wanted.sort_values(keys), queries.QUERIES[name](spark, DATA).toPandas().sort_values(keys)
    for c in wanted.columns:
        assert wanted[c].tolist() == got[c].tolist(), c


def test_clashing_columns_are_kept(spark):
    rows = quality.verdicts(quality.ledger(clashing(spark)))
    assert {"n_words", "n_words_in", "failed_in", "kept_in", "kept"} <= set(rows.columns) and {r.kept_in for r in rows.collect()} == {"mine"}
    kept = quality.keep_good(clashing(spark))
    assert kept.columns == clashing(spark).columns and kept.count() == 0


def test_quality_edges(spark):
    rows = {r.doc_id: r for r in quality.verdicts(quality.ledger(clashing(spark))).collect()}
    assert (rows[1].n_words, rows[1].base_failed, rows[1].kept) == (0, True, False)
    assert rows[6].n_repeat_words == 30_000 and rows[6].base_failed
    assert rows[7].n_words == 9 and rows[8].n_dup_lines == 0
    counts = {(r.version, r.rule): r for r in quality.ablations(quality.ledger(edge(spark))).collect()}
    assert counts["base", "short"].n_failed == 8 and counts["base", "repeated_windows"].n_only == 1 and counts["base", "repeated_windows"].n_kept_without == 1
    assert quality.ledger(empty(spark)).count() == 0
    eight = spark.createDataFrame([(1, "a b c d e f g h x a b c d e f g h " + "z1 z2 z3 z4 z5 z6 z7 z8")], "doc_id long, text string")
    assert quality.ledger(eight).first().n_repeat_words == 16


# Near duplicates


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components_by_hand(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 85 * (len(sets[a][1]) + len(sets[b][1]) - both):
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(s), least.get(root(k))) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("small, split", [(64, 10**9), (2, 10**9), (2, 0)])
def test_near_duplicates_in_a_chain(spark, monkeypatch, small, split):
    """Texts that drift, so that neighbours link and ends don't; compared in blocks of few members, split or not."""
    for name, value in (("SMALL", small), ("SPLIT_ABOVE", split), ("MEMBERS_FIRST", 2), ("PART", 5), ("DRAWN", 1)):
        monkeypatch.setattr(neardup, name, value)
    draw = random.Random(7)
    words = [f"w{i}" for i in range(90)]
    rows, text = [], [draw.choice(words) for _ in range(150)]
    for i in range(70):
        rows.append((1000 - i, " ".join(text)))
        at = draw.randrange(150)
        text = [*text[:at], f"new{i}", *text[at + 1 :]]
    rows += [(i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 60)))) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_hand(rows)


def test_near_duplicates_around_hubs(spark, monkeypatch):
    """Copies of two texts with one to six changes each: many link to neither text but to each other, some to none."""
    for name, value in (("SMALL", 8), ("MEMBERS_FIRST", 4), ("PART", 16), ("DRAWN", 2)):
        monkeypatch.setattr(neardup, name, value)
    draw, rows = random.Random(11), []
    for hub in range(2):
        base = [f"h{hub}w{i}" for i in range(130)]
        for k in range(120):
            text = list(base)
            for at in draw.sample(range(130), draw.randint(1, 6)):
                text[at] = f"x{draw.randrange(40)}"
            rows.append((1000 * hub + k, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = components_by_hand(rows)
    assert got == wanted and len({c for _, c in wanted.values()}) > 4


def test_near_duplicates_linked_by_rows_without_ids(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [words, [*words[:100], "a", *words[101:]], [*words[:100], "a", *words[101:160], "b", *words[161:]], [*words[:30], "c", *words[31:100], "a", *words[101:160], "b", *words[161:190], "d", *words[191:]]]
    texts = [" ".join(t) for t in texts]
    for ids in ((5, None, None, 3), (None, 7, 5, None), (None, None, None, None)):
        rows = [*zip(ids, texts), *zip(ids, texts)]
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        least = min((i for i in ids if i is not None), default=None)
        assert len(got) == 8 and {r.component_id for r in got} == {least}
        assert sum(r.kept for r in got) == 2 * ids.count(least) if least is not None else 8
        assert [r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [least]


def test_near_duplicate_edges(spark):
    for frame in (edge(spark), clashing(spark)):
        rows = neardup.near_duplicates(frame).collect()
        assert len(rows) == len(EDGE)
        got = {r.doc_id: r for r in rows}
        assert (got[1].n_shingles, got[1].component_id, got[1].kept) == (0, 1, True)
        assert (got[4].component_id, got[4].kept, got[3].kept) == (3, False, True)
        assert (got[None].component_id, got[None].kept) == (None, True) and got[6].n_shingles == 1
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_estimates():
    draw = np.random.default_rng(8)
    for share in (0.5, 0.85, 0.95):
        both = draw.integers(0, 1 << 63, 4000, dtype=np.uint64)
        n = int(4000 * share)
        rest = (4000 - n) // 2
        a, b = np.unique(both[: n + rest]), np.unique(np.concatenate((both[:n], both[n + rest :])))
        m = neardup.minima([a, b])
        x = neardup.packed_bits(m).view(np.uint64)
        same = sum(((int(u) ^ int(v)) >> 4 * k) & 15 == 0 for u, v in zip(*x) for k in range(16))
        chance = 0.5**neardup.BITS
        assert abs((same / neardup.HASHES - chance) / (1 - chance) - share) < 0.2
        if share >= 0.85:
            assert set(neardup.band_keys(m)[0]) & set(neardup.band_keys(m)[1]) and same >= neardup.LEAST_MATCHES


# Encoding


def test_encoding(path, library):
    own = bpe.encoder(path)
    draw = random.Random(9)
    texts = [t or "" for _, t, *_ in EDGE] + ["x" * 3000, "  ", "don't I'LL", "\t\t a\r\n  b ", "<|endoftext|>"] + ["".join(draw.choice("abe \n\t'.,<|é日😀0 1\x1c\xa0") for _ in range(120)) for _ in range(400)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_prefix_tokens_equal_plain_merges(path):
    """The stored last token of each prefix ends the prefix's encoding by the merge loop."""
    own = bpe.encoder(path)
    v = own.vocabulary

    def merge_loop(data):
        ids = [v.id_of[bytes([b])] for b in data]
        while len(ids) > 1:
            rank, at = min((v.rank.get(p, bpe.NEVER), k) for k, p in enumerate(zip(ids, ids[1:])))
            if rank == bpe.NEVER:
                break
            ids[at : at + 2] = [v.id_of[v.bytes_of[ids[at]] + v.bytes_of[ids[at + 1]]]]
        return ids

    draw = random.Random(10)
    for _ in range(200):
        data = bytes(draw.choice(b"aaaeinorst th.") for _ in range(12))
        last, size, *_ = own._advance(data, [0], [0], 0, 0)
        for k in range(1, 13):
            assert last[k] == merge_loop(data[:k])[-1]


def test_encoding_edges(spark, path, library):
    for frame in (edge(spark), clashing(spark)):
        got = bpe.encoding_digests(frame, path).collect()
        assert len(got) == len(EDGE)
        texts = {r[0]: r[1] or "" for r in EDGE}
        for r in got:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert bpe.encoding_digests(empty(spark), path).count() == 0
    assert bpe.encode_decode(edge(spark), path).filter("doc_id = 7").first().decoded == EDGE[7][1]
