"""The corpus pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from veritide.llm import neardup, pii, toxicity
from veritide.scratch import written

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    kept = written(stages["quality rules"](spark, docs, DATA), "t")
    assert kept.columns == columns
    short = {r.doc_id for r in docs.collect() if len(r.text.split()) < 20}
    left = {r.doc_id for r in kept.collect()}
    assert left and not left & short

    clean = written(stages["toxicity"](spark, kept, DATA), "t")
    model = toxicity.train(kept, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = kept.collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r, s in zip(rows, model.scores([r.text for r in rows])) if s < 0.5}

    single = written(stages["near duplicates"](spark, clean, DATA), "t")
    rows = sorted(clean.collect())
    sets, parent = [shingles(r.text) for r in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id for r in single.collect()} == {rows[k].doc_id for k in range(len(rows)) if root(k) == k}
    assert single.columns == columns

    redacted = written(stages["personal data"](spark, single, DATA), "t")
    assert redacted.columns == columns
    texts = {r.doc_id: r.text for r in single.collect()}
    assert {r.doc_id: r.text for r in redacted.collect()} == {i: pii.redacted(t) for i, t in texts.items()}

    last = stages["packing"](spark, redacted, DATA).toPandas()
    assert set(last.doc_id) == set(texts) and last.groupby("sequence_id").length.sum().max() <= 2048
    whole = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(whole.ids_crc32) == sorted(last.ids_crc32)
    assert np.array_equal(np.sort(whole.length), np.sort(last.length))


def test_nulls_clashes_and_nothing(spark):
    schema = "doc_id long, text string, n_words string, failed string, kept string, row string, score string, digest string"
    some = spark.createDataFrame([(1, None, *"abcdef"), (None, "x " * 30, *"abcdef"), (3, " ".join(f"w{i}" for i in range(40)), *"abcdef"), (3, " ".join(f"w{i}" for i in range(40)), *"abcdef")], schema)
    for docs in (some, some.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            docs = written(out, "t")
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count()
    assert docs.agg(F.count("*")).first()[0] == 0


def test_near_copies_from_80_percent(spark):
    """The near-duplicate stage by brute force at 0.80; the table holds pairs between 0.80 and 0.85."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    drift = [" ".join(f"w{k}" for k in range(200))]
    for i in range(40):  # neighbours share 81 or 85 percent and more, ends nothing
        words = drift[-1].split()
        at = 5 * (i % 36)
        drift.append(" ".join([*words[:at], *(f"n{i}x{k}" for k in range(16 + 2 * (i % 4))), *words[at + 16 + 2 * (i % 4) :]]))
    docs = docs.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(drift)], "doc_id long, text string"))
    rows = sorted(docs.collect())
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))
    between = 0
    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 80 * either:
                between += 100 * both < 85 * either
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    single = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, DATA)
    assert between >= 10 and {r.doc_id for r in single.collect()} == {rows[k].doc_id for k in range(len(rows)) if root[k] == k}


def test_rounds_on_short_tables_take_no_exchange(spark, monkeypatch):
    """Labels of a long chain and a star, in one task and by exchanges; each exchange or broadcast costs the driver memory."""
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 50)]
    edges = neardup.stored(spark.createDataFrame(pairs, "a long, b long").repartition(4), "t")
    found = neardup.stored(neardup.flooded(edges.frame, 1, edges.rows), "t")
    for df in (neardup.contracted(edges.frame, found, edges.rows), neardup.labelled(edges.frame, found, edges.rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    for most in (0, neardup.SHORT):
        monkeypatch.setattr(neardup, "SHORT", most)
        links = neardup.Links(None, 80)
        links.flood(spark.createDataFrame(pairs[::2], "a long, b long"), len(pairs))
        links.join_up()
        links.flood(neardup.contracted(spark.createDataFrame(pairs[1::2], "a long, b long"), links.labels, len(pairs)), len(pairs))
        links.join_up()
        labels = {r.id: r.label for r in links.labels.frame.collect()}
        assert set(labels) == {x for p in pairs for x in p} and len(set(labels.values())) == 2
        assert len({labels[k] for k in range(301)}) == 1
