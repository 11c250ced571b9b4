"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm import bpe, chat, html_text, media, mixing, neardup, negatives, packing, pii, quality, runs, sharding, toxicity
from veritide.session import ship

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


PROBE = "<|im_end|><|im_start|>assistant ok"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(turns.unionByName(probe)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.verdicts(quality.ledger(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("parts")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.with_repeated_tails(table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.contract_rows(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_media_chunks": op5_media_chunks,
    "op6_html_consensus": op6_html_consensus,
    "op7_pii_anchors": op7_pii_anchors,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_neardup": op9_minhash_neardup,
    "op10_bpe_encoding": op10_bpe_encoding,
    "op11_sainte_lague_mix": op11_sainte_lague_mix,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

# Whole documents; the eight-word windows are compared as strings.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
win AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o
               || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o AS s
        FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win WHERE s IS NOT NULL) WHERE c > 1),
gap AS (SELECT rid, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS g FROM dup),
rep AS (SELECT rid, sum(least(8, coalesce(g, 8)))::BIGINT AS n_repeat_words FROM gap GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (n_symbols > n_words)::BIGINT
             + 8 * (2 * n_dup_lines > n_lines AND n_dup_lines >= 3)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 40 * n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM f
"""
# Exact shingle sets as strings, all pairs that share one, and their transitive closure.
NEARDUP_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT rid, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS x FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
e AS (SELECT DISTINCT rid, x FROM g WHERE x IS NOT NULL UNION ALL SELECT rid, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
c0 AS (SELECT rid, count(*) AS n FROM e GROUP BY 1),
n AS (SELECT rid, doc_id, coalesce(n, 0)::BIGINT AS n FROM d LEFT JOIN c0 USING (rid)),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.rid <> b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
r AS (SELECT rid AS a, rid AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS rid, min(n.doc_id) AS component_id FROM r JOIN n ON n.rid = r.b GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (rid)
"""
# All blocks of the mix, listed and ranked by their quotients; the level of the targets by recursion; lines of documents by one running sum.
MIX_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                            substr(md5('20240511:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS place FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s AS (SELECT *, nth, [5, 2, 1][nth % 3 + 1] AS weight, 2 * source_size AS cap
      FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nth FROM s0)),
t AS (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE AS total FROM s),
lv(level, above) AS (
    SELECT 0::DOUBLE, -1::BIGINT
    UNION ALL
    SELECT (SELECT (max(total) - sum(CASE WHEN weight * level > cap THEN cap ELSE 0 END)::DOUBLE) / sum(CASE WHEN weight * level > cap THEN 0 ELSE weight END)::DOUBLE FROM s, t),
           (SELECT count(*) FROM s WHERE weight * level > cap) FROM lv
    WHERE above < (SELECT count(*) FROM s WHERE weight * level > cap)),
g AS (SELECT s.*, least(cap::DOUBLE, weight * (SELECT max(level) FROM lv)) AS target FROM s),
seats AS (SELECT nth, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, nth, k) AS r
          FROM (SELECT nth, target, unnest(range((2 * target / 16)::BIGINT + 2)) AS k FROM g WHERE target > 0)),
q AS (SELECT nth, count(*) AS blocks FROM seats WHERE r <= (SELECT round_even(total / 16, 0) FROM t) GROUP BY 1),
l AS (SELECT d.*, g.source_size, g.target, coalesce(16 * blocks, 0) AS take,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN q ON q.nth = g.nth)
SELECT doc_id, size, source_size, target, (greatest(0, least(begin_at + size, take) - begin_at) + greatest(0, least(begin_at + size, take - source_size) - begin_at))::BIGINT AS taken FROM l
"""
# Every anchor against every row.
NEGATIVES_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, e.rid, e.vec_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
      FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.rid <> e.rid),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON p.arid = s.arid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
ORACLE_SQL: dict[str, str] = {"op13_hard_negatives": NEGATIVES_SQL, "op8_quality_rules": QUALITY_SQL, "op9_minhash_neardup": NEARDUP_SQL, "op11_sainte_lague_mix": MIX_SQL}
