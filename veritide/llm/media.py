"""Media columns in content-defined chunks.

A text's payload is stored as 8-bit samples of a sound file (WAV, mono). The file's
bytes are cut where a rolling gear hash has twelve zero bits, so equal stretches of
different files give equal chunks; the header is a chunk of its own.

1. One pass notes each row's file digest and the digests of its chunks, no bytes.
2. Joins of digests find one owner of each chunk: the first position in the first file
   that has it. Files that equal another's are stored by the row with the smallest id;
   chunks below the least size, such as headers, stay with their files.
3. A second pass writes the store: per file its ordered chunk list, with bytes of the
   chunks it owns. What isn't plain about a file reaches its rows by a hash of their
   text and is checked against the file's digest, so ids that are null or repeat change
   nothing. That list is broadcast while it is short and joined by a shuffle beyond.
4. Reading back, files that own all their chunks are rebuilt where they lie; the others
   get their missing chunks by a join on digests, so only shared bytes move. Every chunk
   and every file is checked against its digest.

Defined results: null and empty texts are a payload of 192 spaces; equal texts share
one file and all values; rows with ids that repeat or are null get the values of their
texts (where no row of a file has an id, each stores it, and one copy is read); texts
may be of any length below 4 GiB; other columns are ignored, whatever their names; an
empty table gives none. A digest that doesn't match, or a file or chunk that is missing,
raises an error; no row is ever left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.scratch import new_path, written

UNIT, HEADER, RATE = 192, 44, 8_000
LEAST, MOST, ZERO_BITS = 1_024, 16_384, 12
GEAR = np.random.default_rng(20_240_504).integers(0, 1 << 32, 256, dtype=np.uint32)
#: The list of rows that share chunks may be broadcast up to so many rows and positions (under 60 MB).
LISTED_BROADCAST = 300_000

CHUNKS = "array<struct<digest:binary,data:binary,given:boolean>>"


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def sound_file(payload: bytes) -> bytes:
    """An unsigned 8-bit mono WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(media: bytes) -> bytes:
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, kind, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) != HEADER + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER:]


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash over the last 32 bytes at each position: windows of 1, 2, 4 ... 32 bytes by doubling."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            before = h[:-width] << np.uint32(width)
            h = h.copy()
            h[width:] += before
    return h


def cuts(media: bytes) -> list[int]:
    """Where chunks end: after the header, at zero bits of the hash, within the size limits."""
    out, last = [HEADER], HEADER
    size = len(media)
    if size - HEADER > LEAST:
        hits = np.flatnonzero(rolling(np.frombuffer(media, np.uint8, offset=HEADER)) >> np.uint32(32 - ZERO_BITS) == 0) + HEADER + 1
        for at in hits.tolist():
            while at - last > MOST:
                last += MOST
                out.append(last)
            if LEAST <= at - last and at < size:
                last = at
                out.append(last)
    while size - last > MOST:
        last += MOST
        out.append(last)
    return [*out, size]


def chunks_of(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def short(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, by which notes find their rows."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))


def chunk_index(docs: DataFrame) -> DataFrame:
    """doc_id, file digest and ordered chunk digests of each row; null for chunks too short to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists, sizes = [], [], []
            for t in batch.column(1):
                media = sound_file(payload_of(text := t.as_py()))
                keys.append(hashlib.sha256(media).digest())
                lists.append([short(c) if len(c) >= LEAST else None for c in chunks_of(media)])
                sizes.append(len((text or "").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "text_hash", "n_bytes", "media", "digests"])

    return hashed(docs).mapInArrow(run, "doc_id long, text_hash long, n_bytes long, media binary, digests array<binary>")


def special_files(index: DataFrame) -> DataFrame:
    """Per hash of a text what isn't plain about its file: [(file, the id that stores it, positions owned elsewhere, positions others need)]."""
    files = index.groupBy("media").agg(F.min("doc_id").alias("home"), F.count("*").alias("n"), F.first("digests").alias("digests"))
    files = written(files, "media-files")
    places = files.select("media", F.posexplode("digests").alias("pos", "digest")).filter("digest is not null")
    owners = places.groupBy("digest").agg(F.min(F.struct("media", "pos")).alias("owner"), F.count("*").alias("n")).filter("n > 1").select("digest", "owner")
    # A table of its own, so that adaptive plans can split the places of one passage.
    shared = places.join(written(owners, "media-owners"), "digest").select("media", "pos", (F.struct("media", "pos") == F.col("owner")).alias("owns"))
    at = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("pos"))))
    lists = shared.groupBy("media").agg(at(~F.col("owns")).alias("lacks"), at(F.col("owns")).alias("gives"))
    none = F.array().cast("array<int>")
    notes = files.filter("n > 1").select("media").unionByName(lists.select("media")).distinct().join(lists, "media", "left").join(files.select("media", "home"), "media")
    notes = written(notes.select("media", F.struct("media", "home", F.coalesce("lacks", none).alias("lacks"), F.coalesce("gives", none).alias("gives")).alias("what")), "media-notes")
    return index.select("text_hash", "media").distinct().join(notes, "media").groupBy("text_hash").agg(F.collect_list("what").alias("what"))


def store(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each file: its digest and its ordered chunks, with bytes of those it owns."""
    special = written(special_files(index), "media-special")
    size = special.agg(F.count("*") + F.coalesce(F.sum(F.aggregate("what", F.lit(0), lambda n, w: n + F.size(w["lacks"]) + F.size(w["gives"]))), F.lit(0))).first()[0]
    if size <= LISTED_BROADCAST:
        special = F.broadcast(special)
    rows = hashed(docs).join(special, "text_hash", "left").select("doc_id", "text", "what")
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary()), ("given", pa.bool_())]))
    plain = {"home": None, "lacks": (), "gives": ()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists, size = [], [], 0
            for doc_id, t, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                media = sound_file(payload_of(t.as_py()))
                key = hashlib.sha256(media).digest()
                own = next((x for x in w.as_py() or () if x["media"] == key), plain)
                if own["home"] is not None and own["home"] != doc_id:
                    continue
                lacks, gives = set(own["lacks"]), set(own["gives"])
                keys.append(key)
                lists.append([{"digest": short(c), "data": None if i in lacks else c, "given": i in gives} for i, c in enumerate(chunks_of(media))])
                size += len(media)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, kind)], ["media", "chunks"])
                    keys, lists, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, kind)], ["media", "chunks"])

    out = rows.mapInArrow(run, f"media binary, chunks {CHUNKS}")
    path = new_path(docs.sparkSession, "media-store")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def feature(samples: bytes, n_chunks: int) -> str:
    """Level, spread and liveliness of the samples, and the number of chunks."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    mean = float((counts * np.arange(256)).sum()) / len(x)
    crossings = int((np.diff((x >= 128).astype(np.int8)) != 0).sum())
    return f"samples={len(x)};mean={mean:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};peak={int(x.max())};crossings={crossings};chunks={n_chunks}"


FEATURE_SCHEMA = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def rebuilt(files: DataFrame) -> DataFrame:
    """Features of files whose rows have the bytes of all chunks (media, chunks of digest and data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, listed in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunks = listed.as_py()
                if any(c["data"] is None or short(c["data"]) != c["digest"] for c in chunks):
                    raise ValueError("a stored chunk doesn't match its digest")
                media = b"".join(c["data"] for c in chunks)
                if hashlib.sha256(media).digest() != key:
                    raise ValueError("a rebuilt file doesn't match its digest")
                samples = samples_of(media)
                rows.append((key, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), key.hex(), feature(samples, len(chunks))))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], [x.split()[0] for x in FEATURE_SCHEMA.split(", ")])

    return files.select("media", F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["data"].alias("data"))).alias("chunks")).mapInArrow(run, FEATURE_SCHEMA)


def features(stored: DataFrame) -> DataFrame:
    """Features of every file in the store, from its stored bytes."""
    lacking = F.exists("chunks", lambda c: c["data"].isNull())
    given = written(stored.select(F.explode(F.filter("chunks", lambda c: c["given"])).alias("c")).select("c.digest", "c.data").dropDuplicates(["digest"]), "media-given")
    partial = stored.filter(lacking).dropDuplicates(["media"])
    wanted = partial.select("media", F.posexplode("chunks").alias("pos", "c")).filter("c.data is null").select("media", "pos", F.col("c.digest").alias("digest"))
    got = wanted.join(given, "digest").groupBy("media").agg(F.map_from_entries(F.collect_list(F.struct("pos", "data"))).alias("got"))
    filled = partial.join(got, "media", "left").select("media", F.transform("chunks", lambda c, i: F.struct(c["digest"].alias("digest"), F.coalesce(c["data"], F.col("got")[i]).alias("data"))).alias("chunks"))
    return rebuilt(stored.filter(~lacking)).unionByName(rebuilt(filled)).dropDuplicates(["media"])


def media_columns(docs: DataFrame) -> DataFrame:
    """Each row's file digests and features, read back from the chunk store."""
    index = written(chunk_index(docs), "media-index")
    found = written(features(store(docs, index)), "media-features")
    there = F.coalesce(F.col("payload_bytes"), F.raise_error(F.lit("a file is missing from the chunk store")).cast("long"))
    return index.select("doc_id", "n_bytes", "media").join(found, "media", "left").withColumn("payload_bytes", there).drop("media")
