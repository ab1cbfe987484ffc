"""Token-ID output in a binary container (operator 6).

The container is a folder with two Parquet tables. `dictionary` has one row: the zstandard dictionary trained on
serialized id arrays (empty if there was too little to train on), its hash, and on how many arrays. `shards` has a row per shard: its
part (range of ids in doc_id order), its place there, the ids of its documents and the least and greatest of them, the index (byte offset of each document's frame and its number of ids), the hash of
the dictionary its frames need, the width of an id and the payload. Each document is a frame of its own, so a
short document is read without its neighbours. Executors write through Spark, so any store that Spark writes to will do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, texts
from .wordids import word_encoder

#: A shard ends at so many documents or bytes of payload.
SHARD_DOCS, SHARD_BYTES = 2048, 4 << 20
#: The dictionary: its bytes, and the documents (those of the smallest hashes with up to so many characters) it is
#: trained on at most. It changes only how well frames compress.
LEVEL = 3
DICTIONARY_BYTES, DICTIONARY_DOCS, DICTIONARY_CHARS = 32 << 10, 800, 20_000

SHARDS = "part int, shard int, first_token long, least_id long, greatest_id long, doc_ids array<long>, n_tokens array<long>, frame_at array<long>, dictionary_hash string, id_bytes int, payload binary"


def serialized(ids: np.ndarray, id_bytes: int) -> bytes:
    return ids.astype(f"<u{id_bytes}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, id_bytes: int) -> tuple[bytes, int]:
    """A zstandard dictionary from serialized id arrays of a bounded sample, and their number; empty if they are too few to learn from.

    Documents are picked by a threshold of their hashes, set from their number to let twice the wanted ones pass.
    """
    span = 1 << 40
    limit = int(min(1.0, 2 * DICTIONARY_DOCS / max(1, docs.count())) * span)
    picked = docs.filter(F.length("text").between(1, DICTIONARY_CHARS)).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)).alias("hash"))
    found = picked.filter(F.col("hash") < limit).dropDuplicates(["hash"]).orderBy("hash").limit(DICTIONARY_DOCS)
    encoder = word_encoder(tokenizer_path, end_id)
    samples = [serialized(encoder.encode([r.text])[0], id_bytes) for r in found.select("text").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), len(samples)
    except (zstandard.ZstdError, ValueError):
        return b"", len(samples)


def codec(dictionary: bytes, level: int | None = None) -> dict:
    if not dictionary:
        return {}
    data = zstandard.ZstdCompressionDict(dictionary)
    if level is not None:
        data.precompute_compress(level=level)  # once, not for each frame
    return {"dict_data": data}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes the container to `path`, documents in ascending doc_id order (null first; equal ids by
    the text's hash).

    A null or empty text is the end id alone. Repeated rows are written once each. Other columns are not read. An empty
    table gives a container without documents. A text of any length is encoded whole; its task holds it and its ids.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    id_bytes = 2 if word_encoder(tokenizer_path, end_id).size <= 1 << 16 else 4
    dictionary, n_samples = train_dictionary(docs, tokenizer_path, end_id, id_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), n_samples)], "dictionary_hash string, dictionary binary, n_samples int").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        compress = zstandard.ZstdCompressor(level=LEVEL, **codec(dictionary, LEVEL)).compress
        shard, first = 0, 0
        frames, doc_ids, lengths, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            at = np.cumsum([0] + [len(f) for f in frames[:-1]]).tolist()
            known = [x for x in doc_ids if x is not None]
            row = {"part": part, "shard": shard, "first_token": first, "least_id": min(known, default=None), "greatest_id": max(known, default=None), "doc_ids": doc_ids, "n_tokens": lengths, "frame_at": at, "dictionary_hash": digest, "id_bytes": id_bytes, "payload": b"".join(frames)}
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3, pa.string(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in chunks(batches):
            ids, counts = encoder.encode(texts(batch))
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                frames.append(compress(serialized(ids[at : at + n], id_bytes)))
                doc_ids.append(doc_id)
                lengths.append(n)
                held += len(frames[-1])
                at += n
                if len(frames) >= SHARD_DOCS or held >= SHARD_BYTES:
                    yield out()
                    shard, first = shard + 1, first + sum(lengths)
                    frames, doc_ids, lengths, held = [], [], [], 0
        if frames:
            yield out()

    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SHARDS).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """The container's documents: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with
    keep_ids also ids (array<long>). Frames whose dictionary is not the container's fail the job."""
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    found = spark.read.parquet(f"{path}/dictionary").head()
    digest, dictionary = found.dictionary_hash, bytes(found.dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor(**codec(dictionary)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError(f"shard {row['part']}/{row['shard']} needs another dictionary")
                payload, ends = memoryview(row["payload"]), [*row["frame_at"][1:], len(row["payload"])]
                crc, ids = [], []
                for a, b, n in zip(row["frame_at"], ends, row["n_tokens"], strict=True):
                    x = np.frombuffer(decompress(payload[a:b]), dtype=f"<u{row['id_bytes']}")
                    if len(x) != n:
                        raise ValueError(f"shard {row['part']}/{row['shard']}: index and frame differ")
                    crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                    ids.append(x.astype(np.int64) if keep_ids else None)
                n = len(crc)
                start = row["first_token"] + np.concatenate([[0], np.cumsum(row["n_tokens"])[:-1]]).astype(np.int64)
                cols = {"part": pa.array([row["part"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(start), "n_tokens": pa.array(row["n_tokens"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    cols["ids"] = pa.array(ids, type=pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(cols)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    docs = shards.mapInArrow(run, schema)
    # One row per part (a task of the writer): the ids before it.
    totals = shards.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n"))
    before = totals.selectExpr("part as of_part", "sum(n) over (order by part rows between unbounded preceding and 1 preceding) as n_before")
    joined = docs.join(F.broadcast(before), F.col("part") == F.col("of_part"))
    return joined.select("doc_id", (F.col("start") + F.coalesce("n_before", F.lit(0))).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of some documents of the container: only shards that can hold them are read, and only their frames go on.

    An id that isn't there gives no row, one that several documents have a row for each.
    """
    found = spark.read.parquet(f"{path}/dictionary").head()
    digest, dictionary = found.dictionary_hash, bytes(found.dictionary)
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    near = [(F.col("least_id") <= x) & (F.col("greatest_id") >= x) for x in doc_ids]
    places = F.posexplode(F.arrays_zip("doc_ids", "frame_at")).alias("place", "at")
    rows = shards.filter(reduce(or_, near, F.lit(False))).select("frame_at", "payload", "id_bytes", "dictionary_hash", places).filter(F.col("at.doc_ids").isin(doc_ids))
    stop = F.coalesce(F.get("frame_at", F.col("place") + 1), F.length("payload").cast("long"))
    frame = F.substring("payload", (F.col("at.frame_at") + 1).cast("int"), (stop - F.col("at.frame_at")).cast("int"))
    frames = rows.select(F.col("at.doc_ids").alias("doc_id"), frame.alias("frame"), "id_bytes", "dictionary_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor(**codec(dictionary)).decompress
        for batch in batches:
            ids = []
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError(f"the frame of {row['doc_id']} needs another dictionary")
                ids.append(np.frombuffer(decompress(row["frame"]), dtype=f"<u{row['id_bytes']}").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return frames.mapInArrow(run, "doc_id long, ids array<long>")
