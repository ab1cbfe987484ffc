"""Document fingerprints by content-defined chunking (operator 8).

A gear hash of the last bytes decides where chunks end, so an insertion moves only the chunks it touches. Chunk lengths
are normalised: until NORMAL bytes an end needs more zero bits, then fewer. A fingerprint is the set of chunk digests,
each with the bytes it covers; containment is the share of the smaller document's bytes whose chunks the other holds.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, mix, texts

#: Bytes of a chunk: at least, where ends become likelier, at most.
SMALLEST, NORMAL, LARGEST = 16, 48, 192
#: Zero bits that an end needs before and after NORMAL bytes.
STRICT_BITS, LOOSE_BITS = 8, 4
#: Bytes that a gear hash of 32 bits sees, and that are hashed at one time.
WINDOW, HASHED_BYTES = 32, 4 << 20
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Bytes of text of a range of ids, which is a task, and ranges at most: larger tables have longer ones, which a task goes through row by row.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 14
#: Sampled rows for each bound between ranges: 16 MB at the driver at most.
SAMPLED_ROWS = 64


def cut_places(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where an end may lie, LOOSE_BITS and STRICT_BITS: in the texts joined with WINDOW zero bytes after each, in windows."""
    joined = b"".join(r + bytes(WINDOW) for r in raws)
    sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    gaps = np.cumsum(sizes + WINDOW) - WINDOW
    loose, strict = [], []
    for lo in range(0, len(joined), HASHED_BYTES):
        begin, stop = max(0, lo - WINDOW), min(lo + HASHED_BYTES, len(joined))
        h = GEAR[np.frombuffer(joined, dtype=np.uint8, count=stop - begin, offset=begin)]
        for gap in gaps[(gaps < stop) & (gaps + WINDOW > begin)].tolist():
            h[max(0, gap - begin) : gap - begin + WINDOW] = 0
        k = 1
        while k < WINDOW:
            h[k:] += h[:-k] << np.uint32(k)
            k *= 2
        h = h[lo - begin :]
        at = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
        strict.append(at[h[at] >> np.uint32(32 - STRICT_BITS) == 0] + lo + 1)
        loose.append(at + lo + 1)
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(loose or none), np.concatenate(strict or none)


def chunk_ends(raws: list[bytes]) -> list[list[int]]:
    """Of each text, where its chunks end."""
    loose, strict = (array("q", x.astype(np.int64).tobytes()) for x in cut_places(raws))
    out, start = [], 0
    n_strict, n_loose = len(strict), len(loose)
    for raw in raws:
        stop, at, ends = start + len(raw), start, []
        while at < stop:
            i = bisect_left(strict, at + SMALLEST)
            if i < n_strict and strict[i] < at + NORMAL:
                at = strict[i]
            else:
                i = bisect_left(loose, at + NORMAL)
                at = loose[i] if i < n_loose and loose[i] < at + LARGEST else at + LARGEST
            at = min(at, stop)
            ends.append(at - start)
        out.append(ends)
        start = stop + WINDOW
    return out


def fingerprints(docs: list[str]) -> list[dict[str, int]]:
    """Of each text: digest of a chunk -> bytes that chunks of this digest cover."""
    raws = [d.encode("utf-8", "surrogatepass") for d in docs]
    out, digest = [], xxhash.xxh3_64_hexdigest
    for raw, ends in zip(raws, chunk_ends(raws), strict=True):
        found: dict[str, int] = Counter()
        a = 0
        for b in ends:
            found[digest(raw[a:b])] += b - a
            a = b
        out.append(found)
    return out


def written(fingerprint: dict[str, int]) -> str:
    return ",".join(f"{d}:{n}" for d, n in sorted(fingerprint.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Bytes of common chunks over those of the smaller text; two empty texts are alike, one is like no other."""
    total = min(sum(a.values()), sum(b.values()))
    if not total:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    return min(1.0, sum(min(n, b[d]) for d, n in a.items() if d in b) / total)


def range_of(key: np.ndarray, hash_: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many bounds (keys, hashes), sorted, are at or below each (key, hash)."""
    low, high = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
    for a in np.unique(low[low < high]):  # keys that are bounds
        rows = np.flatnonzero((low == a) & (high > a))
        low[rows] = a + np.searchsorted(hashes[a : high[rows[0]]], hash_[rows], side="right")
    return low


def _bounds(keyed: DataFrame, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (key, hash) of n ranges of about as many rows, from SAMPLED_ROWS rows for each: all that reaches the driver."""
    span = 1 << 40
    limit = int(min(1.0, SAMPLED_ROWS * n / max(1, n_rows)) * span)
    found = keyed.select("key", "hash").filter(F.pmod(F.xxhash64("key", "hash"), F.lit(span)) < limit).distinct().toArrow()
    keys, hashes = found["key"].to_numpy(), found["hash"].to_numpy()
    order = np.lexsort((hashes, keys))[np.linspace(0, len(keys), n, endpoint=False).astype(np.int64)[1:]] if len(keys) else []
    return keys[order], hashes[order]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, halo, doc_id, text), so partitioned and sorted that each document's next one (falling id; after the
    last, the first) is the next row of its bucket; halo rows only serve as a next one.

    A bucket is a range of ids, and within an id of text hashes, so that many rows of one id or of none are split. It is a
    partition, of about RANGE_BYTES (of a table beyond MOST_RANGES of them: of an even share), and gets the first document of the range that follows. Null ids come last; rows that share
    an id stand in the order of a hash of their texts. Only bounds and heads of ranges reach the driver and all tasks: MOST_RANGES rows.
    """
    spark = docs.sparkSession
    keyed = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"coalesce(`{text_col}`, '') as text").withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("hash", F.xxhash64("text"))
    size = keyed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).head()
    n = min(MOST_RANGES, 1 + size.bytes // RANGE_BYTES)
    shared = spark.sparkContext.broadcast(_bounds(keyed, size.rows, n))

    @F.pandas_udf("int")
    def bucket(key: pd.Series, hash_: pd.Series) -> pd.Series:
        return pd.Series(range_of(key.to_numpy(), hash_.to_numpy(), *shared.value).astype(np.int32))

    ids = keyed.select("key", "hash").withColumn("bucket", bucket("key", "hash"))
    heads = sorted((r.bucket, r.m.key, r.m.hash) for r in ids.groupBy("bucket").agg(F.max(F.struct("key", "hash")).alias("m")).collect())
    # The first document of a range (falling ids) follows the last one of the range above it; that of the highest the very last.
    halo = spark.createDataFrame([(heads[i - 1][1], heads[i - 1][2], h[0]) for i, h in enumerate(heads)], "key long, hash long, to int")
    rows = keyed.withColumn("bucket", bucket("key", "hash")).join(F.broadcast(halo), ["key", "hash"], "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("halo"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("bucket"), F.lit(True).alias("halo"))))))
    rows = rows.select("place.bucket", "place.halo", "doc_id", "text", "key", "hash")
    parted = rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", "halo", F.desc("key"), F.desc("hash"))
    return parted.select("bucket", "halo", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the first as many code points of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: the fingerprints of its text and edited text, and how like they and the next document's are.

    A null text is empty; empty texts have empty fingerprints. Repeated rows are neighbours and compared as such; copies of one row
    (same id and text) go to one task. A table of one row is its own next. An empty table gives no rows. Other columns are not
    read. A text of any length is held whole, with its next one: chunks are found in windows, a text's chunks take 130 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, halo, doc_id, text, fingerprint) before the chunk
        for batch in chunks(batches, most=1 << 20):
            t = texts(batch)
            rows = list(zip(batch.column("bucket").to_pylist(), batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), t, fingerprints(t), strict=True))
            pairs = [(a, b) for a, b in zip([last, *rows[:-1]], rows, strict=True) if a and a[0] == b[0] and not a[1]]
            last = rows[-1]
            if not pairs:
                continue
            new = [edited(a[3], b[3]) for a, b in pairs]
            prints = fingerprints(new)
            cols = [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in new],
                [written(a[4]) for a, _ in pairs],
                [written(p) for p in prints],
                pa.array([containment(a[4], p) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
                pa.array([containment(a[4], b[4]) for a, b in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return with_next(docs, id_col, text_col).mapInArrow(run, SCHEMA)
