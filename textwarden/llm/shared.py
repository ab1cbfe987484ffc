"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sources.shipping import ship

#: Bytes of text that a task turns into numpy arrays at one time.
CHUNK_BYTES = 2 << 20
#: Rows of such a slice at most.
MAX_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; removed when the driver ends, or with the scratch it is in.

    Without that setting a local folder is taken if all runs on this machine (master local), else there is none to take.
    """
    root = _SCRATCH.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "textwarden-checkpoints")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is removed at the end: results that need it must have been stored in a folder from outside by then."""
    path = shared_folder(spark)
    outer = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        for name in _TABLES.pop(path, []):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder (or a new one) and read again: cuts the lineage and outlives executors."""
    path = (folder or shared_folder(df.sparkSession)) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bucketed tables by the scratch they are in.
_TABLES: dict[str, list[str]] = {}


def stored_by(df: DataFrame, column: str) -> DataFrame:
    """stored(), in as many buckets of a column as Spark has shuffle partitions: what groups by it later needs no shuffle of df."""
    spark = df.sparkSession
    name = f"textwarden_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, column).option("path", shared_folder(spark) + "/t").saveAsTable(name)
    _TABLES.setdefault(_SCRATCH.get() or "", []).append(name)
    return spark.table(name)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        part = np.cumsum(size + most // MAX_ROWS) // most
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as a list, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: White space that parts words: the ASCII kinds.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(BLANKS)] = True
#: Bytes of text whose words are hashed at one time, and of a word that is hashed by itself.
WINDOW_BYTES, LONG_WORD = CHUNK_BYTES, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; n is bounded by a window and a word."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, WINDOW_BYTES + 2 * LONG_WORD), b, dtype=np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS


def _windows(raw: bytes) -> Iterator[bytes]:
    """The text in windows that end with a word: of about WINDOW_BYTES, or a longer word by itself."""
    at = 0
    while at < len(raw):
        stop = min(at + WINDOW_BYTES, len(raw))
        if stop < len(raw) and raw[stop] not in BLANKS:
            back = max(raw.rfind(b, at, stop) for b in BLANKS)
            if back < 0:  # one word, as far as the window reaches
                nexts = [x for b in BLANKS if (x := raw.find(b, stop)) >= 0]
                stop = min(nexts, default=len(raw))
            else:
                stop = back
        yield raw[at:stop]
        at = stop if stop == len(raw) else stop + 1


def _window_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw begin, and their hashes."""
    if len(raw) > WINDOW_BYTES + LONG_WORD:  # a long word
        return np.zeros(1, dtype=np.int64), np.array([xxhash.xxh3_64_intdigest(raw)], dtype=np.uint64)
    buf = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(np.concatenate([[True], space[:-1]])[: len(buf)] & ~space)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    p, inverse = _powers(len(buf))
    x = buf.astype(np.uint64)
    x += np.uint64(1)
    x[space] = 0
    x *= p[: len(buf)]
    found = mix(np.add.reduceat(x, starts) * inverse[starts])
    for i in np.flatnonzero(np.diff(np.append(starts, len(buf))) > LONG_WORD):
        word = raw[starts[i] : starts[i + 1] if i + 1 < len(starts) else None].rstrip(BLANKS)
        if len(word) > LONG_WORD:
            found[i] = xxhash.xxh3_64_intdigest(word)
    return starts, found


def word_starts(raw: bytes) -> np.ndarray:
    """Where the words of raw begin."""
    space = _SPACE[np.frombuffer(raw, dtype=np.uint8)]
    return np.flatnonzero(np.concatenate([[True], space[:-1]])[: len(space)] & ~space)


def word_hashes(docs: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all docs, in order, and the number of words of each doc.

    Words are maximal runs of other characters than ASCII white space. Texts are hashed in windows of WINDOW_BYTES, so a long
    text takes 8 bytes a word and its window's arrays; words of over LONG_WORD bytes have a hash of their own.
    """
    hashes: list[np.ndarray] = []
    n_words = np.zeros(len(docs), dtype=np.int64)
    held: list[bytes] = []
    first = size = 0

    def joined(end: int) -> None:
        if held:
            starts, found = _window_hashes(b"\n".join(held))
            ends = np.cumsum(np.fromiter((len(r) + 1 for r in held), dtype=np.int64, count=len(held)))
            n_words[first:end] = np.diff(np.searchsorted(starts, ends), prepend=0)
            hashes.append(found)
            held.clear()

    for i, d in enumerate(docs):
        raw = d if isinstance(d, bytes) else d.encode("utf-8", "surrogatepass")
        if held and size + len(raw) + 1 > WINDOW_BYTES:
            joined(i)
        if not held:
            first, size = i, 0
        if len(raw) <= WINDOW_BYTES:
            held.append(raw)
            size += len(raw) + 1
            continue
        for window in _windows(raw):
            hashes.append(_window_hashes(window)[1])
            n_words[i] += len(hashes[-1])
    joined(len(docs))
    return np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64), n_words


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] items, then the same for the next."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


def crc32_of(value: object) -> int:
    return zlib.crc32(str(value).encode())
