"""Byte-level BPE encoding and decoding (operator 10).

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as they stand. The others
are merged by rank with a heap over linked bytes. Tasks keep the ids of the words they have met (caches bounded in bytes).
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from .shared import chunks, ranges, texts

#: Bytes that a task's caches may take; beyond it they start anew. ENTRY_BYTES: of an entry, besides its text and ids.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 200
#: Keys a bucket of the perfect hash has on average.
BUCKET = 3


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys to n places.

    Buckets are placed from the largest on: the first displacement that sends all keys of a bucket to free places is
    kept. Buckets of one key name their place itself, as -1 - place.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // BUCKET)
        self.displacement = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.order: list[int] = [-1] * self.n
        groups: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(i)
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                continue
            d = 1
            while True:
                places = [xxhash.xxh3_64_intdigest(keys[i], d) % self.n for i in members]
                if len(set(places)) == len(places) and all(self.order[p] < 0 for p in places):
                    break
                d += 1
            self.displacement[bucket] = d
            for i, p in zip(members, places, strict=True):
                self.keys[p], self.order[p] = keys[i], i
        free = (p for p in range(self.n) if self.order[p] < 0)
        for bucket, members in groups.items():
            if len(members) == 1:
                p = next(free)
                self.displacement[bucket] = -1 - p
                self.keys[p], self.order[p] = keys[members[0]], members[0]

    def find(self, key: bytes) -> int:
        """The key's number in the list it was built from, or -1."""
        if not self.n:
            return -1
        d = self.displacement[xxhash.xxh3_64_intdigest(key) % self.buckets]
        p = -1 - d if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n
        return self.order[p] if self.keys[p] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merges of lowest rank first, leftmost on ties: a heap over linked bytes."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is named by its first byte
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Chunks(dict):
    """The number of a stretch of text (`lead` before it); its ids go to the ragged arrays."""

    def __init__(self, bpe: ByteBpe, lead: str, arrays: tuple[array, array, array]):
        self.bpe, self.lead, self.arrays = bpe, lead, arrays

    def __missing__(self, text: str) -> int:
        flat, start, length = self.arrays
        at = len(flat)
        for token in self.bpe.split(self.lead + text):
            flat.extend(self.bpe.piece(token.encode("utf-8", "replace")))
        start.append(at)
        length.append(len(flat) - at)
        self.bpe.held += ENTRY_BYTES + len(text) + 4 * length[-1]
        code = self[text] = len(start) - 1
        return code


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = list(self.ranks)
        self.ids = [self.ranks[t] for t in self.tokens]
        self.whole = PerfectHash(self.tokens)
        self.split = regex.compile(pattern).findall
        self.forget()
        size = max(self.ids, default=-1) + 1
        self.n_bytes = np.zeros(size, dtype=np.int64)
        self.n_bytes[self.ids] = [len(t) for t in self.tokens]
        by_id = sorted(zip(self.ids, self.tokens, strict=True))
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)
        self.byte_at = np.cumsum(self.n_bytes) - self.n_bytes

    def forget(self) -> None:
        self.pieces: dict[bytes, list[int]] = {}
        self.held = 0
        self.arrays = (array("i"), array("q"), array("q"))
        self.first, self.later = _Chunks(self, "", self.arrays), _Chunks(self, " ", self.arrays)

    def piece(self, b: bytes) -> list[int]:
        if (ids := self.pieces.get(b)) is None:
            at = self.whole.find(b)
            ids = self.pieces[b] = [self.ids[at]] if at >= 0 else merged(b, self.ranks)
            self.held += ENTRY_BYTES + len(b) + 8 * len(ids)
        return ids

    def stretches(self, text: str) -> list[int]:
        """Numbers of the text's stretches. Tokens hold a space at most at their start or among white space, so one
        begins at each single space that a character other than white space follows; those are the cuts."""
        parts = text.split(" ")
        if any(not p or p[0].isspace() for p in parts[1:]):
            joined = [parts[0]]
            for p in parts[1:]:
                if not p or p[0].isspace():
                    joined[-1] += " " + p
                else:
                    joined.append(p)
            parts = joined
        return [self.first[parts[0]], *map(self.later.__getitem__, parts[1:])] if text else []

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of ids of each text."""
        if self.held > CACHE_BYTES:
            self.forget()
        codes, ends = array("q"), array("q")
        for doc in docs:
            codes.extend(self.stretches(doc))
            ends.append(len(codes))
        flat, start, length = (np.frombuffer(a, dtype=t) if len(a) else np.zeros(0, dtype=t) for a, t in zip(self.arrays, (np.int32, np.int64, np.int64), strict=True))
        code = np.array(codes, dtype=np.int64)
        lengths = length[code]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return flat[ranges(start[code], lengths)], np.diff(total[np.array(ends, dtype=np.int64)], prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.byte_at[ids], self.n_bytes[ids])].tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: one row per input row, in no order.

    A null or empty text has no ids. Repeated rows are encoded once each; a null id stays null. Other columns are not
    read. An empty table gives no rows. A text is encoded whole, whatever its length, and only its task holds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in chunks(batches):
            ids, counts = bpe.encode(texts(batch))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of `encoded` (doc_id, ids) with decoded binary, the bytes of the ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            column = batch.column("ids")
            ids, lengths = column.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.fill_null(pc.list_value_length(column), 0))
            decoded, at = [], 0
            for n in lengths.tolist():
                decoded.append(bpe.decode(ids[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
