"""Harmonic packing of token sequences (operator 7).

A piece of length L belongs to the reciprocal-capacity class k = floor(capacity / L): k of them always fit one
bin. Every bin of a class takes that fixed number of pieces, so each task fills its own bins without asking others,
and the job has no shuffle. A document stays whole where k of its length fill a bin up to WASTE of it; else it is cut into a piece
of the next class's full length, floor(capacity / (k + 1)), of which k + 1 fill a bin, and a rest that is treated alike. Rests
below SMALLEST aren't cut. At its end a task puts the pieces of its unfinished bins together, largest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import chunks, texts
from .wordids import word_encoder

CAPACITY = 4096
#: What is shorter stays one piece.
SMALLEST = 256
#: Share of a bin that whole documents of one class may leave empty.
WASTE = 0.03
#: Fixed documents a bin of the classes of short rests: class k takes lengths up to capacity / k.
REST_COUNTS = (16, 18, 20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512, 1024, 4096)

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        piece = n if n < smallest or k * n >= (1 - waste) * capacity else capacity // (k + 1)
        out.append(piece)
        n -= piece
    return out


def count_of(length: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> int:
    """Pieces that a bin of this length's class takes."""
    fit = capacity // length
    return fit if length >= smallest else max((k for k in REST_COUNTS if k <= fit), default=fit)


class Bins:
    """The open bins of one task; a bin is handed out when it has its class's count."""

    def __init__(self, capacity: int, smallest: int, first: int):
        self.capacity, self.smallest, self.next = capacity, smallest, first
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        """piece: (doc_id, start, length, ids, doc_tokens). Returns finished pieces with their places."""
        k = count_of(piece[2], self.capacity, self.smallest)
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.close(self.open.pop(k)) if len(held) == k else []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def rest(self) -> Iterator[tuple]:
        """The pieces of unfinished bins, first fit by falling length; at most sum(REST_COUNTS) pieces."""
        bins: list[tuple[int, list[tuple]]] = []
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            at = next((i for i, (used, _) in enumerate(bins) if used + p[2] <= self.capacity), len(bins))
            used, held = bins[at] if at < len(bins) else (0, [])
            bins[at : at + 1] = [(used + p[2], [*held, p])]
        self.open = {}
        for _, held in bins:
            yield from self.close(held)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, smallest: int = SMALLEST) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (gapless from 0 in its sequence). A sequence is used up to `capacity` ids.

    A null or empty text is the end id alone. Repeated rows are packed once each, also where they share an id; a null
    id stays null. Pieces of equal length go in the order they are read. Other columns are not read. An empty table gives no rows. A
    text of any length is encoded whole, and only its task holds it. sequence_id holds the task's number in its upper bits, so a task that runs again after
    a lost executor gives the same rows as long as its input is read in the same order (files are).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path, end_id)
        bins = Bins(capacity, smallest, (TaskContext.get().partitionId()) << 40)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in chunks(batches):
            ids, counts = encoder.encode(texts(batch))
            ends, rows = np.cumsum(counts).tolist(), []
            for doc_id, n, end in zip(batch.column("doc_id").to_pylist(), counts.tolist(), ends, strict=True):
                at, begin = 0, end - n
                for length in cut(n, capacity, smallest):
                    piece = ids[begin + at : begin + at + length].astype("<u4").tobytes()
                    rows += bins.add((doc_id, at, length, piece, n))
                    at += length
            if rows:
                yield out(rows)
        if rows := list(bins.rest()):
            yield out(rows)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)
