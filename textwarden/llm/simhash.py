"""SimHash near-duplicates with anchor points (operator 12).

A fingerprint has 64 bits, the majority of those of the XXH64 hashes of a text's shingles. All pairs of fingerprints that differ in
at most THRESHOLD bits are found by covering codes: the 64 bits are three blocks, each with a linear code (two perfect Golay codes
of 23 bits, and a Hamming code of 15 bits beside three bits as they are) whose words, the anchors, lie within a covering radius of every point.
A fingerprint is at home at its nearest anchor and is copied to every anchor within that radius plus the bits by
which a pair may differ there; so a pair within the threshold meets at either one's home, and what is at home is compared with all copies.

Of k chosen blocks out of three some choice holds at most THRESHOLD * k // 3 of a pair's differing bits, so not all blocks are needed:
single blocks (1 bit, 21 copies a fingerprint, 4096 and 16384 anchors) up to FEW fingerprints, pairs of blocks (2 bits, some 310 copies, 2**24 and
2**26 anchors) for more. Both find every pair; the second compares fewer others. Anchors that hold many are dealt into slices, homes against copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import components
from .shared import chunks, mix, ranges, scratch, shared_folder, stored

SHINGLE_WORDS, SEED, THRESHOLD = 4, 42, 4
#: Bytes of text that are hashed at one time.
WINDOW_BYTES = 1 << 20
#: Distinct fingerprints up to which single blocks are the anchors' places.
FEW = 50_000_000
#: Homes and copies of an anchor that one slice compares, pairs that are compared at one time, and rows of a small table that goes to all tasks.
SLICE_HOMES, SLICE_COPIES, PAIRS, SMALL = 8192, 65_536, 1 << 22, 100_000


def _bits(raw: bytes, held: list[bytes], counts: np.ndarray, last: bool) -> int:
    """Adds the bits of the hashes of the shingles of held + raw's words to counts; held gets the words that the next window starts with."""
    words = held + raw.split()
    n = len(words) - SHINGLE_WORDS + 1
    spans = min(SHINGLE_WORDS, len(words))
    if n <= 0 and not (last and words):
        held[:] = words
        return 0
    n = max(n, 1)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[spans - 1 : spans - 1 + n].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.uint64(0x0101010101010101)
    for k in range(8):  # bit k of each of the eight bytes at once; a byte holds sums up to 255
        byte = np.add.reduceat((hashes >> np.uint64(k)) & ones, np.arange(0, n, 255))
        counts[:, k] += byte.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    held[:] = words[-(SHINGLE_WORDS - 1) :]
    return n


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a text in UTF-8; 0 if it has no word."""
    counts, held, n, at = np.zeros((8, 8), dtype=np.int64), [], 0, 0  # counts: of byte (lowest first) and bit
    raw = raw.lower()  # of bytes: A-Z only
    while True:
        stop = len(raw)
        if stop - at > WINDOW_BYTES:
            nexts = [x for b in b" \t\n\x0b\x0c\r" if (x := raw.find(b, at + WINDOW_BYTES, at + 2 * WINDOW_BYTES)) >= 0] or [x for b in b" \t\n\x0b\x0c\r" if (x := raw.find(b, at + WINDOW_BYTES)) >= 0]
            stop = min(nexts, default=stop)
        n += _bits(raw[at:stop] if stop - at < len(raw) else raw, held, counts, last=stop == len(raw) and not n)
        at = stop
        if at >= len(raw):
            break
    return int(np.packbits((2 * counts > n)[:, ::-1], axis=1)[::-1, 0].tobytes().hex() or "0", 16)


class Code:
    """A linear code of the bits from `at` on, by the syndrome of each bit, with its covering radius.

    Of each syndrome, the error patterns (a word's differences from codewords) whose weight is up to `most` over the radius: sorted by
    that excess. In a perfect code one pattern a syndrome has none, the nearest codeword's.
    """

    def __init__(self, at: int, syndromes: list[int], n_syndromes: int, radius: int, most: int):
        self.width, self.at, self.syndromes = len(syndromes), at, np.array(syndromes, dtype=np.int64)
        patterns, of, excess = [], [], []
        for weight in range(min(radius + most, self.width) + 1):
            for bits in combinations(range(self.width), weight):
                s = 0
                for b in bits:
                    s ^= syndromes[b]
                patterns.append(sum(1 << b for b in bits))
                of.append(s)
                excess.append(max(0, weight - radius))
        of, excess = np.array(of), np.array(excess)
        order = np.lexsort((excess, of))
        self.patterns = np.array(patterns, dtype=np.uint64)[order] << np.uint64(at)
        self.excess = excess[order]
        self.first = np.searchsorted(of[order], np.arange(n_syndromes))
        #: Of a syndrome and a bound: how many patterns have no more excess.
        self.upto = np.array([np.bincount(of[excess <= e], minlength=n_syndromes) for e in range(most + 1)]).T

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for i, s in enumerate(self.syndromes.tolist()):
            if s:
                out ^= ((x >> np.uint64(self.at + i)) & np.uint64(1)).astype(np.int64) * s
        return out

    @property
    def mask(self) -> int:
        return ((1 << self.width) - 1) << self.at


def golay(at: int, most: int) -> Code:
    """The cyclic code of x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1: 23 bits, radius 3."""
    x, found = 1, []
    for _ in range(23):
        found.append(x)
        x <<= 1
        if x >> 11:
            x ^= 0b110001110101
    return Code(at, found, 1 << 11, 3, most)


def hamming(at: int, most: int) -> Code:
    """The Hamming code of 15 bits, radius 1."""
    return Code(at, list(range(1, 16)), 16, 1, most)


def plain(at: int, width: int, most: int) -> Code:
    """All words of some bits, radius 0."""
    return Code(at, [0] * width, 1, 0, most)


class Anchors:
    """Every choice of n_blocks of the three blocks, with its codes; differ: bits that a pair differs in there at most."""

    def __init__(self, n_blocks: int, threshold: int = THRESHOLD):
        self.differ = threshold * n_blocks // 3
        most = self.differ
        blocks = [[golay(0, most)], [golay(23, most)], [hamming(46, most), plain(61, 3, most)]]
        self.covers = [[code for block in choice for code in block] for choice in combinations(blocks, n_blocks)]

    def copies(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each cover: index into x, anchor (a hash of cover and codewords), whether it is the home."""
        for number, codes in enumerate(self.covers):
            at, excess = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            word = x & np.uint64(sum(c.mask for c in codes))
            for code in codes:
                s = code.syndrome(x)[at]
                n = code.upto[s, self.differ - excess]
                took = ranges(code.first[s], n)
                at, excess, word = np.repeat(at, n), np.repeat(excess, n) + code.excess[took], np.repeat(word, n) ^ code.patterns[took]
            yield at, mix(word * np.uint64(3) + np.uint64(number)), excess == 0


def close_pairs(homes: np.ndarray, copies: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that join what pairs of a home and a copy within the threshold join: the pairs, or where they are over two for each
    copy, one link for each copy and one for each two homes that come together."""
    out = []
    step = max(1, PAIRS // max(1, len(homes)))
    label = np.arange(len(homes))  # the least home that each home has been joined with
    for lo in range(0, len(copies), step):
        other = copies[lo : lo + step]
        i, j = np.nonzero(np.bitwise_count(homes[:, None] ^ other[None, :]) <= threshold)
        some = homes[i] != other[j]
        i, j = i[some], j[some]
        if len(i) <= 2 * len(other):
            out.append((homes[i], other[j]))
            continue
        before = label
        while True:  # labels go from homes to copies and back until nothing changes
            of_copy = np.full(len(other), len(homes))
            np.minimum.at(of_copy, j, label[i])
            new = label.copy()
            np.minimum.at(new, i, of_copy[j])
            np.minimum.at(new, before, new)  # what was joined before stays together
            new = new[before]
            if (new == label).all():
                break
            label = new
        met = np.flatnonzero(of_copy < len(homes))
        moved = np.unique(np.stack([before, label])[:, before != label], axis=1)
        out += [(homes[moved[0]], homes[moved[1]]), (homes[of_copy[met]], other[met])]
    return out


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the 64 bits as a long) of each row; a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            found = np.fromiter((fingerprint(x or b"") for x in raw), dtype=np.uint64, count=len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, print long")


def links(prints: DataFrame, n_blocks: int, threshold: int = THRESHOLD) -> DataFrame:
    """prints: distinct fingerprints (print long). Links (a, b) that join all pairs within the threshold."""
    anchors = Anchors(n_blocks, threshold)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("print").to_numpy().view(np.uint64)
            for lo in range(0, len(x), 4096):
                for at, anchor, home in anchors.copies(x[lo : lo + 4096]):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(x[lo : lo + 4096][at].view(np.int64)), pa.array(home)], ["anchor", "print", "home"])

    rows = prints.select("print").mapInArrow(copied, "anchor long, print long, home boolean")
    full = rows.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("copies")).filter((F.col("homes") > SLICE_HOMES) | (F.col("copies") > SLICE_COPIES))
    full = stored(full.select("anchor", F.ceil(F.greatest("homes", F.lit(1)) / SLICE_HOMES).cast("int").alias("h"), F.ceil(F.col("copies") / SLICE_COPIES).cast("int").alias("c")))
    few = full.limit(SMALL + 1).count() <= SMALL
    rows = rows.join(F.broadcast(full) if few else full, "anchor", "left").withColumns({"h": F.coalesce("h", F.lit(1)), "c": F.coalesce("c", F.lit(1))})
    # A home goes into its slice of homes once for each slice of copies; each row, as a copy, into its slice of copies once for each slice of homes.
    mine = lambda n, seed: F.pmod(F.xxhash64("print", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_home = F.transform(upto("c"), lambda j: F.struct(mine("h", 1).alias("i"), j.alias("j"), F.lit(True).alias("home")))
    as_copy = F.transform(upto("h"), lambda i: F.struct(i.alias("i"), mine("c", 2).alias("j"), F.lit(False).alias("home")))
    split = rows.filter("h > 1 or c > 1").select("anchor", "print", F.explode(F.when(F.col("home"), F.concat(as_home, as_copy)).otherwise(as_copy)).alias("p")).select("anchor", "p.i", "p.j", "print", "p.home")
    whole = rows.filter("h = 1 and c = 1").select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "print", "home")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes = None, np.zeros(0, dtype=np.uint64)  # of the slice that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("anchor", "i", "j")]
            x, home = batch.column("print").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
            stops = np.append(new[1:], len(x))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(new.tolist(), stops.tolist(), strict=True):
                now = tuple(c[a] for c in cols)
                if a or now != key:
                    homes = np.zeros(0, dtype=np.uint64)
                key = now
                n = int(home[a:b].sum())  # homes come first
                if n:
                    mine = x[a : a + n]
                    if len(homes):
                        out += close_pairs(mine, homes, threshold)
                    homes = np.concatenate([homes, mine])
                if len(homes) and (b - a > 1 or not n):
                    out += close_pairs(homes, x[a:b], threshold)
            if out:
                u, v = (np.concatenate(c).view(np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

    parted = whole.unionByName(split).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", F.desc("home"))
    return parted.mapInArrow(compared, "a long, b long").filter("a <> b").distinct()


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, n_blocks: int | None = None) -> DataFrame:
    """doc_id, print, component_id: one row per row of docs; the least doc_id among documents reached over links.

    Equal fingerprints are one; that of a text without words (null, empty) is zero and linked like any other. Repeated rows are in one
    component. A null doc_id counts only where a component has no other. Other columns are not read; an empty table gives no rows. A text of any
    length is hashed in windows; it is held, in lower case.
    """
    spark = docs.sparkSession
    folders = shared_folder(spark), shared_folder(spark)
    marked = stored(signed(docs, id_col, text_col), folders[0])
    with scratch(spark):
        prints = stored(marked.groupBy("print").agg(F.min("doc_id").alias("doc_id")))
        if n_blocks is None:
            n_blocks = 1 if prints.count() <= FEW else 2
        roots = components(stored(links(prints, n_blocks, threshold)))
        tagged = prints.join(roots, F.col("print") == F.col("node"), "left").select("print", "doc_id", F.coalesce("root", "print").alias("class"))
        tagged = stored(tagged)
        least = tagged.groupBy("class").agg(F.min("doc_id").alias("component_id"))
        whole = stored(tagged.join(least, "class").select("print", "component_id"), folders[1])
    return marked.join(whole, "print").select("doc_id", "print", "component_id")
