"""Near-duplicates by MinHash (operator 1): improved consistent weighted sampling over TF-IDF shingles of five words.

A text's shingles weigh their count times 1 + log10(N / df), df counted over all documents for every shingle, without a cut.
Texts are packed into batches; a batch asks for the df of its shingles, block by block of their hashes, and a block's task counts what it
is asked, over all batches, and answers. So no task or driver holds the counts whole. A text's df go with it to where it is compared. ROWS
samples make a band.
Equal texts are one; texts that share a band are compared by their exact weighted Jaccard similarity.

No bucket of a band is expanded into its pairs. Each text is compared with its bucket's centre (the text that shares most
buckets with others). Only in buckets that are then still of several classes more is compared: in those of up to BLOCK
texts, texts of different classes pair by pair, each pair once for all bands; in larger ones, what is left over is compared with the whole
bucket in blocks of BLOCK_TEXTS, two blocks a task, as products of matrices that give out only the links that join classes. So no similar
pair of a bucket is left out. Classes are the components of the links found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import _bodies, _prime, _slices, packed
from .shared import chunks, mix, ranges, scratch, shared_folder, stored, stored_by, texts, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: 8 bands of 3 samples: two texts of similarity 0.8 share a band with probability 0.997, of 0.9 with 1 - 3e-5.
BANDS, ROWS = 8, 3
#: N / df counts up to here: there is no cut.
RARE = math.inf
#: Batches whose shingles, as many as they have, are a block's share of the counts.
BLOCK_BATCHES = 2
BLOCK = 64
#: Bits of the bitmap that picks texts to compare, a power of two.
FILTER_BITS = 1 << 24
#: Texts of a large bucket that meet as many others in one task.
BLOCK_TEXTS = 500
#: Shingles that a task samples at one time, and words it hashes at one time.
SAMPLED_SHINGLES, HELD_WORDS = 1 << 15, 1 << 20
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document (number in docs), hash (48 bits) and count of the distinct shingles, sorted by document, then hash.

    Words are lower case; a text of fewer words than WORDS is one shingle, one without words has none. A text of any length
    is taken whole: at 32 bytes a word, temporary arrays aside, which are of HELD_WORDS.
    """
    w, n = word_hashes([d.lower() for d in docs])
    key = np.zeros(len(w), dtype=np.uint64)
    whole = np.zeros(len(w), dtype=bool)
    ends = np.cumsum(n)
    starts = ends - n
    for lo in range(0, len(w), HELD_WORDS):
        hi = min(lo + HELD_WORDS, len(w))
        at = np.arange(lo, hi)
        doc = np.searchsorted(ends, at, side="right")
        stop = ends[doc]
        h = np.zeros(hi - lo, dtype=np.uint64)
        for j in range(WORDS):
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h += np.where(at + j < stop, w[np.minimum(at + j, len(w) - 1)], np.uint64(0))
        whole[lo:hi] = (at + WORDS <= stop) | (at == starts[doc])
        key[lo:hi] = (doc.astype(np.uint64) << np.uint64(48)) | (mix(h) >> np.uint64(16))
    del w
    key = key[whole]
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return (1 + np.log10(np.minimum(RARE, n_docs / np.maximum(df, 1)))).astype(np.float32)


class Weights:
    """Count times 1 + log10(N / df), of given shingles (some may be given twice) and their df; others are of df 1."""

    def __init__(self, shingle: np.ndarray, df: np.ndarray, n_docs: int):
        order = np.argsort(shingle)
        self.shingle, self.weight, self.other = shingle[order].astype(np.uint64), idf(df[order], n_docs), idf(np.ones(1), n_docs)[0]

    def of(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = np.full(len(shingle), self.other, dtype=np.float32)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
            hit = self.shingle[at] == shingle
            w[hit] = self.weight[at[hit]]
        return w * count.astype(np.float32)


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers as bytes by place: short when compressed, where they are small."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _numbers(body: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(body, decompressed_size=8 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel()


def known(docs: list[str], dfs: list[bytes], n_docs: int) -> Weights:
    """The weights of texts that have their df with them."""
    doc, s, _ = shingles(docs)
    sizes = np.bincount(doc, minlength=len(docs)).tolist()
    return Weights(s, np.concatenate([np.zeros(0, np.uint64), *(_numbers(b, n) for b, n in zip(dfs, sizes, strict=True) if n)]), n_docs)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("key"), text.alias("text"))


def _by_block(keys: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """The blocks of sorted shingles, and the places of each one's, in order."""
    of = keys % np.uint64(blocks)
    order = np.argsort(of, kind="stable")
    found, first = np.unique(of[order], return_index=True)
    return zip(found.tolist(), np.split(order, first[1:]) if len(found) else [], strict=True)


def counts(batches: DataFrame, blocks: int) -> DataFrame:
    """batch, block, df binary: of the batch's different shingles that are of the block, in order, the documents of all batches that have them."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body in _bodies(rows):
            own = [shingles(texts(x))[1] for x in _slices(body)]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
            asked = [(k, len(at), _squeezed(np.diff(keys[at], prepend=np.uint64(0))), _squeezed(n[at])) for k, at in _by_block(keys, blocks)]
            if asked:
                block, size, shingle, held = map(list, zip(*asked, strict=True))
                yield pa.RecordBatch.from_pydict({"block": block, "batch": [batch] * len(asked), "n": size, "shingle": shingle, "held": held})

    def answer(asked: pa.Table) -> pa.Table:
        sizes = asked["n"].to_pylist()
        keys = [np.cumsum(_numbers(b, n), dtype=np.uint64) for b, n in zip(asked["shingle"].to_pylist(), sizes, strict=True)]
        held = np.concatenate([_numbers(b, n) for b, n in zip(asked["held"].to_pylist(), sizes, strict=True)])
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        first = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
        df = np.empty(len(keys), dtype=np.uint64)
        df[order] = np.add.reduceat(held[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        out = [_squeezed(x) for x in np.split(df, np.cumsum(sizes)[:-1])]
        return pa.table({"batch": asked["batch"], "block": asked["block"], "df": pa.array(out, pa.binary())})

    asked = batches.mapInArrow(ask, "block long, batch long, n long, shingle binary, held binary")
    return asked.groupBy("block").applyInArrow(answer, "batch long, block long, df binary")


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Band keys, one row for each document that has shingles, in order: improved consistent weighted sampling.

    Of each shingle, r and c ~ Gamma(2, 1) and b ~ U(0, 1) come from its hash; with t = floor(ln w / r + b) the sample is
    the (shingle, t) of least ln c - r (t - b + 1).
    """
    new = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    n = int(np.count_nonzero(new))
    least, found = np.full((len(_SEEDS), n), np.inf, dtype=np.float32), np.zeros((len(_SEEDS), n), dtype=np.uint64)
    unit, row = np.float32(2.0**-24), -1
    for lo in range(0, len(doc), SAMPLED_SHINGLES):
        h, lw, begins = shingle[lo : lo + SAMPLED_SHINGLES], np.log(weight[lo : lo + SAMPLED_SHINGLES]), new[lo : lo + SAMPLED_SHINGLES].copy()
        row += int(begins[0])  # the document of the slice's first shingle
        begins[0] = True
        at = np.flatnonzero(begins)
        owner = np.cumsum(begins) - 1
        rows = np.arange(row, row + len(at))
        for k, seed in enumerate(_SEEDS):
            z = mix(h ^ seed)
            y = mix(z ^ np.uint64(0xA0761D6478BD642F))
            part = lambda x, shift: ((x >> np.uint64(shift)) & np.uint64(0xFFFFFF)).astype(np.float32) * unit + unit / 2
            r = -np.log(part(z, 40) * part(z, 16))
            c = -np.log(part(y, 40) * part(y, 16))
            beta = (y & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
            t = np.floor(lw / r + beta)
            cost = np.log(c) - r * (t - beta + 1)
            low = np.minimum.reduceat(cost, at)
            best = np.flatnonzero(cost == low[owner])
            best = best[np.concatenate([[True], owner[best[1:]] != owner[best[:-1]]])]
            sample = mix(h[best] ^ (t[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            better = low < least[k, rows]  # a document goes on over slices
            least[k, rows[better]], found[k, rows[better]] = low[better], sample[better]
        row += len(at) - 1
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    for k in range(len(_SEEDS)):
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(3) + found[k])
    return keys


def signed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, key, df binary (of its shingles, in order), b0 .. (null for texts without words) of docs; and the number of texts with words."""
    names = [f"b{i}" for i in range(BANDS)]
    n_docs = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count()
    batches = stored_by(packed(docs), "batch")
    blocks = _prime(batches.count() // BLOCK_BATCHES)

    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        answered = dict(zip(answers["block"].to_pylist(), answers["df"].to_pylist(), strict=True))
        out = []
        for body in packs["body"].to_pylist():
            parts = [(x.select(["doc_id", "key"]), *shingles(texts(x))) for x in _slices(body)]
            keys, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s, _ in parts)]), return_inverse=True)
            every = np.empty(len(keys), dtype=np.uint64)
            for k, at in _by_block(keys, blocks):
                every[at] = _numbers(answered[k], len(at))
            upto = 0
            for rows, doc, s, count in parts:
                df = every[place[upto : upto + len(s)]]
                upto += len(s)
                bands = samples(doc, s, idf(df, n_docs) * count.astype(np.float32)).view(np.int64)
                row = np.full(rows.num_rows, -1)
                row[np.unique(doc)] = np.arange(len(bands))
                take = pa.array(row, mask=row < 0)
                each = np.split(df, np.cumsum(np.bincount(doc, minlength=rows.num_rows))[:-1])
                columns = [*rows.columns, pa.array([_squeezed(x) if len(x) else b"" for x in each], pa.binary()), *(pa.array(bands[:, i]).take(take) for i in range(BANDS))]
                out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "df", *names]))
        return pa.Table.from_batches(out)

    rows = batches.groupBy("batch").cogroup(counts(batches, blocks).groupBy("batch"))
    return rows.applyInArrow(run, "doc_id long, key binary, df binary, " + ", ".join(f"{x} long" for x in names)), n_docs


def similarities(a: list[str], b: list[str], table: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of a[i] and b[i]: the sum of least weights over that of greatest ones."""
    sums, keys, heavy = [], [], []
    for side in (a, b):
        doc, s, count = shingles(side)
        w = table.of(s, count).astype(np.float64)
        sums.append(np.bincount(doc, weights=w, minlength=len(a)))
        keys.append((doc.astype(np.uint64) << np.uint64(48)) | s)
        heavy.append(w)
    if not len(keys[0]) or not len(keys[1]):
        return np.zeros(len(a))
    at = np.minimum(np.searchsorted(keys[0], keys[1]), len(keys[0]) - 1)
    both = np.flatnonzero(keys[0][at] == keys[1])
    common = np.bincount((keys[1][both] >> np.uint64(48)).astype(np.int64), weights=np.minimum(heavy[0][at[both]], heavy[1][both]), minlength=len(a))
    return common / np.maximum(sums[0] + sums[1] - common, 1e-12)


def linked(pairs: DataFrame, held: DataFrame, n_docs: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts in held (key, text, df) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a", 1 << 20):
            a, b = texts(batch, "text_a"), texts(batch, "text_b")
            like = similarities(a, b, known(a + b, batch.column("df_a").to_pylist() + batch.column("df_b").to_pylist(), n_docs))
            yield batch.select(["a", "b"]).filter(pa.array(like >= similarity))

    of = lambda c: held.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"), F.col("df").alias(f"df_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    return both.select("a", "b", "text_a", "text_b", "df_a", "df_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of all nodes of links (a, b) but the roots.

    Alternately every node hands its greater neighbours, then its smaller ones, to the least it knows, until nothing changes.
    """
    measure = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))]
    edges = stored(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct())
    before = None
    while (now := tuple(edges.agg(*measure).head())) != before:
        before = now
        if not now[0]:
            break
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(near.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct())
        least = stored(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(least, "v").select("m", F.explode(F.array("u", "v")).alias("v")).filter("m <> v")
        edges = stored(small.select(F.col("m").alias("u"), "v").distinct())
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


class _Classes:
    """The class of each candidate text so far: (key, class), by links found."""

    def __init__(self, keys: DataFrame, held: DataFrame, n_docs: int, similarity: float):
        self.of, self.held, self.n_docs, self.similarity = stored(keys.select("key", F.col("key").alias("class"))), held, n_docs, similarity

    def link(self, pairs: DataFrame) -> None:
        """Compares the texts of pairs (a, b) and joins the classes of those that are similar."""
        self.join(linked(pairs, self.held, self.n_docs, self.similarity))

    def join(self, links: DataFrame) -> None:
        """Joins the classes of links (a, b) between similar texts."""
        links = stored(links)
        by = lambda c: self.of.select(F.col("key").alias(c), F.col("class").alias(f"{c}_class"))
        between = links.join(by("a"), "a").join(by("b"), "b").select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))
        roots = components(between)
        moved = self.of.join(roots, F.col("class") == F.col("node"), "left")
        self.of = stored(moved.select("key", F.coalesce("root", "class").alias("class")))


def _members(placed: DataFrame) -> DataFrame:
    """placed: bucket, key. bucket, key, n of the texts in buckets of n > 1 texts; stored."""
    counts = stored(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return stored(placed.join(counts, "bucket").select("bucket", "key", "n"))


def _held(keyed: DataFrame, wanted: DataFrame, marked: DataFrame) -> DataFrame:
    """key, text, df (as in marked) of the wanted texts (key, doc_id), one row each; stored.

    A bitmap of FILTER_BITS bits, made of the wanted keys, keeps most other texts from being shuffled; it is that size for any corpus.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    rows = keyed.withColumns({"number": F.bitmap_bucket_number(place), "at": F.bitmap_bit_position(place)}).join(F.broadcast(bits), "number")
    rows = rows.filter(F.expr("getbit(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) = 1"))
    found = rows.select("key", "doc_id", "text").join(wanted.select("key", F.col("doc_id").alias("of")), "key").filter(F.col("doc_id").eqNullSafe(F.col("of")))
    # Of equal texts the df are equal.
    dfs = marked.select("key", "doc_id", "df").join(wanted.select("key", F.col("doc_id").alias("of")), "key").filter(F.col("doc_id").eqNullSafe(F.col("of")))
    return stored(found.select("key", "text").dropDuplicates(["key"]).join(dfs.select("key", "df").dropDuplicates(["key"]), "key"))


def _block_links(docs: list[str], classes: list, left: np.ndarray, right: np.ndarray, table: Weights, similarity: float) -> list[tuple[int, int]]:
    """Links between similar docs, one of left and one of right (numbers), of different classes: enough to join their classes.

    A shingle that a text has n times is n elements, so what two texts share is a product of matrices, built up over blocks of elements.
    """
    doc, s, count = shingles(docs)
    w = table.of(s, np.ones(len(s)))
    size = np.bincount(doc, weights=w * count, minlength=len(docs))
    repeat = ranges(np.zeros(len(s), dtype=np.int64), count)
    doc, w, element = np.repeat(doc, count), np.repeat(w, count), mix(np.repeat(s, count) + (repeat.astype(np.uint64) << np.uint64(48)))
    _, code, n = np.unique(element, return_inverse=True, return_counts=True)
    some = n[code] > 1
    doc, w, code = doc[some], w[some], np.unique(code[some], return_inverse=True)[1]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    row, column = (np.full(len(docs), -1) for _ in range(2))
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(code.max(initial=-1)) + 1, 4096):
        here = np.flatnonzero((code >= at) & (code < at + 4096))
        sides = []
        for place, n_rows, weight in ((row, len(left), w), (column, len(right), np.ones(len(w), dtype=np.float32))):
            m, mine = np.zeros((n_rows, 4096), dtype=np.float32), here[place[doc[here]] >= 0]
            m[place[doc[mine]], code[mine] - at] = weight[mine]
            sides.append(m)
        common += sides[0] @ sides[1].T
    either = size[left][:, None] + size[right][None, :] - common
    parent: dict = {}

    def root(x: object) -> object:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    links = []
    # A little below, as these are sums of 32-bit numbers: the exact comparison follows.
    for i, j in np.argwhere(common >= (similarity - 1e-4) * either).tolist():
        a, b = root(classes[left[i]]), root(classes[right[j]])
        if a != b and similarities([docs[left[i]]], [docs[right[j]]], table)[0] >= similarity:
            parent[a] = b
            links.append((int(left[i]), int(right[j])))
    return links


def _links_in_blocks(rows: DataFrame, classes: _Classes) -> DataFrame:
    """rows: bucket, key, class, n, centre_class. Links (a, b) between texts of one bucket and different classes, compared exactly.

    A bucket is dealt into blocks of about BLOCK_TEXTS, and a task compares two blocks. Texts of the centre's class need not meet each other, so where
    few are left over they are few blocks that meet the others.
    """
    n_docs, similarity = classes.n_docs, classes.similarity
    over = F.col("class") != F.col("centre_class")
    counts = stored(rows.groupBy("bucket").agg(F.ceil(F.count_if(over) / BLOCK_TEXTS).cast("int").alias("over"), F.ceil(F.count_if(~over) / BLOCK_TEXTS).cast("int").alias("within")))
    dealt = rows.join(counts, "bucket").withColumn("over_it", over)
    mine = F.pmod(F.xxhash64("key", F.lit(3)), F.when(F.col("over_it"), F.col("over")).otherwise(F.col("within"))).cast("int")
    # Blocks of what is left over are numbered from 0, the others follow; pairs of blocks (i, j) with i left over and i <= j.
    number = F.when(F.col("over_it"), mine).otherwise(F.col("over") + mine)
    dealt = dealt.withColumn("number", number)
    last = F.col("over") + F.col("within") - 1
    as_second = F.transform(F.sequence(F.lit(0), F.least(F.col("number"), F.col("over") - 1)), lambda i: F.struct(i.alias("i"), F.col("number").alias("j")))
    as_first = F.transform(F.sequence(F.col("number"), last), lambda j: F.struct(F.col("number").alias("i"), j.alias("j")))
    both = F.array_distinct(F.when(F.col("over_it"), F.concat(as_first, as_second)).otherwise(as_second))
    placed = dealt.select("bucket", "key", "class", "number", F.explode(both).alias("p")).select("bucket", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "key", "class", "number")
    placed = placed.join(classes.held, "key")

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        table = table.sort_by("key")
        number, keys = table["number"].to_numpy(), table["key"].to_pylist()
        docs = [x or "" for x in table["text"].to_pylist()]
        found = _block_links(docs, table["class"].to_pylist(), np.flatnonzero(number == i), np.flatnonzero(number == j), known(docs, table["df"].to_pylist(), n_docs), similarity)
        return pa.table({"a": pa.array([keys[x] for x, _ in found], pa.binary()), "b": pa.array([keys[y] for _, y in found], pa.binary())})

    return placed.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def _apart(rows: DataFrame) -> DataFrame:
    """The buckets whose texts (bucket, class) are of several classes; stored."""
    return stored(rows.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("bucket"))


def _compare(members: DataFrame, classes: _Classes) -> None:
    """Compares the texts of buckets (bucket, key, n) as the module says."""
    shared = stored(members.groupBy("key").agg(F.sum("n").alias("shared")))
    ranked = stored(members.join(shared, "key").select("bucket", "key", "n", F.struct("shared", "key").alias("rank")))
    centres = stored(ranked.groupBy("bucket").agg(F.max("rank").alias("rank")).select("bucket", F.col("rank.key").alias("centre")))
    now = lambda: ranked.join(classes.of, "key").select("bucket", "key", "n", "class")
    with_class = lambda: stored(centres.join(classes.of.select(F.col("key").alias("centre"), F.col("class").alias("centre_class")), "centre"))
    classes.link(now().join(with_class(), "bucket").filter("class <> centre_class").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct())
    rest = stored(now().join(_apart(now()), "bucket", "left_semi"))
    few = stored(rest.filter(F.col("n") <= BLOCK).select("bucket", "key", "class"))
    pairs = few.withColumnsRenamed({"key": "a", "class": "a_class"}).join(few.withColumnsRenamed({"key": "b", "class": "b_class"}), "bucket").filter("a_class < b_class")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not few.isEmpty():
        classes.link(pairs)
    many = rest.filter(F.col("n") > BLOCK).select("bucket", "key").join(classes.of, "key")
    if many.isEmpty():
        return
    # Buckets with one centre are one: the same texts meet in several bands.
    around = many.join(with_class(), "bucket").select(F.xxhash64("centre").alias("bucket"), "key", "class", "centre_class").distinct()
    around = stored(around)
    around = stored(around.join(_apart(around), "bucket", "left_semi"))
    if not around.isEmpty():
        classes.join(_links_in_blocks(around, classes))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key (digest of the text), class_id, worded (whether the text has a word): one row per row of docs.
    class_id is the least doc_id of the class.

    Texts are in one class if a chain of similar texts joins them; equal texts are. A text without words (null, empty) is
    like no other, and its class_id is its own doc_id. Repeated rows are in one class; a null doc_id counts only where a
    class has no other. Other columns are not read. An empty table gives no rows. A text of any length is compared whole: a
    text of 100 MB takes a task about 1 GB.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    bands = [f"b{i}" for i in range(BANDS)]
    folders = shared_folder(spark), shared_folder(spark)
    with scratch(spark):  # buckets, texts that were compared and links go when the classes are known
        rows, n_docs = signed(keyed)
        marked = stored(rows, folders[0])
        reps = stored(marked.filter("b0 is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), *(F.min(b).alias(b) for b in bands)))
        members = _members(reps.select("key", F.explode(F.array(*(F.xxhash64(F.lit(i), b) for i, b in enumerate(bands)))).alias("bucket")))
        if members.isEmpty():
            whole = reps.select("key", F.col("doc_id").alias("class_id"))
        else:
            keys = stored(members.select("key").distinct())
            wanted = stored(reps.select("key", "doc_id").join(keys, "key", "left_semi"))
            classes = _Classes(keys, _held(keyed, wanted, marked), n_docs, similarity)
            _compare(members, classes)
            tagged = stored(reps.select("key", "doc_id").join(classes.of, "key", "left").select("key", "doc_id", F.coalesce("class", "key").alias("class")))
            least = stored(tagged.groupBy("class").agg(F.min("doc_id").alias("class_id")))
            whole = tagged.join(least, "class").select("key", "class_id")
        whole = stored(whole, folders[1])
    worded = F.col("b0").isNotNull()
    return marked.select("doc_id", "key", "b0").join(whole, "key", "left").select("doc_id", "key", F.when(worded, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), worded.alias("worded"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without those whose class has a row that goes before (lower doc_id, null last; then lower key).

    Of repeated rows (same id and text) one stays, with words or without, whatever else is there. Other texts without words stay. Other columns stay as
    they are, whatever their names. An empty table stays empty. Long texts as in classify().
    """
    every = stored(classify(docs, id_col, text_col, similarity))
    classes = every.filter("worded")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    first = stored(classes.groupBy(F.col("class_id").alias("of_class")).agg(F.min(order).alias("first")))
    tagged = classes.join(first, F.col("class_id").eqNullSafe(F.col("of_class")))
    gone = tagged.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))))
    gone = stored(gone.select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key")).distinct())
    text = F.col(f"`{text_col}`")
    key = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    kept = docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_doc_id")) & (key == F.col("_key")), "left_anti")
    repeated = every.groupBy("doc_id", "key").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])
