"""Quality rules (operator 5): simple text statistics, and the perplexity of a character n-gram model of the corpus.

Spark counts the n-grams of all documents; a modified Kneser-Ney model is made of the counts with joins and sums. Its most
frequent n-grams (a fixed number) are sent to every task, the others are dealt out by n-gram: batches of documents ask for those
they hold, so no task or driver holds the whole. Every n-gram of the corpus is in it. A document goes if its perplexity lies outside
its language's band: too low is repetitive, too high is unlike the language. Bands come from the quartiles of each language's documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, mix, scratch, shared_folder, stored, stored_by, texts, word_hashes, word_starts

#: Symbols of an n-gram: 5 times 12 bits fit one signed 64-bit number.
ORDER, BITS = 5, 12
#: Code points below SINGLES are a symbol each; others are two, of their upper bits (from SINGLES on) and their lower 10
#: (from LOWS on), so no two characters share symbols.
SINGLES, LOWS = 1984, 3072
MASK = (1 << BITS) - 1
#: Characters turned into symbols, and symbols into n-grams, at one time.
WINDOW = 1 << 22
#: Bytes of text in a batch, whose different n-grams get their part of the model.
BATCH_BYTES = 16 << 20
#: Distinct n-grams that a task holds before it hands its counts on.
HELD_GRAMS = 1_500_000
#: The most frequent n-grams, so many at most, are sent to every task; batches ask for the others.
SENT_GRAMS = 1 << 20
#: Batches and n-grams of the model for each block of it that is asked.
BLOCK_BATCHES, BLOCK_GRAMS = 40, 2_000_000
#: A band reaches so many interquartile ranges beyond the quartiles of the log-perplexity, which is counted in steps.
BAND_RANGES, STEP = 3.0, 0.001
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_BLANK = np.zeros(0x21, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def symbols(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as symbols (16-bit), and the number of them of each text.

    ORDER - 1 zeros stand before each text. A run of blanks is one space; NUL is symbol 1.
    """
    found, sizes = [np.zeros(0, dtype=np.uint16)], np.zeros(len(docs), dtype=np.int64)
    held: list[str] = []
    owners: list[int] = []
    blank_before = False

    def taken() -> None:
        nonlocal blank_before
        points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        blank = _BLANK[np.minimum(points, 0x20)] & (points <= 0x20)
        many = (~(blank & np.concatenate([[blank_before], blank[:-1]]))).astype(np.int8)
        blank_before = bool(blank[-1])
        points = np.where(blank, np.uint32(0x20), points)
        many[points >= SINGLES] = 2
        s = np.repeat(points, many)
        if len(high := np.flatnonzero(points >= SINGLES)):
            at = np.cumsum(many, dtype=np.int64)[high] - 2
            s[at], s[at + 1] = SINGLES + (points[high] >> np.uint32(10)), LOWS + (points[high] & np.uint32(1023))
        found.append(s.astype(np.uint16))
        lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        np.add.at(sizes, owners, np.add.reduceat(many, np.cumsum(lengths) - lengths, dtype=np.int64))
        held.clear()
        owners.clear()

    size = 0
    for i, d in enumerate(docs):
        d = "\0" * (ORDER - 1) + d.replace("\0", "\1")
        for lo in range(0, len(d), WINDOW):
            held.append(d[lo : lo + WINDOW])
            owners.append(i)
            size += len(held[-1])
            if size >= WINDOW:
                taken()
                size = 0
    if held:
        taken()
    return np.concatenate(found), sizes - (ORDER - 1)


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each place, as a number (places before the n-th: what there is)."""
    s = s.astype(np.uint64)
    g = s.copy()
    for k in range(1, n):
        g[k:] |= s[:-k] << np.uint64(BITS * k)
    return g


def gram_windows(s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The n-grams of ORDER symbols that end at each place, in windows: the first place, and the n-grams from there on."""
    for lo in range(0, len(s), WINDOW):
        before = max(0, lo - ORDER + 1)
        yield lo, grams(s[before : lo + WINDOW], ORDER)[lo - before :]


def packed(docs: DataFrame) -> DataFrame:
    """batch long, body binary: the rows of docs in batches of about BATCH_BYTES of text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as to:
                to.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "body"])

        for batch in chunks(batches):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if size >= BATCH_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "batch long, body binary")


def _slices(body: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of a packed batch, in slices."""
    return chunks(iter(pa.ipc.open_stream(body)))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for b in batches:
        yield from zip(b.column("batch").to_pylist(), b.column("body").to_pylist(), strict=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of ORDER symbols of the rows' texts, sorted, and their counts."""
    s, _ = symbols(texts(batch))
    parts = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
    for lo, g in gram_windows(s):
        g = g[s[lo : lo + len(g)] > 0]
        g.sort()
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[: len(g)])
        parts.append((g[first], np.diff(np.append(first, len(g)))))
        if len(parts) > 2:
            parts = [_merged(parts)]
    return _merged(parts) if len(parts) > 1 else parts[0]


def gram_counts(batches: DataFrame) -> DataFrame:
    """gram long, n long: counts of the n-grams of ORDER symbols over all texts of the packed batches."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].astype(np.int64)), pa.array(x[1])], ["gram", "n"])
        for _, body in _bodies(rows):
            for part in _slices(body):
                held.append(_counted(part))
                if sum(len(k) for k, _ in held) > 2 * HELD_GRAMS:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD_GRAMS:
                        yield out(held.pop())
        if held:
            yield out(_merged(held))

    return batches.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts of 1, 2, and 3 or more."""
    r = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).head()
    n1, n2, n3, n4 = (float(r[f"n{k}"]) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    found = [(1 - 2 * y * n2 / n1) if n1 else 0.5, (2 - 3 * y * n3 / n2) if n2 else 1.0, (3 - 4 * y * n4 / n3) if n3 else 1.5]
    return tuple(min(max(d, 0.1 * k), 0.9 * k) for k, d in enumerate(found, 1))


class GramTable:
    """A number for each n-gram, in arrays sorted by the n-gram's hash; an index by the hash's first bits finds them."""

    def __init__(self, gram: np.ndarray, cost: np.ndarray):
        keys = mix(gram.astype(np.uint64))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(0))
        self.cost = np.append(cost[order], 0).astype(np.float32)  # one place more, for n-grams that aren't there
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        firsts = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.index = np.append(np.searchsorted(self.keys[:-1], firsts), len(keys)).astype(np.int32)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Places of the n-grams; the last place if absent. The hash is one to one, so what is found is the n-gram."""
        h = mix(gram)
        bucket = (h >> self.shift).astype(np.int64)
        at, stop = self.index[bucket], self.index[bucket + 1]
        out = np.full(len(h), len(self.keys) - 1, dtype=np.int32)
        left = np.flatnonzero(at < stop)
        at, stop, h = at[left], stop[left], h[left]
        while len(left):
            same = self.keys[at] == h
            out[left[same]] = at[same]
            on = np.flatnonzero(~same & (at + 1 < stop))
            left, at, stop, h = left[on], at[on] + 1, stop[on], h[on]
        return out

    def lacks(self, gram: np.ndarray) -> np.ndarray:
        """Which of the n-grams it doesn't hold."""
        return self.find(gram) == len(self.keys) - 1


def levels(batches: DataFrame) -> list[DataFrame]:
    """For the n-grams of 1 to ORDER symbols, all of them: gram, n (count), share, and back of the context."""
    counts = stored(gram_counts(batches))
    found = []
    for n in range(ORDER, 0, -1):
        d1, d2, d3 = _discounts(counts)
        c = F.col("n")
        rows = counts.select("gram", F.shiftright("gram", BITS).alias("context"), "n", F.when(c == 1, d1).when(c == 2, d2).otherwise(d3).alias("less"))
        of = rows.groupBy("context").agg(F.sum("n").alias("of"), F.sum("less").alias("all_less"))
        found.append(rows.join(of, "context").select("gram", "n", ((c - F.col("less")) / F.col("of")).alias("share"), (F.col("all_less") / F.col("of")).alias("back")))
        # Lower orders count the different symbols before them.
        if n > 1:
            counts = stored(counts.groupBy(F.col("gram").bitwiseAND((1 << BITS * (n - 1)) - 1).alias("gram")).agg(F.count("gram").alias("n")))
    return found[::-1]


def gram_costs(batches: DataFrame) -> DataFrame:
    """gram long, n long, cost float: count and -ln p of the last symbol after the others, for each n-gram of ORDER symbols of the corpus."""
    lower = None
    for n, rows in enumerate(levels(batches), 1):
        if lower is None:
            p = F.col("share") + F.col("back") / (1 << BITS)  # the lowest order stands on an even chance of all symbols
        else:
            rows = rows.withColumn("rest", F.col("gram").bitwiseAND((1 << BITS * (n - 1)) - 1)).join(lower.withColumnRenamed("gram", "rest"), "rest")
            p = F.col("share") + F.col("back") * F.col("p")
        if n < ORDER:
            lower = stored(rows.select("gram", p.alias("p")))
    return rows.select("gram", "n", (-F.log(F.greatest(p, F.lit(1e-12)))).cast("float").alias("cost"))


def frequent(model: DataFrame) -> tuple[float, GramTable]:
    """The count from which on n-grams are among the SENT_GRAMS most frequent ones, to a quarter of its power of two, and their table."""
    step = F.floor(F.log2("n") * 4)
    steps = sorted(((r.step, r.n) for r in model.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = float("inf"), 0
    for k, n in steps:
        if (total := total + n) > SENT_GRAMS:
            break
        least = float(k)
    found = model.filter(step >= least).select("gram", "cost").toArrow()
    return least, GramTable(found["gram"].to_numpy(), found["cost"].to_numpy())


def _prime(least: int) -> int:
    n = max(least, 17)
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def costs_of_batches(batches: DataFrame, rare: DataFrame, sent: GramTable, blocks: int) -> DataFrame:
    """batch, block, costs binary (float32): of the batch's different n-grams that `sent` lacks and whose rest by `blocks` is the block, in order.

    Each batch asks for what its texts hold, block by block; a block's task looks it up in its share of the model (rare).
    """
    shared = batches.sparkSession.sparkContext.broadcast(sent)

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body in _bodies(rows):
            keys = _keys(body)
            keys = keys[shared.value.lacks(keys)]
            of = keys % np.uint64(blocks)
            asked = [(k, keys[of == k]) for k in np.unique(of)]
            if asked:
                # Differences of sorted numbers, their bytes by place: short when compressed.
                bodies = [pa.compress(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True) for _, x in asked]
                yield pa.RecordBatch.from_pydict({"block": [int(k) for k, _ in asked], "batch": [batch] * len(asked), "n": [len(x) for _, x in asked], "asked": bodies})

    def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
        keys = model["gram"].to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        keys, costs = keys[order], model["cost"].to_numpy()[order]
        out = []
        for n, body in zip(asked["n"].to_pylist(), asked["asked"].to_pylist(), strict=True):
            raw = np.frombuffer(pa.decompress(body, decompressed_size=8 * n, codec="zstd"), dtype=np.uint8)
            grams_of = np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
            at = np.searchsorted(keys, grams_of)
            assert np.array_equal(keys[at], grams_of), "the model lacks an n-gram of its corpus"
            out.append(costs[at].astype(np.float32).tobytes())
        return pa.table({"batch": asked["batch"], "block": asked["block"], "costs": pa.array(out, pa.binary())})

    asked = batches.mapInArrow(ask, "block long, batch long, n long, asked binary")
    model = rare.select("gram", "cost").withColumn("block", F.col("gram") % blocks)
    return asked.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(answer, "batch long, block long, costs binary")


def _keys(body: bytes) -> np.ndarray:
    """The different n-grams of ORDER symbols of a packed batch, sorted."""
    parts = [_counted(x) for x in _slices(body)]
    return _merged(parts)[0] if parts else np.zeros(0, dtype=np.uint64)


def mean_costs(docs: list[str], table: GramTable) -> np.ndarray:
    """Mean of the table's costs over the n-grams of ORDER symbols of each text; 0 for an empty one."""
    s, sizes = symbols(docs)
    ends, total = np.cumsum(sizes + ORDER - 1), np.zeros(len(docs))
    for lo, g in gram_windows(s):
        hi = lo + len(g)
        upto = np.concatenate([[0.0], np.cumsum(np.where(s[lo:hi] > 0, table.cost[table.find(g)], 0).astype(np.float64))])
        own = np.arange(np.searchsorted(ends, lo, side="right"), min(np.searchsorted(ends, hi) + 1, len(docs)))
        total[own] += upto[np.minimum(ends[own], hi) - lo] - upto[np.maximum(ends[own] - sizes[own], lo).clip(max=hi) - lo]
    return total / np.maximum(sizes, 1)


def repeated_words(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: words, and words within 3-word windows that the text holds twice or more.

    Windows of the same hash are compared word for word.
    """
    w, n_words = word_hashes(docs)
    covered = np.zeros(len(w), dtype=bool)
    ends = np.cumsum(n_words)
    if len(w) >= 3:
        doc = np.repeat(np.arange(len(docs), dtype=np.uint32), n_words)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        key = mix(w[:-2] + mix(w[1:-1] + mix(w[2:])))[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1))
        del w
        order = np.argsort(key)
        key = key[order]
        same = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
        some = same | np.append(same[1:], False)[: len(key)]
        found, goes_on = inside[order[some]], same[some].tolist()
        del key, order, inside
        raw = "\n".join(docs).encode("utf-8", "surrogatepass")
        starts = word_starts(raw)
        begin, stop = starts[found].tolist(), np.append(starts, len(raw))[found + 3].tolist()
        twice, run = [], []
        for i, d, a, b, on in zip(found.tolist(), doc[found].tolist(), begin, stop, goes_on, strict=True):
            if not on:
                twice += _agreeing(run)
                run = []
            run.append(((d, *raw[a:b].split()), i))
        twice += _agreeing(run)
        twice = np.array(twice, dtype=np.int64)
        for k in range(3):
            covered[twice + k] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    return n_words, total[ends] - total[ends - n_words]


def _agreeing(run: list[tuple[tuple, int]]) -> list[int]:
    """Of windows of one hash, (text and words, number), the numbers of those whose words another one of the text has."""
    if all(words == run[0][0] for words, _ in run):
        return [i for _, i in run] if len(run) > 1 else []
    of: dict[tuple, list[int]] = {}
    for words, i in run:
        of.setdefault(words, []).append(i)
    return [i for same in of.values() if len(same) > 1 for i in same]


def dup_lines(doc: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in doc.split("\n"):
        if line.strip("\x20\x09\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, lang and the statistics of each row."""
    batches = stored_by(packed(docs.select("doc_id", "row_hash", "lang", "text")), "batch")
    model = stored(gram_costs(batches))
    least, sent = frequent(model)
    blocks = _prime(max(batches.count() // BLOCK_BATCHES, model.count() // BLOCK_GRAMS))
    shared = docs.sparkSession.sparkContext.broadcast(sent)
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batch: pa.Table, costs: pa.Table) -> pa.Table:
        body = batch["body"][0].as_py()
        keys = _keys(body)
        at = shared.value.find(keys)
        cost, lacking = shared.value.cost[at], at == len(shared.value.keys) - 1
        of = np.where(lacking, keys % np.uint64(blocks), np.uint64(blocks))
        for block, found in zip(costs["block"].to_pylist(), costs["costs"].to_pylist(), strict=True):
            cost[of == block] = np.frombuffer(found, dtype=np.float32)
        table = GramTable(keys, cost)
        out = []
        for part in _slices(body):
            t = texts(part)
            n_words, n_repeat = repeated_words(t)
            cols = [
                n_words,
                [len(d) - sum(map(d.count, "\x20\x09\x0a\x0b\x0c\x0d")) for d in t],
                [sum(map(d.count, SYMBOLS)) for d in t],
                [dup_lines(d) for d in t],
                n_repeat,
            ]
            arrays = [part.column("doc_id"), part.column("row_hash"), part.column("lang"), *(pa.array(c, pa.int64()) for c in cols), pa.array(mean_costs(t, table), pa.float64())]
            out.append(pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_hash", "lang", *names]))
        return pa.Table.from_batches(out)

    rare = model.filter(F.floor(F.log2("n") * 4) < least)
    costs = costs_of_batches(batches, rare, sent, blocks)
    return batches.groupBy("batch").cogroup(costs.groupBy("batch")).applyInArrow(run, f"doc_id long, row_hash long, lang string, {STATS}")


def bands(measured: DataFrame, ranges: float = BAND_RANGES) -> DataFrame:
    """of_lang, low, high: the band of each language, from its documents that pass the base rules.

    Quartiles are exact to STEP: log-perplexities are counted in steps.
    """
    steps = measured.filter(~F.col("base_failed")).groupBy("lang", F.floor(F.col("log_perplexity") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    to = Window.partitionBy("lang").orderBy("step")
    upto = steps.withColumn("upto", F.sum("n").over(to)).withColumn("of", F.sum("n").over(Window.partitionBy("lang")))
    q = lambda share: F.min(F.when(F.col("upto") >= share * F.col("of"), F.col("step"))) * STEP
    found = upto.groupBy("lang").agg(q(0.25).alias("q1"), q(0.75).alias("q3"))
    spread = ranges * (F.col("q3") - F.col("q1") + STEP)
    return found.select(F.col("lang").alias("of_lang"), (F.col("q1") - spread).alias("low"), (F.col("q3") + STEP + spread).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, row_hash (of the text), lang, the statistics, base_failed, low, high, kept.

    A null or empty text has no words and fails the base rules. Null languages are one language. A language none of
    whose documents passes the base rules keeps none. Repeated rows are each judged, and counted in the model, as often as they
    stand there; documents of equal perplexity are judged alike. Other columns are not read. An empty table gives no rows. A text of
    any length is taken whole, in windows; a task holds it once, with about 30 bytes a word.
    """
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"coalesce(cast(`{lang_col}` as string), '') as lang", f"`{text_col}` as text", f"xxhash64(`{text_col}`) as row_hash")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    folder = shared_folder(docs.sparkSession)
    with scratch(docs.sparkSession):  # the packed texts and the model go when the documents are measured
        measured = stored(measure(docs).withColumn("base_failed", failed), folder)
    band = stored(bands(measured))
    if band.count() <= 10_000:  # a row per language
        band = F.broadcast(band)
    joined = measured.join(band, F.col("lang") == F.col("of_lang"), "left").drop("of_lang")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False)))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows and columns of docs that judge() keeps; repeated rows, nulls and long texts as there. An empty table stays empty."""
    kept = judge(docs, id_col, text_col, lang_col).filter("kept").select(F.col("doc_id").alias("_doc_id"), F.col("row_hash").alias("_row_hash"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(f"`{text_col}`") == F.col("_row_hash"))
    return docs.join(kept, same, "left_semi")
