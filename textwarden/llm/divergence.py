"""Audit of how sources diverge in their words (operator 13).

Spark counts the terms of each group (language, source) and deals the kept terms of a language into blocks of about BLOCK_TERMS
by a hash; a block's terms, the most frequent first, have consecutive ids. Over a block each group has a segment tree of its
counts. The trees are hash-consed: subtrees with the same counts, of whatever group or place, are one node. Two groups are
compared by going down both trees at once, level by level: equal pairs of nodes are met once, with the number of times they
occur, so a pair of counts is priced once for a block, however many terms have it. Sums of blocks add up to those of a language.

All numbers are integers. A share is 1 + floor(SCALE * (count + 1) / (N + V)), by long division in steps of 1000, so it is
exact while N + V is below 9.2e15; a language's sum is at most (SCALE + V) squared, which fits while V is below 2e9.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, scratch, shared_folder, stored

#: Documents of a language that a kept term is in, at least, and ranks of terms that a group gets.
MIN_DOCS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
BLOCK_TERMS = 1024
#: Bytes of text that are split at one time, and counts that a task holds before it hands them on.
WINDOW_BYTES, HELD_COUNTS = 2 << 20, 300_000
#: Parts that a language's row is copied into for the join that tells terms how many blocks their language has.
SALTS = 32
#: Every byte of a term as it is counted (A-Z as a-z), every other as a space.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about WINDOW_BYTES each, or of one longer term."""
    bare = raw.translate(_TERM)
    at = 0
    while at < len(bare):
        stop = bare.find(b" ", at + WINDOW_BYTES)
        stop = len(bare) if stop < 0 else stop
        yield (bare if stop - at == len(bare) else bare[at:stop]).split()
        at = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it) of docs (lang, source, text), as partial sums of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in counts.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), dtype=np.int8)), [x]).cast(pa.string()) for x in (lang, source)]
                cols = [*same, terms, pa.array(n.values(), pa.int64()), pa.array([rows[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            counts.clear()

        for batch in chunks(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw, strict=True):
                n, rows = counts[lang, source]
                seen: set[bytes] = set()
                for found in words(text):
                    n.update(found)
                    seen.update(found)
                rows.update(seen)
            if sum(len(n) for n, _ in counts.values()) > HELD_COUNTS:
                yield from out()
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly; count < total."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):  # SCALE is 1000 cubed
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Forest:
    """Hash-consed segment trees, one for each row of counts; a place that is no term has a count below 0.

    counts: the distinct counts, which leaves are numbers of; levels, from the leaves up: left and right child of each node;
    roots: the root of each tree.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((len(counts), width), -1, dtype=np.int64)
        padded[:, : counts.shape[1]] = counts
        self.counts, node = np.unique(padded, return_inverse=True)
        node = node.reshape(padded.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = len(self.counts)
        while node.shape[1] > 1:
            pairs, above = np.unique(node[:, ::2] * size + node[:, 1::2], return_inverse=True)
            self.levels.append((pairs // size, pairs % size))
            node, size = above.reshape(len(node), -1), len(pairs)
        self.roots = node[:, 0]

    def pairs(self, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of this tree and every other: the other's number, a count here, a count there, how many terms have these; each once."""
        other = np.arange(len(self.roots))
        a, b, times = np.full(len(other), self.roots[tree]), self.roots, np.ones(len(other), dtype=np.int64)
        for left, right in reversed(self.levels):
            size = int(max(left.max(), right.max())) + 1
            key = np.concatenate([(other * size + left[a]) * size + left[b], (other * size + right[a]) * size + right[b]])
            key, at = np.unique(key, return_inverse=True)
            new = np.zeros(len(key), dtype=np.int64)
            np.add.at(new, at, np.concatenate([times, times]))
            other, a, b, times = key // (size * size), key // size % size, key % size, new
        here, there = self.counts[a], self.counts[b]
        some = here >= 0
        return other[some], here[some], there[some], times[some]


_OUT = "lang string, source string, part string, item string, value long"


def _priced(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """One block. terms: term, cells (source, n). groups: lang, source, n, lang_n, v. Rows of _OUT: sums of pairs, and a group's first terms."""
    lang, sources = groups["lang"][0], groups["source"].combine_chunks()
    own, v, total = groups["n"].to_numpy(), int(groups["v"][0].as_py()), int(groups["lang_n"][0].as_py())
    counts = np.zeros((len(sources), terms.num_rows), dtype=np.int64)
    cells = terms["cells"].combine_chunks()
    if terms.num_rows:
        row = pc.index_in(cells.flatten().field("source"), value_set=sources).to_numpy()
        counts[row, pc.list_parent_indices(cells).to_numpy()] = cells.flatten().field("n").to_numpy()
    all_counts = counts.sum(axis=0)
    names = terms["term"].combine_chunks()
    by_name = np.empty(len(names), dtype=np.int64)
    by_name[pc.array_sort_indices(names.cast(pa.binary())).to_numpy()] = np.arange(len(names))
    order = np.lexsort((by_name, -all_counts))
    counts, all_counts, names, by_name = counts[:, order], all_counts[order], names.take(pa.array(order)), by_name[order]
    forest = Forest(counts)
    q_lang = shares(all_counts, np.int64(total + v))
    out: list[pa.Table] = []
    names_of = ["source", "part", "item", "value"]

    def add(source: int, part: str, item: pa.Array, value: np.ndarray) -> None:
        n = len(value)
        out.append(pa.table([pa.array([sources[source].as_py()] * n, pa.string()), pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())], names_of))

    for g in range(len(sources)):
        value = np.zeros(len(sources), dtype=np.int64)
        if len(order):
            other, here, there, times = forest.pairs(g)
            np.add.at(value, other, times * prices(shares(here, np.int64(own[g] + v)), shares(there, own[other] + v)))
            some = np.flatnonzero(counts[g] > 0)
            p = shares(counts[g][some], np.int64(own[g] + v))
            some, p = some[p > q_lang[some]], p[p > q_lang[some]]
            f = prices(p, q_lang[some])
            first = np.lexsort((by_name[some], -f))[:TOP_TERMS]
            add(g, "term", names.take(pa.array(some[first])), f[first])
        others = np.flatnonzero(np.arange(len(sources)) != g)
        add(g, "pair", sources.take(pa.array(others)), value[others])
    found = pa.concat_tables(out)
    return found.add_column(0, "lang", pa.array([lang.as_py()] * found.num_rows, pa.string()))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each group is from the other sources of its language, and its first terms.

    Null language, source and text are empty strings; a group without terms has counts of 0, and a language without kept terms
    values of 0. Repeated rows are documents of their own. Equal values are ranked by item. An empty table gives no rows. Other columns
    are not read. A text of any length is split in windows; its distinct terms are held. A block holds sources x BLOCK_TERMS
    counts, and the rows of pairs are sources squared by contract, so the sources of one language are some ten thousand at most.
    """
    spark = docs.sparkSession
    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    folder = shared_folder(spark)
    with scratch(spark):
        # Dealt by term, so that sums by source, then by term, need no other shuffle.
        by_source = term_counts(named).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
        kept = stored(by_term.filter(F.col("docs") >= MIN_DOCS).select("lang", "term", "cells"))
        sums = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
        sums = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
        sums = stored(sums)
        size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        langs = sums.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(size, "lang", "left").select("lang", "lang_n", F.coalesce("v", F.lit(0)).alias("v"))
        langs = stored(langs.withColumn("blocks", F.ceil(F.greatest("v", F.lit(1)) / BLOCK_TERMS).cast("int")))
        salted = langs.select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        hash_ = F.xxhash64("term")
        dealt = kept.withColumn("salt", F.pmod(hash_, F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).select("lang", F.pmod(F.shiftright(hash_, 8), F.col("blocks")).cast("int").alias("block"), "term", "cells")
        everywhere = sums.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "n", "lang_n", "v")
        priced = stored(dealt.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(_priced, _OUT))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        summed = priced.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        terms = priced.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
        return stored(summed.withColumn("rank", F.row_number().over(order)).unionByName(terms), folder)


#: The same rows as the query over `documents`.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT d.lang, d.source, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) d
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + langs.v) AS p,
         1 + {SCALE}::HUGEINT * (kept.n + 1) // (langs.n + langs.v) AS q
  FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
