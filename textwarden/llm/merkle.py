"""Merkle manifest of a dataset (operator 11): hash trees of ARITY children a node, one for each group, and one over their roots.

A tree is cut into aligned subtrees of BLOCK_LEVELS levels of hashing (ARITY ** BLOCK_LEVELS leaves), a row and a task each; their roots are
the leaves of the next tier, until one subtree is the whole tree. Inside a block digests lie in van Emde Boas order: the upper half of the
levels first, then each lower subtree, each so laid out again. `address` finds a node by arithmetic, when a block is built and when siblings are read.

Places of leaves come from a range sort and sums of its partitions, so a group with a third of all rows is spread like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

ARITY, BLOCK_LEVELS = 16, 3
#: Rows of a range that is sorted in one task, bytes of a digest, and rows that a task gives out at one time.
RANGE_ROWS, DIGEST, ROWS_OUT = 250_000, 32, 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with only A-Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def leaf_digest(*columns: Column) -> Column:
    """Hex SHA-256 of the columns: each `-` if null, else its UTF-8 bytes' count, `:` and itself."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(c.cast("string")) for c in columns)).cast("binary"), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def size(height: int) -> int:
    """Nodes of a full subtree of so many levels of nodes."""
    return (ARITY**height - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, height: int) -> np.ndarray:
    """Places of the nodes `index` of a level (the root's is 0) in the van Emde Boas order of a tree of `height` levels."""
    base = np.zeros(len(index), dtype=np.int64)
    while height > 1:
        upper = height // 2
        if depth < upper:
            height = upper
            continue
        below = ARITY ** (depth - upper)
        height -= upper
        base += size(upper) + index // below * size(height)
        depth, index = depth - upper, index % below
    return base


class Block:
    """An aligned subtree: its digests in van Emde Boas order, cut off after the last that is there.

    n_leaves leaves; levels: how often runs of ARITY are hashed above them. Nodes are named by their level (0: leaves) and number.
    """

    def __init__(self, nodes: bytes | bytearray, n_leaves: int, levels: int):
        self.nodes, self.n_leaves, self.levels = nodes, n_leaves, levels
        self.counts = [-(-n_leaves // ARITY**k) for k in range(levels + 1)]
        self._at = [address(levels - k, np.arange(n), levels + 1).tolist() for k, n in enumerate(self.counts)]
        self._paths: dict[tuple[int, int], list[str]] = {}

    @classmethod
    def of(cls, leaves: list[str], levels: int) -> Block:
        block = cls(bytearray(), len(leaves), levels)
        block.nodes = bytearray(DIGEST * (1 + max(max(x) for x in block._at)))
        row = leaves
        for k in range(levels + 1):
            for place, found in zip(block._at[k], row, strict=True):
                block.nodes[place * DIGEST : (place + 1) * DIGEST] = bytes.fromhex(found)
            row = [digest(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
        return block

    def read(self, level: int, first: int, last: int) -> str:
        """The digests of a level's nodes first to last - 1, joined."""
        at = self._at[level]
        return b"".join(self.nodes[p * DIGEST : (p + 1) * DIGEST] for p in at[first:last]).hex()

    @property
    def root(self) -> str:
        return self.read(self.levels, 0, 1)

    def path(self, level: int, index: int) -> list[str]:
        """Of each level from this one up to below the block's root: what stands left of the node in its run, and what stands right."""
        if level == self.levels:
            return []
        key = level, index
        if key not in self._paths:
            first = index - index % ARITY
            last = min(first + ARITY, self.counts[level])
            here = [self.read(level, first, index), self.read(level, index + 1, last)]
            self._paths[key] = here + self.path(level + 1, index // ARITY)
        return self._paths[key]


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = digest(left, leaf, right)
    return leaf


def _levels(n: int) -> int:
    """Times that runs of ARITY are hashed until one of n nodes remains."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos (the row's number in its tree, by `order`, nulls first) and n (rows of the tree); stored.

    A range sort, then counts of each tree in each range, of which a tree has one for each range at most.
    """
    ranges = 1 + rows.count() // RANGE_ROWS
    by = ["tree", *(F.asc_nulls_first(c) for c in order)]
    sorted_ = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    sorted_ = stored(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted_.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("n"))
    return stored(sorted_.join(counts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


BLOCK = "tree string, block long, n long, n_leaves int, levels int, nodes binary, root string"


def _tiers(leaves: DataFrame, block_levels: int) -> list[DataFrame]:
    """leaves: tree, pos, n, digest. The blocks (BLOCK) of each tier, stored; a tree goes on while it has several.

    n: leaves that the tree has in this tier.
    """
    full = ARITY**block_levels

    def built(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows["n"][0].as_py()
        block = Block.of(rows["digest"].to_pylist(), min(block_levels, _levels(n)))
        found = [rows["tree"][0].as_py(), rows["block"][0].as_py(), n, block.n_leaves, block.levels, bytes(block.nodes), block.root]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        return pa.table([pa.array([x], t) for x, t in zip(found, types, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

    tiers = []
    while True:
        dealt = leaves.select("tree", "pos", "n", "digest", F.expr(f"pos div {full}").alias("block"))
        tiers.append(stored(dealt.groupBy("tree", "block").applyInArrow(built, BLOCK)))
        more = tiers[-1].filter(F.col("n") > full)
        if more.isEmpty():
            return tiers
        leaves = more.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / full).cast("long").alias("n"), F.col("root").alias("digest"))


def _paths(blocks: DataFrame, block_levels: int) -> DataFrame:
    """tree, block (the leaf's number), above (its path to the root of all) of the leaves of blocks, which have `above` of their own."""
    full = ARITY**block_levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            block = Block(row["nodes"], row["n_leaves"], row["levels"])
            for lo in range(0, block.n_leaves, ROWS_OUT):
                some = range(lo, min(lo + ROWS_OUT, block.n_leaves))
                cols = [pa.array([row["tree"]] * len(some), pa.string()), pa.array([row["block"] * full + i for i in some], pa.int64())]
                cols.append(pa.array([block.path(0, i) + row["above"] for i in some], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(cols, ["tree", "block", "above"])

    # By block, so that a task holds one block at a time.
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree string, block long, above array<string>")


@dataclass
class Manifest:
    """leaves: tree, pos, n, digest and what else came with them; tiers: blocks of the trees; top_leaves, top: the same of the tree over their roots."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top_leaves: DataFrame
    top: list[DataFrame]
    block_levels: int

    def blocks(self) -> DataFrame:
        """The lowest blocks of the trees, each with `above` (the path from its root to the root of all), subroot and root_of_all.

        From the top down: a block hands each of its leaves, the blocks of the tier below, the path from there.
        """
        full = ARITY**self.block_levels
        known = self.top[-1].withColumn("above", F.array().cast("array<string>"))
        whole = known.select(F.col("root").alias("root_of_all"))  # the one block that is above all
        for below in reversed(self.top[:-1]):
            known = stored(below.join(_paths(known, self.block_levels), ["tree", "block"]))
        ends = self.top_leaves.join(_paths(known, self.block_levels).select(F.col("block").alias("pos"), "above"), "pos")
        ends = stored(ends.join(F.broadcast(whole)).select(F.col("name").alias("tree"), "above", F.col("digest").alias("subroot"), "root_of_all"))
        upper = None
        for tier in reversed(self.tiers):
            known = tier.filter(F.col("n") <= full).join(ends, "tree")
            if upper is not None:
                lower = tier.filter(F.col("n") > full).join(_paths(upper, self.block_levels), ["tree", "block"])
                known = known.unionByName(lower.join(ends.drop("above"), "tree").select(*known.columns))
            upper = stored(known)
        return upper


def build(rows: DataFrame, group: str, order: list[str], leaf: str, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of rows: a tree for each value of `group`, its leaves by `order` (ties by digest); trees by their group, null first, then by bytes.

    Other columns are kept with the leaves. Repeated rows are leaves of their own.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = placed(rows.withColumns({"tree": tree, "digest": F.col(leaf)}), *order, "digest")
    tiers = _tiers(leaves, block_levels)
    ended = [t.filter(F.col("n") <= ARITY**block_levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")) for t in tiers]
    top = placed(reduce(DataFrame.unionByName, ended), "name")
    return Manifest(leaves, tiers, top, _tiers(top, block_levels), block_levels)


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """The leaves of one block, checked: digest is the manifest's, shown the one that is presented."""
    rows, found = rows.sort_by("pos"), blocks.slice(0, 1).to_pylist()[0]
    block = Block(found["nodes"], found["n_leaves"], found["levels"])
    above, root = found["above"], found["root_of_all"]
    high = "".join(above)
    ends: dict[str, str] = {}  # of a block's root: the root of all that it gives
    proofs, roots = [], []
    for i, shown in enumerate(rows["shown"].to_pylist()):
        path = block.path(0, i)
        proofs.append(digest(*path, high))
        own = fold(shown, path)
        if own not in ends:
            ends[own] = fold(own, above)
        roots.append(ends[own])
    n = rows.num_rows
    cols = [rows["doc_id"], rows["digest"], pa.array([found["subroot"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])]
    return pa.table(cols, [x.split()[0] for x in PROVED.split(", ")])


def prove(manifest: Manifest) -> DataFrame:
    """Each leaf with its proof and the root that `shown`, the digest presented for it, gives along the manifest's siblings.

    A leaf's proof is the digests beside it in its runs, level by level up to the root of all. leaves need doc_id and shown.
    """
    blocks = manifest.blocks().select("tree", "block", "n_leaves", "levels", "nodes", "above", "subroot", "root_of_all")
    rows = manifest.leaves.select("tree", F.expr(f"pos div {ARITY**manifest.block_levels}").alias("block"), "pos", "doc_id", "digest", "shown")
    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_proved, PROVED)


#: The columns of a leaf.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(docs: DataFrame, tampered: Column, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """PROVED of each document: leaves of FIELDS, a tree for each source by doc_id. Rows for which `tampered` holds present their text with A-Z in lower case.

    A null field is `-`; a null doc_id comes first and a null `tampered` is false. Rows of one id stand by their digests; repeated rows are
    leaves of their own. A single row has an empty proof and is the root. An empty table gives no rows. Columns besides FIELDS and what
    `tampered` reads are not read. A text of any length is hashed whole, in the JVM, and is not shuffled.
    """
    given = docs.select(*FIELDS, F.coalesce(tampered, F.lit(False)).alias("tampered"))
    own = [F.col(c) for c in FIELDS]
    rows = given.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*own).alias("leaf"), F.when(F.col("tampered"), leaf_digest(*own[:-1], folded(own[-1]))).alias("changed"))
    rows = stored(rows.withColumn("shown", F.coalesce("changed", "leaf")).drop("changed"))
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], PROVED)
    return prove(build(rows, "source", ["doc_id"], "leaf", block_levels))


#: Levels that the SQL has for a source's tree and for the one above.
SQL_LEVELS = 5


def _oracle() -> str:
    """The same rows as the query over `documents`: runs as lists, level by level, with every document's proof and folded digest beside them."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in [*FIELDS[:-1], text]) + ")"
    byte = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {byte}), lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"
    parts = [
        f"""f AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents
)""",
        "a0 AS (SELECT r, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof, coalesce(changed, leaf) AS cur FROM f)",
        "an0 AS (SELECT a0.tree, i, count(*) OVER (PARTITION BY a0.tree) AS n, leaf AS h FROM a0 JOIN f USING (r))",
    ]

    def tier(x: str) -> None:
        for k in range(SQL_LEVELS):
            parts.extend([
                f"{x}r{k} AS (SELECT tree, i // {ARITY} AS i, list(h ORDER BY i) AS hs, any_value((n + {ARITY - 1}) // {ARITY}) AS n FROM {x}n{k} WHERE n > 1 GROUP BY ALL)",
                f"{x}n{k + 1} AS (SELECT tree, i, n, sha256(array_to_string(hs, '')) AS h FROM {x}r{k} UNION ALL SELECT tree, i, n, h FROM {x}n{k} WHERE n = 1)",
                f"""{x}s{k} AS (
  SELECT {x}{k}.*, hs, array_to_string(hs[1:{x}{k}.i % {ARITY}], '') AS left_, array_to_string(hs[{x}{k}.i % {ARITY} + 2:], '') AS right_
  FROM {x}{k} LEFT JOIN {x}r{k} ON {x}r{k}.tree = {x}{k}.tree AND {x}r{k}.i = {x}{k}.i // {ARITY}
)""",
                f"""{x}{k + 1} AS (
  SELECT r, tree, i // {ARITY} AS i, CASE WHEN hs IS NULL THEN proof ELSE proof || left_ || right_ END AS proof,
         CASE WHEN hs IS NULL THEN cur ELSE sha256(left_ || cur || right_) END AS cur FROM {x}s{k}
)""",
            ])

    tier("a")
    parts.append(f"bn0 AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM an{SQL_LEVELS})")
    parts.append(f"b0 AS (SELECT r, '' AS tree, bn0.i, proof, cur FROM a{SQL_LEVELS} a JOIN bn0 ON bn0.name = a.tree)")
    tier("b")
    return f"""
WITH {", ".join(parts)}
SELECT f.doc_id, f.leaf, bn0.h AS subroot, top.h AS root, sha256(b.proof) AS proof_sha256, b.cur AS folded_root, b.cur = top.h AS verified
FROM f JOIN b{SQL_LEVELS} b USING (r) JOIN bn0 ON bn0.name = f.tree CROSS JOIN bn{SQL_LEVELS} top
"""


ORACLE_SQL = _oracle()
