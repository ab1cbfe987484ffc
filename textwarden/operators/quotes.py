"""Quotes that documents hold word for word or nearly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.fuzzy import Quotes

#: Characters of items that are searched for at once, and of documents in a part, where the items are more.
SENT_CHARS, PART_CHARS = 200_000, 16_000_000


def exact(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id of items (item_id, text) that stand word for word in docs (doc_id, text).

    The words of an item between its first and its last stand whole in any text that holds it, so the first five of them (or as many as there
    are) are met with the documents' runs of that length. Items of one or two words have none: those few are compared with every document.
    """
    run = lambda words, start, n: F.array_join(F.slice(words, start, n), " ")
    items = items.select("item_id", F.col("text").alias("quote")).withColumn("words", F.split("quote", r"[ \n]", -1)).withColumn("n", F.least(F.size("words") - 2, F.lit(5)))
    keys = items.filter("n > 0").select("item_id", "quote", "n", run(F.col("words"), F.lit(2), F.col("n")).alias("gram"))
    lengths = sorted(r.n for r in items.filter("quote is not null").select("n").distinct().collect())
    docs = docs.select("doc_id", "text")
    words = docs.select("doc_id", F.split("text", r"[ \n]", -1).alias("words"))
    pairs = []
    if found := [n for n in lengths if n > 0]:
        runs = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))), lambda i: run(F.col("words"), i + 1, n))
        grams = reduce(DataFrame.unionByName, (words.select("doc_id", F.lit(n).alias("n"), F.explode(F.array_distinct(runs(n))).alias("gram")) for n in found))
        met = grams.join(keys.select("item_id", "n", "gram"), ["n", "gram"]).select("item_id", "doc_id").distinct()
        pairs.append(met.join(keys.select("item_id", "quote").distinct(), "item_id").join(docs, "doc_id"))
    if any(n <= 0 for n in lengths):
        pairs.append(docs.join(F.broadcast(items.filter("n <= 0").select("item_id", "quote")), F.contains("text", F.col("quote"))).select("doc_id", "item_id", "quote", "text"))
    if not pairs:
        return docs.join(items.select("item_id").limit(0), F.lit(False)).select("item_id", "doc_id")
    rows = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])
    return rows.filter(F.contains("text", F.col("quote"))).select("item_id", "doc_id")


def near(items: DataFrame, docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """item_id, doc_id of items (item_id, text) that docs (doc_id, text) hold, case, punctuation and slips aside.

    Texts are squashed. An item is held where it stands whole, or where a window of its length, moved by an eighth of it, is alike by the standard
    library's ratio: all such pairs are found, whatever the items' lengths (functions/fuzzy.py says why). Items of up to SENT_CHARS characters in all go to the
    tasks, and documents are searched where they are read; more are dealt into blocks of that size, and ranges of documents meet each block. An item or
    document that is null, or has no letter, is held by none and holds none.
    """
    squashed = lambda df, id_col, name: df.select(id_col, tx.squash(F.col("text")).alias(name)).filter(F.col(name) != "")
    own, said = squashed(items, "item_id", "quote").distinct(), squashed(docs, "doc_id", "text")
    schema = T.StructType([own.schema["item_id"], said.schema["doc_id"]])

    def held(quotes: pd.DataFrame, index: Quotes, texts: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, d) for d, text in zip(texts["doc_id"], texts["text"], strict=True) for i in index.found(text)]
        return pd.DataFrame({"item_id": quotes["item_id"].iloc[[i for i, _ in rows]].tolist(), "doc_id": [d for _, d in rows]}, dtype=object)

    chars = own.agg(F.sum(F.char_length("quote"))).head()[0] or 0
    if chars <= SENT_CHARS:
        sent = [tuple(r) for r in own.collect()]

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            quotes = pd.DataFrame(sent, columns=["item_id", "quote"], dtype=object)
            index = Quotes(quotes["quote"], threshold)
            for texts in batches:
                yield held(quotes, index, texts)

        return said.mapInPandas(search, schema).distinct()

    # Equal rows are one first, so that no hash of a document and its text can hold many.
    said = said.distinct()
    blocks = -(-chars // SENT_CHARS)
    parts = -(-(said.agg(F.sum(F.char_length("text"))).head()[0] or 0) // PART_CHARS) or 1
    dealt = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = said.withColumn("part", dealt(["doc_id", "text"], parts)).withColumn("block", every(blocks))
    right = own.withColumn("block", dealt(["item_id", "quote"], blocks)).withColumn("part", every(parts))

    def meet(texts: pd.DataFrame, quotes: pd.DataFrame) -> pd.DataFrame:
        return held(quotes, Quotes(quotes["quote"], threshold), texts)

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(meet, schema).distinct()
