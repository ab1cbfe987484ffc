"""Which of a set of short texts a document covers best, by the words they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import content_tokens

#: Tokens of all items up to which what is made of items is sent to all tasks; beyond that both sides are shuffled.
SENT_TOKENS = 100_000


def _needed(size: Column, threshold: float) -> Column:
    """The least number of shared tokens that makes a share of threshold; the small step down undoes what rounding adds."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9))


def covered(items: DataFrame, docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """item_id, doc_id, shared, size: documents (doc_id, text) that hold a share of `threshold` (over 0) or more of an item's (item_id, text) content tokens.

    Whoever holds `needed` of an item's tokens holds one of any size - needed + 1 of them, so items and documents meet over each item's rarest
    tokens alone, rare by the documents that hold them: a token of every document is a key only of items that have too few others. A document with fewer
    tokens than are needed meets nothing. What has met is compared whole, once. Ids name one text each; null texts and those without tokens
    meet nothing.
    """
    tokens = lambda df, id_col: df.select(id_col, content_tokens(F.col("text")).alias("tokens"))
    own, said = tokens(items, "item_id"), tokens(docs, "doc_id")  # no filter by size here: the scan would take it, and the work with it
    words = own.select("item_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    # outer: else a filter by size is inferred, and tokens are made where files are read too; no token joins nothing
    theirs = said.select("doc_id", F.size("tokens").alias("held"), F.explode_outer("tokens").alias("token"))
    small = words.limit(SENT_TOKENS + 1).count() <= SENT_TOKENS
    sent = F.broadcast if small else lambda df: df
    seen = theirs.join(sent(words.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    keys = rare_keys(words, seen, threshold)
    own = own.withColumnRenamed("tokens", "own")
    if small:  # items are in every task, so a document is compared where it is read, and only what holds is shuffled
        here = said.select("doc_id", F.col("tokens").alias("said"), F.explode_outer("tokens").alias("token")).join(F.broadcast(keys.join(own, "item_id")), "token")
        both = here.filter(F.size("said") >= F.col("needed"))
    else:
        met = theirs.join(keys, "token").filter("held >= needed").select("item_id", "doc_id").distinct()
        both = met.join(said.withColumnRenamed("tokens", "said"), "doc_id").join(own, "item_id")
    rows = both.select("item_id", "doc_id", F.size(F.array_intersect("own", "said")).cast("long").alias("shared"), F.size("own").cast("long").alias("size"))
    rows = rows.filter(F.col("shared") / F.col("size") >= threshold)
    return rows.distinct() if small else rows


def rare_keys(words: DataFrame, seen: DataFrame, threshold: float) -> DataFrame:
    """item_id, needed, token of words (item_id, size, token): of each item so many of its rarest tokens that who holds `needed` of all holds one of them.

    seen: df of the tokens that documents hold. A token of no document is the rarest of all: it takes its place in the order, but is no key.
    """
    ranked = words.join(seen, "token", "left").groupBy("item_id", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("order"))
    needed = _needed(F.col("size"), threshold)
    keys = ranked.select("item_id", needed.alias("needed"), F.explode(F.slice("order", 1, (F.col("size") - needed + 1).cast("int"))).alias("k")).filter("k.df > 0")
    return keys.select("item_id", "needed", F.col("k.token").alias("token"))


def best(items: DataFrame, docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """doc_id, item_id, shared, size: of each document in covered() the item with the highest share, of equal ones the least item_id."""
    rows = covered(items, docs, threshold)
    found = F.min_by(F.struct("item_id", "shared", "size"), F.struct(-(F.col("shared") / F.col("size")), F.col("item_id")))
    return rows.groupBy("doc_id").agg(found.alias("b")).select("doc_id", "b.*")
