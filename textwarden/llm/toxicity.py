"""Toxicity by non-negative positive-unlabelled learning (operator 9).

A linear classifier over the words of a text is trained with numpy from confirmed toxic documents and unlabelled ones.
The risk of the unlabelled as negatives is corrected by the class prior, and kept from going below zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chunks, stored, texts, word_hashes

#: The classifier is fitted on at most so many confirmed toxic and unlabelled documents (those of the smallest hashes).
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
#: Words that the classifier knows: in so many toxic documents at least (of a small sample DOCS_SHARE of them, two at least), and so
#: many standard errors more or less frequent there than in unlabelled ones; the clearest first.
MIN_DOCS, DOCS_SHARE, MIN_Z, MAX_WORDS = 5, 0.1, 4.0, 4096
STEPS, RATE, RIDGE = 400, 0.05, 1e-4
THRESHOLD = 0.7

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def distinct_words(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words (runs of letters, lower case) of all texts in order, and how many each text has."""
    w, n = word_hashes([d.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) for d in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), n)
    order = np.lexsort((w, doc))
    w, doc = w[order], doc[order]
    first = np.concatenate([[True], (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])])[: len(w)]
    return w[first], np.bincount(doc[first], minlength=len(docs))


@dataclass
class Classifier:
    """Weights of known words, sorted by hash; the score is the logistic of their sum over a text's distinct words."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, docs: list[str]) -> np.ndarray:
        w, n = distinct_words(docs)
        total = np.zeros(len(docs))
        if len(self.words) and len(w):
            at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            known = self.words[at] == w
            total = np.bincount(np.repeat(np.arange(len(docs)), n)[known], weights=self.weights[at[known]], minlength=len(docs))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def vocabulary(found: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The words that tell, of found (word, df_p, df_u: toxic and unlabelled documents that have it), sorted; at most MAX_WORDS."""
    least = min(MIN_DOCS, max(2, math.ceil(DOCS_SHARE * n_p)))
    p = (F.col("df_p") + F.col("df_u")) / (n_p + n_u)
    z = F.abs(F.col("df_p") / n_p - F.col("df_u") / n_u) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    clear = found.filter(F.col("df_p") >= least).withColumn("z", z).filter(F.col("z") >= MIN_Z)
    return np.sort(clear.orderBy(F.desc("z"), "word").limit(MAX_WORDS).select("word").toArrow()["word"].to_numpy().view(np.uint64))


def risk(theta: np.ndarray, row: np.ndarray, column: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights theta (bias last) and the gradient that its step goes by; (row, column): the words of documents.

    Risk: prior * E_p[-ln q] + max(0, E_u[-ln(1 - q)] - prior * E_p[-ln(1 - q)]). Where the corrected part is negative, the
    gradient is that of its negative alone, to undo the overfit.
    """
    n, n_p = len(positive), int(positive.sum())
    s = np.clip(np.bincount(row, weights=theta[column], minlength=n) + theta[-1], -30, 30)
    q = 1 / (1 + np.exp(-s))
    as_positive, lost = np.log1p(np.exp(-s)), np.log1p(np.exp(s))
    as_negative = lost[~positive].mean() - prior * lost[positive].mean()
    correction = np.where(positive, -prior * q / n_p, q / (n - n_p))
    g = np.where(positive, prior * (q - 1) / n_p, 0.0) + correction if as_negative >= 0 else -correction
    return prior * as_positive[positive].mean() + max(0.0, as_negative), np.append(np.bincount(column, weights=g[row], minlength=len(theta) - 1), g.sum())


def fit(words: np.ndarray, row: np.ndarray, column: np.ndarray, positive: np.ndarray, prior: float) -> Classifier:
    """row, column: document `row` has words[column]; positive: which documents are confirmed toxic."""
    if not positive.any() or positive.all():
        return Classifier(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))))
    theta = np.zeros(len(words) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, grad = risk(theta, row, column, positive, prior)
        grad[:-1] += RIDGE * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(words, theta[:-1], float(theta[-1]))


def _picked(ids: DataFrame, most: int) -> DataFrame:
    """id of at most `most` of the ids, those of the smallest hashes; a threshold of the hash lets about twice as many pass."""
    span = 1 << 40
    limit = int(min(1.0, 2 * most / max(1, ids.count())) * span)
    return ids.withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(span))).filter(F.col("hash") < limit).dropDuplicates(["id"]).orderBy("hash", "id").limit(most).select("id")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Learns from rows that are not held out only. An id with several labels is toxic if one says so.

    Spark counts the sample's words; what reaches the driver is the telling words and which of them the sample's documents have.
    Where no word tells (few labels), every score is the class prior.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
    known = stored(known.groupBy("id").agg(F.max("toxic").alias("toxic")))
    share = known.agg(F.avg("toxic")).head()[0]
    prior = min(max(share if share is not None else 0.0, 1e-3), 0.5)
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id")).filter(F.col("id").isNotNull() & ~held_out("id"))
    positive = _picked(known.filter("toxic = 1").select("id"), MAX_POSITIVE).withColumn("positive", F.lit(True))
    chosen = positive.unionByName(_picked(ids, MAX_UNLABELLED).withColumn("positive", F.lit(False)))  # at most MAX_POSITIVE + MAX_UNLABELLED rows
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w, n = distinct_words(texts(batch))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(w.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("positive"), lists], ["id", "positive", "words"])

    # Rows that share an id and repeated ones count as one document: the words of all its texts.
    found = stored(rows.mapInArrow(run, "id long, positive boolean, words array<long>"))
    sizes = found.groupBy("positive").agg(F.count_distinct("id").alias("n")).collect()
    n_p, n_u = (sum(r.n for r in sizes if r.positive == x) for x in (True, False))
    if not n_p or not n_u:
        return fit(np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int), np.empty(0, bool), prior)
    single = stored(found.select("id", "positive", F.explode("words").alias("word")).distinct())
    words = vocabulary(single.groupBy("word").agg(F.count_if("positive").alias("df_p"), F.count_if(~F.col("positive")).alias("df_u")), n_p, n_u)
    shared = docs.sparkSession.createDataFrame([(i, w) for i, w in enumerate(words.view(np.int64).tolist())], "column int, word long")
    has = single.join(F.broadcast(shared), "word").groupBy("id", "positive").agg(F.sort_array(F.collect_list("column")).alias("columns"))
    every = found.select("id", "positive").distinct().join(has, ["id", "positive"], "left").toArrow().sort_by([("id", "ascending"), ("positive", "ascending")])
    columns = every["columns"].combine_chunks()
    n = pc.fill_null(pc.list_value_length(columns), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return fit(words, np.repeat(np.arange(len(n)), n), columns.flatten().to_numpy(zero_copy_only=False).astype(np.int64), every["positive"].to_numpy(zero_copy_only=False).astype(bool), prior)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    A null or empty text scores what a text without known words does. Equal texts score alike; repeated rows are each scored. Other
    columns are not read. An empty table gives no rows. A text of any length is scored whole, at 40 bytes a word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(texts(batch)), pa.float64())], ["doc_id", "score"])

    scored = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
