"""The n-gram model against a plain Python one, on more than two million characters: rare n-grams count as well."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textwarden.llm import quality
from textwarden.sources.shipping import ship


def plain_costs(texts):
    """Mean of -ln p of the characters of each text under a modified Kneser-Ney model of all texts."""
    cleaned = [re.sub("[ \t-\r]+", " ", t) for t in texts]
    counts = {5: Counter()}
    for t in cleaned:
        t = "\0" * 4 + t
        counts[5].update(t[i : i + 5] for i in range(len(t) - 4))
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p = {}
    for n in range(1, 6):
        have = Counter(counts[n].values())
        y = have[1] / (have[1] + 2 * have[2]) if have[1] + have[2] else 0.0
        less = [min(max(k - (k + 1) * y * have[k + 1] / have[k], 0.1 * k), 0.9 * k) if have[k] else (0.5, 1.0, 1.5)[k - 1] for k in (1, 2, 3)]
        of, left = Counter(), defaultdict(float)
        for g, c in counts[n].items():
            of[g[:-1]] += c
            left[g[:-1]] += less[min(c, 3) - 1]
        for g, c in counts[n].items():
            p[g] = (c - less[min(c, 3) - 1] + left[g[:-1]] * (p[g[1:]] if n > 1 else 1 / 4096)) / of[g[:-1]]
    padded = ["\0" * 4 + t for t in cleaned]
    return [-sum(math.log(p[t[i : i + 5]]) for i in range(len(t) - 4)) / max(1, len(t) - 4) for t in padded]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(300, 900))) for _ in range(760)]
    # One text in a hundred thousand characters of its own language, and one that is unlike its language.
    texts += [" ".join("".join(rng.choice("bcfgjkmpvwxyz") for _ in range(5)) for _ in range(80)) for _ in range(11)]
    texts.append(" ".join("".join(chr(rng.randint(0x100, 0x17F)) for _ in range(6)) for _ in range(2000)))
    langs = ["en"] * 760 + ["qq"] * 11 + ["en"]
    assert sum(map(len, texts)) > 2_200_000
    return [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]


def test_log_perplexity_and_bands(spark, corpus):
    ship(spark)
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality.judge(docs).select("doc_id", "log_perplexity", "base_failed", "kept").collect()}
    want = plain_costs([t for _, t, _ in corpus])
    for (i, _, _), cost in zip(corpus, want, strict=True):
        assert got[i].log_perplexity == pytest.approx(cost, abs=1e-5)
    assert not any(r.base_failed for r in got.values())
    # Bands by language: three interquartile ranges beyond the quartiles, to a step.
    for lang in ("en", "qq"):
        of = {i: want[i] for i, _, x in corpus if x == lang}
        steps = sorted(math.floor(c / 0.001) for c in of.values())
        q1, q3 = (steps[math.ceil(len(steps) * s) - 1] * 0.001 for s in (0.25, 0.75))
        low, high = q1 - 3 * (q3 - q1 + 0.001), q3 + 0.001 + 3 * (q3 - q1 + 0.001)
        for i, c in of.items():
            if min(abs(c - low), abs(c - high)) > 0.005:
                assert got[i].kept == (low <= c <= high)
    assert not got[len(corpus) - 1].kept and got[0].kept


def test_batches_and_blocks(spark, rows, monkeypatch):
    """Small batches and many of them give the same as one."""
    ship(spark)
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    key = lambda r: (str(r.doc_id), r.row_hash or 0)
    columns = ["doc_id", "row_hash", "log_perplexity"]
    whole = sorted(quality.judge(docs).select(*columns).collect(), key=key)
    monkeypatch.setattr(quality, "BATCH_BYTES", 1)
    monkeypatch.setattr(quality, "SENT_GRAMS", 200)
    monkeypatch.setattr(quality, "BLOCK_BATCHES", 3)
    small = sorted(quality.judge(docs.repartition(7, F.col("text"))).select(*columns).collect(), key=key)
    assert len(whole) == len(rows)
    for a, b in zip(whole, small, strict=True):
        assert a.doc_id == b.doc_id and a.log_perplexity == pytest.approx(b.log_perplexity, abs=1e-6)
