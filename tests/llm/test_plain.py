"""Operators against plain Python: chunk ends, risk, reply trees, ranges of ids, windows of long texts, clashing columns, repeated rows and ties."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import bpe, chat, fingerprints, lines, neardup, packing, quality, queries, secrets, shared, tokens, toxicity
from textwarden.sources.shipping import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# ---- fingerprints


def gear_ends(raw):
    """Ends byte by byte: the hash of the last 32 bytes, strict until NORMAL bytes, then loose."""
    ends, start, at, h, gear = [], 0, 0, 0, [int(g) for g in fingerprints.GEAR]
    hashes = []
    for b in raw:
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        hashes.append(h)
    n = len(raw)
    while start < n:
        end = None
        for at in range(start + fingerprints.SMALLEST, min(start + fingerprints.LARGEST, n) + 1):
            bits = fingerprints.STRICT_BITS if at - start < fingerprints.NORMAL else fingerprints.LOOSE_BITS
            if at > 0 and hashes[at - 1] >> (32 - bits) == 0:
                end = at
                break
        end = end or min(start + fingerprints.LARGEST, n)
        ends.append(end)
        start = end
    return ends


def test_chunk_ends_equal_the_sequential_loop(rows, monkeypatch):
    raws = [(r[1] or "").encode() for r in rows] + [b"a" * 1000, bytes(range(256)) * 9]
    want = [gear_ends(r) for r in raws]
    assert fingerprints.chunk_ends(raws) == want
    monkeypatch.setattr(fingerprints, "HASHED_BYTES", 100)
    assert fingerprints.chunk_ends(raws) == want


def test_compare_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4000)  # many ranges
    many = [*rows, *[(None, f"no id {i} " * 40, "en", "s", 0) for i in range(60)], *[(7, f"same id {i} " * 40, "en", "s", 0) for i in range(60)]]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long").withColumn("bucket", F.lit("clash")).withColumn("key", F.lit(1))
    got = fingerprints.compare(df).collect()
    hashed = {t: h for t, h in df.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(((-(1 << 63) if r[0] is None else r[0], hashed[r[1] or ""], r[0], r[1] or "") for r in many), key=lambda x: (x[0], x[1]), reverse=True)
    want = []
    for (_, _, doc_id, text), after in zip(order, [*order[1:], order[0]], strict=True):
        edited = fingerprints.edited(text, after[3])
        a, e, b = fingerprints.fingerprints([text, edited, after[3]])
        want.append((doc_id, len(text), fingerprints.written(a), fingerprints.written(e), round(fingerprints.containment(a, e), 9), round(fingerprints.containment(a, b), 9)))
    assert sorted(((r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == sorted(want, key=repr)


# ---- toxicity


def test_risk_and_gradient_equal_plain_ones():
    rng = np.random.default_rng(5)
    n, words = 30, 6
    positive = np.arange(n) < 10
    has = rng.random((n, words)) < 0.4
    row, column = np.nonzero(has)
    for scale, prior in ((0.3, 0.2), (3.0, 0.5)):  # the second makes the corrected part negative
        theta = rng.normal(size=words + 1) * scale
        if prior == 0.5:
            theta = np.where(np.arange(words + 1) < words, np.abs(theta), 2.0) * np.where(has[:10].sum(0).mean() > 0, 1, 1)

        def parts(th):
            s = has @ th[:-1] + th[-1]
            q = 1 / (1 + np.exp(-s))
            return prior * -np.log(q[positive]).mean(), -np.log(1 - q[~positive]).mean() - prior * -np.log(1 - q[positive]).mean()

        as_positive, as_negative = parts(theta)
        value, grad = toxicity.risk(theta, row, column, positive, prior)
        assert value == pytest.approx(as_positive + max(0.0, as_negative), abs=1e-9)
        aim = (lambda th: sum(parts(th))) if as_negative >= 0 else (lambda th: -parts(th)[1])
        for i in range(words + 1):
            step = np.zeros(words + 1)
            step[i] = 1e-6
            assert grad[i] == pytest.approx((aim(theta + step) - aim(theta - step)) / 2e-6, abs=1e-5)


# ---- reply trees


def test_best_paths_equal_brute_force_on_random_trees(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for t in range(300):
        n = rng.randint(1, 14)
        nodes = [(f"t{t}", f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.95 else None, rng.choice(["user", "assistant"]), f"{t}/{i}", float(rng.randint(0, 3))) for i in range(n)]
        rows += nodes
        parent, score, text = {x[1]: x[2] for x in nodes}, {x[1]: x[5] for x in nodes}, {x[1]: x[4] for x in nodes}
        leaves = []
        for leaf in set(parent) - {p for p in parent.values() if p}:
            path = [leaf]
            while parent[path[-1]]:
                path.append(parent[path[-1]])
            leaves.append((-sum(score[x] for x in path) / len(path), -len(path), leaf, [text[x] for x in reversed(path)]))
        for k, best in enumerate(sorted(leaves)[:3], 1):
            want[f"t{t}", k] = best[3]
    rows += rows[:50]  # repeated rows
    schema = "tree string, node string, parent string, role string, text string, score double"
    df = spark.createDataFrame(rows, schema).withColumn("path", F.lit("clash")).withColumn("depth", F.lit(0))
    got = {(r.tree, r.path): [t for _, t in chat.turns_of(r.conversation)] for r in chat.format_trees(df, 3).collect()}
    assert got == want


def test_ties_nulls_and_repeated_turns(spark):
    turns = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "first"), (1, 2, None, None), (1, 2, None, None), (None, 1, "user", "no id")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash")).withColumn("node", F.lit(3))
    got = {r.tree: chat.turns_of(r.conversation) for r in chat.format_trees(chat.from_turns(df)).collect()}
    assert got == {"1": [("system", "first"), ("user", "a"), ("user", "b"), ("", ""), ("", "")], "null": [("user", "no id")]}
    read = {r.conv_id: r.n_turns for r in chat.digests(chat.format_trees(chat.from_turns(df))).collect()}
    assert read == {1: 5, None: 1}


# ---- quality


def test_every_statistic_on_edge_texts(spark):
    texts = ["a b a b a b a b", "x\nx\n\n \nx \nx", "#*$%&|<>~", " \t\r\n", "", None, "日本語 " * 60, "one two three " * 30, "\x0b w \x0c"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert [got[i].n_symbols for i in range(9)] == [0, 0, 8, 0, 0, 0, 0, 0, 0]
    assert [got[i].n_dup_lines for i in range(9)] == [0, 2, 0, 0, 0, 0, 0, 0, 0]
    assert [got[i].n_repeat_words for i in (0, 1, 6, 7)] == [8, 4, 60, 90] and [got[i].word_chars for i in (0, 6, 8)] == [8, 180, 1]
    assert got[7].base_failed and got[6].base_failed and not got[5].kept


def test_kept_is_the_same_when_the_corpus_is_doubled(spark, rows):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinsh") for _ in range(5)) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(120)), "en") for i in range(80)] + [(99, " ".join("qzxj" for _ in range(3)) + " " + " ".join(f"{rng.randrange(10**6)}" for _ in range(120)), "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    once = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    twice = {r.doc_id: r.kept for r in quality.judge(df.unionAll(df)).collect()}
    assert once == twice and not once[99] and sum(once.values()) >= 75


def test_long_texts_in_windows():
    """Ten megabytes: one text of words, and one without a space."""
    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(10**4, 10**6, 1_500_000).tolist()))
    assert len(text) > 10_000_000
    n, repeated = quality.repeated_words([text])
    assert n[0] == 1_500_000 and repeated[0] == 0
    doc, shingle, count = neardup.shingles([text, "x" * 10_000_000])
    assert len(shingle) == 1_500_000 - 4 + 1 and count.sum() == len(shingle)
    s, sizes = quality.symbols([text])
    assert sizes[0] == len(text) == len(s) - 4
    assert fingerprints.chunk_ends([text.encode()])[0][-1] == len(text)


# ---- columns that clash, and empty tables in every stage


def test_clashing_columns(spark, docs, rows):
    odd = docs.withColumns({x: F.lit("clash") for x in ("secrets", "row_hash", "key", "ids", "start", "length", "sequence_id", "offset", "score", "held_out", "kind", "value", "line", "pos")})
    path = shared.shared_folder(spark) + "/clash"
    tokens.write_tokens(odd, path, queries.WORD_BPE)
    assert tokens.read_tokens(spark, path).count() == len(rows)
    assert packing.pack(odd, queries.WORD_BPE).select("doc_id", "start").filter("start = 0").count() == len(rows)
    assert bpe.encode(odd, queries.BYTE_BPE, queries.public_tokenizers.PATTERN).count() == len(rows)
    model = toxicity.Classifier(np.empty(0, np.uint64), np.empty(0), 0.0)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(rows) and {r.score for r in scored} == {0.5}
    scanned = secrets.scan(odd)
    assert scanned.count() == len(rows) and dict(scanned.dtypes)["secrets"].startswith("array")
    assert lines.remove_boilerplate(odd).count() == len(rows)


def test_ids_in_sequence_by_class(docs):
    got = defaultdict(list)
    for r in packing.pack(docs, queries.WORD_BPE).collect():
        got[r.sequence_id].append(r.length)
    assert all(sum(x) <= packing.CAPACITY for x in got.values())


# ---- what other rows must not change


@pytest.mark.parametrize("others", [[], [(9, "one two three four five six")], [(9, "one two three four five six")] * 2])
def test_a_repeated_text_without_words_becomes_one_row(spark, others):
    rows = [(1, ""), (1, ""), (2, " "), (None, None), (None, None), (3, ""), *others]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(set(rows), key=repr)


def test_one_site_is_enough_where_one_is_asked_for(spark):
    rows = [(1, "seen\nalso seen", "a"), (2, "nowhere", None), (3, "seen", "b"), (4, " \n", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.remove_boilerplate(df, min_sites=1).collect()}
    assert got == {1: ("", 2, 2), 2: ("nowhere", 1, 0), 3: ("", 1, 1), 4: (" \n", 2, 0)}
    got = {r.doc_id: r.n_removed for r in lines.remove_boilerplate(df, min_sites=2).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0}


def test_ranges_of_a_large_table_get_longer_not_more(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(map(repr, fingerprints.compare(df).collect()))
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 100)
    monkeypatch.setattr(fingerprints, "MOST_RANGES", 3)
    parts = fingerprints.with_next(df)
    assert parts.select("bucket").distinct().count() <= 3
    assert sorted(map(repr, fingerprints.compare(df).collect())) == want
