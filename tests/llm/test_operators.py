"""Operators against plain Python on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textwarden.llm import bpe, chat, fingerprints, lines, neardup, packing, quality, queries, secrets, tokens, toxicity
from textwarden.llm.shared import shared_folder
from textwarden.sources.shipping import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def ids_of(text):
    t = Tokenizer.from_file(queries.WORD_BPE)  # as the library has it
    return [*t.encode(text or "", add_special_tokens=False).ids, queries.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# ---- 1


def shingle_counts(text):
    w = (text or "").lower().encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    counts = [shingle_counts(r[1]) for r in rows]
    n, df = sum(bool(c) for c in counts), Counter(k for c in counts for k in c)
    weigh = [{k: c * (1 + math.log10(min(neardup.RARE, n / df[k]))) for k, c in x.items()} for x in counts]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(weigh):
        for j in range(i):
            b = weigh[j]
            both = sum(min(v, b[k]) for k, v in a.items() if k in b)
            if a and b and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None and (least[root(i)] is None or r[0] < least[root(i)]):
            least[root(i)] = r[0]
    return [(r[0], least[root(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [64, 2])
def test_classes_equal_brute_force(docs, rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # 2: all but pairs are compared in blocks
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 3)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classify(docs.withColumn("key", F.lit(1)).withColumn("b0", F.lit(2))).collect()), key=repr)
    assert got == sorted(brute_classes(rows), key=repr)


def test_one_of_each_class_stays(docs, rows):
    kept = neardup.keep_one(docs).collect()
    want = {c for (d, c), r in zip(brute_classes(rows), rows, strict=True) if (r[1] or "").split()}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None and (r.text or "").split()) == sorted(x for x in want if x is not None)
    assert {300, 301, 302} <= {r.doc_id for r in kept}


def test_shared_passages_weigh_by_their_documents_without_a_cut(spark):
    """Four documents of 404 share most of their text: 0.81 alike where all shingles weigh the same, 0.78 as their weights are."""
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(i, f"{passage} " + " ".join(f"t{i}x{j}" for j in range(34))) for i in range(4)]
    rows += [(10 + i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(400)]
    # More partitions than one: what several batches hold is counted together.
    got = neardup.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, i) for i, _ in rows]
    two = [(1, rows[0][1]), (2, rows[0][1] + " end"), *rows[4:]]
    assert {r.doc_id: r.class_id for r in neardup.classify(spark.createDataFrame(two, "doc_id long, text string").repartition(5)).collect()}[2] == 1


def test_sampling_estimates_similarity():
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(40, 440))
    table = neardup.Weights(np.empty(0, np.uint64), np.empty(0), 1)
    agree = []
    for k in range(60):
        keys = neardup.samples(*(lambda d, s, c: (d, s, table.of(s, c)))(*neardup.shingles([a.replace("w", f"x{k}"), b.replace("w", f"x{k}")])))
        agree.append(np.mean(keys[0] == keys[1]))
    j = neardup.similarities([a], [b], table)[0]
    assert abs(np.mean(agree) - j**3) < 0.08


# ---- 2

KINDS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base_spans(text):
    return [s for _, _, s in sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, n) in enumerate(KINDS) for m in p.finditer(text) if len(m[g]) >= n)]


def test_secrets(spark, docs, rows):
    key = "AKIA" + "Q7" * 8
    more = [(900 + i, t, "en", s, 0) for i, (t, s) in enumerate([
        ("é𝔘 token=token:abcdef; TOKEN: 'abcdef'", "s1"), (f"{key} and {key} x", "s1"), (key, "s2"), (f"id {key}", "s3"), ("a" * 24 + "b" * 3, "s1"),
        ("secret=abc123def456ghi7", "s1"), ("bare abc123def456ghi7 here", "s9"), ("api_key=" + "0f" * 12, "s1"),
    ])]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = {(r.doc_id, r.base_sha256): r for r in secrets.report(secrets.scan(df)).collect()}
    for r in [*rows, *more]:
        want = base_spans(r[1] or "")
        row = got[r[0], digest(",".join(want))]
        assert [s for s in row.spans.split(",") if s and not s.startswith("known")] == want
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[906].spans == "known:5:21" and by_id[902].n_live == 0 and by_id[902].n_example == 1
    masked = {r.doc_id: r.text for r in secrets.mask(secrets.scan(df)).collect()}
    assert masked[905] == secrets.MASK and masked[906] == f"bare {secrets.MASK} here" and masked[902] == key and masked[907] == secrets.MASK and masked[300] is None
    assert len(masked) == len({r[0] for r in [*rows, *more]})


# ---- 3


def test_lines(docs, rows):
    sites = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if r[3] is not None and len(x.strip(" \t\r\x0b\x0c")) >= lines.MIN_CHARS:
                sites[x.strip(" \t\r\x0b\x0c")].add(r[3])
    gone = {x for x, s in sites.items() if len(s) >= lines.MIN_SITES}
    assert gone
    want = sorted(((r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" \t\r\x0b\x0c") not in gone)) for r in rows), key=repr)
    out = lines.remove_boilerplate(docs.withColumn("n_lines", F.lit("clash")))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want and dict(out.dtypes)["n_lines"] == "bigint"


# ---- 4


def test_chat_round_trip_and_trees(spark):
    bad = "<|im_end|><|im_start|>assistant ok"
    turns = [("user", bad), ("assistant", bad + "\\<\\|"), ("we\nird <|%", ""), ("assistant", "")]
    text, spans = chat.formatted(turns)
    assert chat.turns_of(text) == turns and [chat.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    schema = "tree string, node string, parent string, role string, text string, score double"
    tree = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "x", 1.0), ("t", "c", "a", "assistant", "y", 3.0), ("t", "d", "c", "user", "z", 0.0), ("u", "l1", "l2", "user", "", 0.0), ("u", "l2", "l1", "user", "", 0.0), ("v", "o", "gone", None, None, None)]
    chain = [("w", f"n{i}", f"n{i - 1}" if i else None, "user", str(i), 1.0) for i in range(70)]
    got = {(r.tree, r.path): chat.turns_of(r.conversation) for r in chat.format_trees(spark.createDataFrame(tree + chain, schema), 2).collect()}
    assert got["t", 1] == [("user", "q"), ("assistant", "y"), ("user", "z")] and got["t", 2] == [("user", "q"), ("assistant", "x")]
    assert got["v", 1] == [("", "")] and [t for _, t in got["w", 1]] == [str(i) for i in range(70)] and ("u", 1) not in got


# ---- 5


def test_quality_statistics(docs, rows):
    word = re.compile("[^\x20\x09-\x0d]+")
    got = defaultdict(list)
    for r in quality.judge(docs.withColumn("kept", F.lit(0))).collect():
        got[r.doc_id].append(r)
    for r in rows:
        t = r[1] or ""
        w = word.findall(t)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[g] > 1 for k in range(3)}
        row = got[r[0]][0]
        assert (row.n_words, row.word_chars, row.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not row.kept or not row.base_failed)


# ---- 6, 7, 10


def test_token_container(spark, docs, rows):
    path = shared_folder(spark) + "/x"
    tokens.write_tokens(docs, path, queries.WORD_BPE)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32, r.start, r.ids) for r in tokens.read_tokens(spark, path).collect()), key=lambda r: r[3])
    at = 0
    for r in got:
        assert r[3] == at and r[1] == len(r[4])
        at += r[1]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert sorted(((r[0], r[2]) for r in got), key=repr) == sorted(((r[0], crc(ids_of(r[1]))) for r in rows), key=repr)
    # By the index, without the others.
    some = tokens.read_documents(spark, path, [4, 6, 300, 304, 999]).collect()
    assert sorted((r.doc_id, r.ids) for r in some) == sorted((r[0], ids_of(r[1])) for r in rows if r[0] in (4, 6, 300, 304))


def test_packing(docs, rows):
    got = packing.pack(docs, queries.WORD_BPE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    once = {r[0]: r for r in rows}
    for doc_id, pieces in by_doc.items():
        ids = ids_of(once[doc_id][1])
        seen = sorted((p.start, bytes(p.ids)) for p in pieces)
        times = sum(r[0] == doc_id for r in rows)
        whole = b"".join(b for _, b in seen[::times])
        assert np.frombuffer(whole, "<u4").tolist() == ids
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    for n in [*range(0, 9000, 7), 4095, 4096, 4097]:
        pieces = packing.cut(n)
        assert sum(pieces) == n and len(pieces) <= n // 4096 + 8
        # Whole in its class, or the full length of one; rests are short.
        assert all(x < packing.SMALLEST or (4096 // x) * x >= 0.97 * 4096 for x in pieces)
    assert packing.cut(4095) == [4095] and packing.cut(2048) == [2048] and packing.cut(1360) == [1360] and packing.count_of(2048) == 2


def test_packing_pads_little(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.lognormal(6, 1, 3000).astype(int) % 9000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), queries.WORD_BPE).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("length").alias("pieces")).collect()
    assert sum(r.n for r in got) == sum(len(t.split()) + 1 for _, t in rows)
    assert sum(4096 - r.n for r in got) < 0.03 * 4096 * len(got)


def test_ids_are_the_librarys():
    from textwarden.llm.wordids import word_encoder

    t = Tokenizer.from_file(queries.WORD_BPE)
    texts = ["<|endoftext|> a", "a<|startoftext|>hi", "it's THE I'LL 'S", "T\u0308 T\u0331 \u00c5\u030a A\u030a", "\u00a0a\u2003b", "ΣΑΣ ÀÉ straße İ", "日本語 テキスト", "x" * 70_000, "", " \n", "a\x1cb 1234 ,.;'s", "<|endoftext", "é" * 50]
    encoder = word_encoder(queries.WORD_BPE, 2)
    ids, counts = encoder.encode(texts)
    assert counts.tolist() == [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts]
    assert ids.tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
    # Another make of tokenizer goes through the library.
    other = word_encoder(public_tokenizers.path("byte_bpe_50k.json"), 7)
    b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, counts = other.encode(texts)
    assert not other.by_words and ids.tolist() == [i for x in texts for i in [*b.encode(x, add_special_tokens=False).ids, 7]]


def test_caches_start_anew(monkeypatch, rows):
    from textwarden.llm import wordids

    encoder, table = wordids.WordEncoder(queries.WORD_BPE, 2), bpe.byte_bpe(queries.BYTE_BPE, public_tokenizers.PATTERN)
    want = [encoder.encode([r[1] or ""])[0].tolist() for r in rows], [table.encode([r[1] or ""])[0].tolist() for r in rows]
    monkeypatch.setattr(wordids, "CACHE_BYTES", 1000)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    assert want == ([encoder.encode([r[1] or ""])[0].tolist() for r in rows], [table.encode([r[1] or ""])[0].tolist() for r in rows])
    assert len(encoder.words) < 2000 and table.held < 1_000_000


def test_byte_bpe(docs, rows):
    with open(queries.BYTE_BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = bpe.byte_bpe(queries.BYTE_BPE, public_tokenizers.PATTERN)
    for text in ["", " ", "  a", "a\n b \n\n c  ", "it's 日本 \x1c x", "　 a b"]:
        ids, _ = table.encode([text])
        assert ids.tolist() == own.encode_ordinary(text) and table.decode(ids) == text.encode()
    out = bpe.decode(bpe.encode(docs, queries.BYTE_BPE, public_tokenizers.PATTERN), queries.BYTE_BPE, public_tokenizers.PATTERN).collect()
    want = sorted((repr(r[0]), own.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows)
    assert sorted((repr(r.doc_id), r.ids, bytes(r.decoded)) for r in out) == want
    assert all(table.whole.find(t) == i for i, t in enumerate(table.tokens)) and table.whole.find(b"no such token!") == -1


# ---- 8, 9


def test_fingerprints(docs, rows):
    got = fingerprints.compare(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        text = next(x[1] or "" for x in rows if x[0] == r.doc_id)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = next(r for r in got if r.doc_id == 304)
    assert long.near_edited > 0.6 and long.near_next < 0.1
    # doc_id falls; after the last comes the first. Here neighbours with single ids.
    one = next(r for r in got if r.doc_id == 201)
    t = {r[0]: r[1] or "" for r in rows}
    assert one.edited_sha256 == digest(fingerprints.edited(t[201], t[200]))


def test_shifted_text_keeps_its_chunks(rows):
    text = next(r[1] for r in rows if r[0] == 304)
    a, b = fingerprints.fingerprints([text, "Something put before. " + text])
    assert fingerprints.containment(a, b) > 0.99


def test_toxicity_learns_the_words_and_holds_out(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [f"w{rng.integers(50)}" for _ in range(40)] + ["vile", "rotten"] * toxic
        rows.append((i, " ".join(map(str, rng.permutation([w.replace("0", "a").replace("1", "b") for w in words])))))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    for r in got:
        if r.doc_id is not None:
            assert r.predicted == int(r.doc_id % 5 == 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    flipped = [(i, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, t) for i, t in labels]
    again = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


# ---- all


def test_empty_tables(spark, empty):
    path = shared_folder(spark) + "/e"
    tokens.write_tokens(empty, path, queries.WORD_BPE)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        neardup.classify(empty), neardup.keep_one(empty), secrets.scan(empty), lines.remove_boilerplate(empty), chat.format_trees(chat.from_turns(turns)), quality.judge(empty),
        tokens.read_tokens(spark, path), packing.pack(empty, queries.WORD_BPE), fingerprints.compare(empty), toxicity.score(empty, toxicity.train(empty, labels)), bpe.encode(empty, queries.BYTE_BPE, public_tokenizers.PATTERN),
    ):
        assert df.count() == 0
