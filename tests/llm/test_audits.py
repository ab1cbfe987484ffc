"""Merkle manifest, anchors of fingerprints and divergence of sources against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textwarden.llm import divergence, merkle, simhash
from textwarden.sources.shipping import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ---- 11


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, o in zip(paths, own, strict=True):
            run = nodes[o // 16 * 16 : o // 16 * 16 + 16]
            path.append(("".join(run[: o % 16]), "".join(run[o % 16 + 1 :])))
        own = [o // 16 for o in own]
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_manifest(rows):
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf, changed = (H(*map(coded, (doc_id, source, lang, n, t))) for t in (text, text and lower(text)))
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by[source].append((doc_id is not None, doc_id or 0, leaf, changed if tampered else leaf, doc_id))
    for group in by.values():
        group.sort(key=lambda r: r[:3])
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in by[s]]) for s in sources}
    root, above = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, high in zip(sources, above, strict=True):
        for (_, _, leaf, shown, doc_id), low in zip(by[s], trees[s][1], strict=True):
            for a, b in low + high:
                shown = H(a, shown, b)
            out.append((doc_id, leaf, trees[s][0], root, H(*itertools.chain(*(low + high))), shown, shown == root))
    return out


def audited(df, block_levels=merkle.BLOCK_LEVELS):
    return [tuple(r) for r in merkle.audit(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, block_levels).collect()]


def test_manifest_with_nulls_ties_repeated_rows_and_other_columns(spark, rows, docs, empty):
    clash = docs.withColumns({c: F.lit(1) for c in ("tree", "block", "pos", "n", "leaf", "digest", "shown", "tampered", "_part")})
    same(audited(clash), plain_manifest(rows))
    assert audited(empty) == []
    same(audited(docs.limit(1)), plain_manifest([tuple(r) for r in docs.limit(1).collect()]))


@pytest.mark.parametrize("block_levels", [1, 2])
def test_manifest_of_many_tiers_and_ranges(spark, monkeypatch, block_levels):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 70)
    rows = [(i // 2 if i % 11 else None, f"Text {i // 2}" if i % 7 else None, "en", f"s{i % 30}" if i < 600 else "hot", None) for i in range(1500)]
    same(audited(spark.createDataFrame(rows, SCHEMA), block_levels), plain_manifest(rows))


def test_van_emde_boas_places():
    def order(height):  # (depth, index) as laid out, by the definition
        if height == 1:
            return [(0, 0)]
        upper = height // 2
        out = order(upper)
        for i in range(16**upper):
            out += [(upper + d, i * 16**d + x) for d, x in order(height - upper)]
        return out

    for height in (1, 2, 3, 4):
        places = order(height)
        assert len(places) == merkle.size(height)
        for depth in range(height):
            at = merkle.address(depth, np.arange(16**depth), height)
            assert [places[p] for p in at[:: max(1, len(at) // 300)]] == [(depth, i) for i in range(0, 16**depth, max(1, 16**depth // 300))]


def test_manifest_hashes_a_long_text_whole(spark):
    rows = [(i, "Ab" * n, "en", "s", n) for i, n in enumerate((4_000_000, 4_000_001, 3))]
    same(audited(spark.createDataFrame(rows, SCHEMA)), plain_manifest(rows))


# ---- 12


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        parent[root(a)] = root(b)
    out = defaultdict(set)
    for x in items:
        out[root(x)].add(x)
    return sorted(map(sorted, out.values()))


def test_fingerprint_equals_the_plain_one_in_windows_too(monkeypatch):
    texts = ["", " \n", "a", "A b", "a b c d", "ÀB c\x1cd É e x", "  x\x85y a\x0bb ", " ".join(str(i % 7) for i in range(3000)), "x" * 500 + " a", "a b " + " " * 300 + "c d e"]
    for window in (1 << 20, 50):
        monkeypatch.setattr(simhash, "WINDOW_BYTES", window)
        for t in texts:
            assert simhash.fingerprint(t.encode()) == plain_print(t)


def test_simhash_equals_brute_force_with_nulls_and_repeated_rows(spark, rows, docs, empty):
    got = simhash.classify(docs.withColumns({"print": F.lit("clash"), "home": F.lit(1)})).collect()
    prints = [plain_print(r[1]) for r in rows]
    same([(r.doc_id, r.print & (1 << 64) - 1) for r in got], [(r[0], p) for r, p in zip(rows, prints, strict=True)])
    linked = [(a, b) for a, b in itertools.combinations(set(prints), 2) if (a ^ b).bit_count() <= 4]
    least = {}
    for group in components(set(prints), linked):
        ids = [r[0] for r, p in zip(rows, prints, strict=True) if p in group and r[0] is not None]
        least |= dict.fromkeys(group, min(ids, default=None))
    same([(r.doc_id, r.component_id) for r in got], [(r[0], least[p]) for r, p in zip(rows, prints, strict=True)])
    assert simhash.classify(empty).collect() == []


@pytest.mark.parametrize("n_blocks", [1, 2, 3])
def test_every_close_pair_meets_at_either_home(n_blocks):
    rng, anchors = np.random.default_rng(7), simhash.Anchors(n_blocks)
    x = rng.integers(0, 1 << 64, 120 if n_blocks < 3 else 4, dtype=np.uint64)
    y = x.copy()
    for _ in range(simhash.THRESHOLD):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    homes, copies = defaultdict(set), defaultdict(set)
    for at, anchor, home in anchors.copies(x):
        assert home.sum() == len(x)
        for i, a in zip(at[home].tolist(), anchor[home].tolist(), strict=True):
            homes[i].add(a)
    for at, anchor, _ in anchors.copies(y):
        for i, a in zip(at.tolist(), anchor.tolist(), strict=True):
            copies[i].add(a)
    assert all(homes[i] & copies[i] for i in range(len(x)))


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("n_blocks", [1, 2])
def test_links_join_what_all_pairs_join(spark, monkeypatch, n_blocks, small):
    if small:  # anchors that hold many
        monkeypatch.setattr(simhash, "SLICE_HOMES", 50)
        monkeypatch.setattr(simhash, "SLICE_COPIES", 100)
    rng = np.random.default_rng(3)
    bit = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    base = rng.integers(0, 1 << 64, 1200, dtype=np.uint64)
    near = [base[:300] ^ bit(300) ^ bit(300) ^ bit(300) for _ in range(4)]
    dense = np.uint64(99) ^ bit(700) ^ bit(700)
    x = np.unique(np.concatenate([base, *near, dense]))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    found = simhash.links(spark.createDataFrame([(v,) for v in x.view(np.int64).tolist()], "print long"), n_blocks).collect()
    got = components(x.tolist(), [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in found])
    assert got == components(x.tolist(), zip(x[i].tolist(), x[j].tolist(), strict=True))


def test_many_close_pairs_become_few_links(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 5000)
    rng = np.random.default_rng(4)
    x = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 12, (600, 3)).astype(np.uint64), axis=1))
    x = np.concatenate([x, x ^ np.uint64(0xFFFF << 40)])
    found = simhash.close_pairs(x, x, 4)
    assert sum(len(a) for a, _ in found) < 12 * len(x)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert components(x.tolist(), [p for a, b in found for p in zip(a.tolist(), b.tolist(), strict=True)]) == components(x.tolist(), zip(x[i].tolist(), x[j].tolist(), strict=True))


# ---- 13


def plain_audit(rows):
    docs, groups = [], defaultdict(set)
    for _, text, lang, source, _ in rows:
        docs.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        df = Counter(t for la, _, ts in docs if la == lang for t in set(ts))
        kept = {t for t, n in df.items() if n >= 3}
        count = {s: Counter(t for la, so, ts in docs if (la, so) == (lang, s) for t in ts if t in kept) for s in sources}
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        price = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            found = [("pair", o, sum(price(share(count[s], t), share(count[o], t)) for t in kept)) for o in sources if o != s]
            found += [("term", t, price(share(count[s], t), share(whole, t))) for t in kept if count[s][t] and share(count[s], t) > share(whole, t)]
            for part in ("pair", "term"):
                ranked = sorted((x for x in found if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k + 1) for k, x in enumerate(ranked if part == "pair" else ranked[:200])]
    return out


@pytest.mark.parametrize("block_terms", [divergence.BLOCK_TERMS, 7])
def test_divergence_equals_plain_sums(spark, rows, docs, empty, monkeypatch, block_terms):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block_terms)
    more = [(1000 + i, "Éa éA the THE ÀÉ" if i % 2 else "tie tie x_y 5z the\x00end", "xx", f"q{i % 4}", 0) for i in range(9)] + [(2000, "lone", "yy", "a", 0), (2001, None, "yy", "b", 0)]
    df = docs.union(spark.createDataFrame(more, SCHEMA)).withColumns({c: F.lit(1) for c in ("term", "n", "cells", "block", "rank")})
    same([tuple(r) for r in divergence.audit(df).collect()], plain_audit([*rows, *more]))
    assert divergence.audit(empty).collect() == []


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(2)
    total = rng.integers(1, 9 * 10**15, 500)
    count = (rng.random(500) * total).astype(np.int64) % total
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def test_equal_counts_are_one_node_and_are_priced_once():
    counts = np.array([[1, 0] * 64, [2, 0] * 64, [1, 0] * 64])
    forest = divergence.Forest(counts)
    assert sum(len(left) for left, _ in forest.levels) == 2 * 7  # two different trees, one node a level
    other, here, there, times = forest.pairs(0)
    assert sorted(zip(other.tolist(), here.tolist(), there.tolist(), times.tolist(), strict=True)) == [(0, 0, 0, 64), (0, 1, 1, 64), (1, 0, 0, 64), (1, 1, 2, 64), (2, 0, 0, 64), (2, 1, 1, 64)]


def test_long_texts_are_split_in_windows(monkeypatch):
    raw = ("Wörd and x1y  " * 500 + "z" * 300).encode()
    want = Counter(w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(raw.decode())))
    monkeypatch.setattr(divergence, "WINDOW_BYTES", 100)
    assert Counter(w for part in divergence.words(raw) for w in part) == want
