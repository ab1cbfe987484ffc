import random

from textwarden.operators import overlap


def test_covered_equals_all_pairs(spark):
    """Items of one to twelve tokens over few and many common words, numbers, repeated words, nulls and empty texts, against every pair."""
    rng = random.Random(7)
    common, rare = [f"{c}common" for c in "abcdef"], [f"rare{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    text = lambda n: [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(n)]
    items = [(i, text(rng.randint(1, 12))) for i in range(60)] + [(60, ["the", "and"]), (61, ["acommon"]), (62, [])]
    docs = [(i, text(rng.randint(0, 40)) + (rng.choice(items)[1] if i % 3 == 0 else [])) for i in range(200)] + [(900, common)]
    tokens = lambda words: {w for w in words if w not in ("the", "and")}
    for threshold in (0.3, 0.6, 1.0):
        want = {(i, d, len(tokens(a) & tokens(b)), len(tokens(a))) for i, a in items for d, b in docs if tokens(a) and len(tokens(a) & tokens(b)) / len(tokens(a)) >= threshold}
        rows = [(i, " ".join(w)) for i, w in items] + [(98, None), (99, "")]
        said = [(d, "\n".join(w)) for d, w in docs] + [(998, None), (999, "")]
        given = spark.createDataFrame(rows, "item_id long, text string"), spark.createDataFrame(said, "doc_id long, text string")
        got = [tuple(r) for r in overlap.covered(*given, threshold).select("item_id", "doc_id", "shared", "size").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        if threshold == 0.6:
            first = {}
            for i, d, shared, size in sorted(want, key=lambda w: (-w[2] / w[3], w[0])):
                first.setdefault(d, (d, i, shared, size))
            assert {tuple(r) for r in overlap.best(*given, threshold).collect()} == set(first.values())


def test_without_rows(spark):
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert overlap.best(items, docs).count() == 0
    assert overlap.best(items.limit(0), docs.unionByName(items.select(items.item_id.alias("doc_id"), "text"))).count() == 0


def test_both_sides_shuffled_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"everyone everywhere says {'special thing' if i == 5 else 'nothing'}") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "everyone everywhere special thing says")], "item_id long, text string")
    for most in (overlap.SENT_TOKENS, 0):
        monkeypatch.setattr(overlap, "SENT_TOKENS", most)
        assert sorted(r.doc_id for r in overlap.covered(items, docs).collect()) == [*range(50)]  # three of five are shared by all: 0.6
        assert [r.doc_id for r in overlap.covered(items, docs, 0.8).collect()] == [5]


def test_a_word_of_every_document_is_no_key_beside_rarer_ones(spark):
    words = spark.createDataFrame([(1, 5, w) for w in ("everyone", "everywhere", "special", "thing", "never")], "item_id long, size int, token string")
    seen = spark.createDataFrame([("everyone", 50), ("everywhere", 50), ("special", 1), ("thing", 2)], "token string, df long")
    assert {(r.needed, r.token) for r in overlap.rare_keys(words, seen, 0.6).collect()} == {(3, "special"), (3, "thing")}
    assert {r.token for r in overlap.rare_keys(words, seen, 0.2).collect()} == {"everyone", "everywhere", "special", "thing"}
