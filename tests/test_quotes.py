import random
import re
from difflib import SequenceMatcher

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.functions import fuzzy
from textwarden.functions.fuzzy import Quote, Quotes
from textwarden.operators import quotes
from textwarden.plans import catalogue
from textwarden.sources.shipping import ship


def test_exact_quotes_of_any_shape(spark):
    items = [
        (1, "one two\nthree four five six seven eight"), (2, "alpha beta gamma delta epsilon zeta"), (3, "short one here"), (4, "two words"), (5, "word"),
        (6, "a  double space and\n\nblank line in it"), (7, "plain run of seven or more words here"), (8, None),
    ]
    docs = [(100 + i, f"xx{t}yy and more text after it") for i, t in items if t] + [(200 + i, f"Before {t}") for i, t in items if t] + [(300 + i, t) for i, t in items]
    docs += [(400, ""), (401, "one two three four five six seven eight"), (402, "short one there")]
    want = {(i, d) for i, q in items for d, t in docs if q is not None and t is not None and q in t}
    got = quotes.exact(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(want) and {(r.item_id, r.doc_id) for r in got} == want


def test_exact_quotes_of_the_large_table(spark):
    sf = "/root/testdata/sf0.1"
    sql = catalogue.SQL["quote_exact_join"].replace("benchmark b", f"'{sf}/benchmark.parquet' b").replace("documents d", f"'{sf}/documents.parquet' d")
    got = catalogue.QUERIES["quote_exact_join"](spark, sf).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == sorted(duckdb.sql(sql).fetchall())


def test_near_quotes_equal_all_pairs(spark, monkeypatch):
    """Slips in each place of a quote, other case, punctuation and line breaks; items of all lengths, null and repeated ones; against every pair's plain comparison."""
    ship(spark)
    base = "take one white tablet with a full glass of water every morning before you eat and call the clinic if you feel dizzy or weak at any time"
    words = base.split()
    docs = [(1, f"Before it. {base.upper()}! After it."), (2, "Take one white tablet,\nwith a full glass of water; every morning before you eat and call the clinic if you feel dizzy or weak at any time"), (3, "Nothing of the kind stands here, it is another text."), (4, None), (5, "")]
    for i in range(0, len(words), 3):
        slipped = [w[::-1] if j == i else w for j, w in enumerate(words)]
        docs.append((10 + i, "Some words first. " + " ".join(slipped) + " and then some."))
    docs.append((90, " ".join(w[::-1] for w in words)))
    items = [(1, base), (2, "call the clinic"), (3, "dizzy"), (4, "no such thing anywhere in it"), (5, None), (6, "glass water"), (1, base), (7, "... !?"), (8, base * 3)]
    items += [(100 + n, base[n : n + n]) for n in range(1, 30)] + [(200 + n, base[n : 2 * n - 1] + "q" + base[2 * n : 3 * n]) for n in range(2, 40, 3)]
    docs += [(1, docs[0][1]), (91, base[:70]), (92, base[2:9]), (93, "".join(c + ("x" if i % 14 == 0 else "") for i, c in enumerate(base) if i % 14 != 7))]

    def squashed(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s.]", " ", t.lower())).strip()

    def held(q, s):
        n = len(q)
        return bool(q) and (q in s or any(SequenceMatcher(None, q, s[a : a + n]).ratio() >= 0.85 for a in range(0, max(1, len(s) - n + 1), max(1, n // 8))))

    want = {(i, d) for i, q in items for d, t in docs if q and t and held(squashed(q), squashed(t))}
    assert {(1, 93), (1, 10)} <= want  # a slip in every few characters leaves no words alone
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for sent, part in ((200_000, 16_000_000), (300, 2_000)):  # all items at once; in blocks
        monkeypatch.setattr(quotes, "SENT_CHARS", sent)
        monkeypatch.setattr(quotes, "PART_CHARS", part)
        got = quotes.near(items, docs).collect()
        assert len(got) == len(want) and {(r.item_id, r.doc_id) for r in got} == want
        assert quotes.near(items.limit(0), docs).collect() == quotes.near(items, docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text("abcde ", max_size=60), st.data())
def test_near_quotes_lose_no_window(source, data):
    """Stretches of a text with characters lost, put in and changed, at several thresholds, against the ratio of every window."""
    texts = []
    for _ in range(4):
        begin = data.draw(st.integers(0, max(0, len(source) - 1)))
        quote = list(source[begin : begin + data.draw(st.integers(1, 40))])
        for _ in range(data.draw(st.integers(0, 4))):
            i = data.draw(st.integers(0, len(quote)))
            quote[i : i + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "z", "a"]))
        texts.append("".join(quote))
    threshold = data.draw(st.sampled_from([0.7, 0.85, 0.9, 1.0]))
    found = list(Quotes(texts, threshold).found(source))
    windows = lambda n: (source[a : a + n] for a in range(0, max(1, len(source) - n + 1), max(1, n // 8)))
    want = [i for i, q in enumerate(texts) if q and (q in source or any(SequenceMatcher(None, q, w).ratio() >= threshold for w in windows(len(q))))]
    assert sorted(found) == want


def test_near_quotes_of_a_long_text():
    """Many stretches of a long text, a match in one of them."""
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
    at = text.index(" ", 4000)
    slipped = list(text[at : at + 160])
    del slipped[20], slipped[90]
    slipped[50:50] = "zz"
    assert list(Quotes(["".join(slipped), "nothing like it in the whole text here"]).found(text)) == [0]


def _edited(text, share, rng):
    out = []
    for c in text:
        x = rng.random()
        out += [] if x < share / 2 else [rng.choice("aetz"), c] if x < share else [c]
    return "".join(out)


def test_near_quotes_of_200_characters_and_more_lose_no_window():
    """Windows in which the ratio leaves out popular characters, with few and with many unpopular ones, edited until they just match or just don't."""
    rng, near_limit = random.Random(5), 0
    for letters in ("etaoin s" * 9 + "bcdfghjklmpqrvwxyz", "etao n" * 30 + "bkz", "".join(map(chr, range(0x4E00, 0x4E90))) + "ab " * 20):
        for n in (199, 200, 230, 305):
            source = "".join(rng.choice(letters) for _ in range(900))
            own = [_edited(source[a : a + n], share, rng) for share in (0, 0.02, 0.06, 0.1, 0.13, 0.2) for a in (0, 3 * (n // 8), 333)] + [source[300:400] + source[420 : 420 + n]]
            best = [max(SequenceMatcher(None, q, source[a : a + len(q)]).ratio() for a in range(0, len(source) - len(q) + 1, len(q) // 8)) for q in own]
            near_limit += sum(0.8 < r < 0.9 for r in best)
            assert sorted(Quotes(own).found(source)) == [i for i, (q, r) in enumerate(zip(own, best, strict=True)) if q in source or r >= 0.85]
    assert near_limit > 5


def test_few_windows_are_compared_character_by_character(monkeypatch):
    """Texts of the quotes' own syllables, none near: before, nothing but a count over the whole text kept a quote from being compared with all of it."""
    rng, left = random.Random(7), []
    syllables = "th he in er an re nd ed ha tion ent on st or ea ble ly en que ción ment ar lo mi sub ter per con dis pre ing ous al est ity ver com".split()
    write = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    own, texts = [write(k) for k in range(14, 54)], [write(300) for _ in range(5)]
    alike = Quote.alike
    monkeypatch.setattr(Quote, "alike", lambda q, window, threshold: left.append(1) or alike(q, window, threshold))
    search = Quotes(own)
    assert not any(i for t in texts for i in search.found(t))
    windows = sum(len(search._windows(np.arange(len(own)), 0, len(t))[0]) for t in texts)
    assert len(left) < windows / 50


def test_a_long_text_is_searched_in_pieces(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("etaoin sbdkz") for _ in range(5000))
    own = [_edited(text[a : a + n], 0.05, rng) for n in (40, 120, 260) for a in range(0, 4700, 331)]
    whole = sorted(Quotes(own).found(text))
    monkeypatch.setattr(fuzzy, "PIECE", 700)
    monkeypatch.setattr(fuzzy, "MET", 100)
    monkeypatch.setattr(fuzzy, "HELD", 3000)
    assert sorted(Quotes(own).found(text)) == whole and len(whole) > 20
