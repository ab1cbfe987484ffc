"""Unicode canonical composition (NFC) as a column: Spark has no such function.

Characters are taken apart, the marks after a starter put in order of class, and put together pair by pair. The tables come from Python's Unicode data by
rule; Hangul is put together by its arithmetic. Only texts with a character that composition could change go that way.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from unicodedata import combining, decomposition, normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _map, let

#: Hangul: leading consonants, vowels and trailing consonants, and the syllables in order.
_LEADS, _VOWELS, _TRAILS = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)
_SYLLABLES = range(0xAC00, 0xD7A4)


def _class(chars: Iterable[str]) -> str:
    """A pattern's class of the characters, as ranges."""
    codes, ranges = sorted(map(ord, chars)), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in ranges)


@cache
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """What characters are taken apart into, classes of marks, and what pairs are put together into."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in _SYLLABLES]
    apart = {c: d for c in every if (d := normalize("NFD", c)) != c}
    classes = {c: str(k) for c in every if (k := combining(c))}
    parts = {c: "".join(chr(int(x, 16)) for x in decomposition(c).split()) for c in apart}
    return apart, classes, {p: c for c, p in parts.items() if len(p) == 2 and normalize("NFC", p) == c}


def nfc(text: Column) -> Column:
    """The text in Unicode's canonical composition; null for null."""
    apart, classes, pairs = _tables()
    marks = _class(classes)
    followers = _class({*classes, *(p[1] for p in pairs), *map(chr, _VOWELS), *map(chr, _TRAILS)})
    changing = _class(c for c in apart if normalize("NFC", c) != c)
    chars = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    of = lambda c: F.coalesce(_map(classes)[c].cast("int"), F.lit(0))

    # Only what marks follow, and what never stays as it is, has to be taken apart.
    def ordered(cluster: Column) -> Column:
        taken = F.array_join(F.transform(chars(cluster), lambda c: F.coalesce(_map(apart)[c], c)), "")
        runs = F.regexp_extract_all(taken, F.lit(f"(?s)[^{marks}]|[{marks}]+"), F.lit(0))
        by_class = lambda run: F.array_join(F.transform(F.array_sort(F.transform(chars(run), lambda c, i: F.struct(of(c).alias("k"), i.alias("i"), c.alias("c")))), lambda m: m["c"]), "")
        return F.array_join(F.transform(runs, lambda r: F.when(F.char_length(r) > 1, by_class(r)).otherwise(r)), "")

    def hangul(head: Column, c: Column) -> Column:
        a, b = F.ascii(head), F.ascii(c)
        lead = F.when(a.between(_LEADS[0], _LEADS[-1]) & b.between(_VOWELS[0], _VOWELS[-1]), ((a - _LEADS[0]) * 21 + b - _VOWELS[0]) * 28)
        trail = F.when(a.between(_SYLLABLES[0], _SYLLABLES[-1]) & ((a - _SYLLABLES[0]) % 28 == 0) & b.between(_TRAILS[0], _TRAILS[-1]), a - _SYLLABLES[0] + b - _TRAILS[0] + 1)
        return F.substring(F.lit("".join(map(chr, _SYLLABLES))), F.coalesce(lead, trail) + 1, F.lit(1))

    def joined(cluster: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), F.substring(cluster, 1, 1).alias("head"), F.lit("").alias("tail"), F.lit(-1).alias("last"))

        def step(s: Column, c: Column) -> Column:
            def taken(x: Column) -> Column:
                both, k = x["both"], x["k"]
                return (
                    F.when(both.isNotNull(), F.struct(s["done"].alias("done"), both.alias("head"), s["tail"].alias("tail"), s["last"].alias("last")))
                    .when(k == 0, F.struct(F.concat(s["done"], s["head"], s["tail"]).alias("done"), c.alias("head"), F.lit("").alias("tail"), F.lit(-1).alias("last")))
                    .otherwise(F.struct(s["done"].alias("done"), s["head"].alias("head"), F.concat(s["tail"], c).alias("tail"), k.alias("last")))
                )

            both = F.when((s["last"] < 0) | (s["last"] < of(c)), F.coalesce(_map(pairs)[F.concat(s["head"], c)], F.when(s["last"] < 0, hangul(s["head"], c))))
            return let(F.struct(both.alias("both"), of(c).alias("k")), taken)

        return F.aggregate(chars(F.substring(cluster, F.lit(2), F.char_length(cluster))), start, step, lambda s: F.concat(s["done"], s["head"], s["tail"]))

    def each(t: Column, pattern: str, touched: str, do: object) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: F.when(x.rlike(touched), do(x)).otherwise(x)), "")

    apart_text = each(text, f"(?s)[^{marks}{changing}][{marks}{changing}]*|[{marks}{changing}]+", f"[{marks}{changing}]", ordered)
    return F.when(text.rlike(f"[{followers}{changing}]"), each(apart_text, f"(?s)[^{followers}][{followers}]*|[{followers}]+", f"[{followers}]", joined)).otherwise(text)
