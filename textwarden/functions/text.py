"""Numbers, readability, quantities, dates, clock times and dose scales of a text, as columns.

Sets are arrays of distinct values, never null: of a null text they are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import AM, MONTHS, PM, UNITS, WORD_NUMBERS
from .dims import TIME as _TIME

NUMBER = r"(?<![0-9A-Za-z.])\d+(?:[.,]\d+)?"
THOUSANDS = r"(?<=\d),(?=\d{3}\b)"
TOKEN = r"\[[A-Z_]+_\d+\]"
HOUR_H = r"\b(\d{1,2})\s?h\s?(\d{2})\b"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: Parts a text where a pattern matched; no character of a text, and where one is, the slow way is taken.
_CUT = "\uffff"


def _between(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern: split(), which compiles its pattern anew for every row, by a replacement, which doesn't."""
    quick = F.split(F.regexp_replace(text, pattern, _CUT), _CUT, -1)
    return F.when(F.contains(text, F.lit(_CUT)), F.split(text, pattern, -1)).otherwise(quick)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used: inside lambdas Spark shares no common expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, the longest first, by their first letters: so that few are tried at each place."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _map(values: dict[str, str]) -> Column:
    """A map of strings; one value in the plan, however many entries it has."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in values.items())), F.lit("\n"), F.lit("\t"))


def _zipped(**arrays: Column) -> Column:
    """Arrays of strings as one of structs with these names."""
    return F.arrays_zip(*arrays.values()).cast("array<struct<" + ",".join(f"{n}:string" for n in arrays) + ">>")


def norm_number(n: Column) -> Column:
    """Decimal point, no trailing zeros after it, no leading zeros but one before the point: 2,50 -> 2.5, 007 -> 7, .5 -> 0.5."""
    point = F.replace(n, F.lit(","), F.lit("."))
    short = F.when(F.contains(point, F.lit(".")), F.regexp_replace(point, r"\.?0+$", "")).otherwise(point)
    return F.regexp_replace(F.regexp_replace(short, r"^0+(?=\d)", ""), r"^\.", "0.")


def digits_in(text: Column) -> Column:
    """The numbers that a text writes with digits."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(text), THOUSANDS, ""), TOKEN, " "), HOUR_H, "$1:$2")
    return F.array_distinct(F.transform(_all(plain, NUMBER), norm_number))


def numbers_in(text: Column) -> Column:
    """digits_in and the numbers that a text writes as English words."""
    words = "|".join(sorted((w.replace(".", r"\.") for w in WORD_NUMBERS), key=len, reverse=True))
    said = F.transform(_all(_text(text), rf"(?i)\b({words})\b", 1), lambda w: F.element_at(_map(WORD_NUMBERS), F.lower(w)))
    return F.array_union(digits_in(text), said)


def date_numbers(text: Column) -> Column:
    dates = _all(_text(text), r"\b\d{1,2}/\d{1,2}/\d{2,4}\b")
    return F.array_distinct(F.flatten(F.transform(dates, digits_in)))


def syllables(word: Column) -> Column:
    w = F.btrim(F.lower(word), F.lit(".,;:!?'\"()"))
    stem = F.regexp_replace(F.regexp_replace(w, r"(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiouy]+"))))


def fk_grade(text: Column) -> Column:
    """Flesch-Kincaid grade of English text, not below 0, one decimal (half up); 0 without sentences or words."""
    sentences = F.size(F.filter(_between(_text(text), r"[.!?]+(?:\s|$)|\n+"), lambda s: s.rlike("[A-Za-z]")))
    words = _all(_text(text), r"[A-Za-z][A-Za-z'-]*")
    n = F.size(words)
    total = F.aggregate(words, F.lit(0), lambda acc, w: acc + syllables(w).cast("int"))
    grade = F.lit(0.39) * n / sentences + F.lit(11.8) * total / n - F.lit(15.59)
    return F.when((sentences == 0) | (n == 0), F.lit(0.0)).otherwise(F.round(F.greatest(grade, F.lit(0.0)), 1))


def word_count(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(r"[\p{L}\p{N}_]+"))


def squash(text: Column) -> Column:
    """Lower case, punctuation but the point as a space, single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(_text(text)), r"[^\p{L}\p{N}_\s.]", " "), r"\s+", " "))


def contained(quote: Column, source: Column) -> Column:
    """Whether the squashed quote stands in the squashed source; an empty one does not."""
    q = squash(quote)
    return (F.length(q) > 0) & F.contains(squash(source), q)


_ALTERNATIVES = sorted(((alt, name) for name, alts in UNITS.items() for alt in alts), key=lambda x: (-len(x[0]), x[0]))
QUANTITY = r"(?iu)(?<![0-9A-Za-z.])(\d+(?:[.,]\d+)?)\s*(?:-|to|a|à|đến|到|至)?\s*(?:\d+(?:[.,]\d+)?)?\s*(" + "|".join(a for a, _ in _ALTERNATIVES) + r")(?![A-Za-zÀ-ỹ])"


def unit_name(token: Column) -> Column:
    """The unit that a word stands for, in any language; longer words first."""
    out = F.lit(None).cast("string")
    for name, alts in reversed(UNITS.items()):
        out = F.when(token.rlike("(?iu)^(?:" + "|".join(alts) + ")$"), F.lit(name)).otherwise(out)
    return out


def quantities(text: Column) -> Column:
    """array<struct<num, unit>>; of a range the first number."""
    plain = F.regexp_replace(_text(text), THOUSANDS, "")
    pairs = _zipped(n=_all(plain, QUANTITY, 1), u=_all(plain, QUANTITY, 2))
    return F.array_distinct(F.transform(pairs, lambda p: F.struct(norm_number(p["n"]).alias("num"), unit_name(p["u"]).alias("unit"))))


ZH_DATE = r"(?:(\d{4})\s*年\s*)?(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]"
ISO_DATE = r"(?<![0-9/])(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?![0-9/])"
VI_DATE = r"(?iu)ngày\s+(\d{1,2})\s*(?:tháng\s*|/)(\d{1,2})(?:\s*(?:năm\s*|/)(\d{4}))?"
NUMERIC_DATE = r"(?<![0-9/])(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?![0-9/])"


def _month_date(lang: str) -> str:
    """Month name first (groups 1 month, 2 day, 3 year) or day first (4 day, 5 month, 6 year): whichever begins first in a text."""
    names = "|".join(dict.fromkeys([*MONTHS.get(lang, []), *MONTHS["en"]]))
    return rf"(?iu)\b({names})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?|\b(\d{{1,2}})(?:er|º|°)?\s+(?:de\s+)?({names})(?:\s+(?:de\s+|del\s+)?(\d{{4}}))?"


_DATE_TYPE = "array<struct<year:int,month:int,day:int>>"
#: Texts without any of these hold no date.
_DATE_HINT = r"(?iu)\d[/-]\d|月|ngày|" + "|".join(m for months in MONTHS.values() for m in months)


def _dates(text: Column, pattern: str, y: list[int], m: list[int], d: list[int], month: Callable[[Column], Column]) -> Column:
    """The dates of a pattern; y, m, d: the groups that may hold each part (an absent group is an empty string)."""
    groups = sorted({*y, *m, *d})
    found = _zipped(**{f"g{g}": _all(text, pattern, g) for g in groups})
    first = lambda x, of: F.coalesce(*(F.nullif(x[f"g{g}"], F.lit("")) for g in of))
    part = lambda x: F.struct(first(x, y).try_cast("int").alias("year"), month(first(x, m)).alias("month"), first(x, d).try_cast("int").alias("day"))
    return F.filter(F.transform(found, part).cast(_DATE_TYPE), lambda x: x["month"].between(1, 12) & x["day"].between(1, 31))


def dates_in(text: Column, lang: str = "en") -> Column:
    """array<struct<year, month, day>>, year null where none is given.

    Each form is taken out before the next is looked for: Chinese, ISO, Vietnamese, month names, numeric. Numeric dates need a year and
    are read month first in English, or if the second number can't be a month; else day first.
    """
    number = lambda x: x.try_cast("int")
    names = {n: str(i + 1) for months in MONTHS.values() for i, n in enumerate(months)}
    named = lambda x: F.element_at(_map(names), F.lower(x)).try_cast("int")
    rest, found = _text(text), []
    for pattern, (y, m, d), month in [
        (ZH_DATE, ([1], [2], [3]), number),
        (ISO_DATE, ([1], [2], [3]), number),
        (VI_DATE, ([3], [2], [1]), number),
        (_month_date(lang), ([3, 6], [1, 5], [2, 4]), named),
    ]:
        found.append(_dates(rest, pattern, y, m, d, month))
        rest = F.regexp_replace(rest, pattern, " ")
    parts = _zipped(**{n: _all(rest, NUMERIC_DATE, g) for n, g in (("a", 1), ("b", 2), ("y", 3))})

    def numeric(x: Column) -> Column:
        a, b = x["a"].cast("int"), x["b"].cast("int")
        year = F.when(F.length(x["y"]) == 2, F.lit(2000) + x["y"].cast("int")).otherwise(x["y"].cast("int"))
        first = F.lit(lang == "en") | (b > 12)
        return F.struct(year.alias("year"), F.when(first, a).otherwise(b).alias("month"), F.when(first, b).otherwise(a).alias("day"))

    found.append(F.filter(F.transform(parts, numeric).cast(_DATE_TYPE), lambda x: x["month"].between(1, 12) & x["day"].between(1, 31)))
    return F.when(_text(text).rlike(_DATE_HINT), F.array_distinct(F.concat(*found))).otherwise(F.array().cast(_DATE_TYPE))


def strip_dates(text: Column, lang: str = "en") -> Column:
    rest = _text(text)
    for pattern in (ZH_DATE, ISO_DATE, VI_DATE, _month_date(lang), NUMERIC_DATE):
        rest = F.regexp_replace(rest, pattern, " ")
    return rest


def ambiguous_dates(text: Column) -> Column:
    """Numeric dates that read differently month first and day first."""
    both = lambda d: (F.split(d, "/")[0].cast("int") <= 12) & (F.split(d, "/")[1].cast("int") <= 12) & (F.split(d, "/")[0] != F.split(d, "/")[1])
    return F.filter(_all(_text(text), NUMERIC_DATE), both)


def spell_dates(text: Column) -> Column:
    """US numeric dates with a four-digit year, the month as a word: 10/21/2026 -> October 21, 2026."""
    names = F.array(*(F.lit(m.title()) for m in MONTHS["en"]))

    def spelled(out: Column, date: Column) -> Column:
        p = F.split(date, "/")
        m, d = p[0].cast("int"), p[1].cast("int")
        good = m.between(1, 12) & d.between(1, 31) & (F.length(p[2]) == 4)
        return F.when(good, F.replace(out, date, F.concat(F.get(names, m - 1), F.lit(" "), d.cast("string"), F.lit(", "), p[2]))).otherwise(out)

    longest = F.array_sort(F.array_distinct(_all(_text(text), NUMERIC_DATE)), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, _text(text), spelled)


TIME = "(?iu)" + _TIME


def _getter(array: Column, shift: int) -> Callable[[Column], Column]:
    return lambda i: F.get(array, i + shift)


def times_in(text: Column, lang: str = "en") -> Column:
    """array<struct<hour (0-11), minute, period ('am', 'pm', '?')>>: times with minutes, or hours with a word of the day.

    The nearest such word decides: the first in the 16 characters after the time, else the last in the 6 before it.
    """
    t = _text(text)
    # What stands between the matches shows what is around each.
    matches, between = _all(t, TIME), _between(t, TIME)
    groups = [_all(t, TIME, g) for g in range(1, 8)]
    places = F.sequence(F.lit(0), F.greatest(F.size(matches) - 1, F.lit(0)))
    at = lambda array, shift: F.transform(places, _getter(array, shift))
    zipped = _zipped(m=matches, **{f"g{i}": g for i, g in enumerate(groups, 1)}, before=at(between, 0), after=at(between, 1), next=at(matches, 1))
    zipped = F.filter(zipped, lambda x: x["m"].isNotNull())
    am, pm = AM.get(lang, AM["en"]), PM.get(lang, PM["en"])

    def read(x: Column) -> Column:
        first = lambda names: F.coalesce(*(F.nullif(x[n], F.lit("")) for n in names)).try_cast("int")
        h, minute = first(["g1", "g3", "g5", "g7"]), F.coalesce(first(["g2", "g4", "g6"]), F.lit(0))
        after = F.substring(F.concat(F.coalesce(x["after"], F.lit("")), F.coalesce(x["next"], F.lit(""))), 1, 16)
        before = F.right(F.coalesce(x["before"], F.lit("")), F.lit(6))
        found = lambda s, p: F.nullif(F.regexp_instr(s, F.lit(f"(?iu){p}")), F.lit(0))
        later = F.when(F.coalesce(found(after, am), F.lit(99)) < F.coalesce(found(after, pm), F.lit(99)), F.lit("am")).when(found(after, pm).isNotNull(), F.lit("pm"))
        earlier = F.when(F.coalesce(found(before, am), F.lit(0)) > F.coalesce(found(before, pm), F.lit(0)), F.lit("am")).when(found(before, pm).isNotNull(), F.lit("pm"))
        period = F.coalesce(later, earlier, F.lit("?"))
        period = F.when(h >= 13, F.lit("pm")).when((h == 12) & (period == "?"), F.lit("pm")).otherwise(period)
        return F.struct((F.when(h >= 13, h - 12).otherwise(h) % 12).alias("hour"), minute.alias("minute"), period.alias("period"), h.alias("said"))

    good = F.filter(F.transform(zipped, read).cast("array<struct<hour:int,minute:int,period:string,said:int>>"), lambda x: (x["said"] <= 24) & (x["minute"] <= 59))
    kind = "array<struct<hour:int,minute:int,period:string>>"
    found = F.array_distinct(F.transform(good, lambda x: F.struct(x["hour"], x["minute"], x["period"])).cast(kind))
    return F.when(t.rlike(TIME), found).otherwise(F.array().cast(kind))


def strip_times(text: Column) -> Column:
    return F.regexp_replace(_text(text), TIME, " ")


SCALE = r"(?iu)(?<![0-9.])(\d{2,3})\s*(?:-|–|to|a|à|al|đến|到|至)\s*(\d{2,3})(?![0-9])[^0-9;。；]{0,30}?(\d+(?:[.,]\d+)?)\s*(?:units?|unidad(?:es)?|unità|unités?|đơn vị|个?单位)"


def scale_steps(text: Column) -> Column:
    """array<struct<low, high, dose>>: steps such as '201-250 give 4 units'; of one range the last."""
    steps = _zipped(**{n: _all(_text(text), SCALE, g) for n, g in (("low", 1), ("high", 2), ("dose", 3))})
    rows = F.transform(steps, lambda s: F.struct(s["low"], s["high"], norm_number(s["dose"]).alias("dose")))
    kind = "array<struct<low:string,high:string,dose:string>>"
    last = F.filter(rows, lambda s, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda o: (o["low"] == s["low"]) & (o["high"] == s["high"])))
    return F.when(_text(text).rlike(SCALE), last.cast(kind)).otherwise(F.array().cast(kind))


_TIMES = {"once": "1", "one": "1", "twice": "2", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6"} | {str(i): str(i) for i in range(1, 10)}


def per_day(text: Column) -> Column:
    """Doses a day that an English text states, as array<int>."""
    t = F.lower(_text(text))
    count = lambda w: F.try_element_at(_map(_TIMES), F.split(w, " ")[0]).try_cast("int")
    a_day = F.transform(_all(t, r"\b(once|twice|one|two|three|four|five|six|\d)\s*(?:times?\s*)?(?:a|per|each|every)\s+day\b", 1), count)
    daily = F.transform(_all(t, r"\b(once|twice|three times|four times|\d times)\s+(?:daily|a day)\b", 1), count)
    hours = F.transform(_all(t, r"\bevery\s+(\d{1,2})\s*(?:hours?|hrs?|h)\b", 1), lambda h: h.cast("int"))
    every = F.transform(F.filter(hours, lambda h: (h > 0) & (24 % F.greatest(h, F.lit(1)) == 0) & ~F.contains(t, F.lit("as needed"))), lambda h: (24 / h).cast("int"))
    short = F.array_compact(F.array(*(F.when(t.rlike(rf"\b{w}\b"), F.lit(n)) for w, n in (("bid", 2), ("tid", 3), ("qid", 4)))))
    found = F.array_distinct(F.array_compact(F.concat(a_day, daily, every, short)))
    once = t.rlike(r"\b(?:daily|every day|each day|once a day|every morning|every night|nightly|at bedtime)\b")
    return F.when((F.size(found) == 0) & once, F.array(F.lit(1))).otherwise(found)
