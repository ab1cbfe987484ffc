"""Medicine names, the sense of an instruction, and writing systems, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import ACTION_WORDS, CONTINUE, CUES, DEFAULT, EXPECTED_SCRIPTS, LABEL, LABELS, LIMIT, NOT_A_STOP, REASSURANCE, SCRIPTS, STOP, STOP_WORDS, TEMPORARY, Lexicon
from .text import _all, _between, _map, _text, digits_in, let, one_of

WORD = r"[a-zA-ZÀ-ÿ]+"
DOSE = r"(?i)\b\d+(?:[.,/]\d+)?\s*(?:mg|mcg|g|units?|puffs?|tablets?|capsules?|ml)\b"
WARNING = r"(?i)\b(?:911|999|112|emergency|return to|go to the|call (?:your|the)|get help|urgent)"
FOLLOW_UP = r"(?i)\b(?:follow-?up|appointment|clinic|class|lab|blood test|panel|intake|physiotherapy)\b"
PLACEHOLDER = r"\[(?:PATIENT|CLINICIAN|CONTACT|MRN|ID|DATE_OF_BIRTH|DATE|EMAIL|PHONE|ADDRESS)_\d+\]"


def generic(word: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The generic name that a known lower-case word stands for; only names that differ from it are looked up, as Spark goes through a map entry by entry."""
    other = {w: name for w, name in lexicon.canonical().items() if w != name}
    return F.when(word.isin(*other), F.element_at(_map(other), word)).otherwise(word)


def drugs_in(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Medicines that a text names, brands and synonyms as their generic name, in order of appearance."""
    # A hashed set finds the few words that are names.
    known = F.filter(_all(F.lower(_text(text)), WORD), lambda w: w.isin(*lexicon.canonical()))
    return F.array_distinct(F.transform(known, lambda w: generic(w, lexicon)))


def canonical_drug(name: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.get(drugs_in(name, lexicon), F.lit(0))


def is_high_alert(drug: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.coalesce(canonical_drug(drug, lexicon).isin(*lexicon.high_alert), F.lit(False))


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def polarity(text: Column) -> Column:
    """struct<continue, stop, temporary> of an English instruction. Limits, conditions and negated stops are no stop."""
    t = F.lower(_text(text))
    bare = reduce(lambda x, p: F.regexp_replace(x, f"(?U){p}", " "), [*NOT_A_STOP, *CONTINUE], t)
    return F.struct(_any(t, CONTINUE).alias("continue"), _any(bare, STOP).alias("stop"), _any(t, TEMPORARY).alias("temporary"))


def polarity_in(text: Column, lang: str) -> Column:
    """polarity() of a text in another language: temporary is always false; an unknown language has none."""
    if lang == "en":
        return polarity(text)
    cues = CUES.get(lang)
    no = F.lit(False)
    if not cues:
        return F.struct(no.alias("continue"), no.alias("stop"), no.alias("temporary"))
    t = F.lower(_text(text))
    bare = reduce(lambda x, p: F.regexp_replace(x, f"(?iU){p}", " "), cues["continue"], t)
    return F.struct(_any(t, cues["continue"]).alias("continue"), _any(bare, cues["stop"]).alias("stop"), no.alias("temporary"))


def has_cue(text: Column, lang: str, cue: str) -> Column:
    patterns = CUES.get(lang, {}).get(cue)
    return _any(_text(text), patterns) if patterns else F.lit(False)


def reassurance(text: Column) -> Column:
    """The number of the first reassuring phrase in a text, null if it has none."""
    return F.coalesce(*(F.when(_any(_text(text), [p]), F.lit(i)) for i, p in enumerate(REASSURANCE)))


def states_limit(text: Column) -> Column:
    return _any(_text(text), [LIMIT])


def text_action(quote: Column) -> Column:
    """What a quote says to do: its capital label, else 'continue' if it reads so, else the first family of words found."""
    label = F.regexp_extract(_text(quote), LABEL, 1)
    t = F.lower(_text(quote))
    out = F.lit(None).cast("string")
    for action, words in reversed(ACTION_WORDS.items()):
        out = F.when(t.rlike(r"\b(?:" + "|".join(words) + r")\b"), F.lit(action)).otherwise(out)
    return F.when(label != "", F.element_at(_map(LABELS), label)).when(polarity(t)["continue"], F.lit("continue")).otherwise(out)


def is_labelled(quote: Column) -> Column:
    return _text(quote).rlike(LABEL)


def clause_for(text: Column, drug: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The first clause that names the medicine, else the text."""
    parts = _between(_text(text), r"[.;]|\bbut\b|\band\b")
    return F.coalesce(F.get(F.filter(parts, lambda p: F.array_contains(drugs_in(p, lexicon), drug)), F.lit(0)), _text(text))


def span_for(text: Column, drug: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The part of a text about one medicine: from its first mention back to the last point, comma or other medicine, and on to the
    next other medicine. The text if it isn't named."""
    words = r"(?i)(?<![a-zA-ZÀ-ÿ])(" + one_of(lexicon.canonical()) + r")(?![a-zA-ZÀ-ÿ])"
    t = _text(text)
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("over"))
    piece = lambda acc, m: F.struct(F.when(acc["over"] | ~m["own"], acc["text"]).otherwise(F.concat(acc["text"], m["word"], m["after"])).alias("text"), (acc["over"] | ~m["own"]).alias("over"))

    def marked(between: Column) -> Column:
        own = lambda word: generic(F.lower(word), lexicon) == drug
        return F.transform(F.arrays_zip(_all(t, words, 1).alias("word"), F.slice(between, 2, F.size(between)).alias("after")), lambda m: F.struct(m["word"], m["after"], own(m["word"]).alias("own")))

    def part(between: Column) -> Column:
        return let(marked(between), lambda marks: let(F.array_position(F.transform(marks, lambda m: m["own"]), F.lit(True)).cast("int"), lambda first: F.when(
            first > 0,
            F.concat(F.regexp_replace(F.get(between, first - 1), r"(?s)^.*[.;,]", ""), F.aggregate(F.slice(marks, first, F.size(marks)), start, piece, lambda acc: acc["text"])),
        ).otherwise(t)))

    return let(_between(t, words), part)


def foreign_script(text: Column, lang: str) -> Column:
    """The first run of a writing system that the language does not use, '' if there is none."""
    own = EXPECTED_SCRIPTS.get(lang, [])
    runs = [F.nullif(F.regexp_extract(_text(text), f"[{chars}]+", 0), F.lit("")) for name, chars in SCRIPTS.items() if name not in own]
    return F.coalesce(*runs, F.lit(""))


def local_spelling(drug: Column, text: Column) -> Column:
    """A word with the medicine's stem and another ending, at most two letters longer; null if none, or for short or compound names."""
    words = _all(_text(text), r"[\p{L}\p{N}_]+")
    stem = F.substring(drug, F.lit(1), F.length(drug) - 1)
    like = lambda w: (F.lower(w) != drug) & F.startswith(F.lower(w), stem) & (F.length(w) - F.length(drug) <= 2)
    return F.when((F.length(drug) >= 7) & ~drug.rlike("[ /]"), F.get(F.filter(words, like), F.lit(0)))


def placeholders_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(_text(text), PLACEHOLDER)))


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or more but the common ones, and the numbers written with digits."""
    words = F.array_except(F.array_distinct(_all(F.lower(_text(text)), "[a-z]{3,}")), F.array(*map(F.lit, STOP_WORDS)))
    # Most texts have no digit, and looking for numbers reads a text five times.
    return F.when(text.rlike("[0-9]"), F.array_union(words, digits_in(text))).otherwise(words)
