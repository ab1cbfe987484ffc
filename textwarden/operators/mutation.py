"""Errors put into good sentences on purpose, to see which the checks catch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.dims import DEFAULT, Lexicon


def bumped(text: Column) -> Column:
    """The first number ten times as great, without its decimals; 5 if it is below 1."""
    whole = F.regexp_extract(text, r"^\D*(\d+)", 1)
    new = F.when(whole.try_cast("long") < 1, F.lit("$15")).otherwise(F.concat(F.lit("$1"), whole, F.lit("0")))
    return F.when(whole != "", F.regexp_replace(text, F.lit(r"^(\D*)\d+(?:[.,]\d+)?"), new))


#: What a made-up instruction adds to a sentence.
INVENTED = " Also take aspirin every day."


def _reading(text: Column, drug: Column, other: Column, lexicon: Lexicon) -> Column:
    """The text with each spelling of one medicine as another name."""
    spelled: dict[str, list[str]] = {}
    for word, name in lexicon.canonical().items():
        spelled.setdefault(name, []).append(word)
    names = F.try_element_at(F.create_map(*(F.lit(x) for name, words in spelled.items() for x in (name, "|".join(words)))), drug)
    pattern = F.concat(F.lit(r"(?i)(?<![a-zA-ZÀ-ÿ])(?:"), names, F.lit(r")(?![a-zA-ZÀ-ÿ])"))
    return F.regexp_replace(text, pattern, other)


def mutants(sentences: DataFrame, other_drug: Column, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """One row per sentence and error that applies: mutation, text_en, text_tl, back_en, fact_ids and removed as changed; `clean` is the sentence as it is.

    sentences: text_en, fact_ids, drug (canonical, or null) and med_action of the medicine it is about, critical (whether it is the only one to
    tell a fact that must be told), and, where there is a translation, text_tl and back_en.
    """
    for name, kind in (("text_tl", "string"), ("back_en", "string"), ("critical", "boolean")):
        if name not in sentences.columns:
            sentences = sentences.withColumn(name, F.lit(None).cast(kind))
    en, tl, back, ids, drug, action = (F.col(c) for c in ("text_en", "text_tl", "back_en", "fact_ids", "drug", "med_action"))
    no = F.lit(False)
    named = drug.isNotNull() & F.array_contains(lex.drugs_in(en, lexicon), drug)
    halted = named & action.isin("stop", "hold")
    read_back = lambda text: F.when(back.isNotNull(), text)
    dial = lambda t: F.regexp_replace(t, r"[Cc]all (911|999|112)", "Call your doctor")
    always = lambda t: F.regexp_replace(t, r"(?i)\s*only if pain is very bad|\s*only if the pain is very strong|\s*(?:only )?(?:if|as) needed", "")
    keep, stop = F.concat(F.lit("Keep taking "), drug, F.lit(" the same as before.")), F.concat(F.lit("Stop taking "), drug, F.lit("."))
    swapped = lambda t: _reading(t, drug, other_drug, lexicon)
    none = F.array().cast("array<string>")
    kinds: list[tuple[str, Column, Column, Column, Column, Column, Column]] = [
        # name, where it applies, English, translation, back-translation, cited ids, removed
        ("clean", F.lit(True), en, tl, back, ids, no),
        ("omission", F.coalesce("critical", no), en, tl, back, ids, F.lit(True)),
        ("flip_stop_to_keep", halted, keep, tl, read_back(keep), ids, no),
        ("translation_flip", halted & tl.isNotNull(), en, tl, F.concat(F.lit("Keep taking "), drug, F.lit(".")), ids, no),
        ("hold_as_permanent_stop", named & (action == "hold"), stop, tl, read_back(stop), ids, no),
        ("number_changed", bumped(en).isNotNull(), bumped(en), F.coalesce(bumped(tl), tl), F.coalesce(bumped(back), back), ids, no),
        ("translation_number_changed", bumped(tl).isNotNull(), en, bumped(tl), back, ids, no),
        ("emergency_number_dropped", en.rlike(r"\b(?:911|999|112)\b"), dial(en), F.regexp_replace(tl, r"\b(?:911|999|112)\b", ""), dial(back), ids, no),
        ("as_needed_dropped", en.rlike(r"(?i)only if|as needed|if needed"), always(en), tl, always(back), ids, no),
        ("hallucinated_medicine", F.lit(True), F.concat(en, F.lit(INVENTED)), tl, F.concat(back, F.lit(INVENTED)), ids, no),
        ("unsupported_sentence", F.lit(True), en, tl, back, none, no),
        ("contact_lost_in_translation", F.contains(tl, F.lit("[")), en, F.regexp_replace(tl, r"\[[A-Z_]+_\d+\]", ""), back, ids, no),
        ("wrong_medicine_named", named & other_drug.isNotNull(), swapped(en), swapped(tl), swapped(back), ids, no),
        ("other_unit", en.rlike(r"\d m[gl]\b"), F.when(en.rlike(r"\d mg\b"), F.regexp_replace(en, r"(\d) mg\b", "$1 ml")).otherwise(F.regexp_replace(en, r"(\d) ml\b", "$1 mg")), tl, back, ids, no),
    ]
    made = F.array(*(F.when(F.coalesce(where, no), F.struct(F.lit(k).alias("mutation"), e.alias("text_en"), t.alias("text_tl"), b.alias("back_en"), i.alias("fact_ids"), gone.alias("removed"))) for k, where, e, t, b, i, gone in kinds))
    rest = [c for c in sentences.columns if c not in ("text_en", "text_tl", "back_en", "fact_ids", "critical", "removed")]
    return sentences.select(*rest, F.explode(F.array_compact(made)).alias("m")).select(*rest, "m.*")


def outcomes(runs: DataFrame, signals: DataFrame, omissions: DataFrame, keys: list[str]) -> DataFrame:
    """runs (keys, needs_review) with `outcome`: blocked (a new check fails, or something new is missing), flagged (a new check warns), in review
    (only because it is reviewed anyway) or slipped. signals: rollup.new_signals; omissions: keys of what is missing in the run alone."""
    found = signals.groupBy(*keys).agg(F.max(F.col("status") == "fail").alias("hard"), F.lit(True).alias("some"))
    rows = runs.join(found, keys, "left").join(omissions.select(*keys, F.lit(True).alias("missing")).distinct(), keys, "left")
    outcome = F.when(F.coalesce("hard", F.lit(False)) | F.coalesce("missing", F.lit(False)), "blocked").when(F.coalesce("some", F.lit(False)), "flagged").when(F.col("needs_review"), "in review").otherwise("slipped")
    return rows.withColumn("outcome", outcome).drop("hard", "some", "missing")


def variant(base: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """base with the fields that patches (keys, fields, drop) give: a null field stays as it is, a dropped row goes, a row that base lacks is added."""
    fields = [c for c in base.columns if c not in keys]
    theirs = patches.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields if c in patches.columns), F.coalesce("drop", F.lit(False)).alias("_drop"))
    rows = base.join(theirs, keys, "full").filter(~F.coalesce("_drop", F.lit(False)))
    return rows.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) if c in patches.columns else F.col(c) for c in fields))


def matrix(caught: DataFrame) -> DataFrame:
    """caught: mutation, flagged, blocked and, where a row stands for several, n. Totals by error and over all of them (mutation 'all')."""
    n = F.col("n") if "n" in caught.columns else F.lit(1).cast("long")
    of = lambda name: F.coalesce(F.sum(F.when(F.col(name), n)), F.lit(0).cast("long")).alias(name)
    sums = caught.rollup("mutation").agg(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("total"), of("flagged"), of("blocked"))
    return sums.select(F.coalesce("mutation", F.lit("all")).alias("mutation"), "total", "flagged", "blocked")
