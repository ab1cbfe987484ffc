"""Rechecking after reviewers' work: only the sentences and facts that a batch of events touches are checked again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import DEFAULT, Lexicon
from ..functions.text import let, spell_dates
from ..sources.stores import stored as kept
from . import coverage, rollup
from . import sentences as said
from .facts import stripped

KEY = ["case_id", "sent_id"]
#: What a review changes of a sentence. translated: whether its case has translations; verdict: the model's, null where there is none (any more).
STATE = "text_en string, text_tl string, fact_ids array<string>, back_en string, verdict string, tl_stale boolean, removed boolean, review string, changed boolean"
_NAMES = [x.split()[0] for x in STATE.split(", ")]
_STRUCT = "struct<" + ", ".join(x.replace(" ", ":", 1) for x in STATE.split(", ")) + ">"


@dataclass
class Checked:
    """sentences: KEY, translated, judged, STATE without changed, and status, risk, needs_review; checks: KEY, seq, name, status; omissions: case_id, fact_id, rule."""

    sentences: DataFrame
    checks: DataFrame
    omissions: DataFrame


def _step(translated: Column) -> Callable[[Column, Column], Column]:
    def step(acc: Column, e: Column) -> Column:
        def edited(texts: Column) -> Column:
            en, tl = texts["en"], texts["tl"]
            ids = F.coalesce(e["fact_ids"], acc["fact_ids"])
            new_en, new_tl = ~en.eqNullSafe(acc["text_en"]), ~tl.eqNullSafe(acc["text_tl"])
            stale = F.when(translated & new_en & ~new_tl, F.lit(True)).when(translated & new_tl, F.lit(False)).otherwise(acc["tl_stale"])
            row = F.struct(en, tl, ids, F.when(translated, F.lit("")).otherwise(acc["back_en"]), F.lit(None).cast("string"), stale, acc["removed"], F.lit("edited"), F.lit(True)).cast(_STRUCT)
            return F.when(new_en | new_tl | ~ids.eqNullSafe(acc["fact_ids"]), row).otherwise(acc)

        texts = F.struct(F.coalesce(spell_dates(F.when(e["text_en"].isNotNull(), stripped(e["text_en"]))), acc["text_en"]).alias("en"), F.when(translated, F.coalesce(stripped(e["text_tl"]), acc["text_tl"])).otherwise(acc["text_tl"]).alias("tl"))
        texts = F.struct(F.when(e["text_en"].isNotNull(), texts["en"]).otherwise(acc["text_en"]).alias("en"), texts["tl"].alias("tl"))
        return (
            F.when(e["action"] == "edit", let(texts, edited))
            .when(e["action"] == "approve", acc.withField("review", F.lit("approved")))
            .when(e["action"] == "remove", acc.withField("removed", F.lit(True)))
            .otherwise(acc)
        )

    return step


def folded(sentences: DataFrame, events: DataFrame) -> DataFrame:
    """The sentences that events (KEY, at, action, text_en, text_tl, fact_ids) touch, after them: STATE as it then is, `before` (review as it was)
    and `old_ids`. An edit that changes nothing is none; one that does clears back-translation and verdict, and English edited alone makes the
    translation stale. Whether an approval holds is known when the sentence has been checked.
    """
    steps = events.filter("sent_id is not null").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "action", "text_en", "text_tl", "fact_ids"))).alias("_events"))
    # A case's events are met by case, so that sentences which are there by case aren't shuffled.
    steps = steps.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("sent_id", "_events"))).alias("_steps"))
    rows = sentences.join(steps.hint("merge"), "case_id").withColumn("_events", F.try_element_at("_steps", F.col("sent_id"))).filter("_events is not null").drop("_steps")
    start = F.struct(*(F.col(n) for n in _NAMES[:-1]), F.lit(False).alias("changed")).cast(_STRUCT)
    rows = rows.withColumn("_state", F.aggregate("_events", start, _step(F.col("translated"))))
    kept = [c for c in sentences.columns if c not in _NAMES]
    return rows.select(*kept, F.col("review").alias("before"), F.col("fact_ids").alias("old_ids"), F.col("removed").alias("was_removed"), "_state.*")


def checks_of(sentences: DataFrame, facts: DataFrame, languages: list[str] | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """KEY, seq, name, status, risk of live sentences: all checks, those of translations for the languages (sentences need `language` then)."""
    rows = kept(said.checked(sentences, facts, lexicon))
    found = rows.select(*KEY, F.explode("checks").alias("c")).select(*KEY, "c.*")
    one = lambda of, seq, name, status: of.select(*KEY, F.lit(seq).alias("seq"), F.lit(name).alias("name"), status.alias("status")).filter("status is not null")
    found = found.unionByName(one(rows.filter("tl_stale"), 100, "translation_stale", F.lit("fail")))
    found = found.unionByName(one(rows.filter("judged"), 300, "model_check", said.model_check(F.col("verdict"), F.col("review").isNotNull())))
    for lang in languages or ():
        mine = said.translation_checks(rows.filter(F.col("language") == lang), lang, lexicon)
        found = found.unionByName(mine.withColumn("seq", F.col("seq") + 200))
    return found.join(rows.select(*KEY, "risk"), KEY, "right").select(*KEY, "seq", "name", "status", "risk")


def _judged(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """rows with status, risk and needs_review of their checks (with risk); what has been approved and isn't red needs no review."""
    worst = checks.groupBy(*KEY).agg(rollup.severity(F.col("status")).alias("status"), F.first("risk").alias("risk"))
    out = rows.drop("status", "risk", "needs_review").join(worst, KEY)
    approved = (F.col("review") == "approved") & (F.col("status") != "red")
    return out.withColumn("needs_review", ((F.col("status") != "green") | (F.col("risk") == "high")) & ~F.coalesce(approved, F.lit(False)))


def full(sentences: DataFrame, facts: DataFrame, languages: list[str] | None = None, lexicon: Lexicon = DEFAULT) -> Checked:
    """Everything checked: sentences with translated, judged and STATE; removed ones keep null in status, risk and needs_review."""
    live = sentences.filter("not removed")
    checks = checks_of(live, facts, languages, lexicon)
    done = _judged(live, checks).unionByName(sentences.filter("removed").drop("status", "risk", "needs_review"), allowMissingColumns=True)
    return Checked(done, checks.filter("name is not null").drop("risk"), coverage.omissions(facts, live, lexicon))


def _of_case(rows: DataFrame, name: str) -> DataFrame:
    """case_id, _ids: each case's values of a column, to be met by case alone: what is there by case isn't shuffled."""
    return rows.filter(F.col(name).isNotNull()).groupBy("case_id").agg(F.collect_set(name).alias("_ids")).hint("merge")


def _among(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """As a left semi join on case_id and the column whose values _of_case() has; where that column is an array, on any of it."""
    met = F.arrays_overlap if df.schema[name].dataType.typeName() == "array" else lambda values, ids: F.array_contains(ids, values)
    return df.join(ids, "case_id").filter(met(F.col(name), F.col("_ids"))).drop("_ids")


def _not_among(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """As a left anti join on case_id and the column whose values _of_case() has."""
    there = F.coalesce(F.array_contains("_ids", F.col(name)), F.lit(False))
    return df.join(ids, "case_id", "left").filter(~there).drop("_ids")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recheck(stored: Checked, facts: DataFrame, events: DataFrame, folder: str, languages: list[str] | None = None, lexicon: Lexicon = DEFAULT) -> Checked:
    """stored after a batch of events, equal to folding them and checking everything again.

    folder: where the touched sentences and their new checks are written, one of its own for each batch, which driver and executors share.

    Texts are read of the sentences that an edit changes, with the facts of their cases; coverage of the facts that those or removed sentences
    cite, or cited before, with the sentences that cite them. All else is taken over by anti-joins. An approval holds unless its sentence is red then.
    """
    touched = _kept(folded(stored.sentences, events), f"{folder}/touched")
    gone = F.col("removed") & ~F.col("was_removed")
    dirty = touched.filter(F.col("changed") & ~F.col("removed"))
    own = facts.join(dirty.select("case_id").distinct(), "case_id", "left_semi")
    fresh = _kept(checks_of(dirty, own, languages, lexicon), f"{folder}/checks")
    columns = stored.sentences.columns
    anew = _judged(dirty.drop("status", "risk", "needs_review"), fresh)
    same = touched.filter(~F.col("changed") | F.col("removed"))
    status = {c: F.when(~F.col("removed"), F.col(c)) for c in ("status", "risk", "needs_review")}
    after = anew.unionByName(same.withColumns(status))
    # A red sentence can't be approved: its review is what it was, or the edit that came before.
    refused = (F.col("review") == "approved") & (F.col("status") == "red")
    earlier = F.when(F.col("changed"), F.lit("edited")).otherwise(F.col("before"))
    after = after.withColumn("review", F.when(refused, earlier).otherwise(F.col("review")))
    after = after.withColumn("needs_review", F.when((F.col("review") == "approved") & (F.col("status") != "red"), F.lit(False)).otherwise(F.col("needs_review")))
    rest, after = _not_among(stored.sentences, _of_case(events, "sent_id"), "sent_id"), after.select(*columns)
    merged = rest.unionByName(after)
    moved = touched.filter(F.col("changed") | gone)
    checks = stored.checks.join(moved.select(*KEY), KEY, "left_anti").unionByName(fresh.filter("name is not null").drop("risk"))
    cited = _of_case(moved.select("case_id", F.explode(F.array_union("old_ids", "fact_ids")).alias("fact_id")), "fact_id")
    citing = _among(rest.filter("not removed"), cited, "fact_ids").unionByName(_among(after.filter("not removed"), cited, "fact_ids"))
    again = coverage.omissions(_among(facts, cited, "fact_id"), citing, lexicon)
    return Checked(merged, checks, _not_among(stored.omissions, cited, "fact_id").unionByName(again))
