"""Facts that matter and that no sentence tells the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as tx
from ..functions.dims import CRITICAL_KINDS, DEFAULT, Lexicon
from ..sources.stores import stored, together
from .facts import features, key_of, saying


def omissions(facts: DataFrame, sentences: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """case_id, fact_id, rule: at most two for a fact, of what its citing sentences leave out. Dismissed facts and removed sentences don't count.

    facts may have must_cover and dismissed, sentences removed (boolean).
    """
    for df_name, name in (("facts", "must_cover"), ("facts", "dismissed"), ("sentences", "removed")):
        if df_name == "facts" and name not in facts.columns:
            facts = facts.withColumn(name, F.lit(False))
        if df_name == "sentences" and name not in sentences.columns:
            sentences = sentences.withColumn(name, F.lit(False))
    no = F.lit(False)
    wanted = facts.filter((F.col("kind").isin(*CRITICAL_KINDS) | F.coalesce("must_cover", no)) & ~F.coalesce("dismissed", no))
    # A fact meets the texts that cite it as they are; facts that say the same and are cited by the same texts are judged once.
    said = sentences.filter(~F.coalesce("removed", no)).select("case_id", F.explode("fact_ids").alias("fact_id"), F.coalesce("text_en", F.lit("")).alias("_text"))
    both = together("case_id", wanted.filter("case_id is not null and fact_id is not null").select("case_id", "fact_id", saying(wanted).alias("_fact")), said)
    met = both.groupBy("case_id", "fact_id").agg(F.collect_list("_fact").alias("_facts"), F.array_sort(F.collect_set("_text")).alias("_texts")).filter(F.size("_facts") > 0)
    met = met.select("case_id", "fact_id", F.explode("_facts").alias("_fact"), "_texts").withColumn("_key", key_of(F.col("_fact"), F.col("_texts")))
    cases = stored(met.select("_key", "_fact", "_texts").distinct())
    t = F.col("_text")
    clock = F.transform(tx.times_in(t), lambda x: F.concat_ws(":", x["hour"], x["minute"]))
    days = F.transform(tx.dates_in(t), lambda x: F.concat_ws("/", x["month"], x["day"]))
    citing = cases.select("_key", F.explode("_texts").alias("_text"))
    texts = citing.select("_text").distinct().select(
        "_text",
        F.struct(
            tx.numbers_in(t).alias("numbers"), lex.placeholders_in(t).alias("tokens"), lex.drugs_in(t, lexicon).alias("drugs"),
            lex.has_cue(t, "en", "prn").alias("prn"), lex.polarity(t).alias("p"), days.alias("days"), clock.alias("clock"),
        ).alias("s"),
    )
    read = citing.join(texts, "_text").groupBy("_key").agg(F.collect_set("s").alias("said"))
    known = features(cases.select(key_of(F.col("_fact")).alias("_said"), "_fact").distinct().select("_said", "_fact.*"), lexicon)
    rows = cases.select("_key", key_of(F.col("_fact")).alias("_said")).join(known, "_said").join(read, "_key", "left")
    every = lambda name: F.array_distinct(F.flatten(F.transform("said", lambda s: s[name])))
    lost = lambda need, name: F.size(F.array_except(F.col(f"need_{need}"), every(name))) > 0
    action, kind, canon = F.col("med_action"), F.col("kind"), F.col("canon")
    told = F.col("said").isNotNull()
    taken = (kind == "medication") & action.isin("new", "changed", "continue")
    naming = F.filter("said", lambda s: F.array_contains(s["drugs"], canon))
    by_kind = (
        F.when(~told, "not_explained")
        .when(taken & lost("dose", "numbers"), "dose_never_stated")
        .when(taken & lost("numbers", "numbers"), "numbers_never_stated")
        .when((kind == "follow_up") & (lost("days", "days") | lost("clock", "clock")), "appointment_never_stated")
        .when((kind == "warning_sign") & (lost("limits", "numbers") | lost("tokens", "tokens")), "threshold_never_stated")
    )
    by_name = F.when(
        told & (kind == "medication") & canon.isNotNull(),
        F.when(F.size(naming) == 0, "never_named")
        .when(F.col("prn") & ~F.coalesce(action.isin("stop", "hold"), no) & ~F.exists(naming, lambda s: s["prn"]), "as_needed_not_told")
        .when(action.isin("stop", "hold") & ~F.exists(naming, lambda s: s["p"]["stop"] & ~s["p"]["continue"]), "stop_not_clear"),
    )
    # Stored, so that it is known how few they are: facts stay by case.
    rules = stored(rows.select("_key", F.explode(F.array_compact(F.array(by_kind, by_name))).alias("rule")))
    return met.select("case_id", "fact_id", "_key").join(rules, "_key").select("case_id", "fact_id", "rule")
