"""The released packet: live sentences of a case by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masking


def sections(sentences: DataFrame) -> DataFrame:
    """case_id, section, n, body: texts of a section in order, one space between them."""
    turn = F.array_sort(F.collect_list(F.struct("pos", "text_en")))
    return sentences.groupBy("case_id", "section").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(turn, lambda s: s["text_en"]), " ").alias("body"))


def released(sentences: DataFrame, mappings: DataFrame, allowed: DataFrame) -> DataFrame:
    """The sections of released cases with the masked values put back (mappings: case_id, mapping)."""
    rows = sentences.join(allowed.select("case_id"), "case_id", "left_semi").join(mappings, "case_id", "left")
    text = F.when(F.col("mapping").isNull(), F.col("text_en")).otherwise(masking.unmask(F.col("text_en"), F.col("mapping")))
    return sections(rows.withColumn("text_en", text))


def lines(sentences: DataFrame, facts: DataFrame, mappings: DataFrame, allowed: DataFrame) -> DataFrame:
    """case_id, section, pos, sent_id, text_en, text_tl, risk, med_action: live sentences of the allowed cases as their reader sees them.

    Masked values are put back; an empty translation is null; med_action is that of the first cited fact that has one. Cases without a mapping keep their text.
    """
    some = sentences.filter(~F.coalesce("removed", F.lit(False))).join(allowed.select("case_id").distinct(), "case_id", "left_semi")
    cited = some.select("case_id", "sent_id", F.posexplode("fact_ids").alias("_at", "fact_id"))
    own = facts.filter(F.coalesce("med_action", F.lit("")) != "").select("case_id", "fact_id", "med_action")
    actions = cited.join(own, ["case_id", "fact_id"]).groupBy("case_id", "sent_id").agg(F.min_by("med_action", F.struct("_at", "med_action")).alias("med_action"))
    rows = some.join(actions, ["case_id", "sent_id"], "left").join(mappings.select("case_id", "mapping"), "case_id", "left")
    back = lambda text: F.when(F.col("mapping").isNull(), F.col(text)).otherwise(masking.unmask(F.col(text), F.col("mapping")))
    return rows.select("case_id", "section", "pos", "sent_id", back("text_en").alias("text_en"), F.nullif(back("text_tl"), F.lit("")).alias("text_tl"), "risk", "med_action")


def without_answers(quiz: DataFrame, mappings: DataFrame) -> DataFrame:
    """The quiz as it is handed out: options' texts alone, masked values put back."""
    rows = quiz.join(mappings.select("case_id", "mapping"), "case_id", "left")
    back = lambda t: F.when(F.col("mapping").isNull(), t).otherwise(masking.unmask(t, F.col("mapping")))
    return rows.withColumn("options", F.transform("options", lambda o: back(o["text"]))).drop("mapping")


#: The order in which a reader sees medicines, by what to do with them.
ACTION_ORDER = ["stop", "hold", "changed", "new", "continue", "other"]


def by_action(rows: DataFrame) -> DataFrame:
    """rows (med_action) with `action`, 'other' where there is none that is known, and its `place` in the order of display."""
    action = F.when(F.col("med_action").isin(*ACTION_ORDER), F.col("med_action")).otherwise("other")
    out = rows.withColumn("action", action)
    return out.withColumn("place", F.array_position(F.array(*map(F.lit, ACTION_ORDER)), F.col("action")).cast("int"))


def is_emergency(text: Column) -> Column:
    """Whether a warning tells its reader to call or go at once."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)\b(?:911|999|112|emergency)\b")
