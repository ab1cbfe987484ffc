"""Questions that show whether the reader has understood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.dims import DEFAULT, Lexicon
from ..functions.quiz_texts import QUIZ, WRONG_BY_ACTION, WRONG_OTHERWISE

#: Questions of a case, and the kinds they are about in order.
MOST, KIND_ORDER = 4, ["medication", "warning_sign", "follow_up"]


def candidates(facts: DataFrame, sentences: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """case_id, fact_id, kind, sent_id: the critical facts (drug) at high risk (or to follow up), each with the first live sentence that cites it.

    Of a medicine that is the first one that names it, by any of its names, if one does. Sentences (text_en, pos) with a true `removed` are none; a null or missing one is live.
    """
    first_word = F.lower(F.regexp_extract(F.coalesce("drug", F.lit("")), r"\S+", 0))
    wanted = facts.filter(F.col("kind").isin(*KIND_ORDER) & ((F.col("risk") == "high") | (F.col("kind") == "follow_up")))
    drug = F.when(F.col("kind") == "medication", lex.canonical_drug(first_word, lexicon))
    wanted = wanted.select("case_id", "fact_id", F.struct("kind", drug.alias("drug")).alias("_wanted"))
    live = sentences.filter(~F.coalesce("removed", F.lit(False))) if "removed" in sentences.columns else sentences
    said = live.select("case_id", "pos", "sent_id", lex.drugs_in(F.col("text_en"), lexicon).alias("named"), "fact_ids")
    said = said.select("case_id", F.struct("pos", "sent_id", "named").alias("_said"), F.explode("fact_ids").alias("fact_id"))
    # Facts and what cites them meet once, by case, which all that follows goes by too.
    both = wanted.unionByName(said, allowMissingColumns=True).filter("case_id is not null and fact_id is not null").repartition("case_id")
    both = both.groupBy("case_id", "fact_id").agg(F.collect_set("_wanted").alias("_wanted"), F.collect_list("_said").alias("_said"))
    rows = both.filter("size(_said) > 0").select("case_id", "fact_id", "_said", F.explode("_wanted").alias("_w"))
    silent = lambda x: ~F.coalesce(F.array_contains(x["named"], F.col("_w.drug")), F.lit(False))
    first = F.array_min(F.transform("_said", lambda x: F.struct(silent(x).alias("silent"), x["pos"].alias("pos"), x["sent_id"].alias("sent_id"))))
    rows = rows.select("case_id", "fact_id", F.col("_w.kind").alias("kind"), first.alias("first"))
    return rows.groupBy("case_id", "fact_id", "kind").agg(F.min("first")["sent_id"].alias("sent_id"))


def pick(found: DataFrame, most: int = MOST) -> DataFrame:
    """case_id, q_id, fact_id, kind, sent_id: of each sentence its first candidate, by kind, then the fact's id as text; at most `most` of a case."""
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    order = [rank, F.col("fact_id")]
    rows = found.withColumn("_n", F.row_number().over(Window.partitionBy("case_id", "sent_id").orderBy(*order))).filter("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).filter(F.col("_n") <= most)
    return rows.select("case_id", F.concat(F.lit("Q"), F.col("_n").cast("string")).alias("q_id"), "fact_id", "kind", "sent_id")


def shuffled(options: DataFrame, keys: list[Column], option: Column) -> DataFrame:
    """options with `place`: an order that is the same in every run, by a digest of the question and the option."""
    digest = F.sha2(F.concat_ws("|", *keys, option).cast("binary"), 256)
    return options.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(digest)))


def built(facts: DataFrame, sentences: DataFrame, most: int = MOST, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """case_id, q_id, fact_id, sent_id, question, options (array of text, correct): the quiz of each case, from its approved sentences and fixed wrong answers.

    facts have the case's language, drug and med_action, sentences text_en and text_tl. The right answer is the sentence as the reader sees it: its translation where
    there is one. Of three wrong answers about warnings two are taken; which ones, and the order of options, is told by a digest of case, fact and option.
    An unknown language is English.
    """
    rows = pick(candidates(facts, sentences, lexicon), most)
    rows = rows.join(facts.select("case_id", "fact_id", "language", "drug", "med_action"), ["case_id", "fact_id"]).join(sentences.select("case_id", "sent_id", "text_en", "text_tl"), ["case_id", "sent_id"])
    lang = F.when(F.col("language").isin(*QUIZ), F.col("language")).otherwise("en")
    drug = F.lower(F.regexp_extract(F.coalesce("drug", F.lit("")), r"\S+", 0))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in zip(KIND_ORDER, ("med", "warn", "appt"), strict=True) for x in pair)), F.col("kind"))
    texts = lambda values: F.array(*map(F.lit, values))

    def of(values: dict[str, Column], key: Column) -> Column:
        return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), key)

    questions = of({f"{l}|{k}": F.lit(t[f"{k}_q"]) for l, t in QUIZ.items() for k in ("med", "warn", "appt")}, F.concat_ws("|", lang, kind))
    by_action = WRONG_BY_ACTION | {"": WRONG_OTHERWISE}
    action = F.when(F.col("med_action").isin(*WRONG_BY_ACTION), F.col("med_action")).otherwise("")
    of_medicine = of({f"{l}|{a}": texts(t["med_wrong"][k] for k in keys) for l, t in QUIZ.items() for a, keys in by_action.items()}, F.concat_ws("|", lang, action))
    of_others = of({f"{l}|{k}": texts(t[f"{k}_wrong"]) for l, t in QUIZ.items() for k in ("warn", "appt")}, F.concat_ws("|", lang, kind))
    digest = lambda text: F.sha2(F.concat_ws("|", "case_id", "fact_id", text).cast("binary"), 256)
    mixed = lambda options: F.transform(F.array_sort(F.transform(options, lambda o: F.struct(digest(o["text"]).alias("d"), o.alias("o")))), lambda x: x["o"])
    put = lambda text: F.replace(text, F.lit("{drug}"), drug)
    option = lambda text, correct: F.struct(text.alias("text"), F.lit(correct).alias("correct"))
    wrong = F.transform(F.when(F.col("kind") == "medication", F.transform(of_medicine, put)).otherwise(of_others), lambda w: option(w, False))
    shown = F.when(lang == "en", F.col("text_en")).otherwise(F.coalesce(F.nullif("text_tl", F.lit("")), "text_en"))
    rows = rows.select("case_id", "q_id", "fact_id", "sent_id", put(questions).alias("question"), option(shown, True).alias("_right"), F.slice(mixed(wrong), 1, 2).alias("_wrong"))
    return rows.withColumn("options", mixed(F.array_append("_wrong", F.col("_right")))).drop("_right", "_wrong")
