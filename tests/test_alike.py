"""What is alike in text and cited facts is read once, with the results of reading each sentence."""

from pyspark.sql import functions as F

from textwarden.operators import coverage, rollup, sentences
from textwarden.plans import inputs

FACT = "case_id int, fact_id string, kind string, med_action string, drug string, dose string, frequency string, detail string, source_quote string"
WARFARIN = ("medication", "continue", "warfarin", "3 mg", "daily", "", "CONTINUE: warfarin 3 mg daily")
INSULIN = ("medication", "stop", "insulin", None, None, "", "STOP: insulin")


def made(spark):
    facts = [(c, f"F{i}", *fact) for c in (1, 2, 3) for i, fact in ((1, WARFARIN), (2, INSULIN)) if (c, i) != (3, 2)]
    texts = [("Keep taking warfarin 3 mg.", ["F1"]), ("Keep taking warfarin 30 mg.", ["F1"]), ("Take warfarin 3 mg and insulin.", ["F1"]), ("Take insulin.", []), ("Take insulin.", None), ("Stop.", ["F9"]), ("Keep taking insulin.", ["F2", "F1", "F2"]), (None, ["F1", None]), ("Take warfarin.", ["F2"])]
    rows = [(c, f"S{i}", text, ids) for c in (1, 2, 3) for i, (text, ids) in enumerate(texts)]
    return spark.createDataFrame(rows, "case_id int, sent_id string, text_en string, fact_ids array<string>"), spark.createDataFrame(facts, FACT)


def test_alike_sentences_have_the_checks_of_each_read_alone(spark):
    said, facts = made(spark)
    plain = sentences.with_cited(said, facts)
    want = {tuple(r) for r in sentences.sentence_checks(plain).select("case_id", "sent_id", "name", "status").collect()}
    rows = sentences.checked(said, facts)
    assert {tuple(r) for r in rows.select("case_id", "sent_id", F.explode("checks").alias("c")).select("case_id", "sent_id", "c.name", "c.status").collect()} == want
    assert rows.count() == said.count()
    # Whether a strange medicine is elsewhere in its case tells sentences apart that are alike otherwise.
    assert {(1, "S2", "drug", "warn"), (3, "S2", "drug", "fail")} <= want or {(1, "S3", "drug", "warn"), (3, "S3", "drug", "fail")} <= want
    one = sentences.checked(said, facts, only=["drug"]).select("case_id", "sent_id", F.explode("checks").alias("c")).select("case_id", "sent_id", "c.name", "c.status")
    assert {tuple(r) for r in one.collect()} == {r for r in want if r[2] == "drug"}


def test_errors_are_put_once_into_alike_sentences(spark):
    said, facts = made(spark)
    rows = rollup.with_status(sentences.alike(said, facts, lambda of: of)).collect()
    each = rollup.with_status(sentences.checked(said, facts)).collect()
    assert sum(r.n for r in rows) == len(each) and len(rows) < len(each)
    assert {s: sum(r.n for r in rows if r.status == s) for s in ("green", "amber", "red")} == {s: sum(r.status == s for r in each) for s in ("green", "amber", "red")}


def test_facts_of_cases_stay_narrow_and_what_is_missing_is_found(spark):
    assert not {"need_dose", "quote_polarity"} & set(inputs.facts_of_cases(spark, "/root/testdata/sf0.001").columns)
    said, facts = made(spark)
    found = {tuple(r) for r in coverage.omissions(facts, said.filter("sent_id in ('S0', 'S6')")).collect()}
    assert {(c, "F2", "stop_not_clear") for c in (1, 2)} <= found and not {r for r in found if r[2] == "not_explained"}
