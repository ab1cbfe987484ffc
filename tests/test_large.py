"""Texts written from keys are dealt out, stay off the driver, and are read once where they are alike."""

import pytest
from pyspark.sql import functions as F

from textwarden.functions import masking
from textwarden.operators import coverage, mutation, quiz, recheck, sentences
from textwarden.plans import inputs, languages, workflow
from textwarden.plans.registry import CORES, rows_of, spread

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def twice(spark, tmp_path):
    """Each part twice, under a key whose texts are those of the first."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.unionAll(part.withColumn("p_partkey", F.col("p_partkey") + 2520 * len(languages.TRANSLATIONS))).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_texts_from_keys_are_dealt_out_and_not_sent_through_the_driver(spark):
    rows = rows_of(spark, SF, "SELECT p_partkey, concat('text of ', p_partkey) AS t FROM part", "part")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert "Broadcast" not in plan(rows.join(rows.groupBy("p_partkey").agg(F.max("t").alias("u")), "p_partkey"))


def test_cases_that_are_alike_get_errors_once(spark, twice, monkeypatch):
    def mutants(said, other):
        raise Seen(said.count())

    monkeypatch.setattr(mutation, "mutants", mutants)
    with pytest.raises(Seen) as found:
        workflow.mutation_kinds(spark, twice)
    assert found.value.args[0] <= 200


def test_words_of_instructions_are_not_sent_through_the_driver(spark):
    assert "Broadcast" not in plan(workflow.uncovered_instructions(spark, SF))


def test_quizzes_are_not_sent_through_the_driver(spark):
    assert "Broadcast" not in plan(workflow.quiz_questions(spark, SF))


def test_facts_and_sentences_of_quizzes_are_shuffled_once(spark):
    own = spark.createDataFrame([("c", "F1", "medication", "high", "Warfarin 5"), ("c", "F2", "medication", "normal", "x"), (None, "F1", "medication", "high", "x"), ("c", None, "follow_up", "high", None)], "case_id string, fact_id string, kind string, risk string, drug string")
    said = spark.createDataFrame([("c", "S1", 1, "Read this.", ["F1", "F2", None]), ("c", "S2", 2, "Take warfarin.", ["F1", "F1"]), (None, "S1", 1, "Take x.", ["F1"]), ("d", "S1", 1, "Take x.", ["F1"])], "case_id string, sent_id string, pos int, text_en string, fact_ids array<string>")
    found = quiz.pick(quiz.candidates(own, said))
    options = quiz.shuffled(found.select("case_id", "fact_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("opt")), [F.col("case_id"), F.col("fact_id")], F.col("opt"))
    assert plan(options).count("Exchange") == 1
    assert [tuple(r) for r in found.collect()] == [("c", "Q1", "F1", "medication", "S2")]


def test_medicines_are_not_sent_through_the_driver(spark):
    assert "Broadcast" not in plan(workflow.med_cross_check(spark, SF))


@pytest.mark.parametrize("name", ["review_totals", "check_sets", "sentence_meaning_checks", "caught_bars"])
def test_sentences_that_are_alike_are_read_once(spark, twice, monkeypatch, name):
    def read(readings, *_):
        raise Seen(readings.count())

    monkeypatch.setattr(sentences, "read", read)
    with pytest.raises(Seen) as found:
        getattr(workflow, name)(spark, twice)
    assert found.value.args[0] <= 200


def test_translations_that_are_alike_are_read_once(spark, twice, monkeypatch):
    def checks(rows, *_):
        raise Seen(rows.count())

    monkeypatch.setattr(sentences, "translation_checks", checks)
    with pytest.raises(Seen) as found:
        languages.translation_checks(spark, twice)
    spanish = [k for k, t in enumerate(languages.TRANSLATIONS) if t[0] == "es"]
    assert found.value.args[0] <= spark.read.parquet(f"{SF}/part.parquet").filter((F.col("p_partkey") % len(languages.TRANSLATIONS)).isin(spanish)).count()


def test_customers_are_dealt_out(spark):
    assert workflow.reviewer_names(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_names_that_are_typed_alike_are_cleaned_once(spark, monkeypatch):
    """Ten thousand rows of three names, one of them null; what is given to clean_name is counted as it runs."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        read.add(1)
        return name

    clean = masking.clean_name
    monkeypatch.setattr(masking, "clean_name", lambda name: clean(seen(name)))
    monkeypatch.setattr(workflow, "rows_of", lambda *_: spark.range(10_000).selectExpr("id as c_custkey", "element_at(array('A\u0301 b', 'x', null), cast(id % 3 + 1 as int)) as typed"))
    rows = workflow.reviewer_names(spark, SF).groupBy("name", "is_real").count().collect()
    assert sorted(map(tuple, rows)) == [("", False, 3333), ("x", False, 3333), ("\u00c1 b", True, 3334)] and read.value <= 6


def test_documents_are_dealt_out_before_executors_have_come(spark):
    assert spread(spark.read.parquet(f"{SF}/documents.parquet")).rdd.getNumPartitions() >= 4 * CORES


def test_sentences_and_facts_that_are_there_by_case_are_not_shuffled(spark):
    lines = inputs.lines_by_case(spark, SF)
    own, said = inputs.facts_of_cases(spark, SF, lines=lines), inputs.sentences(spark, SF, lines)
    rows = said.select("case_id", "sent_id", "text_en", "fact_ids")
    assert "Exchange hashpartitioning" not in plan(sentences.met(rows, own))
    assert "Exchange hashpartitioning" not in plan(sentences.checked(rows, own, buckets=inputs.buckets_of(spark, SF)).groupBy("case_id").count())
    assert "Exchange hashpartitioning" not in plan(coverage.omissions(own, said))


def test_sentences_and_facts_by_case_are_those_of_the_tables(spark):
    lines = inputs.lines_by_case(spark, SF)
    for by_case, plain in ((inputs.sentences(spark, SF, lines), inputs.sentences(spark, SF)), (inputs.facts_of_cases(spark, SF, lines=lines), inputs.facts_of_cases(spark, SF))):
        by_case = by_case.select(*plain.columns)
        assert by_case.count() == plain.count() and by_case.exceptAll(plain).isEmpty()


def test_events_meet_sentences_without_a_shuffle_of_those(spark):
    lines = inputs.lines_by_case(spark, SF)
    events = inputs.sentences(spark, SF, lines).filter("case_id % 10 = 0").select("case_id", "sent_id")
    said = inputs.sentences(spark, SF, lines)
    assert "Exchange" not in plan(recheck._not_among(said, recheck._of_case(events, "sent_id"), "sent_id"))
    assert "Exchange" not in plan(recheck._among(said, recheck._of_case(events, "sent_id"), "sent_id"))
    # A case, an id or ids that are null are among none.
    rows = spark.createDataFrame([(1, "a", ["x", None]), (1, "b", ["y"]), (1, None, None), (None, "a", ["x"]), (2, "a", ["x"])], "case_id int, sent_id string, ids array<string>")
    ids = recheck._of_case(spark.createDataFrame([(1, "a"), (1, "x"), (1, None), (None, "a")], "case_id int, sent_id string"), "sent_id")
    assert [tuple(r) for r in recheck._among(rows, ids, "ids").select("case_id", "sent_id").collect()] == [(1, "a")]
    assert sorted(map(str, (tuple(r) for r in recheck._not_among(rows, ids, "sent_id").select("case_id", "sent_id").collect()))) == sorted(map(str, [(1, "b"), (1, None), (None, "a"), (2, "a")]))
