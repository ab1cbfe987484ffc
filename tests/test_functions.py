import pytest
from pyspark.sql import functions as F

from textwarden.functions import lexicon as lex
from textwarden.functions import masking
from textwarden.functions import text as tx
from textwarden.functions.fuzzy import near


def value(spark, column, text, schema="t string"):
    return spark.createDataFrame([(text,)], schema).select(column.alias("v")).head().v


@pytest.mark.parametrize(("text", "found"), [
    ("40 mg BID", {"40", "2"}), ("2,5 mg and 1,000 mL", {"2.5", "1000"}), ("half a tablet", {"0.5"}), (".5 is kept", set()), ("0.50", {"0.5"}),
    ("[PHONE_1] at 11h30", {"11", "30"}), ("A1c", set()), ("", set()), (None, set()),
])
def test_numbers(spark, text, found):
    assert set(value(spark, tx.numbers_in(F.col("t")), text)) == found


def test_half_equals_its_digits(spark):
    # The word and the number compare equal: one leading zero is kept.
    assert set(value(spark, tx.numbers_in(F.col("t")), "half of 0.5")) == {"0.5"}


def test_readability(spark):
    easy, hard = (value(spark, tx.fk_grade(F.col("t")), x) for x in ("Take it now. Rest well.", "Anticoagulation necessitates considerable deliberation regarding gastrointestinal haemorrhage."))
    assert easy < hard and value(spark, tx.fk_grade(F.col("t")), "") == 0.0


def test_spell_dates_and_ambiguous(spark):
    assert value(spark, tx.spell_dates(F.col("t")), "On 10/21/2026 and 13/40/2026") == "On October 21, 2026 and 13/40/2026"
    assert value(spark, tx.ambiguous_dates(F.col("t")), "10/12/2026 and 10/21/2026") == ["10/12/2026"]


@pytest.mark.parametrize(("text", "keep", "stop", "temporary"), [
    ("Keep taking aspirin.", True, False, False), ("Do not stop aspirin.", True, False, False), ("Hold warfarin until Monday.", False, True, True),
    ("Do not take more than 4 tablets.", False, False, False), ("Stop ibuprofen.", False, True, False),
])
def test_polarity(spark, text, keep, stop, temporary):
    p = value(spark, lex.polarity(F.col("t")), text)
    assert (p["continue"], p["stop"], p["temporary"]) == (keep, stop, temporary)


def test_drugs_and_scripts(spark):
    assert value(spark, lex.drugs_in(F.col("t")), "Lasix, Paracetamol and furosemide") == ["furosemide", "acetaminophen"]
    assert value(spark, lex.foreign_script(F.col("t"), "es"), "Tome 药 hoy") == "药"
    assert value(spark, lex.foreign_script(F.col("t"), "zh"), "吃药") == ""


def test_masking_numbers_tokens_and_round_trip(spark):
    text = "Patient: Maria Lopez. Call 408-555-0101 or a@b.org, again a@b.org; dose at 0800 1400 2000."
    row = masking.mask(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()
    assert "[EMAIL_1]" in row[0].masked and row[0].masked.count("[EMAIL_1]") == 2 and "555" not in row[0].masked and "0800 1400 2000" in row[0].masked
    out = text[:0] + row[0].masked
    for m in row[0].mapping:
        out = out.replace(m.token, m.value)
    assert out == text and row[1].masked == "" and row[1].mapping == []


def test_fuzzy():
    assert near("take one tablet daily", "please take one tablet daly now") and not near("take one tablet daily", "walk every morning outside")


def test_rules_are_tried_only_where_a_text_has_what_they_need(spark):
    """What every match has is looked for once a text, also where the library's rules are given; the masks are those of rules that are always tried."""
    said = ["MRN: ABCDE", "MRN abc", "Patient ID # A-B-C", "member ID ABCDEF and call 555-1234", "mail a.b@c.de, DOB 1/2/1990", "SW1A 1AA", "Record AB12", "P.O. Box 12", "policy: \u0663\u0664\u0665\u0666\u0667",
            "Admitted on 3 May \u0662\u0660\u0662\u0660", "x@y.z MRN ABCDE1 [EMAIL_1] 12 High Street.", "medicare ABCDE, medicare ABCD", "no such thing", None, ""]
    docs = spark.createDataFrame(list(enumerate(said)), "id int, text string").coalesce(1)
    always = [(kind, f"{pattern}(?:)") for kind, pattern in masking.RULES]
    found = masking.mask(docs, "text", masking.RULES)
    assert [tuple(r) for r in found.orderBy("id").collect()] == [tuple(r) for r in masking.mask(docs, "text", always).orderBy("id").collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_digit#") > sum(r"\d" in pattern for _, pattern in masking.RULES)
    assert plan.count(" AS _digit#") == 1


def test_content_tokens_look_for_numbers_only_where_there_is_a_digit(spark):
    said = ["Take 2,50 mg and 1,000 units, take it", "No such thing, none such", "\u0663 pills", "007", None, ""]
    docs = spark.createDataFrame([(x,) for x in said], "text string").coalesce(1)
    found = docs.select(lex.content_tokens(F.col("text")).alias("t"))
    assert [r.t for r in found.collect()] == [r.t for r in docs.select(F.array_union(F.filter(lex.content_tokens(F.col("text")), lambda w: w.rlike("^[a-z]")), tx.digits_in(F.col("text"))).alias("t")).collect()]
    assert "[0-9]" in found._jdf.queryExecution().analyzed().toString()
