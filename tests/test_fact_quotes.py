from textwarden.operators import facts
from textwarden.sources.shipping import ship

FACT = "case_id long, fact_id string, kind string, med_action string, drug string, dose string, frequency string, detail string, source_quote string"


def test_near_quotes_and_dropped_labels(spark):
    ship(spark)
    source = "MEDICATIONS\nSTOP:  ibuprofen 400 mg tablets for pain\nTake furosemide 40 mg every morning with water\nWalk every day for ten minutes after lunch."
    rows = [
        (1, "whole", "medication", "stop", "ibuprofen", None, None, None, "STOP: ibuprofen 400 mg tablets for pain"),
        (1, "slip", "medication", None, "furosemide", None, None, None, "Take furosemide 40 mg evry mornng with water"),
        (1, "label", "activity", None, None, None, None, None, "Activity: Walk every day for ten minuts after lunch."),
        (1, "other", "activity", None, None, None, None, None, "Lift nothing heavier than a small bag of rice."),
        (1, "dropped", "medication", "new", "ibuprofen", None, None, None, "ibuprofen 400 mg tablets for pain"),
        (2, "no source", "activity", None, None, None, None, None, "Walk every day."),
    ]
    sources = spark.createDataFrame([(1, source)], "case_id long, source string")
    read = facts.classify(spark.createDataFrame(rows, FACT).join(sources, "case_id", "left"), source=sources["source"]).drop("source")
    assert {r.fact_id: r.med_action for r in read.collect()}["dropped"] == "stop"
    got = {(r.fact_id, r.name): r.status for r in facts.fact_checks(read, sources).collect()}
    assert {f: s for (f, n), s in got.items() if n == "quote"} == {"whole": "pass", "slip": "pass", "label": "pass", "other": "fail", "dropped": "pass", "no source": "fail"}
    assert got[("dropped", "cross_check")] == "warn" and ("whole", "cross_check") not in got
