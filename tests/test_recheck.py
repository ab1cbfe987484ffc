"""Rechecking what reviewers' events touch equals folding them and checking everything again."""

import itertools

from pyspark.sql import functions as F

from textwarden.operators import facts, recheck

SENTENCE = "case_id int, sent_id string, translated boolean, judged boolean, text_en string, text_tl string, fact_ids array<string>, back_en string, verdict string, tl_stale boolean, removed boolean, review string"
EVENT = "case_id int, sent_id string, at int, action string, text_en string, text_tl string, fact_ids array<string>"


def tables(spark):
    own = [(c, f"F{i}", "medication", a, d, "20 mg", "daily", "", f"{a.upper()}: {d} 20 mg daily") for c in (1, 2, 3) for i, (a, d) in enumerate([("continue", "metoprolol"), ("stop", "lisinopril"), ("new", "warfarin")], 1)]
    given = facts.features(spark.createDataFrame(own, "case_id int, fact_id string, kind string, med_action string, drug string, dose string, frequency string, detail string, source_quote string"))
    texts = [("S1", "Keep taking metoprolol 20 mg daily.", "F1"), ("S2", "Stop taking lisinopril.", "F2"), ("S3", "Take warfarin 20 mg daily.", "F3"), ("S4", "Take warfarin 50 mg daily.", "F3")]
    rows = [(c, s, c == 2, c == 3, t, "Texto" if c == 2 else None, [f], "Text" if c == 2 else "", "supported" if c == 3 else None, False, False, None) for c in (1, 2, 3) for s, t, f in texts]
    return given, spark.createDataFrame(rows, SENTENCE)


EVENTS = [
    (1, "S4", 1, "edit", " Take warfarin 20 mg daily. ", None, None),  # right now, then approved
    (1, "S4", 2, "approve", None, None, None),
    (1, "S2", 1, "approve", None, None, None),  # an approval, then an edit that makes it red and an approval that is refused
    (1, "S2", 2, "edit", "Keep taking lisinopril.", None, None),
    (1, "S2", 3, "approve", None, None, None),
    (1, "S1", 1, "remove", None, None, None),  # nothing tells F1 any more
    (2, "S1", 1, "edit", "Keep taking metoprolol 20 mg each day.", None, None),  # the translation is stale
    (2, "S2", 1, "edit", "Stop lisinopril.", "Otro texto", None),
    (2, "S4", 1, "approve", None, None, None),  # red: refused
    (3, "S3", 1, "edit", None, None, ["F2"]),  # cites another fact
    (3, "S4", 1, "edit", "Take warfarin 50 mg daily.", None, None),  # changes nothing
    (3, "S1", 1, "approve", None, None, None),
]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


COLUMNS = ["case_id", "sent_id", "text_en", "text_tl", "back_en", "verdict", "tl_stale", "removed", "review", "status", "risk", "needs_review"]


def test_recheck_equals_checking_everything_again(spark, tmp_path):
    own, sentences = tables(spark)
    stored = recheck.full(sentences, own)
    for name in ("sentences", "checks", "omissions"):
        getattr(stored, name).write.parquet(str(tmp_path / name))
        setattr(stored, name, spark.read.parquet(str(tmp_path / name)))
    events = spark.createDataFrame(EVENTS, EVENT)
    got = recheck.recheck(stored, own, events, str(tmp_path / "batch"))
    after = {(r.case_id, r.sent_id): r for r in got.sentences.collect()}
    assert len(after) == 12
    assert (after[1, "S4"].status, after[1, "S4"].review, after[1, "S4"].needs_review, after[1, "S4"].text_en) == ("green", "approved", False, "Take warfarin 20 mg daily.")
    assert (after[1, "S2"].status, after[1, "S2"].review, after[1, "S2"].needs_review) == ("red", "edited", True)
    assert (after[2, "S1"].tl_stale, after[2, "S1"].back_en, after[2, "S1"].status) == (True, "", "red")
    assert (after[2, "S2"].tl_stale, after[2, "S2"].text_tl) == (False, "Otro texto")
    assert (after[2, "S4"].status, after[2, "S4"].review) == ("red", None)
    assert (after[3, "S3"].verdict, after[3, "S3"].review, after[3, "S4"].review, after[3, "S4"].verdict, after[3, "S1"].review) == (None, "edited", None, "supported", "approved")
    # Everything from the start, with what the events have made of the sentences.
    again = recheck.full(got.sentences.select(*sentences.columns), own)
    assert rows(got.sentences, *COLUMNS) == rows(again.sentences, *COLUMNS)
    assert rows(got.checks, "case_id", "sent_id", "name", "status") == rows(again.checks, "case_id", "sent_id", "name", "status")
    assert rows(got.omissions, "case_id", "fact_id", "rule") == rows(again.omissions, "case_id", "fact_id", "rule")
    assert ("translation_stale", "fail") in {(r.name, r.status) for r in got.checks.collect() if (r.case_id, r.sent_id) == (2, "S1")}
    assert (1, "F1", "not_explained") in rows(got.omissions, "case_id", "fact_id", "rule")
    # Only what an edit has changed was read again.
    read = {(r.case_id, r.sent_id) for r in spark.read.parquet(str(tmp_path / "batch" / "checks")).collect()}
    assert read == {(1, "S4"), (1, "S2"), (2, "S1"), (2, "S2"), (3, "S3")}


def test_no_events_leave_everything(spark, tmp_path):
    own, sentences = tables(spark)
    stored = recheck.full(sentences.filter("case_id = 1"), own.filter("case_id = 1"))
    got = recheck.recheck(stored, own, spark.createDataFrame([], EVENT), str(tmp_path / "batch"))
    assert rows(got.sentences, *COLUMNS) == rows(stored.sentences, *COLUMNS)
    assert rows(got.omissions, "fact_id", "rule") == rows(stored.omissions, "fact_id", "rule")


def test_order_of_events_decides(spark):
    _, sentences = tables(spark)
    one = sentences.filter("case_id = 2 and sent_id = 'S1'")
    edits = [("edit", "New words.", None), ("edit", None, "Texto nuevo"), ("approve", None, None)]
    for order in itertools.permutations(range(3)):
        events = spark.createDataFrame([(2, "S1", i, *edits[k], None) for i, k in enumerate(order)], EVENT)
        r = recheck.folded(one, events).head()
        assert r.tl_stale == (order.index(0) > order.index(1))  # English after the translation
        assert r.review == ("approved" if order[-1] == 2 else "edited")
        assert (r.text_en, r.text_tl, r.back_en, r.changed) == ("New words.", "Texto nuevo", "", True)
