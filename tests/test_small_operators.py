"""Operators that no query reaches, by hand-made rows."""

import json

from pyspark.sql import functions as F

from textwarden.functions import masking
from textwarden.operators import packet, review, rollup
from textwarden.sources import readers


def test_a_store_evicts_the_oldest_finished_rows_as_if_one_by_one(spark):
    rows = [(k, i, (i * 7 + k) % 3 != 0) for k in range(3) for i in range(4 + 5 * k)]
    gone = {(r.k, r.i) for r in review.evicted(spark.createDataFrame(rows, "k int, i int, finished boolean"), "k", ["i"], 5).collect()}
    for k in range(3):
        held = [r for r in rows if r[0] == k]
        while len(held) > 5 and any(r[2] for r in held):
            held.remove(next(r for r in held if r[2]))
        assert {r[1] for r in rows if r[0] == k and (k, r[1]) not in gone} == {r[1] for r in held}


def test_released_packets_get_their_values_back(spark):
    said = spark.createDataFrame([(1, "why", 2, "Ask [CONTACT_1]."), (1, "why", 1, "You were ill."), (2, "why", 1, "Not yet."), (3, "why", 1, "No [X_1] here.")], "case_id int, section string, pos int, text_en string")
    maps = spark.createDataFrame([(1, [("[CONTACT_1]", "Ann")])], "case_id int, mapping array<struct<token string, value string>>")
    found = packet.released(said, maps, spark.createDataFrame([(1,), (3,)], "case_id int")).collect()
    assert sorted((r.case_id, r.n, r.body) for r in found) == [(1, 2, "You were ill. Ask Ann."), (3, 1, "No [X_1] here.")]


def test_packet_lines_and_quiz_as_handed_out(spark):
    said = spark.createDataFrame(
        [(1, "a", 1, "S1", ["F9", "F2", "F1"], "Ask [CONTACT_1].", "Pregunte a [CONTACT_1].", "high", None), (1, "a", 2, "S2", [], "Rest.", "", "normal", False), (1, "a", 3, "S3", ["F1"], "Gone.", "x", "normal", True),
         (2, "a", 1, "S1", None, "Not released.", None, None, False), (3, "b", 1, "S1", ["F1"], "Of [X_1].", None, "normal", False)],
        "case_id int, section string, pos int, sent_id string, fact_ids array<string>, text_en string, text_tl string, risk string, removed boolean",
    )
    facts = spark.createDataFrame([(1, "F1", "stop"), (1, "F2", ""), (2, "F1", "new"), (3, "F1", None)], "case_id int, fact_id string, med_action string")
    maps = spark.createDataFrame([(1, [("[CONTACT_1]", "Ann")])], "case_id int, mapping array<struct<token string, value string>>")
    rows = packet.lines(said, facts, maps, spark.createDataFrame([(1,), (1,), (3,)], "case_id int")).orderBy("case_id", "pos").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 1, "S1", "Ask Ann.", "Pregunte a Ann.", "high", "stop"), (1, "a", 2, "S2", "Rest.", None, "normal", None), (3, "b", 1, "S1", "Of [X_1].", None, "normal", None)]
    quiz = spark.createDataFrame([(1, "Q1", [("See [CONTACT_1].", True), ("No.", False)]), (3, "Q1", [("[X_1]", True)])], "case_id int, q_id string, options array<struct<text string, correct boolean>>")
    assert sorted((r.case_id, r.options) for r in packet.without_answers(quiz, maps).collect()) == [(1, ["See Ann.", "No."]), (3, ["[X_1]"])]


def test_next_ids_and_shares(spark):
    items = spark.createDataFrame([("a", "S2"), ("a", "S10"), ("b", None)], "c string, s string")
    assert {tuple(r) for r in review.next_ids(items, "c", "s", "S").collect()} == {("a", "S11"), ("b", "S1")}
    said = spark.createDataFrame([("green", "normal"), ("green", "high"), ("red", "normal"), ("green", "normal")], "status string, risk string")
    assert tuple(rollup.verified_share(said).head()) == (2, 50.0)


def test_names_and_links(spark):
    df = spark.createDataFrame([("  Ann​ \n Lee\x07 ", "/p/a-b_1/x"), ("​1", "/api/patient/zz"), (None, "/q/a")], "name string, path string")
    got = [tuple(r) for r in df.select(masking.clean_name(F.col("name")), masking.is_real_name(F.col("name")), masking.redact_link(F.col("path"))).collect()]
    assert got == [("Ann Lee", True, "/p/<token>/x"), ("1", False, "/api/patient/<token>"), ("", False, "/q/a")]


def test_samples_and_recorded_outputs(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"_meta": {"source": f"s{name}", "model": "m"}, "id": name}))
    assert [r.id for r in readers.samples(spark, str(tmp_path)).collect()] == ["a", "b"]
    (tmp_path / "summary.json").write_text("{}")
    assert sorted(map(tuple, readers.replayable(spark, str(tmp_path)).collect())) == [("a", "sa", "m", None), ("b", "sb", "m", None)]


def test_uploads_that_are_too_large(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_BYTES", 5)
    (tmp_path / "a.txt").write_bytes(b"abc\xff")
    (tmp_path / "b.txt").write_text("abcdef")
    found = sorted((r.path[-5:], r.error, r.text) for r in readers.uploads(spark, str(tmp_path)).collect())
    assert found == [("a.txt", None, "abc�"), ("b.txt", "too large", None)]
