import json

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from textwarden.operators import sentences
from textwarden.sources import readers


def test_replay_and_lenient_json(spark, tmp_path):
    (tmp_path / "case-a.json").write_text(json.dumps({"_meta": {"source": "x"}, "_timings": {"facts:k": {"seconds": 2.5}}, "facts": {"k": {"facts": []}}}))
    (tmp_path / "summary.json").write_text("{}")
    rows = readers.replay(spark, str(tmp_path)).collect()
    assert [(r.case_id, r.stage, r.key, r.seconds) for r in rows] == [("case-a", "facts", "k", 2.5)]


def test_ingest_errors(spark):
    rows = spark.createDataFrame([("x", "en", "n"), (" ", "en", "n"), ("x", "??", "n"), ("y" * 30_001, "en", "n"), (None, "en", None)], "source string, language string, patient_name string")
    assert [r.error for r in readers.ingest(rows, ["en"]).collect()] == [None, "empty", "language", "too long", "empty"]


def test_attached_outputs_last_wins_missing_is_empty(spark):
    s = spark.createDataFrame([(1, "S1"), (1, "S2")], "case_id int, sent_id string")
    tl = spark.createDataFrame([(1, "S1", "a", 0), (1, "S1", "b", 1), (1, None, "c", 2)], "case_id int, sent_id string, text string, pos int")
    assert {r.sent_id: r.text_tl for r in sentences.attach(s, {"text_tl": tl}).collect()} == {"S1": "b", "S2": ""}


def test_sentence_normalisation(spark):
    payload = '[{"id":"S1","section":"medicines","text":" Take it. ","fact_ids":["f1"," F2"]},{"text":""},{"text":"Walk.","fact_ids":"F3"},7]'
    rows = sentences.normalise(spark.createDataFrame([(1, payload)], "case_id int, payload string")).orderBy("pos").collect()
    assert [(r.sent_id, r.section, r.text_en, r.fact_ids) for r in rows] == [("S1", "medicines", "Take it.", ["F1", "F2"]), ("S3", "daily_care", "Walk.", ["F3"])]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xe9 ok")
    assert readers.uploads(spark, str(tmp_path)).select(F.contains("text", F.lit("�"))).head()[0]


def test_one_sample_and_one_recorded_output(spark, tmp_path):
    """Only the named file is read (another is no JSON at all); what is missing is an error."""
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "title": "First"}, indent=1))
    (tmp_path / "case-1.json").write_text(json.dumps({"_meta": {}, "facts": {"k": {"n": 1}}, "_timings": {"facts:k": {"seconds": 0.5}}}))
    (tmp_path / "broken.json").write_bytes(b"\x00\x01 no json")
    one = readers.sample(spark, str(tmp_path), "a")
    assert [(r.id, r.title) for r in one.collect()] == [("a", "First")] and len(one.inputFiles()) == 1
    with pytest.raises(AnalysisException):
        readers.sample(spark, str(tmp_path), "b").collect()
    for name in ("../a", "*", ""):
        with pytest.raises(ValueError):
            readers.sample(spark, str(tmp_path), name)
    found = readers.replayed(spark, str(tmp_path), "case-1", "facts", "k")
    assert [(r.case_id, json.loads(r.payload), r.seconds) for r in found.collect()] == [("case-1", {"n": 1}, 0.5)] and len(found.inputFiles()) == 1
    with pytest.raises(PySparkException, match="no facts/z output"):
        readers.replayed(spark, str(tmp_path), "case-1", "facts", "z").collect()
    with pytest.raises(AnalysisException):
        readers.replayed(spark, str(tmp_path), "case-2", "facts", "k").collect()


def test_samples_by_name_and_recorded_runs(spark, tmp_path):
    for name in ("b", "a", "summary"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name, "_meta": {"source": f"s-{name}", "model": "m"}}))
    assert [r.file for r in readers.samples(spark, str(tmp_path)).collect()] == ["a.json", "b.json", "summary.json"]
    assert sorted((r.case_id, r.source, r.model, r.note) for r in readers.replayable(spark, str(tmp_path)).collect()) == [("a", "s-a", "m", None), ("b", "s-b", "m", None)]


def test_an_upload_that_is_too_large_has_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_BYTES", 10)
    (tmp_path / "a.txt").write_text("0123456789")
    (tmp_path / "b.txt").write_text("0123456789!")
    (tmp_path / "c.pdf").write_text("%PDF")
    rows = readers.uploads(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.length, r.error, r.text) for r in rows] == [(10, None, "0123456789"), (11, "too large", None), (4, None, None)]
