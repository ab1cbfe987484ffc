from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textwarden.llm import queries


def test_stages_and_run(spark, docs, rows, tmp_path):
    docs.withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.stored(stage(spark, step, str(tmp_path)))
        assert step.columns == corpus_pipeline.COLUMNS, name
    kept = {r.doc_id: r for r in step.collect()}
    assert 303 not in kept and 300 not in kept  # too short
    assert len({200, 201, 5} & set(kept)) == 1 and len({4, *range(100, 106)} & set(kept)) == 1
    assert all(r.n_chars == len(r.text) and "stands on many sites" not in r.text and "password = " not in r.text for r in kept.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append((r.start, bytes(r.ids)))
    assert set(by_doc) == set(kept)
    t = Tokenizer.from_file(queries.WORD_BPE)
    for doc_id, pieces in by_doc.items():
        ids = np.frombuffer(b"".join(b for _, b in sorted(pieces)), "<u4").tolist()
        assert ids == [*t.encode(kept[doc_id].text, add_special_tokens=False).ids, 2]


def test_stages_on_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
