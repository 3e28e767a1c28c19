from __future__ import annotations

import os

import pytest

import corpus_pipeline
from orogen.llm.queries import PIECES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.exists(SF) and os.path.exists(PIECES)), reason="the driver's tables are not here")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from orogen.llm.shared import written

        after = written(stage(spark, out, SF), name)
        assert after.columns == docs.columns
        now = {r.doc_id for r in after.select("doc_id").collect()}
        assert now <= ids and after.count() == len(now)
        if name == "pii":
            assert now == ids and after.filter("text rlike 'mail[0-9][.]example[.]com'").count() == 0
        else:
            assert len(now) < len(ids) and len(now) > 0.6 * len(ids)
        out, ids = after, now
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    assert {r.doc_id for r in last.collect()} == ids and last.filter("not round_trip").count() == 0
