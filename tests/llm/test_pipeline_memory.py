"""What keeps Python's share of an executor's memory bounded in the pipeline's stages."""

from __future__ import annotations

import numpy as np
import pytest

from labelforge.llm import neardup, quality, sharding

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_sends_texts_by_the_hundred(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["to", "Be", "x|", "42", "é"], n)) for n in rng.integers(1, 60, 250)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x = np.array([quality.statistics(t) for t in texts])
    forest = quality.fit(x, rng.permutation(np.arange(len(x)) % 2).astype(float), trees=20)
    out = quality.scored(docs, forest)
    assert "ArrowEvalPython" not in _plan(out)
    assert {r.doc_id: r.score for r in out.collect()} == dict(enumerate(forest.score(x)))
    assert np.unique(forest.score(x)).size > 2


def test_near_duplicates_stage_runs_on_small_batches_and_restores_the_session(spark, monkeypatch):
    seen = []
    whole = neardup.near_duplicates
    monkeypatch.setattr(neardup, "near_duplicates", lambda *a: seen.append(spark.conf.get(BATCH)) or whole(*a))
    before = spark.conf.get(BATCH)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [1, 3]
    assert seen == [str(neardup.ARROW_ROWS)] and spark.conf.get(BATCH) == before


@pytest.mark.parametrize("rows", [0, 40])
def test_placements_need_no_python_on_executors(spark, rows):
    docs = spark.range(rows).selectExpr("id", "cast(id % 7 as string) as k", "id + 1 as size")
    out = sharding.shard(docs, "k", "size", shards=3)
    plan = _plan(out)
    assert "ExistingRDD" not in plan and "Python" not in plan
    got = out.select("k", "shard").distinct().collect()
    assert len(got) == min(rows, 7) and {r.shard for r in got} <= {0, 1, 2}
