"""Order statistics by places, against sorted lists."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from labelforge import ranks
from labelforge.operators import metrics


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    return {None: [5.0], "a": [float(rng.randint(0, 9)) for _ in range(500)], "b": [1.0] * 40, "c": [rng.random() for _ in range(7)], "d": []}


@pytest.fixture(scope="module")
def rows(spark, groups):
    data = [(k, v, "x") for k, vs in groups.items() for v in [*vs, None]]
    random.Random(4).shuffle(data)
    return spark.createDataFrame(data, "kind string, value double, _lf_place string").repartition(6)


def test_values_at_places(rows, groups):
    places = rows.sparkSession.createDataFrame([(k, p) for k in groups for p in (0, 3, 250, 10_000)], "kind string, place long")
    got = {(r.kind, r.place): r.value for r in ranks.at_places(rows, ["kind"], "value", places).collect()}
    assert got == {(k, p): sorted(v)[p] for k, v in groups.items() for p in (0, 3, 250) if p < len(v)}


def test_percentiles_by_index(rows, groups):
    got = {r.kind: (r.p0, r.p50, r.p99, r.p100) for r in metrics.indexed_percentiles(rows, "value", ["kind"], {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    assert got == {k: tuple(sorted(v)[min(int(len(v) * p), len(v) - 1)] if v else None for p in (0.0, 0.5, 0.99, 1.0)) for k, v in groups.items()}
    every = sorted(v for vs in groups.values() for v in vs)
    assert metrics.indexed_percentiles(rows, "value", [], {"p95": 0.95}).first().p95 == every[int(len(every) * 0.95)]


def test_latency(rows, groups):
    got = {r.kind: r for r in metrics.latency(rows, "value", ["kind"]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        want = (round(statistics.mean(v), 4), min(v), max(v), round(statistics.median(v), 4), round(statistics.stdev(v), 4) if len(v) > 1 else 0.0, len(v)) if v else (None, None, None, None, 0.0, 0)
        assert (got[k]["mean"], got[k]["min"], got[k]["max"], got[k]["median"], got[k]["stdev"], got[k]["n"]) == want
    assert metrics.latency(rows, "value", []).first()["n"] == sum(map(len, groups.values()))
    assert metrics.latency(rows.limit(0), "value", ["kind"]).count() == 0


def test_no_group_is_gathered(rows):
    """The plan of the ranks has no window or list over a group's rows."""
    plan = ranks.ranked(rows.select("kind", "value"), ["kind"], ["value"], "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Window") <= 1 and F is not None
