"""What a worker holds of two tiles that meet."""

import tracemalloc

import numpy as np
import pytest

from millrace.operators import shared, vector


@pytest.fixture
def runs(monkeypatch):
    """The functions that isolation, novelty and similar_groups run on tiles, in that order."""
    found = []

    class Stop(Exception):
        pass

    def met(left, right, run, schema, keep):
        found.append(run)
        raise Stop

    monkeypatch.setattr(vector, "_met", met)

    def of(spark):
        table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
        for start in (lambda: vector.isolation(table), lambda: vector.novelty(table, table), lambda: vector.similar_groups(table, 0.5)):
            with pytest.raises(Stop):
                start()
        return found

    return of


def test_tiles_meet_in_strips(spark, runs):
    rng = np.random.default_rng(0)
    a, b = ((np.arange(n, n + 4096), vector._unit(rng.normal(size=(4096, 8)))) for n in (0, 4096))
    for run in runs(spark):
        tracemalloc.start()
        run(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6  # all cosines of two tiles are 134 MB
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_strips_give_what_brute_force_gives(spark, runs, monkeypatch):
    monkeypatch.setattr(vector, "STRIP", 4)
    rng = np.random.default_rng(1)
    a, b = ((np.arange(n, n + 10), vector._unit(rng.normal(size=(10, 3)))) for n in (0, 10))
    isolation, novelty, groups = runs(spark)
    x = np.concatenate([a[1], b[1]])
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    own, pair = isolation(a, None), isolation(a, b)
    assert own.id.tolist() == list(range(10)) and np.allclose(own.s, s[:10, :10].max(1))
    assert pair.id.tolist() == list(range(20)) and np.allclose(pair.s, np.concatenate([s[:10, 10:].max(1), s[10:, :10].max(1)]))
    assert np.allclose(novelty(a, b).s, s[:10, 10:].max(1))
    for other, close in ((None, s[:10, :10] >= 0.5), (b, np.where(np.not_equal.outer(np.arange(20) < 10, np.arange(20) < 10), s, -2) >= 0.5)):
        label = list(range(len(close)))
        for _ in label:
            for i, j in zip(*np.nonzero(close)):
                label[i] = label[j] = min(label[i], label[j])
        edges = groups(a, other)
        got = dict(enumerate(range(len(close)))) | dict(zip(edges.a.tolist(), edges.b.tolist()))
        assert got == dict(enumerate(label)) and len(edges)
