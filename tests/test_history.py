"""The history of series against a plain loop."""

import random

import pytest

from kgspark.operators import stats


def plain(rows, spacing, kept):
    out = []
    for s in {r[0] for r in rows}:
        took = []
        for _, at, v in sorted(r for r in rows if r[0] == s):
            if not took or at - took[-1][1] >= spacing:
                took.append((s, at, v))
        out += took[-kept:]
    return sorted(out)


@pytest.mark.parametrize("spacing,kept", [(60, 200), (7, 10_000), (60, 3)])
def test_history(spark, spacing, kept):
    """Dense and sparse series, several samples a second, gaps around the spacing, times before 1970, many stretches."""
    rng = random.Random(spacing + kept)
    rows = [("dense", rng.randrange(-3000, 6000), float(rng.randrange(9))) for _ in range(12_000)]
    rows += [("sparse", k * 977 + rng.randrange(90), 1.0) for k in range(60)] + [("edge", k * 59 + k % 3, 2.0) for k in range(200)] + [("one", 5, 3.0)]
    got = stats.history(spark.createDataFrame(rows, "series string, at long, value double").repartition(5), spacing, kept, stretch=500)
    assert sorted(map(tuple, got.collect())) == plain(rows, spacing, kept)


def test_long_series(spark):
    """Forty days of one series, all of whose kept samples are asked for."""
    days = 40
    rows = spark.range(days * 86_400 // 20).selectExpr("'a' AS series", "id * 20 AS at", "1.0D AS value")
    history = stats.history(rows, kept=1_000_000)
    got = history.orderBy("at").collect()
    assert [r.at for r in got] == list(range(0, days * 86_400, 60))
    assert stats.history(rows.limit(0)).count() == 0
