"""Bootstrap weights that hang on keys alone."""

from math import exp, factorial

import numpy as np
import pytest

from tallyspark.operators import evaluation


@pytest.mark.parametrize("n", [1, 7, 60, 5000])
def test_weights_are_poisson(n):
    keys = np.random.default_rng(n).integers(0, 2**63, 300 if n <= evaluation.TABLED else 100).astype(np.uint64)
    drawn = evaluation.poisson_weights(keys, n, 2000, 5)
    assert drawn.shape == (len(keys), 2000) and drawn.min() >= 0
    assert abs(drawn.mean() - n) < 5 * (n / drawn.size) ** 0.5
    assert abs(drawn.var() / n - 1) < 0.02
    if n == 1:
        for k in range(6):
            chance = exp(-1) / factorial(k)
            assert abs((drawn == k).mean() - chance) < 5 * (chance / drawn.size) ** 0.5
    # Rows, resamples and neighbouring keys are independent of one another.
    assert abs(np.corrcoef(drawn[:50]) - np.eye(50)).max() < 0.12
    assert abs(np.corrcoef(evaluation.poisson_weights(np.arange(2, dtype=np.uint64), n, 20_000, 5))[0, 1]) < 0.04
    assert (evaluation.poisson_weights(keys[::-1], n, 2000, 5) == drawn[::-1]).all()


def test_drawing_is_dealt_out(spark):
    """All distinct values went to one task, as they are few bytes."""
    rows = spark.range(0, 20_000, 1, 2).selectExpr("id * 1.0D AS part", "id + 1.0D AS whole")
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("drawing", "drawing")
    low, high = evaluation.ratio_interval(rows, "part", "whole")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("drawing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == evaluation.DRAWING_TASKS
    assert low <= high and abs(low - 0.99995) < 1e-4
