"""Learning from every labelled row, as a table."""

import numpy as np
import pytest

from newsloom.llm import quality


def table(spark, found, labels):
    rows = [(int(y), x.tolist()) for x, y in zip(found, labels, strict=True)]
    return spark.createDataFrame(rows, "label int, found array<double>").repartition(3).localCheckpoint()


def test_weights_are_at_the_minimum_over_all_pairs(spark):
    rng = np.random.default_rng(3)
    found, labels = rng.normal(size=(500, 4)), (rng.random(500) < 0.3).astype(int)
    found[:, 0] += labels
    model = quality.learn(table(spark, found, labels), penalty=1e-2)
    x = quality.expanded(found, found.mean(axis=0), found.std(axis=0))
    pairs = (x[labels == 1][:, None] - x[labels == 0][None, :]).reshape(-1, x.shape[1])

    def loss(w):
        return np.log1p(np.exp(-pairs @ w)).mean() + 0.5e-2 * w @ w

    least = loss(model.weights)
    for i in range(len(model.weights)):
        for step in (-1e-3, 1e-3):
            assert loss(model.weights + step * np.eye(len(model.weights))[i]) > least
    strengths = model.strengths(found)
    assert model.threshold == pytest.approx(np.quantile(strengths, 1 - labels.mean()), abs=1e-12)
    assert model.width == pytest.approx(strengths.std())


def test_rows_beyond_any_sample_count(spark):
    """30,000 rows of which the last 5,000 alone tell the labels apart by the second feature."""
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 30_000)
    found = np.zeros((30_000, 2))
    found[:, 0] = rng.normal(size=30_000) + labels
    found[-5000:, 1] = labels[-5000:] * 2 - 1
    model = quality.learn(table(spark, found, labels))
    assert model.centre == pytest.approx(found.mean(axis=0)) and model.spread == pytest.approx(found.std(axis=0))
    assert model.threshold == pytest.approx(np.quantile(model.strengths(found), 1 - labels.mean()), abs=1e-9)


def test_quantile_of_equal_values(spark):
    found = np.repeat([[0.0], [1.0]], 6000, axis=0)
    labels = np.tile([0, 1], 6000)
    model = quality.learn(table(spark, found, labels))
    assert model.threshold == pytest.approx(np.quantile(model.strengths(found), 0.5))
