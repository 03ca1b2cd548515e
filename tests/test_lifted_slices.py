"""Kernel features are made in slices of a batch."""

from cadenza.operators import models
from conftest import rows


def test_vectors_are_widened_in_slices(spark, monkeypatch):
    monkeypatch.setattr(models, "LIFTED", 3)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id bigint, x array<double>").coalesce(1)

    def few(m):
        assert len(m) <= 3
        return m * 2

    assert rows(models._map_vectors(df, "x", few), "id") == [(i, [2.0 * i, 2.0]) for i in range(20)]
