"""Formulas against constants worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.functions import geo, ids, numeric
from plotwise.operators import ladder, layers, search, spatial


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_ids(spark):
    raw = [None, "", "1500000US360050001001", "360050001001.0", "3.60050001001E11", "60050001001", " 360050001001 ", "3600500010011"]
    got = [r[0] for r in column(spark, raw, "string").select(ids.normalize_id(F.col("x"))).collect()]
    assert got == ["", "", "360050001001", "360050001001", "360050001001", "060050001001", "360050001001", "3600500010011"]


def test_octants(spark):
    degrees = [0.0, 22.5, 22.6, 67.5, 180.0, 337.5, 337.6, 359.9]
    assert [r[0] for r in column(spark, degrees, "double").select(geo.octant(F.col("x"))).collect()] == ["N", "N", "NE", "NE", "S", "NW", "N", "N"]


def test_numbers(spark):
    got = [r[0] for r in column(spark, ["1.5", " 2 ", "x", None, "inf", "NaN"], "string").select(numeric.to_number(F.col("x"))).collect()]
    assert got == [1.5, 2.0, None, None, None, None]


def test_schedule(spark):
    rows = {round(r["t"], 2): r for r in ladder.ladder(spark).collect()}
    assert len(rows) == 100
    assert [rows[t]["min_select"] for t in (0.0, 0.05, 0.15, 0.5)] == [20, 20, 18, 15]
    assert [round(rows[t]["demand"]) for t in (0.0, 0.05, 0.15, 0.5)] == [10000, 9217, 8138, 6400]
    assert all(r["demand"] == round(4000 + 6000 / (1 + 3 * t)) for t, r in rows.items())
    assert rows[0.0]["max_search_mi"] == 1.5


def test_ring(spark):
    near = spark.createDataFrame([("a", 0.2, 1.0), ("a", 0.5, 3.0), ("a", 0.5, 6.0), ("a", 1.0, 10.0)], "src string, dist_mi double, cum_weight double")
    steps = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.0), (2, 6.0, 1.0), (3, 7.0, 1.0), (4, 11.0, 1.0), (5, 7.0, 0.9)], "scenario_idx int, demand double, max_search_mi double")
    assert {r["scenario_idx"]: r["ring_mi"] for r in spatial.demand_rings(near, steps).collect()} == {0: 0.2, 1: 0.5, 2: 0.5, 3: 1.0}


def test_colors(spark):
    got = [r[0] for r in column(spark, [1, 8, 9, 0, None], "int").select(layers.rank_color(F.col("x"))).collect()]
    assert got == ["#b3de69", "#fccde5", "#b3de69", layers.GREY, layers.GREY]


def test_sobol():
    x = search.sobol(8, 64)
    for d in range(8):  # each of 64 equal cells has one point
        assert sorted((x[:, d] * 64).astype(int)) == list(range(64))
    w = search.simplex_weights(6, 10, 1)
    assert np.allclose(w.sum(1), 1) and (w > 0).all()


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert d == pytest.approx(math.radians(1) * geo.EARTH_MILES)
