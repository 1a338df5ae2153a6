from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor_jobs.functions import linear


def project(x: np.ndarray, y: np.ndarray, px: float, py: float) -> float:
    """Nearest point leg by leg; the first of equals."""
    dx, dy = np.diff(x), np.diff(y)
    size = dx * dx + dy * dy
    t = np.where(size > 0, ((px - x[:-1]) * dx + (py - y[:-1]) * dy) / np.where(size > 0, size, 1), 0.0).clip(0, 1)
    i = int(np.argmin(np.hypot(x[:-1] + t * dx - px, y[:-1] + t * dy - py)))
    return float(np.sqrt(size[:i]).sum() + t[i] * np.sqrt(size[i]))


def between(x: np.ndarray, y: np.ndarray, start: float, end: float) -> list[tuple[float, float]]:
    along = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    lo, hi = sorted((min(max(start, 0.0), along[-1]), min(max(end, 0.0), along[-1])))
    at = [lo, *(d for d in along if lo < d < hi), hi] if hi > lo else [lo]
    points = [(float(np.interp(d, along, x)), float(np.interp(d, along, y))) for d in at]
    return points[::-1] if start > end else points


LINE = "array<struct<x:double,y:double>>"


def test_equals_legs_tried_one_by_one(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        n = int(rng.integers(2, 40))
        line = [(float(a), float(b)) for a, b in rng.integers(-9, 9, (n, 2))]  # crossings, repeated points, ties
        rows.append((i, line, *map(float, rng.uniform(-12, 12, 2)), *map(float, rng.uniform(-5, 120, 2))))
    df = spark.createDataFrame(rows, f"i int, line {LINE}, px double, py double, a double, b double")
    got = df.select("i", linear.project_on_line(F.col("line"), F.col("px"), F.col("py")).alias("d"), linear.segment_geometry(F.col("line"), F.col("a"), F.col("b")).alias("s"))
    for r in got.collect():
        _, line, px, py, a, b = rows[r.i]
        x, y = (np.array(c) for c in zip(*line, strict=True))
        assert r.d == pytest.approx(project(x, y, px, py), abs=1e-9)
        want = between(x, y, a, b)
        assert len(r.s) == len(want) and np.allclose([tuple(p) for p in r.s], want, atol=1e-9)


def test_a_point_on_the_line_projects_onto_itself(spark):
    rng = np.random.default_rng(3)
    rows = [([(float(a), float(b)) for a, b in rng.uniform(-50, 50, (int(rng.integers(2, 7)), 2))], float(s)) for s in rng.uniform(0, 1, 200)]
    df = spark.createDataFrame(rows, f"line {LINE}, share double").withColumn("line", linear.measured(F.col("line")))
    df = df.withColumn("d", F.col("share") * F.element_at("line", -1)["m"]).withColumn("p", linear.between_measured(F.col("line"), F.col("d"), F.col("d"))[0])
    back = linear.project_measured(F.col("line"), F.col("p.x"), F.col("p.y"))
    again = linear.between_measured(F.col("line"), back, back)[0]
    assert df.filter(F.hypot(again["x"] - F.col("p.x"), again["y"] - F.col("p.y")) > 1e-6).isEmpty()


def test_folds_nulls_and_short_lines(spark):
    rows = [([(0.0, 0.0), (10.0, 0.0), (0.0, 0.0)], 4.0, 1.0), ([(0.0, 0.0)], 4.0, 1.0), ([], 4.0, 1.0), (None, 4.0, 1.0), ([(0.0, 0.0), (1.0, 0.0)], None, 1.0), ([(2.0, 2.0), (2.0, 2.0)], 4.0, 1.0)]
    df = spark.createDataFrame(rows, f"line {LINE}, px double, py double")
    got = df.select(linear.project_on_line(F.col("line"), F.col("px"), F.col("py")).alias("d"), linear.segment_geometry(F.col("line"), F.col("px"), F.lit(3.0)).alias("s")).collect()
    assert [r.d for r in got] == [4.0, None, None, None, None, 0.0]
    assert [r.s and [tuple(p) for p in r.s] for r in got] == [[(4.0, 0.0), (3.0, 0.0)], None, None, None, None, [(2.0, 2.0)]]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0)],)], f"line {LINE}")
    plan = df.select(linear.segment_geometry(F.col("line"), linear.project_on_line(F.col("line"), F.lit(1.0), F.lit(2.0)), F.lit(0.0)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
