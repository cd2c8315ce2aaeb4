"""Probability calibration of detectors from labelled outcomes: Platt or isotonic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, ISOTONIC_FROM = 10, 50
CALIBRATION = "method string, a double, b double, points array<array<double>>, labels int, note string"


def fit_platt(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over the log-odds, by Newton's method."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(p / (1 - p)), np.ones_like(p)])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-(w @ x)))
        curve = (x * (q * (1 - q) + 1e-9)) @ x.T
        if abs(np.linalg.det(curve)) < 1e-12:
            break
        step = np.linalg.solve(curve, x @ (y - q))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return round(float(w[0]), 6), round(float(w[1]), 6)


def fit_isotonic(p: np.ndarray, y: np.ndarray) -> list[list[float]]:
    """Knots (mean probability, mean outcome) of pools in which the outcome never falls."""
    pools: list[list[float]] = []  # sum of p, sum of y, number
    for a, b in sorted(zip(p.tolist(), y.tolist(), strict=True)):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return [[round(a / n, 6), round(b / n, 6)] for a, b, n in pools]


def calibrate(labels: DataFrame) -> DataFrame:
    """One row for each ``policy_id, detector_id`` of ``labels`` (with ``probability, violates``).

    Under 10 labels or with one outcome alone there is only a note; under 50 a Platt curve; else
    isotonic knots. A detector's labels are the hand-made judgements of it, so a group is small.
    """

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, y = pdf["probability"].to_numpy(float), pdf["violates"].to_numpy().astype(float)
        order = np.lexsort((y, p))
        p, y = p[order], y[order]
        row = {"policy_id": key[0], "detector_id": key[1], "method": None, "a": None, "b": None, "points": None, "labels": len(p), "note": None}
        if len(p) < LEAST or len(set(y)) < 2:
            row["note"] = f"needs {LEAST} labels of both outcomes"
        elif len(p) < ISOTONIC_FROM:
            row["method"], (row["a"], row["b"]) = "platt", fit_platt(p, y)
        else:
            row["method"], row["points"] = "isotonic", fit_isotonic(p, y)
        return pd.DataFrame([row]).astype({"a": float, "b": float})

    return labels.groupBy("policy_id", "detector_id").applyInPandas(fit, f"policy_id string, detector_id string, {CALIBRATION}")


def apply_platt(p: Column, a: Column, b: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return 1 / (1 + F.exp(-(a * F.log(q / (1 - q)) + b)))


def apply_isotonic(p: Column, points: Column) -> Column:
    """Piecewise linear between the knots, level beyond them; on an upright step the left value."""
    x = lambda k: F.element_at(k, 1)
    y = lambda k: F.element_at(k, 2)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    below = F.element_at(F.filter(points, lambda k: x(k) <= p), -1)
    above = F.element_at(F.filter(points, lambda k: x(k) >= p), 1)
    flat = x(above) == x(below)
    between = y(below) + (y(above) - y(below)) * (p - x(below)) / F.when(flat, F.lit(1.0)).otherwise(x(above) - x(below))
    return F.when(p <= x(first), y(first)).when(p >= x(last), y(last)).when(flat, F.least(y(below), y(above))).otherwise(between)


def apply_calibration(p: Column, calibration: Column) -> Column:
    """``calibration``: a struct of ``method, a, b, points``; null leaves the probability alone."""
    return (
        F.when(calibration["method"] == "platt", apply_platt(p, calibration["a"], calibration["b"]))
        .when(calibration["method"] == "isotonic", apply_isotonic(p, calibration["points"]))
        .otherwise(p)
    )


def calibration_error(rows: DataFrame, bins: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error of ``probability`` against ``violates``, by ``keys``."""
    at = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).alias("bin")
    per = rows.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("p"), F.sum(F.col("violates").cast("int")).alias("y"))
    return per.groupBy(*keys).agg((F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
