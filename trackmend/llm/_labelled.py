"""Labelled rows, all or a bounded sample, and a logistic model for a few features.

Rows whose ``crc32(key as text) mod 3`` is 1 are held out: nothing is learned from their labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def dealt(key: Column) -> Column:
    """A number in [0, 1) that deals rows out to the steps of a fit."""
    return F.pmod(F.xxhash64(F.lit(23), key), F.lit(1000)) / 1000


def training_rows(labels: DataFrame, label: str, key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """((key, y) of every row that may be learned from, number of rows of each class).  A key with both labels counts as 1."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    rows = rows.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    return rows, {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}


def training_sample(labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """((key, y, part): up to ``per_class`` rows of each class in the order of a hash, number of rows of each class).

    ``part`` in [0, 1) deals the rows out to the steps of a fit.  A key with both labels counts as 1.
    """
    rows, sizes = training_rows(labels, label, key)
    rows = rows.withColumn("order", F.xxhash64(F.lit(17), F.col("key")))
    some = [rows.where(F.col("y") == y).orderBy("order", "key").limit(per_class) for y in (0, 1)]
    return some[0].unionByName(some[1]).select("key", "y", dealt(F.col("key")).alias("part")), sizes


@dataclass(frozen=True)
class Logistic:
    """P(1) from features; with no rows of one class it is the share of the other."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights, -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], ridge: float = 0.002, times: np.ndarray | None = None) -> Logistic:
    """By Newton's method, each class weighted to its share among all labelled rows; ``times`` says how many rows each
    one stands for."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    times = np.ones(len(y)) if times is None else np.asarray(times, float)
    width = x.shape[1]
    total = max(1, sum(sizes.values()))
    if len(set(y)) < 2:
        share = (sizes.get(1, 0) + 1) / (total + 2)
        return Logistic(np.zeros(width), np.ones(width), np.array([np.log(share / (1 - share)), *np.zeros(width)]))
    mean = np.average(x, 0, times)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, times)) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    each = times * np.where(y == 1, sizes.get(1, 1) / max(1, times[y == 1].sum()), sizes.get(0, 1) / max(1, times[y == 0].sum()))
    each = each * times.sum() / each.sum()
    w = np.zeros(width + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + ridge * np.eye(width + 1), z.T @ (each * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)
