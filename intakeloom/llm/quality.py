"""Quality classifier: support vectors on n-gram indicators scaled by naive Bayes.

Indicators of words, word shapes and shape pairs are multiplied by the log ratio
of their smoothed counts in the two classes, and a linear hinge-loss model is
fitted by dual coordinate descent.  A part of the sample is kept out of the fit
and turns margins into probabilities.

* Fitted on at most ``limit`` labelled rows (the least id hashes of the training
  folds), which the driver holds; every text is scored whole.
* A document with several labels counts as good if one of them is; null labels
  and ids are ignored.  With labels of one class only, or none, every score is
  the share of good labels (1/2 without labels).
* Null and empty texts have no features and get the score of the bias.
* Columns of the input pass through; one named ``quality_score`` is replaced.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeloom.llm import features as ft

FOLDS, HELD_OUT = 3, 1


def log_ratios(flat: np.ndarray, starts: np.ndarray, label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Per feature the log ratio of its smoothed, normalised counts in the classes."""
    row_label = np.repeat(label, np.diff(starts))
    good = np.bincount(flat[row_label > 0], minlength=ft.SIZE) + smooth
    bad = np.bincount(flat[row_label <= 0], minlength=ft.SIZE) + smooth
    return np.log((good / good.sum()) / (bad / bad.sum()))


def coordinate_descent(
    lists: list[np.ndarray], values: np.ndarray, label: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model, one dual variable at a time."""
    sign = np.where(label > 0, 1.0, -1.0)
    share = {1.0: max((sign > 0).mean(), 1e-9), -1.0: max((sign < 0).mean(), 1e-9)}
    upper = np.array([cost * 0.5 / share[s] for s in sign])  # the rarer class weighs more
    weights, bias = np.zeros(ft.SIZE), 0.0
    parts = []
    for found in lists:
        value = values[found]
        norm = np.sqrt((value * value).sum() + 1e-12)
        parts.append((found, value / norm))
    alpha = np.zeros(len(lists))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for k in order.permutation(len(lists)):
            found, value = parts[k]
            slope = sign[k] * (weights[found] @ value + bias) - 1
            fresh = min(max(alpha[k] - slope / 2, 0.0), upper[k])  # squared norm 1, and 1 for the bias
            step = (fresh - alpha[k]) * sign[k]
            if step:
                weights[found] += step * value
                bias += step
                alpha[k] = fresh
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def fit(documents: DataFrame, labels: DataFrame, limit: int = 6000) -> ft.Model:
    """The fitted model; without both classes one that gives the share of good labels."""
    ids = (
        labels.select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("double").alias("label"))
        .where("sample_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("sample_id")
        .agg(F.max("label").alias("label"))
        .where(ft.fold(F.col("sample_id"), FOLDS) != HELD_OUT)
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(limit)
    )
    rows = ft.fetched(documents, ids, ft.Shapes, limit)
    label = np.array([row[1] for row in rows])
    if not rows or label.min() == label.max():
        return ft.constant(float(label.mean()) if rows else 0.5)
    apart = ft.apart([row[0] for row in rows], label)
    lists = [row[2] for row in rows]
    inner = np.flatnonzero(~apart)
    flat, starts = ft.rows_of([lists[k] for k in inner])
    ratios = log_ratios(flat, starts, label[inner])
    weights, bias = coordinate_descent([lists[k] for k in inner], ratios, label[inner])
    model = ft.Model(weights * ratios, bias, squares=ratios * ratios)
    outer = np.flatnonzero(apart) if apart.any() else inner
    margin = np.array([model.margin(lists[k]) for k in outer])
    slope, shift = ft.calibrated(margin, label[outer])
    return replace(model, slope=slope, shift=shift)


def scored(documents: DataFrame, labels: DataFrame, limit: int = 6000, text_col: str = "text") -> DataFrame:
    """``documents`` with ``quality_score``, higher for better texts."""
    return ft.scored(documents, ft.Shapes, fit(documents, labels, limit), "quality_score", text_col)
