"""Toxicity: non-negative learning from confirmed toxic texts and unlabelled ones.

Positives are documents labelled toxic, the unlabelled sample is drawn from all
documents.  Linear numpy classifiers minimise the risk estimated from positives
and unlabelled texts alone: the unlabelled risk of being taken for clean, less
the part that is due to toxic texts among them (the class prior times the
positives' risk), is never let below zero.  Features are words and beginnings of
words, each scaled by the log ratio of its share among positives to its
prior-corrected share among clean texts.

* The prior is the share of toxic rows among the labels of the training folds.
  Labels of a part of the sample kept out of the fit turn the mean margin of the
  classifiers into a score that is 1/2 where errors weigh least at that prior.
* Fitted on at most ``limit`` positives, ``limit`` clean labels (for the
  calibration only) and ``2 * limit`` unlabelled texts, those of the least id
  hashes, which the driver holds; every text is scored whole.
* A document with several labels counts as toxic if one of them is; null labels
  and ids are ignored.  Without a toxic label nothing is toxic (score 0).
* Null and empty texts have no features and get the score of the bias.
* Columns of the input pass through; one named ``toxicity_score`` is replaced.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeloom.llm import features as ft

FOLDS, HELD_OUT = 5, 0
CLASSIFIERS = 3
POSITIVE, CLEAN, UNLABELLED = 1.0, 0.0, -1.0


def evidence(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Per feature the log ratio of its share among positives to that among clean texts, never below zero."""
    share = []
    for lists in (positive, unlabelled):
        flat, _ = ft.rows_of(lists)
        share.append(np.bincount(flat, minlength=ft.SIZE) / max(len(lists), 1))
    clean = np.maximum(share[1] - prior * share[0], 0.0) / (1 - prior)
    smooth = 1.0 / max(len(positive), 1)
    ratio = np.log((share[0] + smooth) / (clean + 2 * smooth))
    return np.maximum(ratio, 0.0)


def non_negative_risk(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    values: np.ndarray,
    prior: float,
    seed: int,
    rounds: int = 30,
    rate: float = 0.05,
    decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias after mini-batches of the non-negative estimator with sigmoid loss (Adam steps)."""
    draw = np.random.default_rng(seed)
    size = len(values)
    weights, bias = np.zeros(size), -1.0
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    batches = max(1, min(32, len(positive) // 16, len(unlabelled) // 16))
    count = 0
    for _ in range(rounds):
        p_parts = np.array_split(draw.permutation(len(positive)), batches)
        u_parts = np.array_split(draw.permutation(len(unlabelled)), batches)
        for p_part, u_part in zip(p_parts, u_parts):
            if not len(p_part) or not len(u_part):
                continue
            sides = []
            for lists, part in ((positive, p_part), (unlabelled, u_part)):
                flat, starts = ft.rows_of([lists[k] for k in part])
                margin = ft.margins(flat, starts, weights * values) + bias
                taken = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))  # loss of a row that is clean
                sides.append((flat, starts, taken))
            p_taken, u_taken = sides[0][2], sides[1][2]
            clean_risk = u_taken.mean() - prior * p_taken.mean()
            p_slope = p_taken * (1 - p_taken) / len(p_taken)
            u_slope = u_taken * (1 - u_taken) / len(u_taken)
            if clean_risk >= 0:
                row_slopes = (-2 * prior * p_slope, u_slope)
            else:  # the estimate has gone below what can be: step back
                row_slopes = (prior * p_slope, -u_slope)
            gradient = np.zeros(size + 1)
            for (flat, starts, _), slopes in zip(sides, row_slopes):
                gradient[:-1] += np.bincount(
                    flat, np.repeat(slopes, np.diff(starts)) * values[flat], minlength=size
                )
                gradient[-1] += slopes.sum()
            gradient[:-1] += decay * weights
            count += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            step = rate * (mean / (1 - 0.9**count)) / (np.sqrt(square / (1 - 0.999**count)) + 1e-8)
            weights -= step[:-1]
            bias -= step[-1]
    return weights * values, bias


def fit(documents: DataFrame, labels: DataFrame, limit: int = 2000) -> ft.Model:
    known = (
        labels.select(F.col("doc_id").alias("sample_id"), F.col("toxic").cast("double").alias("label"))
        .where("sample_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("sample_id")
        .agg(F.max("label").alias("label"))
        .where(ft.fold(F.col("sample_id"), FOLDS) != HELD_OUT)
    )
    prior = known.agg(F.avg("label")).first()[0]
    if not prior:
        return ft.constant(0.0)
    prior = min(prior, 0.95)
    in_order = [F.xxhash64("sample_id"), F.col("sample_id")]
    unlabelled = documents.select(F.col("doc_id").alias("sample_id"), F.lit(UNLABELLED).alias("label"))
    ids = (
        known.where("label > 0").orderBy(*in_order).limit(limit)
        .unionByName(known.where("label <= 0").orderBy(*in_order).limit(limit))
        .unionByName(
            unlabelled.where("sample_id IS NOT NULL")
            .where(ft.fold(F.col("sample_id"), FOLDS) != HELD_OUT)
            .orderBy(*in_order)
            .limit(2 * limit)
        )
    )
    rows = ft.fetched(documents, ids, ft.Stems, 4 * limit)
    of = {kind: [row for row in rows if row[1] == kind] for kind in (POSITIVE, CLEAN, UNLABELLED)}
    if not of[POSITIVE] or not of[UNLABELLED]:
        return ft.constant(0.0)
    marked = of[POSITIVE] + of[CLEAN]
    label = np.array([row[1] for row in marked])
    apart = ft.apart([row[0] for row in marked], label)
    outside = {row[0] for row, out in zip(marked, apart) if out}
    positive = [row[2] for row in of[POSITIVE] if row[0] not in outside]
    crowd = [row[2] for row in of[UNLABELLED] if row[0] not in outside] or [row[2] for row in of[UNLABELLED]]
    values = evidence(positive, crowd, prior)
    # Only features that speak for toxicity have a weight; the fit sees no others.
    active = np.flatnonzero(values > 0)
    number = np.full(ft.SIZE, -1)
    number[active] = np.arange(len(active))
    told, crowd_told = ([number[x][number[x] >= 0] for x in lists] for lists in (positive, crowd))
    fits = [non_negative_risk(told, crowd_told, values[active], prior, seed) for seed in range(CLASSIFIERS)]
    weights = np.zeros(ft.SIZE)
    weights[active] = np.mean([found for found, _ in fits], 0)
    model = ft.Model(weights, float(np.mean([bias for _, bias in fits])))
    chosen = np.flatnonzero(apart) if apart.any() else np.arange(len(marked))
    margin = np.array([model.margin(marked[k][2]) for k in chosen])
    slope, _ = ft.calibrated(margin, label[chosen])
    if 0 < label[chosen].sum() < len(chosen):
        return replace(model, slope=slope, shift=-slope * ft.least_cost(margin, label[chosen], prior))
    return model


def scored(documents: DataFrame, labels: DataFrame, limit: int = 2000, text_col: str = "text") -> DataFrame:
    """``documents`` with ``toxicity_score``."""
    return ft.scored(documents, ft.Stems, fit(documents, labels, limit), "toxicity_score", text_col)
