"""Linear models fitted row by row, in an order that a seed gives.

Stochastic descent takes one step per row, so what it learns depends on the order of the rows. Rows are
dealt into shards; in each epoch every shard takes its rows one after the other, in an order of its seed and
epoch, from the same weights, and Spark averages what the shards have reached by their rows (iterative
parameter mixing; McDonald, Hall and Mann 2010). One job trains all seeds. Step sizes fall with the number of
steps (Bottou 2012), the l1 penalty is applied to a row's terms as far as it has piled up (Tsuruoka et al. 2009).
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from presssignal.operators.linear import Corpus, Fitted, ModelSpec, vocabulary_mask

#: Rows that are taken in one after the other, about.
SHARD_ROWS = 1 << 16
#: Intercepts move by smaller steps: their feature is in every row.
INTERCEPT_SHARE = 0.01

_SUMS = "seed int, place int, total double"


def first_step(spec: ModelSpec) -> float:
    """The number that steps are counted from, so that the first is no longer than a typical weight."""
    typical = math.sqrt(1 / math.sqrt(spec.alpha))
    slope = 1.0 if spec.loss == "hinge" else 1 / (1 + math.exp(-typical))
    return 1 / (typical / max(1.0, slope) * spec.alpha)


def one_pass(rows, weights: np.ndarray, intercept: float, spec: ModelSpec, start: int) -> tuple[np.ndarray, float]:
    """``weights`` and the intercept after one step per row (places, values, label); steps are counted from ``start``."""
    t0, due, paid = first_step(spec), 0.0, np.zeros(len(weights))
    for step, (idx, x, y) in enumerate(rows, start=start):
        eta = 1 / (spec.alpha * (t0 + step))
        w = weights[idx]
        margin = y * (w @ x + intercept)
        pull = float(margin < 1) if spec.loss == "hinge" else 1 / (1 + math.exp(min(max(margin, -500), 500)))
        if spec.penalty == "l2":
            weights *= 1 - min(1.0, eta * spec.alpha)
            w = weights[idx]
        if pull:
            w = w + eta * pull * y * x
            intercept += eta * pull * y * INTERCEPT_SHARE
        if spec.penalty == "l1":
            due += eta * spec.alpha
            cut = np.where(w > 0, np.maximum(0, w - (due + paid[idx])), np.minimum(0, w + (due - paid[idx])))
            paid[idx] += cut - w
            w = cut
        weights[idx] = w
    return weights, intercept


def _rows(frame: pd.DataFrame, idf: np.ndarray, mask: np.ndarray, norm: str | None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    out = []
    for idx, x, y in zip(frame["idx"], frame["x"], frame["y"]):
        idx = np.asarray(idx, np.int64)
        inside = mask[idx]
        idx, x = idx[inside], np.asarray(x, float)[inside] * idf[idx[inside]]
        size = 1.0 if norm is None else np.abs(x).sum() if norm == "l1" else math.sqrt(x @ x)
        out.append((idx, x / size if size else x, int(y)))
    return out


def fit(corpus: Corpus, spec: ModelSpec, seeds: list[int], shard_rows: int = SHARD_ROWS) -> list[Fitted]:
    """One model per seed, ``model_id`` being the seed; equal seeds give equal models on one corpus.

    Weights are bounded by the vocabulary, so those of all seeds visit the driver between epochs. A shard is one
    group of rows, dealt at random by their number, whatever they hold.
    """
    mask = vocabulary_mask(corpus, spec)
    named = [replace(spec, model_id=seed) for seed in seeds]
    if corpus.table is None or not mask.any() or corpus.n_classes < 2:
        return [Fitted(s, corpus.terms, mask, np.zeros(len(corpus.terms)), 0.0, True) for s in named]
    if spec.alpha <= 0:
        raise ValueError("steps are sized by alpha, which must be above 0")
    terms = len(corpus.terms)
    idf = corpus.idf if spec.use_idf else np.ones(terms)
    shards = -(-corpus.n_train // shard_rows)
    numbered = corpus.table.withColumn("row", F.monotonically_increasing_id()).filter("split = 'train'")
    dealt = numbered.select("row", "y", "idx", "x", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    weights, intercepts = np.zeros((len(seeds), terms)), np.zeros(len(seeds))
    for epoch in range(spec.max_iter):
        sent = corpus.spark.sparkContext.broadcast((weights, intercepts))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("row")
            rows, out = _rows(frame, idf, mask, spec.norm), []
            for at, seed in enumerate(seeds):
                order = np.random.default_rng([seed, epoch, int(frame["shard"].iloc[0])]).permutation(len(rows))
                w, b = one_pass([rows[i] for i in order], sent.value[0][at].copy(), float(sent.value[1][at]), spec, epoch * len(rows) + 1)
                places = np.flatnonzero(w)
                totals = np.concatenate([w[places], [b]]) * len(rows)
                out.append(pd.DataFrame({"seed": seed, "place": np.append(places, terms).astype(np.int32), "total": totals}))
            return pd.concat(out)

        sums = dealt.groupBy("shard").applyInPandas(run, _SUMS)
        # sums of doubles in a fixed order: equal seeds give equal weights to the last bit
        found = sums.groupBy("seed", "place").agg(F.aggregate(F.array_sort(F.collect_list("total")), F.lit(0.0), lambda t, x: t + x).alias("t"))
        weights, intercepts = np.zeros_like(weights), np.zeros_like(intercepts)
        at_of = {seed: at for at, seed in enumerate(seeds)}
        for seed, place, total in zip(*found.toArrow().to_pydict().values()):
            if place == terms:
                intercepts[at_of[seed]] = total / corpus.n_train
            else:
                weights[at_of[seed], place] = total / corpus.n_train
        sent.unpersist()
    return [Fitted(s, corpus.terms, mask, w, float(b), False) for s, w, b in zip(named, weights, intercepts)]
