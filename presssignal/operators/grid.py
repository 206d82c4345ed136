"""The hyper-parameter grid: 384 models from one sparse table."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presssignal.operators import seeded
from presssignal.operators.linear import Corpus, Fitted, ModelSpec, evaluate, prepare, scores, train

# Ends and lengths of the geometric parameter lists, and the single-valued ones.
MIN_DF = (0.01, 0.020, 4)
MAX_DF = (0.05, 0.2, 4)
ALPHA = (1e-4, 1e-3, 6)
NORMS = ["l1", "l2"]
NGRAM_MAX = [2, 1]
MAX_ITER = 5


def _geometric(bounds: tuple[float, float, int], step):
    low, high, count = bounds
    return F.lit(low) * F.pow(F.lit(high / low), step / (count - 1))


def grid_table(spark: SparkSession) -> DataFrame:
    """One row per model. ``model_id`` counts with alpha slowest, then max_df, min_df,
    n-gram range and norm fastest; ties are won by the smallest number."""
    sizes = [("alpha", ALPHA[2]), ("max_df", MAX_DF[2]), ("min_df", MIN_DF[2]), ("ngram", 2), ("norm", 2)]
    total = math.prod(n for _, n in sizes)
    df, below = spark.range(total).withColumnRenamed("id", "model_id"), total
    for name, count in sizes:
        below //= count
        df = df.withColumn(f"_{name}", F.pmod(F.floor(F.col("model_id") / below), F.lit(count)).cast("int"))
    return df.select(
        F.col("model_id").cast("int").alias("model_id"),
        _geometric(ALPHA, F.col("_alpha")).alias("alpha"),
        _geometric(MAX_DF, F.col("_max_df")).alias("max_df"),
        _geometric(MIN_DF, F.col("_min_df")).alias("min_df"),
        F.element_at(F.array(*[F.lit(n) for n in NGRAM_MAX]), F.col("_ngram") + 1).alias("ngram_max"),
        F.element_at(F.array(*[F.lit(n) for n in NORMS]), F.col("_norm") + 1).alias("norm"),
        F.lit("hinge").alias("loss"),
        F.lit("l1").alias("penalty"),
        F.lit(MAX_ITER).alias("max_iter"),
    )


def grid_specs(spark: SparkSession) -> list[ModelSpec]:
    """The grid's 384 rows as trainer parameters."""
    return [ModelSpec(**row.asDict()) for row in grid_table(spark).orderBy("model_id").collect()]


def mask_sizes(frequencies: DataFrame, n_docs: int, grid: DataFrame) -> DataFrame:
    """Vocabulary size of every (min_df, max_df, ngram_max) of the grid.

    The masks are counted as conditional sums over one pass of the term table.
    """
    from presssignal.operators.features import within_bounds

    masks = [
        (r.min_df, r.max_df, r.ngram_max)
        for r in grid.select("min_df", "max_df", "ngram_max").distinct().orderBy("min_df", "max_df", "ngram_max").collect()
    ]
    sums = []
    for lo, hi, n in masks:
        inside = within_bounds(F.col("df"), F.lit(n_docs), lo, hi) & (F.col("ngram") <= n)
        size = F.coalesce(F.sum(F.when(inside, 1).otherwise(0)), F.lit(0)).cast("bigint")
        sums.append(
            F.struct(F.lit(lo).alias("min_df"), F.lit(hi).alias("max_df"), F.lit(n).alias("ngram_max"), size.alias("terms"))
        )
    return frequencies.agg(F.array(*sums).alias("m")).select(F.inline("m"))


@dataclass
class GridResult:
    table: DataFrame  # model parameters and scores, one row per model
    best: Fitted
    accuracy: float
    corpus: Corpus


def corpus_for(split_rows: DataFrame, text: str, stop_words: list[str], specs: list[ModelSpec]) -> Corpus:
    return prepare(
        split_rows,
        text,
        stop_words,
        min(s.min_df for s in specs),
        max(s.max_df for s in specs),
        max(s.ngram_max for s in specs),
    )


def grid_search(
    split_rows: DataFrame,
    text: str,
    stop_words: list[str],
    specs: list[ModelSpec] | None = None,
    select_on: str = "test",
) -> GridResult:
    """Train every model, score it on ``select_on`` rows, refit the winner and check it.

    ``select_on='validation'`` needs rows with that split; the default picks the winner on
    the test rows.
    """
    spark = split_rows.sparkSession
    specs = grid_specs(spark) if specs is None else specs
    corpus = corpus_for(split_rows, text, stop_words, specs)
    models = train(corpus, specs)
    # one row per model: at most the size of the grid
    measured = {r["model_id"]: r for r in scores(evaluate(corpus, models, select_on)).collect()}
    winner = min(specs, key=lambda s: (-measured[s.model_id]["accuracy"], s.model_id))
    accuracy = measured[winner.model_id]["accuracy"]
    best = train(corpus, [winner])[0]
    again = scores(evaluate(corpus, [best], select_on)).first()["accuracy"]
    if not math.isclose(again, accuracy, abs_tol=1e-9):
        raise AssertionError(f"refit reached {again}, the search {accuracy}")
    parameters = ["model_id", "alpha", "max_df", "min_df", "ngram_max", "norm", "loss", "penalty", "max_iter"]
    outcomes = ["tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1"]
    result = spark.createDataFrame(
        [
            tuple(getattr(s, p) for p in parameters) + tuple(measured[s.model_id][o] for o in outcomes)
            for s in specs
        ],
        "model_id int, alpha double, max_df double, min_df double, ngram_max int, norm string, loss string,"
        " penalty string, max_iter int, tp bigint, fp bigint, tn bigint, fn bigint, accuracy double,"
        " precision double, recall double, f1 double",
    )
    return GridResult(result, best, accuracy, corpus)


def seed_stability(
    split_with_seed, text: str, stop_words: list[str], spec: ModelSpec, seeds: tuple[int, ...] = (42, 41)
) -> DataFrame:
    """Scores of one parameter set under other split seeds.

    ``split_with_seed(seed)`` returns the labelled rows split with that seed.
    """
    out = None
    for seed in seeds:
        corpus = corpus_for(split_with_seed(seed), text, stop_words, [spec])
        fitted = train(corpus, [replace(spec, model_id=seed)])
        part = scores(evaluate(corpus, fitted)).withColumnRenamed("model_id", "seed")
        out = part if out is None else out.unionByName(part)
    return out


def fit_stability(corpus: Corpus, spec: ModelSpec, seeds: tuple[int, ...] = (42, 41)) -> DataFrame:
    """Scores of one parameter set on one split, its rows taken in under other seeds."""
    return scores(evaluate(corpus, seeded.fit(corpus, spec, list(seeds)))).withColumnRenamed("model_id", "seed")
