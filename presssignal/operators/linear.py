"""Sparse linear text classifiers.

Many models over one corpus are trained together. The documents become one table of sparse
rows over the loosest vocabulary; a model is a mask on that vocabulary plus a row norm, so
nothing is tokenised or stored twice. Each epoch is one Spark job: every partition turns
its rows into a partial gradient per model (numpy on Arrow batches), Spark sums the
partials in a tree, and the weights - whose size does not depend on the number of documents - are
updated and broadcast again.

The update is the proximal sub-gradient step with per-coordinate step sizes (Duchi, Hazan
and Singer 2011; forward-backward splitting, Duchi and Singer 2009). It does not depend on
how the rows are partitioned.

Models with a tolerance take accelerated proximal steps instead (Beck and Teboulle 2009, restarted as
O'Donoghue and Candes 2015 do), whose sizes are set per term by sums over the rows, and stop by themselves. The same
job then sums the objective and what a point of the dual problem needs: how much the rows of each class
still pull, and their gradient. Balanced between the classes and scaled until no term pulls harder than
the penalty holds, the pulls bound the optimum from below. A model whose best objective is within
``tol`` of its best bound is done and leaves the jobs. The hinge is rounded off over a stretch of ``tol`` for the
steps, not for the objective. Between epochs that look at all terms only those are summed that have a
weight or nearly pull one up.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presssignal.operators.dataset import drop_blank_texts
from presssignal.operators.features import add_terms, fit_vocabulary, tfidf_vectors
from presssignal.session import cut_lineage

LOSSES = ("hinge", "log")
PENALTIES = ("l1", "l2", "none")
_CELLS_PER_PASS = 8_000_000  # weights trained together, at most
_ROWS_PER_BLOCK = 512
_STEP = 1.0
#: Scores are compared with the threshold to so many digits, so that ties do not hang on rounding.
_TIE_DIGITS = 9
#: A sum this small against the most that its rows can add up to is a rest of rounding.
_CANCELLED = 1e-12
#: Partial sums that one task adds up.
_FAN = 32
#: A model with a tolerance looks at all its terms in every so many epochs, else at those that pull with this share of alpha.
_ALL_TERMS_EVERY, _NEARLY = 5, 0.8
_PARTIAL_SCHEMA = "model int, part int, places binary, grad binary"


@dataclass(frozen=True)
class ModelSpec:
    """Parameters of one model. The defaults are fixed values.

    ``max_iter`` counts epochs; with a ``tol`` above 0 (for the l1 penalty) a model stops earlier, once the duality gap
    of its mean loss plus penalty is no larger. ``norm`` None leaves rows as they are, ``use_idf`` False counts terms.
    """

    model_id: int = 0
    alpha: float = 1e-3
    max_df: float = 0.5
    min_df: float = 0.016
    ngram_max: int = 2
    norm: str | None = "l1"
    loss: str = "hinge"
    penalty: str = "l1"
    max_iter: int = 5
    use_idf: bool = True
    tol: float = 0.0

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"unsupported loss: {self.loss}")
        if self.penalty not in PENALTIES:
            raise ValueError(f"unsupported penalty: {self.penalty}")
        if self.norm not in ("l1", "l2", None):
            raise ValueError(f"unsupported norm: {self.norm}")
        if self.tol and (self.penalty != "l1" or self.alpha <= 0):
            raise ValueError("a tolerance needs the l1 penalty")


@dataclass
class Corpus:
    """Sparse rows ``split, y, idx, x`` (x = term counts) and the vocabulary behind ``idx``."""

    spark: SparkSession
    table: DataFrame | None
    terms: list[str]
    df: np.ndarray
    ngram: np.ndarray
    idf: np.ndarray
    n_train: int
    n_classes: int


@dataclass
class Fitted:
    """One trained model: weights over ``terms`` (zero off its own vocabulary)."""

    spec: ModelSpec
    terms: list[str]
    in_vocabulary: np.ndarray
    weights: np.ndarray
    intercept: float
    degenerate: bool
    #: How far the objective may be from the optimum; infinite for models without a tolerance.
    gap: float = float("inf")

    def keyword_table(self, spark: SparkSession) -> DataFrame:
        """``term, weight`` for every vocabulary term, zeros included."""
        used = np.flatnonzero(self.in_vocabulary)
        frame = pd.DataFrame(
            {"term": [self.terms[i] for i in used], "weight": self.weights[used].astype(float)}
        )
        return spark.createDataFrame(frame, "term string, weight double")


def prepare(
    split_rows: DataFrame,
    text: str,
    stop_words: list[str],
    min_df: float,
    max_df: float,
    ngram_max: int,
) -> Corpus:
    """Tokenise once and keep sparse rows within the loosest bounds.

    ``split_rows`` needs ``split`` and ``trend`` (-1/1). ``min_df`` must be above 0: that
    bounds the vocabulary by (mean distinct terms per document) / min_df.
    """
    if min_df <= 0:
        raise ValueError("min_df must be a fraction above 0")
    spark = split_rows.sparkSession
    rows = cut_lineage(
        drop_blank_texts(split_rows, text).select("split", F.col("trend").alias("y"), F.col(text).alias("text"))
    )
    docs = add_terms(rows, "text", stop_words, ngram_max)
    train = docs.filter(F.col("split") == "train")
    counted = rows.filter(F.col("split") == "train").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("k")
    ).first()
    found = fit_vocabulary(train, min_df, max_df).select("term", "df", "ngram", "idf").toPandas() if counted.n else None
    if found is None or found.empty:
        return Corpus(spark, None, [], np.zeros(0), np.zeros(0, dtype=int), np.zeros(0), counted.n, counted.k)
    found = found.sort_values("term", kind="stable").reset_index(drop=True)
    model = CountVectorizerModel.from_vocabulary(found["term"].tolist(), "terms", "counts")
    sparse = model.transform(docs).select("split", "y", F.unwrap_udt("counts").alias("v"))
    table = cut_lineage(sparse.select("split", "y", F.col("v.indices").alias("idx"), F.col("v.values").alias("x")))
    return Corpus(
        spark, table, found["term"].tolist(), found["df"].to_numpy(float), found["ngram"].to_numpy(int),
        found["idf"].to_numpy(float), int(counted.n), int(counted.k),
    )


# --- inside the tasks ---------------------------------------------------------------


# Every task gets one plain namespace: idf, masks (mask, term), mask_of (model -> mask),
# l2, plain and log_loss (model -> bool), weights (model, term), intercepts, n_train, active
# (model, term), and smooth (model -> stretch of the hinge), which is None without a tolerance.


def _blocks(batches, shared):
    """Dense blocks over the columns that occur, with the row norms of every model."""
    rows = max(1, min(_ROWS_PER_BLOCK, _CELLS_PER_PASS // max(1, len(shared.idf))))
    for pdf in batches:
        for start in range(0, len(pdf), rows):
            part = pdf.iloc[start : start + rows]
            lengths = part["idx"].map(len).to_numpy()
            if lengths.sum():
                flat = np.concatenate(part["idx"].to_numpy()).astype(int)
                values = np.concatenate(part["x"].to_numpy()).astype(float) * shared.idf[flat]
            else:
                flat, values = np.zeros(0, dtype=int), np.zeros(0)
            columns, position = np.unique(flat, return_inverse=True)
            block = np.zeros((len(part), len(columns)))
            block[np.repeat(np.arange(len(part)), lengths), position] = values
            masks = shared.masks[:, columns].T
            l1, l2 = np.abs(block) @ masks, np.sqrt((block * block) @ masks)
            size = np.where(shared.l2, l2[:, shared.mask_of], l1[:, shared.mask_of])
            inverse = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
            inverse[:, shared.plain] = 1.0
            scores = (block @ shared.weights[:, columns].T) * inverse + shared.intercepts
            yield part["y"].to_numpy(float)[:, None], block, columns, inverse, scores


def _entropy(p):
    return -(p * np.log(np.maximum(p, 1e-300)) + (1 - p) * np.log(np.maximum(1 - p, 1e-300)))


def _gradients(shared_var):
    """Per model the cells: gradient by term, and by intercept; with a tolerance also by term that of the positive
    rows alone, the pulls of both classes, the dual's entropy and the loss."""

    def run(batches):
        shared = shared_var.value
        models, terms = shared.weights.shape
        gaps = shared.smooth is not None
        total, bias, seen = np.zeros((models, terms)), np.zeros(models), False
        positive, sums = np.zeros((models, terms if gaps else 0)), np.zeros((models, 4 if gaps else 0))
        for y, block, columns, inverse, scores in _blocks(batches, shared):
            margin = np.round(y * scores, _TIE_DIGITS)
            hinge = np.clip((1 - margin) / shared.smooth, 0, 1) if gaps else (margin < 1).astype(float)
            pull = np.where(shared.log_loss, 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500))), hinge)
            slope = -y * pull / shared.n_train
            mask = shared.masks[shared.mask_of][:, columns]
            total[:, columns] += ((slope * inverse).T @ block) * mask
            bias += slope.sum(axis=0)
            if gaps:
                positive[:, columns] += ((slope * (y > 0) * inverse).T @ block) * mask
                loss = np.where(shared.log_loss, np.logaddexp(0, -margin), np.maximum(0, 1 - margin))
                entropy = np.where(shared.log_loss, _entropy(pull), pull)
                parts = (pull * (y > 0), pull * (y < 0), entropy, loss)
                sums += np.column_stack([p.sum(axis=0) for p in parts]) / shared.n_train
            seen = True
        if seen:
            cells = np.column_stack([total * shared.active, bias, positive * (shared.active if gaps else 1), sums])
            task = TaskContext.get()
            part = task.partitionId() if task else 0
            yield _sparse(np.arange(models), part, cells)

    return run


def _curvatures(shared_var):
    """Per model, by term and intercept: how fast a gradient may change, for steps of all terms at once."""

    def run(batches):
        shared = shared_var.value
        models, terms = shared.weights.shape
        total, bias = np.zeros((models, terms)), np.zeros(models)
        for _, block, columns, inverse, _ in _blocks(batches, shared):
            mask = shared.masks[shared.mask_of][:, columns]
            size = np.abs(block) @ mask.T * inverse + 1
            total[:, columns] += ((size * inverse).T @ np.abs(block)) * mask / shared.n_train
            bias += size.sum(axis=0) / shared.n_train
        task = TaskContext.get()
        yield _sparse(np.arange(models), task.partitionId() if task else 0, np.column_stack([total, bias]))

    return run


def _sparse(models, part: int, cells) -> pd.DataFrame:
    """One row per model: where its partial gradient is not zero, and the values there."""
    places = [np.flatnonzero(row) for row in cells]
    return pd.DataFrame(
        {
            "model": models,
            "part": part,
            "places": [p.astype("<i4").tobytes() for p in places],
            "grad": [row[p].tobytes() for row, p in zip(cells, places)],
        }
    )


def _add_up(size: int, fan: int):
    """Sum the partial gradients of ``fan`` neighbouring parts of a model, in the order of the parts.

    The order is fixed, so equal runs give equal weights to the last bit. Rows come sorted by model and
    part, so one sum is held at a time.
    """

    def run(batches):
        current, total = None, np.zeros(size)
        for pdf in batches:
            for model, part, places, cells in zip(pdf["model"], pdf["part"], pdf["places"], pdf["grad"]):
                if (model, part // fan) != current:
                    if current is not None:
                        yield _sparse([current[0]], current[1], total[None])
                    current, total = (model, part // fan), np.zeros(size)
                total[np.frombuffer(places, "<i4")] += np.frombuffer(cells)
        if current is not None:
            yield _sparse([current[0]], current[1], total[None])

    return run


def _summed(partials: DataFrame, parts: int, models: int, size: int) -> DataFrame:
    """One row per model, added up in a tree: no task reads more than ``_FAN`` parts of a sum."""
    while True:
        groups = -(-parts // _FAN)
        dealt = partials.repartition(min(parts, models) * groups, F.col("model"), F.floor(F.col("part") / _FAN))
        partials = dealt.sortWithinPartitions("model", "part").mapInPandas(_add_up(size, _FAN), _PARTIAL_SCHEMA)
        parts = groups
        if parts <= 1:
            return partials


def _tallies(shared_var):
    def run(batches):
        shared = shared_var.value
        models = shared.weights.shape[0]
        counts = np.zeros((4, models), dtype=int)
        for y, _, _, _, scores in _blocks(batches, shared):
            positive, actual = np.round(scores, _TIE_DIGITS) > 0, y > 0
            counts += np.stack(
                [
                    (positive & actual).sum(axis=0),
                    (positive & ~actual).sum(axis=0),
                    (~positive & ~actual).sum(axis=0),
                    (~positive & actual).sum(axis=0),
                ]
            )
        yield pd.DataFrame(
            {"model": np.arange(models), "tp": counts[0], "fp": counts[1], "tn": counts[2], "fn": counts[3]}
        )

    return run


# --- on the driver: the loop over epochs --------------------------------------------


def vocabulary_mask(corpus: Corpus, spec: ModelSpec) -> np.ndarray:
    low, high = spec.min_df * corpus.n_train, spec.max_df * corpus.n_train
    return (corpus.df >= low) & (corpus.df <= high) & (corpus.ngram <= spec.ngram_max)


def _shared_for(corpus: Corpus, specs: list[ModelSpec], weights, intercepts, smooth=None, active=1.0) -> SimpleNamespace:
    """What the tasks need for models that agree in ``use_idf``."""
    kinds = sorted({(s.min_df, s.max_df, s.ngram_max) for s in specs})
    masks = np.stack(
        [
            vocabulary_mask(corpus, replace(specs[0], min_df=lo, max_df=hi, ngram_max=n)).astype(float)
            for lo, hi, n in kinds
        ]
    )
    where = {kind: i for i, kind in enumerate(kinds)}
    return SimpleNamespace(
        idf=corpus.idf if specs[0].use_idf else np.ones_like(corpus.idf),
        masks=masks,
        mask_of=np.array([where[(s.min_df, s.max_df, s.ngram_max)] for s in specs]),
        l2=np.array([s.norm == "l2" for s in specs]),
        plain=np.array([s.norm is None for s in specs]),
        log_loss=np.array([s.loss == "log" for s in specs]),
        weights=weights,
        intercepts=intercepts,
        n_train=corpus.n_train,
        smooth=smooth,
        active=active,
    )


def _shrink(weights, step, specs):
    alpha = np.array([s.alpha for s in specs])[:, None]
    l1 = np.array([s.penalty == "l1" for s in specs])[:, None]
    l2 = np.array([s.penalty == "l2" for s in specs])[:, None]
    weights = np.where(l1, np.sign(weights) * np.maximum(np.abs(weights) - step * alpha, 0.0), weights)
    return np.where(l2, weights / (1.0 + step * alpha), weights)


def _dual_bound(cells, alpha, log_loss):
    """The dual objective of averaged pulls, balanced between the classes and scaled to be feasible.

    Scaling by s keeps at least s of the entropy, which is concave and 0 at 0.
    """
    terms = (cells.shape[1] - 3) // 2
    up, down = cells[:, 2 * terms], cells[:, 2 * terms + 1]
    least = np.minimum(up, down)
    keep_up, keep_down = (np.divide(least, pulls, out=np.zeros_like(least), where=pulls > 0) for pulls in (up, down))
    force = np.abs(keep_up[:, None] * cells[:, :terms] + keep_down[:, None] * cells[:, terms : 2 * terms]).max(axis=1, initial=0)
    scale = np.minimum(1, np.divide(alpha, force, out=np.ones_like(force), where=force > 0))
    entropy = np.where(log_loss, np.minimum(keep_up, keep_down) * cells[:, -1], 2 * least)
    return scale * entropy


def _totals(corpus: Corpus, shared: SimpleNamespace, tasks, width: int) -> np.ndarray:
    """One job over the training rows: ``tasks`` per partition, added up to ``width`` cells per model."""
    sent = corpus.spark.sparkContext.broadcast(shared)
    train = corpus.table.filter(F.col("split") == "train").select("y", "idx", "x")
    cells = np.zeros((len(shared.weights), width))
    summed = _summed(train.mapInPandas(tasks(sent), _PARTIAL_SCHEMA), train.rdd.getNumPartitions(), len(cells), width)
    for model, places, values in zip(*summed.select("model", "places", "grad").toArrow().to_pydict().values()):
        cells[model, np.frombuffer(places, "<i4")] = np.frombuffer(values)
    sent.unpersist()
    return cells


def _train_group(corpus: Corpus, specs: list[ModelSpec]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and intercepts after ``max_iter`` epochs, of models that agree in ``use_idf``; no gaps are known."""
    terms = len(corpus.terms)
    weights, intercepts = np.zeros((len(specs), terms)), np.zeros(len(specs))
    squares, bias_squares = np.zeros_like(weights), np.zeros_like(intercepts)
    epochs = np.array([s.max_iter for s in specs])
    rest = _CANCELLED * np.append(corpus.df / corpus.n_train, 1.0)
    for epoch in range(int(epochs.max())):
        shared = _shared_for(corpus, specs, weights, intercepts)
        gradient = _totals(corpus, shared, _gradients, terms + 1)
        # contributions that cancel leave a rest of rounding, which the step size would blow up
        gradient[np.abs(gradient) < rest] = 0.0
        live = (epochs > epoch)[:, None]
        slope = gradient[:, :-1] * shared.masks[shared.mask_of] * live
        squares += slope * slope
        step = _STEP / np.sqrt(np.where(squares > 0, squares, np.inf))
        weights = np.where(live, _shrink(weights - step * slope, step, specs), weights)
        bias_slope = gradient[:, -1] * live[:, 0]
        bias_squares += bias_slope * bias_slope
        intercepts = intercepts - _STEP * bias_slope / np.sqrt(np.where(bias_squares > 0, bias_squares, np.inf))
    return weights, intercepts, np.full(len(specs), np.inf)


def _converge_group(corpus: Corpus, specs: list[ModelSpec]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, intercepts and duality gaps of models with a tolerance that agree in ``use_idf``."""
    terms, models = len(corpus.terms), len(specs)
    tol, alpha = np.array([s.tol for s in specs]), np.array([s.alpha for s in specs])
    epochs, log_loss = np.array([s.max_iter for s in specs]), np.array([s.loss == "log" for s in specs])
    last, ahead, turn = np.zeros((models, terms + 1)), np.zeros((models, terms + 1)), np.ones(models)
    best, objective, bound = ahead.copy(), np.full(models, np.inf), np.full(models, -np.inf)
    mean, looks, active = np.zeros((models, 2 * terms + 3)), np.zeros(models), np.ones((models, terms))
    curved = _totals(corpus, _shared_for(corpus, specs, ahead[:, :-1], ahead[:, -1]), _curvatures, terms + 1)
    step = 1 / np.where(curved > 0, curved * np.where(log_loss, 0.25, 1 / tol)[:, None], np.inf)
    for epoch in range(int(epochs.max())):
        at = np.flatnonzero((epochs > epoch) & (objective - bound > tol))
        if not len(at):
            break
        full = epoch % _ALL_TERMS_EVERY == 0
        shared = _shared_for(
            corpus, [specs[i] for i in at], ahead[at, :-1], ahead[at, -1], tol[at], 1.0 if full else active[at])
        cells = _totals(corpus, shared, _gradients, 2 * terms + 5)
        gradient, positive, sums = cells[:, : terms + 1], cells[:, terms + 1 : -4], cells[:, -4:]
        now = sums[:, 3] + alpha[at] * np.abs(ahead[at, :-1]).sum(axis=1)
        better = now < objective[at]
        objective[at[better]], best[at[better]] = now[better], ahead[at[better]]
        if full:
            looks[at] += 1
            pulls = np.column_stack([positive, gradient[:, :-1] - positive, sums[:, :3]])
            share = (2 / (looks[at] + 1))[:, None]
            mean[at] = (1 - share) * mean[at] + share * pulls
            for some in (pulls, mean[at]):
                bound[at] = np.maximum(bound[at], _dual_bound(some, alpha[at], log_loss[at]))
            active[at] = np.abs(gradient[:, :-1]) >= _NEARLY * alpha[at, None]
        new = ahead[at] - step[at] * gradient
        cut = np.maximum(np.abs(new[:, :-1]) - step[at, :-1] * alpha[at, None], 0)
        new[:, :-1] = np.sign(new[:, :-1]) * cut
        # momentum that points uphill is dropped
        uphill = ((ahead[at] - new) * (new - last[at]) / np.where(step[at] > 0, step[at], np.inf)).sum(axis=1) > 0
        turn[at] = np.where(uphill, 1.0, turn[at])
        longer = (1 + np.sqrt(1 + 4 * turn[at] ** 2)) / 2
        ahead[at] = new + ((turn[at] - 1) / longer)[:, None] * (new - last[at])
        active[at] = np.maximum(active[at], ahead[at, :-1] != 0)
        last[at], turn[at] = new, longer
    return best[:, :-1], best[:, -1], objective - bound


def _groups(corpus: Corpus, models: list, spec_of) -> list[list]:
    """Models that are handled together: alike in ``use_idf`` and in having a tolerance, and of a bounded number of cells."""
    size = max(1, _CELLS_PER_PASS // max(1, len(corpus.terms)))
    kinds = [[m for m in models if (spec_of(m).use_idf, spec_of(m).tol > 0) == kind] for kind in product((True, False), repeat=2)]
    return [kind[at : at + size] for kind in kinds for at in range(0, len(kind), size)]


def train(corpus: Corpus, specs: list[ModelSpec]) -> list[Fitted]:
    """Train all models; those without a vocabulary or with one class are degenerate."""
    fitted: dict[int, Fitted] = {}
    ready = []
    for i, spec in enumerate(specs):
        mask = vocabulary_mask(corpus, spec)
        if corpus.table is None or not mask.any() or corpus.n_classes < 2:
            fitted[i] = Fitted(spec, corpus.terms, mask, np.zeros(len(corpus.terms)), 0.0, True)
        else:
            ready.append((i, spec, mask))
    for part in _groups(corpus, ready, lambda m: m[1]):
        fit = _converge_group if part[0][1].tol else _train_group
        for (i, spec, mask), w, b, gap in zip(part, *fit(corpus, [spec for _, spec, _ in part])):
            fitted[i] = Fitted(spec, corpus.terms, mask, w, float(b), False, float(gap))
    return [fitted[i] for i in range(len(specs))]


TALLY_SCHEMA = "model_id int, tp bigint, fp bigint, tn bigint, fn bigint"


def evaluate(corpus: Corpus, models: list[Fitted], split: str = "test") -> DataFrame:
    """``model_id, tp, fp, tn, fn`` on one split; degenerate models have NULL counts."""
    spark = corpus.spark
    live = [m for m in models if not m.degenerate]
    dead = spark.createDataFrame(
        [(m.spec.model_id, None, None, None, None) for m in models if m.degenerate], TALLY_SCHEMA
    )
    out = dead
    rows = None if corpus.table is None else corpus.table.filter(F.col("split") == split).select("y", "idx", "x")
    for part in _groups(corpus, live, lambda m: m.spec):
        shared = _shared_for(
            corpus,
            [m.spec for m in part],
            np.stack([m.weights for m in part]),
            np.array([m.intercept for m in part]),
        )
        sent = spark.sparkContext.broadcast(shared)
        ids = F.array(*[F.lit(m.spec.model_id) for m in part])
        tallied = (
            rows.mapInPandas(_tallies(sent), "model int, tp bigint, fp bigint, tn bigint, fn bigint")
            .groupBy("model")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
            .select(F.element_at(ids, F.col("model") + 1).alias("model_id"), "tp", "fp", "tn", "fn")
        )
        out = out.unionByName(tallied)
    return out


def scores(tallies: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 where undefined."""

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        tallies.withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )


# --- single models in DataFrame form ------------------------------------------------


def predict_terms(weights_long: DataFrame, model: DataFrame, doc_id: str, intercept: float = 0.0) -> DataFrame:
    """``doc_id, score, prediction`` (-1/1): weights joined on the term, summed per document.

    ``model`` is ``term, weight``. Documents without any model term score the intercept.
    """
    words = model.filter(F.col("weight") != 0).select("term", "weight")
    total = F.coalesce(F.sum(F.col("tfidf") * F.col("weight")), F.lit(0.0)) + F.lit(intercept)
    return (
        weights_long.join(words, "term", "left")
        .groupBy(doc_id)
        .agg(total.alias("score"))
        .withColumn("prediction", F.when(F.col("score") > 0, 1).otherwise(-1))
    )


def predict_rows(
    docs: DataFrame, model: DataFrame, doc_id: str, intercept: float = 0.0, terms: str = "terms"
) -> DataFrame:
    """``doc_id, score, prediction`` by term counts: every document is scored in its own row.

    The model's words become the index of sparse vectors, so it must be bounded (fitted with a
    ``min_df`` above 0); nothing is shuffled. ``predict_terms`` takes any model.
    """
    found = model.filter(F.col("weight") != 0).select("term", "weight").toPandas().sort_values("term")
    score = F.lit(float(intercept))
    if not found.empty:
        docs = tfidf_vectors(docs, found["term"].tolist(), found["weight"].tolist(), None, terms, "_parts")
        score = score + F.aggregate(F.unwrap_udt("_parts")["values"], F.lit(0.0), lambda total, x: total + x)
    return docs.select(doc_id, score.alias("score")).withColumn(
        "prediction", F.when(F.col("score") > 0, 1).otherwise(-1)
    )


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Counts of the four outcomes; the positive class is 1."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1

    def count(test):
        return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")

    cells = [
        count(actual & said).alias("tp"),
        count(~actual & said).alias("fp"),
        count(~actual & ~said).alias("tn"),
        count(actual & ~said).alias("fn"),
    ]
    return predictions.groupBy(*by).agg(*cells) if by else predictions.agg(*cells)


def train_logistic(
    features: DataFrame, alpha: float, label: str = "label01", column: str = "features", max_iter: int = 20
):
    """Log loss with an l1 penalty by the built-in solver (labels 0/1)."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(
        featuresCol=column,
        labelCol=label,
        elasticNetParam=1.0,
        regParam=alpha,
        standardization=False,
        maxIter=max_iter,
    ).fit(features)
