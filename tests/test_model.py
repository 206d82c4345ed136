import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presssignal.operators import components, features, grid, linear, report, seeded, sentiment
from presssignal.operators.linear import ModelSpec

FILLER = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]


def toy(spark, n=200, one_class=False):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        up = 1 if one_class else i % 2
        words = rng.sample(FILLER, 4) + (["profit surges"] if up else ["loss deepens"])
        rng.shuffle(words)
        rows.append(("train" if i < n * 0.8 else "test", 1 if up else -1, " ".join(words)))
    return spark.createDataFrame(rows, "split string, trend int, title string").repartition(5)


def test_separable_words_are_learnt(spark):
    specs = [ModelSpec(model_id=i, alpha=a, max_df=0.9, min_df=0.01, norm=n, loss=loss)
             for i, (a, n, loss) in enumerate([(1e-3, "l1", "hinge"), (1e-3, "l2", "hinge"), (1e-3, "l2", "log")])]
    corpus = grid.corpus_for(toy(spark), "title", [], specs)
    models = linear.train(corpus, specs)
    table = linear.scores(linear.evaluate(corpus, models)).orderBy("model_id").collect()
    assert [r.accuracy for r in table] == [1.0, 1.0, 1.0]
    for m in models:
        w = dict(zip(m.terms, m.weights))
        assert w["surges"] > 0 > w["deepens"]


def test_strong_penalty_gives_exact_zeros(spark):
    spec = ModelSpec(alpha=0.05, max_df=0.9, min_df=0.01, norm="l2")
    corpus = grid.corpus_for(toy(spark), "title", [], [spec])
    weights = linear.train(corpus, [spec])[0].weights
    assert (weights == 0).sum() > len(weights) / 2 and (weights != 0).any()


def test_result_does_not_depend_on_partitions(spark):
    spec = ModelSpec(alpha=1e-3, max_df=0.9, min_df=0.01)
    rows = toy(spark)
    a = linear.train(grid.corpus_for(rows.coalesce(1), "title", [], [spec]), [spec])[0]
    b = linear.train(grid.corpus_for(rows.repartition(7), "title", [], [spec]), [spec])[0]
    assert a.terms == b.terms and np.allclose(a.weights, b.weights, atol=1e-9)


def test_partial_sums_over_many_partitions(spark):
    spec = ModelSpec(alpha=1e-3, max_df=0.9, min_df=0.01)
    corpus = grid.corpus_for(toy(spark), "title", [], [spec])
    one = linear.train(corpus, [spec])[0]
    corpus.table = corpus.table.repartition(6)
    many = linear.train(corpus, [spec])[0]
    assert np.allclose(one.weights, many.weights, atol=1e-9)


def test_gradient_against_plain_loops(spark):
    from types import SimpleNamespace

    import pandas as pd

    rng = np.random.default_rng(1)
    dense = rng.integers(0, 3, (7, 5)).astype(float)
    dense[3] = 0
    y = np.array([1, -1, 1, -1, 1, -1, 1])
    masks = np.array([[1, 1, 1, 0, 1], [1, 1, 1, 1, 1.0]])
    weights = rng.normal(size=(2, 5)) * masks
    idf = rng.random(5) + 1
    shared = SimpleNamespace(idf=idf, masks=masks, mask_of=np.array([0, 1]), l2=np.array([True, False]),
                             log_loss=np.array([False, True]), weights=weights, intercepts=np.array([0.1, -0.2]), n_train=7,
                             plain=np.array([False, False]), smooth=None, active=1.0)
    pdf = pd.DataFrame({"y": y, "idx": [np.flatnonzero(r).astype(np.int32) for r in dense], "x": [r[np.flatnonzero(r)] for r in dense]})
    out = list(linear._gradients(SimpleNamespace(value=shared))([pdf.iloc[:3], pdf.iloc[3:]]))[0]
    for m in range(2):
        want = np.zeros(6)
        for row, label in zip(dense, y):
            x = row * idf * masks[m]
            size = np.sqrt((x * x).sum()) if m == 0 else np.abs(x).sum()
            x = x / size if size else x
            margin = label * (x @ weights[m] + shared.intercepts[m])
            pull = (1.0 if margin < 1 else 0.0) if m == 0 else 1 / (1 + np.exp(margin))
            want += -label * pull / 7 * np.append(x, 1.0)
        got = np.zeros(6)
        got[np.frombuffer(out["places"][m], "<i4")] = np.frombuffer(out["grad"][m])
        inside = np.append(masks[m] > 0, True)
        assert np.allclose(got[inside], want[inside])


def noisy(spark, n=240):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        up = rng.random() < 0.5
        words = rng.sample(FILLER, 5) + (["surges"] if up != (rng.random() < 0.15) else ["deepens"])
        rows.append(("train" if i < n * 0.8 else "test", 1 if up else -1, " ".join(words)))
    return spark.createDataFrame(rows, "split string, trend int, title string").repartition(5)


def dense_rows(corpus, spec):
    rows = corpus.table.filter("split = 'train'").collect()
    x = np.zeros((len(rows), len(corpus.terms)))
    for i, r in enumerate(rows):
        x[i, r.idx] = r.x
    x = x * (corpus.idf if spec.use_idf else 1) * linear.vocabulary_mask(corpus, spec)
    if spec.norm:
        size = np.abs(x).sum(axis=1) if spec.norm == "l1" else np.sqrt((x * x).sum(axis=1))
        x = x / np.where(size > 0, size, 1)[:, None]
    return x, np.array([r.y for r in rows])


def test_gap_falls_below_the_tolerance(spark):
    specs = [
        ModelSpec(model_id=0, alpha=0.01, max_df=0.9, min_df=0.01, norm="l2", ngram_max=1, loss="log", max_iter=400, tol=0.005),
        ModelSpec(model_id=1, alpha=0.02, max_df=0.9, min_df=0.01, norm="l2", ngram_max=1, max_iter=400, tol=0.05),
        ModelSpec(model_id=2, alpha=0.01, max_df=0.9, min_df=0.01, norm="l2", ngram_max=1, loss="log", max_iter=400, tol=0.05),
        ModelSpec(model_id=3, alpha=0.01, max_df=0.9, min_df=0.01, norm="l2", ngram_max=1, loss="log"),
    ]
    corpus = grid.corpus_for(noisy(spark), "title", [], specs)
    models = linear.train(corpus, specs)
    assert all(m.gap <= m.spec.tol for m in models[:3]) and models[3].gap == np.inf

    def objective(m):
        x, y = dense_rows(corpus, m.spec)
        margin = y * (x @ m.weights + m.intercept)
        loss = np.logaddexp(0, -margin) if m.spec.loss == "log" else np.maximum(0, 1 - margin)
        return loss.mean() + m.spec.alpha * np.abs(m.weights).sum()

    # the gap is a promise about the optimum: a far better trained model is no better than it says
    far = linear.train(corpus, [ModelSpec(alpha=0.01, max_df=0.9, min_df=0.01, norm="l2", ngram_max=1, loss="log", max_iter=400, tol=2e-4)])[0]
    assert far.gap < models[0].gap <= models[2].gap
    for m in (models[0], models[2]):
        assert objective(far) - 1e-9 <= objective(m) <= objective(far) + m.gap + 1e-9
    # with a tolerance a model does not depend on its company
    alone = linear.train(corpus, [specs[2]])[0]
    assert np.allclose(alone.weights, models[2].weights) and alone.gap == pytest.approx(models[2].gap)


def test_models_without_norm_or_idf(spark):
    specs = [ModelSpec(model_id=i, alpha=1e-3, max_df=0.9, min_df=0.01, norm=n, use_idf=u, max_iter=1) for i, (n, u) in enumerate([(None, True), ("l2", False), (None, False), ("l1", True)])]
    corpus = grid.corpus_for(noisy(spark), "title", [], specs)
    for m in linear.train(corpus, specs):
        x, y = dense_rows(corpus, m.spec)
        slope = -(y[:, None] * x).mean(axis=0)
        step = np.divide(1, np.abs(slope), out=np.zeros_like(slope), where=np.abs(slope) > 1e-15)
        moved = -step * slope
        want = np.sign(moved) * np.maximum(np.abs(moved) - step * m.spec.alpha, 0)
        assert np.allclose(m.weights, want)


def test_sums_in_a_tree(spark, monkeypatch):
    spec = ModelSpec(alpha=1e-3, max_df=0.9, min_df=0.01)
    corpus = grid.corpus_for(toy(spark), "title", [], [spec])
    corpus.table = corpus.table.repartition(9)
    whole = linear.train(corpus, [spec])[0]
    monkeypatch.setattr(linear, "_FAN", 2)
    assert np.allclose(linear.train(corpus, [spec])[0].weights, whole.weights, atol=1e-12)


def test_seeds_of_the_fit(spark):
    spec = ModelSpec(alpha=1e-3, max_df=0.9, min_df=0.01, norm="l2", ngram_max=1)
    corpus = grid.corpus_for(noisy(spark), "title", [], [spec])
    first = seeded.fit(corpus, spec, [41, 42], shard_rows=50)
    again = seeded.fit(corpus, spec, [42, 41], shard_rows=50)
    assert all((a.weights == b.weights).all() and a.intercept == b.intercept for a, b in zip(first, again[::-1]))
    assert (first[0].weights != first[1].weights).any()
    table = {r.seed: r.accuracy for r in grid.fit_stability(corpus, spec, (41, 42)).collect()}
    assert set(table) == {41, 42} and min(table.values()) > 0.7
    for m in first:
        w = dict(zip(m.terms, m.weights))
        assert w["surges"] > 0 > w["deepens"]
    strong = seeded.fit(corpus, ModelSpec(alpha=0.05, max_df=0.9, min_df=0.01, norm="l2", ngram_max=1), [7])[0]
    assert (strong.weights == 0).sum() > len(strong.weights) / 4


def test_one_pass_against_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3), int(rng.choice([-1, 1]))) for _ in range(40)]
    weights, intercept = rng.normal(size=6) * 0.1, 0.2
    got, bias = seeded.one_pass(rows, weights.copy(), intercept, ModelSpec(alpha=0.01), 5)
    w, b, u, q = weights.copy(), intercept, 0.0, np.zeros(6)
    t0 = seeded.first_step(ModelSpec(alpha=0.01))
    for t, (idx, x, y) in enumerate(rows, start=5):
        eta = 1 / (0.01 * (t0 + t))
        if y * (w[idx] @ x + b) < 1:
            w[idx] += eta * y * x
            b += eta * y * seeded.INTERCEPT_SHARE
        u += eta * 0.01
        for j in idx:
            z = w[j]
            w[j] = max(0, z - (u + q[j])) if z > 0 else min(0, z + (u - q[j]))
            q[j] += w[j] - z
    assert np.allclose(got, w) and bias == pytest.approx(b)


def test_degenerate_models_score_zero(spark):
    specs = [ModelSpec(model_id=0, max_df=0.9, min_df=0.01), ModelSpec(model_id=1, max_df=0.01, min_df=0.02)]
    rows = toy(spark)
    corpus = grid.corpus_for(rows, "title", [], specs)
    table = linear.scores(linear.evaluate(corpus, linear.train(corpus, specs))).orderBy("model_id").collect()
    assert table[0].accuracy == 1.0 and table[1].accuracy == 0.0 and table[1].tp is None
    empty = grid.corpus_for(rows, "title", [], [specs[1]])
    fitted = linear.train(empty, [specs[1]])
    assert fitted[0].degenerate and fitted[0].keyword_table(spark).count() == 0
    assert linear.scores(linear.evaluate(empty, fitted)).first().accuracy == 0.0
    single = grid.corpus_for(toy(spark, one_class=True), "title", [], [specs[0]])
    assert linear.train(single, [specs[0]])[0].degenerate


def test_unsupported_parameters_raise():
    for wrong in ({"loss": "squared"}, {"penalty": "elastic"}, {"norm": "max"}):
        with pytest.raises(ValueError):
            ModelSpec(**wrong)


def test_grid_table(spark):
    rows = grid.grid_table(spark).orderBy("model_id").collect()
    assert len(rows) == 384 and len(set(rows)) == 384
    assert rows[0].alpha == pytest.approx(1e-4) and rows[-1].alpha == pytest.approx(1e-3)
    assert [(r.ngram_max, r.norm) for r in rows[:4]] == [(2, "l1"), (2, "l2"), (1, "l1"), (1, "l2")]
    assert np.allclose(sorted({round(r.min_df, 9) for r in rows}), np.geomspace(0.01, 0.02, 4))
    assert np.allclose(sorted({round(r.max_df, 9) for r in rows}), np.geomspace(0.05, 0.2, 4))
    assert np.allclose(sorted({round(r.alpha, 12) for r in rows}), np.geomspace(1e-4, 1e-3, 6))


def test_grid_search_takes_the_first_of_equal_models(spark):
    specs = [ModelSpec(model_id=i, alpha=a, max_df=0.9, min_df=0.01) for i, a in enumerate([0.9, 1e-3, 1e-4])]
    found = grid.grid_search(toy(spark), "title", [], specs)
    assert found.accuracy == 1.0 and found.best.spec.model_id == 1
    assert found.table.count() == 3
    words = report.most_positive(found.best.keyword_table(spark), 3)
    assert "surges" in [r.term for r in words.collect()]


def test_select_on_validation(spark):
    rows = toy(spark).withColumn("split", F.when((F.col("split") == "train") & (F.hash("title") % 4 == 0), "validation").otherwise(F.col("split")))
    found = grid.grid_search(rows, "title", [], [ModelSpec(alpha=1e-3, max_df=0.9, min_df=0.01)], select_on="validation")
    assert found.accuracy > 0.9


def test_blank_texts_are_dropped(spark):
    rows = toy(spark).unionByName(spark.createDataFrame([("train", 1, None), ("test", 1, "  ")], "split string, trend int, title string"))
    spec = ModelSpec(alpha=1e-3, max_df=0.9, min_df=0.01)
    assert grid.corpus_for(rows, "title", [], [spec]).table.count() == 200


def test_scores_with_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 5, 0)], "tp long, fp long, tn long, fn long")
    row = linear.scores(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_component_weights(spark):
    words = components.component_keywords(toy(spark), "title", [], 0.01, 0.9, 1e-4, k=7)
    w = {r.term: r.weight for r in words.collect()}
    assert w["surges"] > w["deepens"]


@pytest.mark.parametrize("word2vec", [False, True])
def test_sentiment(spark, word2vec):
    model = sentiment.fit_sentiment(toy(spark).select("title", "trend"), use_word2vec=word2vec)
    articles = spark.createDataFrame([(1, "wordd profit surges"), (2, "loss deepens wordd"), (3, None)], "i int, full_text string")
    got = {r.i: r.sentiment for r in sentiment.score_sentiment(model, articles).collect()}
    assert got[3] is None
    if not word2vec:
        assert (got[1], got[2]) == (1, 0)


@pytest.mark.parametrize("min_df", [0.02, 0.1, 1.0])
def test_candidates_hold_every_frequent_term(spark, min_df, monkeypatch):
    """Summaries so small that they are cut, batches of a few rows, terms that only some partitions hold."""
    monkeypatch.setattr(features, "SUMMARY_ROOM", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = [
            (i, ["all", "all"] + [f"half{i % 2}", f"late{i // 100}", f"ten{i % 10}"] + [f"once{i}_{k}" for k in range(30)])
            for i in range(1000)
        ] + [(1000, []), (1001, None)]
        docs = spark.createDataFrame(rows, "i int, terms array<string>").repartitionByRange(7, "i")
        exact = {(r.term, r.df) for r in features.fit_vocabulary(docs, min_df, 1.0).collect()}
        assert {(r.term, r.df) for r in features.fit_vocabulary_by_candidates(docs, min_df, 1.0).collect()} == exact
        # 30 000 terms are in one document each
        candidates = [r.term for r in features.candidate_terms(docs, min_df).collect()]
        assert len(candidates) == len(set(candidates)) < 30_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_candidates_of_nothing(spark):
    docs = spark.createDataFrame([], "terms array<string>")
    assert features.fit_vocabulary_by_candidates(docs, 0.5, 1.0).count() == 0
    with pytest.raises(ValueError):
        features.candidate_terms(docs, 0.0)


def test_candidates_are_counted_in_buckets(spark):
    """No task holds terms as Python objects, and few rare terms share a full bucket."""
    docs = spark.range(500).select(F.array(F.lit("all"), F.lit(None), *(F.concat(F.lit(f"w{k}_"), "id") for k in range(40))).alias("terms"))
    candidates = features.candidate_terms(docs, 0.1)
    assert "InArrow" not in candidates._jdf.queryExecution().executedPlan().toString()
    found = [r.term for r in candidates.collect()]
    assert "all" in found and None not in found and len(found) < 100


def test_rare_terms_are_left_where_they_lie(spark):
    """The vocabulary and the joined weights move only terms of buckets that are full enough; NULL terms count as before."""
    docs = spark.range(300).select("id", F.array(F.lit("all"), F.lit(None), *(F.concat(F.lit(f"w{k}_"), F.col("id") % (k + 1)) for k in range(20))).alias("terms"))
    plain = features.document_frequency(docs).filter(features.within_bounds(F.col("df"), F.lit(300), 0.1, 1.0))
    found = features.fit_vocabulary(docs, 0.1, 1.0)
    assert {(r.term, r.df) for r in found.collect()} == {(r.term, r.df) for r in plain.collect()}
    weights = features.tfidf_joined(docs.select("id", F.array_compact("terms").alias("terms")), found, "id", None)
    known = [r.term for r in found.collect() if r.term]
    expected = docs.select("id", F.explode("terms").alias("term")).filter(F.col("term").isin(known)).distinct()
    assert weights.count() == expected.count()
    for frame in (found, weights):
        assert "_bucket" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_sentiment_words_are_counted_by_rows(spark):
    """In how many rows a word is decides, and the order is that of these counts."""
    rows = [("often often often often good", 1), ("bank good", 1), ("bank bad", -1), ("bad lone", -1), ("bank bad", -1)]
    headlines = spark.createDataFrame(rows, "title string, trend int")
    for min_df in (2.0, 0.4):
        assert sentiment.fit_sentiment(headlines, min_df=min_df).stages[2].vocabulary == ["bad", "bank", "good"]
    with pytest.raises(ValueError):
        sentiment.fit_sentiment(headlines, min_df=4.0)
