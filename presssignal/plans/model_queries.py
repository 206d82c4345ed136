"""Queries from the core join to features, models and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from presssignal.operators import (
    components, dataset, features, grid, linear, report, sentiment, trend,
)
from presssignal.operators.linear import ModelSpec
from presssignal.plans.registry import query
from presssignal.session import cut_lineage
from presssignal.sources import files, standins

QUERY, SERIES = "en", "click.csv"
STOP = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "en", "ens"]
_CORE = standins.core_join_cte(QUERY, SERIES)


def _labels(spark, sf):
    return trend.price_labels(standins.prices(spark, sf), 5)


def labelled(spark, sf):
    return dataset.labelled_articles(standins.articles(spark, sf), _labels(spark, sf), QUERY, SERIES)


@query(f"WITH {_CORE} SELECT date, title, trend, sentiment, url, search_range, page_num FROM v_core")
def labelled_articles(spark, sf):
    """Articles with the day's label inside the relevance cuts."""
    return labelled(spark, sf)


@query(
    f"WITH {standins.core_join_cte(QUERY, SERIES, extra='AND a.sentiment = t.trend')} SELECT date, title, trend, sentiment, url, search_range, page_num FROM v_core"
)
def labelled_articles_agreeing(spark, sf):
    """The same with the sentiment equal to the label, as a join condition."""
    return dataset.labelled_articles(
        standins.articles(spark, sf), _labels(spark, sf), QUERY, SERIES, require_sentiment=True
    )


@query(
    f"WITH {_CORE} SELECT c.date, a.title, c.trend, c.url FROM v_core c JOIN v_article a ON c.url = a.url"
)
def labelled_titles(spark, sf):
    """Titles instead of bodies as the text."""
    rows = dataset.labelled_articles(
        standins.articles(spark, sf), _labels(spark, sf), QUERY, SERIES, text_col="title"
    )
    return rows.select("date", "title", "trend", "url")


@query(f"WITH {_CORE} SELECT url, trend, sentiment FROM v_core WHERE trend = sentiment")
def sentiment_agrees(spark, sf):
    return dataset.sentiment_agrees(labelled(spark, sf)).select("url", "trend", "sentiment")


@query(f"WITH {_CORE} SELECT url, CASE WHEN trend = 0 THEN -1 ELSE 1 END AS trend FROM v_core")
def class_labels(spark, sf):
    return dataset.classes(labelled(spark, sf)).select("url", "trend")


# --- splits --------------------------------------------------------------------------


def _ranked(seed: int, share: float, source: str = "v_article") -> str:
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY md5(concat('{seed}|', url)), url) AS rn, count(*) OVER () AS n FROM {source}),
split AS (SELECT *, CASE WHEN rn <= CAST(trunc(n * {share}::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {standins.V_ARTICLE}, {_ranked(7, 0.8)} SELECT url, split FROM split")
def random_split(spark, sf):
    """An exact share of all articles in seeded random order."""
    rows = standins.articles(spark, sf).select("url")
    return dataset.random_split(rows, ["url"], 0.8, seed=7)


@query(
    f"WITH {_CORE}, {_ranked(7, 0.9, 'v_core')} SELECT url, split, trend FROM split WHERE split = 'test' OR trend = sentiment"
)
def random_split_sentiment(spark, sf):
    """The cut is taken on all rows; only train rows are thinned."""
    rows = dataset.random_split(
        labelled(spark, sf), ["url"], dataset.TRAIN_SHARE_SENTIMENT, seed=7, sentiment_filter=True
    )
    return rows.select("url", "split", "trend")


@query(
    f"""WITH {standins.V_ARTICLE}, r AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM v_article),
l AS (SELECT max(date) AS d FROM r WHERE pos = CAST(trunc(n * 0.85::DOUBLE) AS BIGINT))
SELECT url, CASE WHEN date <= (SELECT d FROM l) THEN 'train' ELSE 'test' END AS split FROM v_article"""
)
def date_split(spark, sf):
    """Train up to the day at 85 percent of the rows."""
    rows = standins.articles(spark, sf).select("url", "date")
    return dataset.date_split(rows).select("url", "split")


@query(
    f"WITH {standins.V_ARTICLE} SELECT url, CASE WHEN date < DATE '2024-01-20' THEN 'train' ELSE 'test' END AS split FROM v_article WHERE date <> DATE '2024-01-20'"
)
def fixed_date_split(spark, sf):
    rows = standins.articles(spark, sf).select("url", "date")
    return dataset.fixed_date_split(rows, "2024-01-20").select("url", "split")


@query(
    f"""WITH {standins.V_ARTICLE}, r AS (SELECT url, row_number() OVER (ORDER BY date, md5(concat('0|', url)), url) AS rn, count(*) OVER () AS n FROM v_article)
SELECT url, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r"""
)
def head_tail_split(spark, sf):
    rows = standins.articles(spark, sf).select("url", "date")
    return dataset.head_tail_split(rows, ["url"]).select("url", "split")


@query(
    f"WITH {standins.V_HEADLINE} SELECT doc_id, CASE WHEN left(md5(concat('3|', CAST(doc_id AS VARCHAR))), 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS split FROM v_headline"
)
def headline_split(spark, sf):
    """Each headline decides by its own hash."""
    rows = standins.headlines(spark, sf).select("doc_id")
    return dataset.bernoulli_split(rows, ["doc_id"], 0.8, seed=3)


_SPLIT = f"{standins.V_ARTICLE}, {standins.trend_cte(5)}, {_ranked(7, 0.8)}"


def _split_titles(spark, sf):
    arts = standins.articles(spark, sf)
    rows = arts.select("url", "date", "title", F.coalesce("sentiment", F.lit(0)).alias("trend"))
    return dataset.random_split(rows, ["url"], 0.8, seed=7)


@query(
    f"""WITH {_SPLIT}, s AS (SELECT date, title, coalesce(sentiment, 0) AS trend, split FROM split)
SELECT a.date, a.title, a.trend, count(*) AS pairs FROM (SELECT * FROM s WHERE split = 'train') a
JOIN (SELECT * FROM s WHERE split = 'test') b ON a.date = b.date AND a.title = b.title AND a.trend = b.trend GROUP BY 1, 2, 3"""
)
def split_leakage(spark, sf):
    """Rows found on both sides of a split, with the pairs the join would give."""
    return dataset.leakage(_split_titles(spark, sf)).select("date", "title", "trend", "pairs")


@query(
    f"""WITH {_SPLIT}, s AS (SELECT date, full_text AS title, coalesce(sentiment, 0) AS trend, split FROM split)
SELECT a.date, a.title, a.trend, count(*) AS pairs FROM (SELECT * FROM s WHERE split = 'train') a
JOIN (SELECT * FROM s WHERE split = 'test') b ON a.date = b.date AND a.title = b.title AND a.trend = b.trend GROUP BY 1, 2, 3"""
)
def body_leakage(spark, sf):
    """The same by whole bodies, of which only leaked ones are moved."""
    arts = standins.articles(spark, sf)
    rows = arts.select("url", "date", F.col("full_text").alias("title"), F.coalesce("sentiment", F.lit(0)).alias("trend"))
    return dataset.leakage(dataset.random_split(rows, ["url"], 0.8, seed=7)).select("date", "title", "trend", "pairs")


@query(
    f"""WITH {_SPLIT}, s AS (SELECT split, CASE WHEN coalesce(sentiment, 0) = 0 THEN -1 ELSE 1 END AS trend FROM split),
g AS (SELECT split, count(*) AS rows, avg(trend) AS m FROM s GROUP BY 1)
SELECT split, rows, CAST(trunc(rows / (SELECT count(*) FROM s) * 100) AS INT) AS percent, round(m, 9) AS mean_trend, round(m / 2 + 0.5, 9) AS mean_share FROM g"""
)
def split_summary(spark, sf):
    out = dataset.split_summary(dataset.classes(_split_titles(spark, sf)))
    return out.withColumn("mean_trend", F.round("mean_trend", 9)).withColumn("mean_share", F.round("mean_share", 9))


# --- features ------------------------------------------------------------------------

_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
_TOKENS = r"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents)"""
_KEPT = f"{_TOKENS}, kept AS (SELECT doc_id, list_filter(t, lambda x: x NOT IN ({_STOP_SQL})) AS t FROM tok)"
_BIGRAMS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
_TERMS = f"{_KEPT}, terms AS (SELECT doc_id, unnest(list_concat(t, {_BIGRAMS})) AS term FROM kept)"
_COUNTS = f"{_TERMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2)"


def _docs(spark, sf):
    return standins.table(spark, sf, "documents").select("doc_id", "text")


def _terms(spark, sf, ngram_max=2):
    return features.add_terms(_docs(spark, sf), "text", STOP, ngram_max)


@query(f"WITH {_TOKENS} SELECT doc_id, array_to_string(t, ' ') AS tokens FROM tok")
def word_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(features.tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {_KEPT} SELECT doc_id, array_to_string(t, ' ') AS tokens FROM kept")
def without_stop_words(spark, sf):
    """Tokens without a short stop list joined with the searched word and its plural."""
    stop = features.stop_words_for("en", STOP[:-2])
    docs = features.add_terms(_docs(spark, sf), "text", stop, 1)
    return docs.select("doc_id", F.array_join("terms", " ").alias("tokens"))


@query(f"WITH {_KEPT} SELECT doc_id, array_to_string(list_concat(t, {_BIGRAMS}), '|') AS terms FROM kept")
def word_pairs(spark, sf):
    """Words and pairs of neighbouring words."""
    return _terms(spark, sf).select("doc_id", F.array_join("terms", "|").alias("terms"))


@query(f"WITH {_COUNTS} SELECT doc_id, term, tf FROM tf")
def term_counts(spark, sf):
    return features.term_counts(_terms(spark, sf), "doc_id")


_VOCABULARY = f"""WITH {_COUNTS}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df FROM df WHERE df >= 0.01::DOUBLE * (SELECT n FROM n) AND df <= 0.2::DOUBLE * (SELECT n FROM n)"""


@query(_VOCABULARY)
def vocabulary(spark, sf):
    """Terms between one and twenty percent of the documents."""
    return features.fit_vocabulary(_terms(spark, sf), 0.01, 0.2).select("term", "df")


@query(_VOCABULARY)
def vocabulary_by_candidates(spark, sf):
    """The same terms; only those that partitions' summaries leave possible are shuffled."""
    return features.fit_vocabulary_by_candidates(_terms(spark, sf), 0.01, 0.2).select("term", "df")


def _tfidf_sql(norm: str) -> str:
    size = "sum(abs(w)) OVER (PARTITION BY doc_id)" if norm == "l1" else "sqrt(sum(w * w) OVER (PARTITION BY doc_id))"
    return f"""WITH {_COUNTS},
s AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('5|', CAST(doc_id AS VARCHAR))), doc_id) <= CAST(trunc(count(*) OVER () * 0.8::DOUBLE) AS BIGINT) AS train FROM documents),
n AS (SELECT count(*) AS n FROM s WHERE train),
df AS (SELECT term, count(*) AS df FROM tf JOIN s USING (doc_id) WHERE train GROUP BY 1),
v AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + df)) + 1 AS idf FROM df
  WHERE df >= 0.01::DOUBLE * (SELECT n FROM n) AND df <= 0.2::DOUBLE * (SELECT n FROM n)),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN v USING (term))
SELECT doc_id, term, round(w / {size}, 8) AS tfidf FROM w"""


def _tfidf(spark, sf, norm, weigh=features.tfidf):
    # split and tokenised once: read again for the vocabulary and for the weights
    docs = dataset.random_split(_docs(spark, sf), ["doc_id"], 0.8, seed=5)
    terms = cut_lineage(features.add_terms(docs, "text", STOP, 2).select("doc_id", "split", "terms"))
    words = features.fit_vocabulary(terms.filter(F.col("split") == "train"), 0.01, 0.2)
    return weigh(terms, words, "doc_id", norm)


@query(_tfidf_sql("l1"))
def tfidf_l1(spark, sf):
    """Weights fitted on the train rows, applied to all."""
    return _tfidf(spark, sf, "l1").withColumn("tfidf", F.round("tfidf", 8))


@query(_tfidf_sql("l2"))
def tfidf_l2(spark, sf):
    return _tfidf(spark, sf, "l2").withColumn("tfidf", F.round("tfidf", 8))


@query(_tfidf_sql("l2"))
def tfidf_l2_joined(spark, sf):
    """The same by joins, the way of vocabularies too large to send around."""
    return _tfidf(spark, sf, "l2", features.tfidf_joined).withColumn("tfidf", F.round("tfidf", 8))


@query(
    f"""WITH {_COUNTS}, df AS (SELECT term, count(*) AS df, len(string_split(term, ' ')) AS k FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
g AS (SELECT i, 0.01 * pow(2.0::DOUBLE, i / 3.0::DOUBLE) AS lo FROM range(4) a(i)), h AS (SELECT j, 0.05 * pow(4.0::DOUBLE, j / 3.0::DOUBLE) AS hi FROM range(4) b(j)), m AS (SELECT unnest([1, 2]) AS ngram_max)
SELECT round(lo, 9) AS min_df, round(hi, 9) AS max_df, ngram_max,
  count(*) FILTER (WHERE df >= lo * (SELECT n FROM n) AND df <= hi * (SELECT n FROM n) AND k <= ngram_max) AS terms
FROM g, h, m, df GROUP BY 1, 2, 3"""
)
def grid_vocabulary_sizes(spark, sf):
    """Vocabulary size of every feature mask of the grid, from one pass of the terms."""
    docs = _terms(spark, sf)
    # the loosest bounds of the grid hold every mask
    terms = features.fit_vocabulary(docs, grid.MIN_DF[0], grid.MAX_DF[1])
    sizes = grid.mask_sizes(terms, docs.count(), grid.grid_table(spark))
    return sizes.withColumn("min_df", F.round("min_df", 9)).withColumn("max_df", F.round("max_df", 9))


# --- models with a fixed rule for the weights -------------------------------------------

# Weight of a word: mean class of the labelled documents that hold it, in thousandths.
_WEIGHTS = f"""{_COUNTS},
y AS (SELECT doc_id, CASE WHEN quality = 0 THEN -1 ELSE 1 END AS label FROM labels),
words AS (SELECT term, floor(avg(label) * 1000) / 1000 AS weight, count(*) AS df FROM tf JOIN y USING (doc_id)
  WHERE term NOT LIKE '% %' GROUP BY 1 HAVING count(*) >= 0.02::DOUBLE * (SELECT count(*) FROM y)
  AND count(*) <= 0.4::DOUBLE * (SELECT count(*) FROM y))"""


def _labelled_terms(spark, sf):
    labels = standins.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, -1).otherwise(1).alias("label")
    )
    docs = features.add_terms(_docs(spark, sf).join(labels, "doc_id"), "text", STOP, 1)
    return cut_lineage(docs.select("doc_id", "label", "terms"))  # tokenised once, read for weights and scores


def _fixed_weights(docs):
    """One row per word of the vocabulary with its mean class."""
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    per_term = (
        docs.select("label", F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("term")
        .agg(F.avg("label").alias("m"), F.count(F.lit(1)).alias("df"))
        .join(F.broadcast(n))
    )
    return per_term.filter(features.within_bounds(F.col("df"), F.col("_n"), 0.02, 0.4)).select(
        "term", (F.floor(F.col("m") * 1000) / 1000).alias("weight")
    )


_SCORED = f"""{_WEIGHTS}, score AS (SELECT t.doc_id, coalesce(sum(t.tf * w.weight), 0) AS score FROM tf t JOIN y USING (doc_id) LEFT JOIN words w USING (term) GROUP BY 1),
pred AS (SELECT doc_id, round(score, 6) AS score, CASE WHEN round(score, 6) > 0 THEN 1 ELSE -1 END AS prediction FROM score)"""


def _predictions(spark, sf):
    docs = _labelled_terms(spark, sf)
    said = linear.predict_rows(docs, _fixed_weights(docs), "doc_id")
    rounded = F.round("score", 6)
    return said.select("doc_id", rounded.alias("score"), F.when(rounded > 0, 1).otherwise(-1).alias("prediction"))


@query(f"WITH {_SCORED} SELECT doc_id, score, prediction FROM pred")
def predict_with_weights(spark, sf):
    """Every document scored in its row by the weights of its words."""
    return _predictions(spark, sf)


@query(
    f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn, count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM pred JOIN y USING (doc_id))
SELECT *, round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c"""
)
def confusion_scores(spark, sf):
    """Confusion counts, accuracy, precision, recall and F1."""
    labels = standins.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, -1).otherwise(1).alias("label")
    )
    out = linear.scores(linear.confusion(_predictions(spark, sf).join(labels, "doc_id")))
    for c in ("accuracy", "precision", "recall", "f1"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query(f"WITH {_WEIGHTS} SELECT term, weight FROM words ORDER BY weight, term LIMIT 7")
def most_negative_words(spark, sf):
    return report.most_negative(_fixed_weights(_labelled_terms(spark, sf)))


@query(f"WITH {_WEIGHTS} SELECT term, weight FROM words ORDER BY weight DESC, term LIMIT 7")
def most_positive_words(spark, sf):
    return report.most_positive(_fixed_weights(_labelled_terms(spark, sf)))


@query(f"WITH {_WEIGHTS} SELECT term, weight FROM words WHERE weight <> 0")
def weighted_words(spark, sf):
    """All words with a weight, ordered."""
    return report.ordered_keywords(_fixed_weights(_labelled_terms(spark, sf)))


@query(f"WITH {_WEIGHTS} SELECT count(*) AS keywords, count(*) FILTER (WHERE weight <> 0) AS nonzero FROM words")
def weighted_word_counts(spark, sf):
    return report.keyword_counts(_fixed_weights(_labelled_terms(spark, sf)))


# --- trained models ------------------------------------------------------------------------

def _trainer_sql(models: str, seed: int = 0, epochs: int = 5) -> str:
    """CTEs that train every row of ``models`` on the core join's train rows, epoch by epoch.

    Leaves ``weights(model_id, term, w)``, ``bias(model_id, b)``, ``outcome(model_id, tp, fp, tn, fn)``
    and ``m``, the models with the size of their vocabulary.
    """
    steps = [f"""w0 AS (SELECT NULL::INT AS model_id, NULL::VARCHAR AS term, 0.0::DOUBLE AS w, 0.0::DOUBLE AS sq WHERE false),
b0 AS (SELECT model_id, 0.0::DOUBLE AS b, 0.0::DOUBLE AS sq FROM m)"""]

    def scores(e: int, name: str, split: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT d.model_id, d.doc, d.y, coalesce(s.s, 0) + b.b AS score
  FROM (SELECT m.model_id, r.doc, r.y FROM m, texts r WHERE r.split = '{split}' AND m.terms > 0) d JOIN b{e} b ON b.model_id = d.model_id
  LEFT JOIN (SELECT x.model_id, x.doc, sum(x.x * w.w) AS s FROM xn x JOIN w{e} w ON w.model_id = x.model_id AND w.term = x.term GROUP BY 1, 2) s
  ON s.model_id = d.model_id AND s.doc = d.doc)"""

    for e in range(epochs):
        steps.append(scores(e, f"s{e}", "train"))
        steps.append(f"""p{e} AS MATERIALIZED (SELECT s.model_id, s.doc, -s.y / (SELECT n FROM n) * CASE WHEN m.loss = 'log'
  THEN 1 / (1 + exp(greatest(least(round(s.y * s.score, 9), 500), -500))) ELSE CASE WHEN round(s.y * s.score, 9) < 1 THEN 1 ELSE 0 END END AS slope
  FROM s{e} s JOIN m ON m.model_id = s.model_id)""")
        steps.append(f"""g{e} AS (SELECT model_id, term, CASE WHEN abs(g) < 1e-12 THEN 0 ELSE g END AS g FROM (
  SELECT x.model_id, x.term, sum(p.slope * x.x) AS g FROM xn x JOIN p{e} p ON p.model_id = x.model_id AND p.doc = x.doc GROUP BY 1, 2))""")
        steps.append(f"""w{e + 1} AS MATERIALIZED (SELECT model_id, term, CASE penalty WHEN 'l1' THEN sign(w) * greatest(abs(w) - step * alpha, 0)
  WHEN 'l2' THEN w / (1 + step * alpha) ELSE w END AS w, sq FROM (
  SELECT g.model_id, g.term, m.penalty, m.alpha, coalesce(o.sq, 0) + g.g * g.g AS sq,
    CASE WHEN coalesce(o.sq, 0) + g.g * g.g > 0 THEN 1 / sqrt(coalesce(o.sq, 0) + g.g * g.g) ELSE 0 END AS step, coalesce(o.w, 0) - step * g.g AS w
  FROM g{e} g JOIN m ON m.model_id = g.model_id LEFT JOIN w{e} o ON o.model_id = g.model_id AND o.term = g.term))""")
        steps.append(f"""b{e + 1} AS MATERIALIZED (SELECT model_id, CASE WHEN sq + g * g > 0 THEN b - g / sqrt(sq + g * g) ELSE b END AS b, sq + g * g AS sq FROM (
  SELECT b.model_id, b.b, b.sq, CASE WHEN abs(coalesce(p.g, 0)) < 1e-12 THEN 0 ELSE p.g END AS g FROM b{e} b
  LEFT JOIN (SELECT model_id, sum(slope) AS g FROM p{e} GROUP BY 1) p ON p.model_id = b.model_id))""")
    unrolled = ",\n".join(steps)
    return f"""{_CORE}, {_ranked(seed, dataset.TRAIN_SHARE, 'v_core')},
texts AS MATERIALIZED (SELECT url AS doc, title AS text, split, CASE WHEN trend = 0 THEN -1 ELSE 1 END AS y FROM split WHERE title IS NOT NULL AND trim(title) <> ''),
n AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT y) AS classes FROM texts WHERE split = 'train'),
k AS (SELECT doc, split, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP_SQL})) AS t FROM texts),
tf AS MATERIALIZED (SELECT doc, split, term, count(*) AS tf FROM (SELECT doc, split, unnest(list_concat(t, {_BIGRAMS})) AS term FROM k) GROUP BY 1, 2, 3),
models AS ({models}),
v AS MATERIALIZED (SELECT term, df, len(string_split(term, ' ')) AS grams, ln((1 + (SELECT n FROM n)) / (1 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY 1)),
mv AS MATERIALIZED (SELECT model_id, term, idf FROM v, models WHERE df >= min_df * (SELECT n FROM n) AND df <= max_df * (SELECT n FROM n) AND grams <= ngram_max),
m AS MATERIALIZED (SELECT models.*, CASE WHEN (SELECT classes FROM n) < 2 THEN 0 ELSE coalesce(c, 0) END AS terms FROM models LEFT JOIN (SELECT model_id, count(*) AS c FROM mv GROUP BY 1) USING (model_id)),
xn AS MATERIALIZED (SELECT model_id, doc, term, x / CASE norm WHEN 'l1' THEN sum(abs(x)) OVER (PARTITION BY model_id, doc) ELSE sqrt(sum(x * x) OVER (PARTITION BY model_id, doc)) END AS x
  FROM (SELECT mv.model_id, tf.doc, tf.term, tf.tf * mv.idf AS x, models.norm FROM tf JOIN mv ON mv.term = tf.term JOIN models ON models.model_id = mv.model_id)),
{unrolled},
{scores(epochs, 'tested', 'test')},
weights AS (SELECT model_id, term, w FROM w{epochs}), bias AS (SELECT model_id, b FROM b{epochs}),
outcome AS (SELECT model_id, count(*) FILTER (WHERE round(score, 9) > 0 AND y > 0) AS tp, count(*) FILTER (WHERE round(score, 9) > 0 AND y < 0) AS fp,
  count(*) FILTER (WHERE round(score, 9) <= 0 AND y < 0) AS tn, count(*) FILTER (WHERE round(score, 9) <= 0 AND y > 0) AS fn FROM tested GROUP BY 1)"""


_MEASURES = """coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""
_NINE = "round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"
_GRID_MODELS = """SELECT CAST(((a * 4 + b) * 4 + c) * 4 + d * 2 + e AS INT) AS model_id, 0.0001::DOUBLE * pow(10.0::DOUBLE, a / 5.0::DOUBLE) AS alpha,
  0.05::DOUBLE * pow(4.0::DOUBLE, b / 3.0::DOUBLE) AS max_df, 0.01::DOUBLE * pow(2.0::DOUBLE, c / 3.0::DOUBLE) AS min_df, 2 - d AS ngram_max,
  CASE e WHEN 0 THEN 'l1' ELSE 'l2' END AS norm, 'hinge' AS loss, 'l1' AS penalty
  FROM range(6) ra(a), range(4) rb(b), range(4) rc(c), range(2) rd(d), range(2) re(e)"""


def _one_model(model_id: int = 0, loss: str = "hinge", norm: str = "l1", min_df: float = 0.016, max_df: float = 0.5) -> str:
    return f"""SELECT {model_id} AS model_id, 0.001::DOUBLE AS alpha, {max_df}::DOUBLE AS max_df, {min_df}::DOUBLE AS min_df,
  2 AS ngram_max, '{norm}' AS norm, '{loss}' AS loss, 'l1' AS penalty"""


_KEYWORDS = "SELECT term, round(w, 6) AS weight FROM weights WHERE w <> 0"


def split_core(spark, sf, seed=0):
    rows = dataset.random_split(labelled(spark, sf), ["url"], dataset.TRAIN_SHARE, seed)
    return dataset.classes(rows)


def _rounded(df, columns, digits):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_SCORES = ["accuracy", "precision", "recall", "f1"]


@query(
    f"""WITH {_trainer_sql(_GRID_MODELS)}, o AS (SELECT m.model_id, round(alpha, 9) AS alpha, round(max_df, 9) AS max_df, round(min_df, 9) AS min_df,
  ngram_max, norm, loss, penalty, 5 AS max_iter, tp, fp, tn, fn, {_MEASURES} FROM m LEFT JOIN outcome USING (model_id))
SELECT * REPLACE ({_NINE}) FROM o"""
)
def grid_search(spark, sf):
    """All 384 models on the core join, scored on the test rows."""
    return _rounded(grid.grid_search(split_core(spark, sf), "title", STOP).table, ["alpha", "max_df", "min_df", *_SCORES], 9)


def _keywords(spark, sf, spec):
    corpus = grid.corpus_for(split_core(spark, sf), "title", STOP, [spec])
    return _rounded(report.ordered_keywords(linear.train(corpus, [spec])[0].keyword_table(spark)), ["weight"], 6)


@query(f"WITH {_trainer_sql(_one_model())} {_KEYWORDS}")
def model_keywords(spark, sf):
    """Word weights of one hinge model."""
    return _keywords(spark, sf, ModelSpec(alpha=1e-3, min_df=0.016, max_df=0.5))


@query(f"WITH {_trainer_sql(_one_model(loss='log', norm='l2'))} {_KEYWORDS}")
def log_model_keywords(spark, sf):
    """Word weights of a log-loss model by the same trainer."""
    return _keywords(spark, sf, ModelSpec(alpha=1e-3, min_df=0.016, max_df=0.5, loss="log", norm="l2"))


def _stability_sql(seed: int) -> str:
    return f"""(WITH {_trainer_sql(_one_model(seed), seed)}, o AS (SELECT model_id AS seed, tp, fp, tn, fn, {_MEASURES} FROM outcome)
SELECT * REPLACE ({_NINE}) FROM o)"""


@query(f"{_stability_sql(42)} UNION ALL {_stability_sql(41)}")
def seed_stability(spark, sf):
    """Scores of one parameter set under two more split seeds."""
    spec = ModelSpec(alpha=1e-3, min_df=0.016, max_df=0.5)
    return _rounded(grid.seed_stability(lambda seed: split_core(spark, sf, seed), "title", STOP, spec), _SCORES, 9)


@query()
def fit_seed_stability(spark, sf):
    """Scores of one parameter set on one split, fitted row by row under two seeds."""
    spec = ModelSpec(alpha=1e-3, min_df=0.016, max_df=0.5)
    corpus = grid.corpus_for(split_core(spark, sf), "title", STOP, [spec])
    return _rounded(grid.fit_stability(corpus, spec), _SCORES, 9)


@query()
def converged_keywords(spark, sf):
    """Word weights of a log-loss model trained until its duality gap is below its tolerance."""
    return _keywords(spark, sf, ModelSpec(alpha=1e-3, min_df=0.016, max_df=0.5, loss="log", norm="l2", max_iter=100, tol=0.01))


@query(
    f"""WITH {_trainer_sql(_one_model(1, min_df=0.9, max_df=0.1))}
SELECT m.model_id, CAST(NULL AS BIGINT) AS tp, CAST(NULL AS BIGINT) AS fp, CAST(NULL AS BIGINT) AS tn, CAST(NULL AS BIGINT) AS fn,
  CASE WHEN terms = 0 THEN 0.0::DOUBLE END AS accuracy, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1 FROM m"""
)
def degenerate_models(spark, sf):
    """A model whose bounds leave no vocabulary scores an accuracy of 0."""
    spec = ModelSpec(model_id=1, min_df=0.9, max_df=0.1)
    corpus = grid.corpus_for(split_core(spark, sf), "title", STOP, [spec])
    return linear.scores(linear.evaluate(corpus, linear.train(corpus, [spec])))


# --- models of the built-in solvers (no SQL form) -------------------------------------------


@query()
def logistic_keywords(spark, sf):
    """Word weights of a log-loss model with an l1 penalty, by the built-in solver."""
    stop = features.stop_words_for(QUERY)
    rows, terms = components.split_vectors(split_core(spark, sf), "title", stop, 0.016, 0.5)
    train = rows.filter(F.col("split") == "train").select(
        "features", (F.col("trend") > 0).cast("double").alias("label01")
    )
    train = cut_lineage(train)
    model = linear.train_logistic(train, 1e-3)
    pairs = [(t, float(w)) for t, w in zip(terms, model.coefficients.toArray())]
    return report.ordered_keywords(spark.createDataFrame(pairs, "term string, weight double"))


@query()
def component_keywords(spark, sf):
    """Weights of a model on seven singular directions, mapped back to words."""
    stop = features.stop_words_for(QUERY)
    return components.component_keywords(split_core(spark, sf), "title", stop, 0.016, 0.5, 1e-3)


@query(
    """SELECT a.i AS one, b.i AS other, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END::DOUBLE AS product, 0.0::DOUBLE AS residual
FROM range(1, 8) a(i), range(1, 8) b(i)"""
)
def component_invariants(spark, sf):
    """Of every two of the seven directions: their product, and what that of their images lacks of the singular values."""
    stop = features.stop_words_for(QUERY)
    _, entries = components.train_entries(split_core(spark, sf), "title", stop, 0.016, 0.5)
    entries = cut_lineage(entries)
    sizes, directions = components.singular_directions(entries, components.COMPONENTS)
    images = components.products(components.images(entries, directions, len(sizes)), len(sizes))
    squares = F.array(*(F.lit(float(s) ** 2) for s in sizes))
    want = F.when(F.col("one") == F.col("other"), F.element_at(squares, F.col("one").cast("int"))).otherwise(0.0)
    return (
        components.products(directions, len(sizes)).join(images.withColumnRenamed("product", "_image"), ["one", "other"])
        .select("one", "other", *((F.round(c, 8) + 0.0).alias(n) for c, n in ((F.col("product"), "product"), (F.col("_image") - want, "residual"))))
    )


@query()
def article_sentiment(spark, sf):
    """Sentiment of every article by a model of the labelled headlines."""
    model = sentiment.fit_sentiment(files.recode_polarity(standins.headlines(spark, sf)).drop("doc_id"))
    return sentiment.score_sentiment(model, standins.articles(spark, sf)).select("doc_id", "sentiment")
