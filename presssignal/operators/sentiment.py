"""A sentiment score per article, learnt from labelled headlines."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, RegexTokenizer, StopWordsRemover, Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.functions.text import WORD_CLASS
from presssignal.operators.features import document_frequency, english_stop_words


def _frequent_words(words: DataFrame, min_df: float) -> list[str]:
    """Words in at least ``min_df`` of the rows, or in so many rows if it is 1 or more, most frequent first.

    Counted by an aggregate: the words of a row stay in its task and nothing is cached, as ``CountVectorizer.fit`` would do.
    """
    least = min_df if min_df >= 1 else min_df * words.count()
    found = document_frequency(words, "_words").filter(F.col("df") >= F.lit(float(least)))
    frequent = [r.term for r in found.orderBy(F.desc("df"), "term").collect()]
    if not frequent:
        raise ValueError("no word is in enough rows; lower min_df")
    return frequent


def fit_sentiment(
    headlines: DataFrame,
    alpha: float = 1e-3,
    min_df: float = 0.001,
    use_word2vec: bool = False,
    vector_size: int = 50,
    seed: int = 42,
) -> PipelineModel:
    """Fit on ``title, trend`` (-1/1): tf-idf, or averaged word vectors, and log loss."""
    rows = headlines.select(F.col("title").alias("text"), (F.col("trend") > 0).cast("double").alias("label01"))
    text_stages = [
        RegexTokenizer(inputCol="text", outputCol="_raw", pattern=f"{WORD_CLASS}{{2,}}", gaps=False),
        StopWordsRemover(inputCol="_raw", outputCol="_words", stopWords=english_stop_words(), locale="en_US"),
    ]
    stages = list(text_stages)
    if use_word2vec:
        stages.append(Word2Vec(inputCol="_words", outputCol="_features", vectorSize=vector_size, minCount=2, seed=seed))
    else:
        words = PipelineModel(text_stages).transform(rows).select("_words")
        stages += [
            # the fraction bounds the vocabulary
            CountVectorizerModel.from_vocabulary(_frequent_words(words, min_df), "_words", "_counts"),
            IDF(inputCol="_counts", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol="_features", p=2.0),
        ]
    stages.append(
        LogisticRegression(
            featuresCol="_features", labelCol="label01", predictionCol="_said", elasticNetParam=1.0,
            regParam=alpha, standardization=False, maxIter=20,
        )
    )
    return Pipeline(stages=stages).fit(rows)


def score_sentiment(model: PipelineModel, articles: DataFrame, text: str = "full_text") -> DataFrame:
    """Sets ``sentiment`` to 0/1, NULL where there is no text."""
    rows = articles.withColumn("text", F.coalesce(F.col(text), F.lit("")))
    said = F.when(F.col(text).isNull(), F.lit(None)).otherwise(F.col("_said").cast("int"))
    columns = [c for c in articles.columns if c != "sentiment"]
    return model.transform(rows).select(*columns, said.alias("sentiment"))
