"""Sentiment scoring of texts: by lexicon, by a trained classifier, or by any batch model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.scores import argmax, best_label, label_of, ranked, score_map, softmax
from palaver.schemas import SENTIMENTS

Scorer = Callable[[list[str]], np.ndarray]

CELLS = 1 << 17  # of a padded batch, in what texts are measured by


@dataclass(frozen=True)
class Lexicon:
    """Words per class, lower-case a-z. A text's class logit is the number of its words on the list."""

    negative: tuple[str, ...] = (
        "angry", "awful", "bad", "clown", "disgusting", "hate", "idiot", "moron", "pathetic",
        "scum", "terrible", "trash", "useless", "worst", "worthless",
    )
    positive: tuple[str, ...] = (
        "best", "excellent", "good", "great", "happy", "helpful", "love", "perfect", "thank",
        "thanks", "wonderful",
    )
    neutral_logit: float = 1.0


def word_pattern(words: Sequence[str]) -> str:
    """Any of the words, with no letter a-z on either side."""
    return f"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"


def with_scores(df: DataFrame, scores: Sequence[Column]) -> DataFrame:
    """Add the three class scores and the winning label."""
    named = df.withColumns(dict(zip(SENTIMENTS, scores, strict=True)))
    return named.withColumn("Sentiment", best_label(F.array(*SENTIMENTS)))


def lexicon_logits(df: DataFrame, text: str = "text", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Add the word counts per class: one scan of the text finds the few listed words in it."""
    either = word_pattern([*lexicon.negative, *lexicon.positive])
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(either), F.lit(0))

    def count(listed: Sequence[str]) -> Column:
        return F.size(F.filter("_found", lambda word: word.isin(list(listed)))).cast("double")

    counts = {"_neg": count(lexicon.negative), "_pos": count(lexicon.positive)}
    return df.withColumn("_found", found).withColumns(counts).drop("_found")


def score_by_lexicon(df: DataFrame, text: str = "text", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Score whole texts by word lists, all in native expressions."""
    logits = lexicon_logits(df, text, lexicon)
    scores = softmax([F.col("_neg"), F.lit(lexicon.neutral_logit), F.col("_pos")])
    return with_scores(logits, scores).drop("_neg", "_pos")


def batches_by_cells(lengths: np.ndarray, cells: int, most: int | None = None) -> Iterator[np.ndarray]:
    """Row numbers in batches of like length: a batch holds rows while its padded size stays within `cells`.

    A model pads every row of a batch to its longest, so the size is the number of rows times the
    longest length. A row that is larger alone makes a batch of its own. `most` bounds the rows.
    """
    order = np.argsort(lengths, kind="stable")
    start = 0
    for at in range(len(order)):
        rows = at - start + 1
        if rows > 1 and (rows * max(int(lengths[order[at]]), 1) > cells or (most and rows > most)):
            yield order[start:at]
            start = at
    if start < len(order):
        yield order[start:]


def score_batches(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "text",
    batch_size: int | None = None,
    spread: int | None = None,
    cells: int = CELLS,
    measure: Callable[[str], int] = len,
) -> DataFrame:
    """Score texts with any model that maps a list of texts to an (n, 3) array of probabilities.

    The model is made once per task. It gets texts of like length together, by `measure` (their
    characters, or what a tokenizer counts, up to where the model cuts), as many as fit `cells` when
    padded to the longest and at most `batch_size`. Scores stay on the row they belong to, in the
    order of the rows. `spread` deals the rows out evenly over that many tasks first, for when
    scoring costs far more than a shuffle and the input has few or lopsided partitions.
    """
    kinds = T.StructType([T.StructField(c, T.DoubleType()) for c in SENTIMENTS])

    @F.pandas_udf(kinds)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for values in series:
            texts = ["" if value is None else value for value in values]
            scores = np.empty((len(texts), len(SENTIMENTS)))
            lengths = np.fromiter(map(measure, texts), np.int64, len(texts))
            for rows in batches_by_cells(lengths, cells, batch_size):
                scores[rows] = scorer([texts[k] for k in rows])
            yield pd.DataFrame(scores, columns=list(SENTIMENTS))

    rows = df.repartition(spread) if spread else df
    # Only the text crosses to Python; nondeterministic, so that no filter runs the model again.
    scored = rows.withColumn("_scores", run.asNondeterministic()(F.col(text)))
    return with_scores(scored, [F.col(f"_scores.{c}") for c in SENTIMENTS]).drop("_scores")


def lexicon_scorer(lexicon: Lexicon = Lexicon()) -> Scorer:
    """The lexicon as a batch scorer, vectorised over the batch."""

    def score(texts: list[str]) -> np.ndarray:
        lower = pd.Series(texts, dtype="object").str.lower()
        negative, positive = (
            lower.str.count(word_pattern(listed)).to_numpy(float) for listed in (lexicon.negative, lexicon.positive)
        )
        logits = np.column_stack([negative, np.full(len(texts), lexicon.neutral_logit), positive])
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    return score


def class_of_labels(quality: Column, toxic: Column) -> Column:
    """Training class: toxic is Negative, good and not toxic is Positive, the rest Neutral."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).otherwise(1)


def train_classifier(labelled: DataFrame, features: int = 1 << 12, iterations: int = 10) -> PipelineModel:
    """Bag-of-words classifier on (text, label 0/1/2). Only the coefficients reach the driver."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern="[^\\p{L}]+"),
        HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=features),
        LogisticRegression(
            featuresCol="_features", labelCol="label", maxIter=iterations, regParam=0.01, family="multinomial"
        ),
    ]
    return Pipeline(stages=stages).fit(labelled)


def score_by_classifier(df: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(df).withColumn("_p", vector_to_array("probability"))
    present = model.stages[-1].numClasses
    scores = [F.col("_p")[n] if n < present else F.lit(0.0) for n in range(len(SENTIMENTS))]
    return with_scores(scored, scores).select(*df.columns, *SENTIMENTS, "Sentiment")


def unpack_scores(df: DataFrame, vector: str = "scores") -> DataFrame:
    """Score vector to three columns and the label."""
    scores = F.col(vector)
    named = df.withColumns({label: scores[n] for n, label in enumerate(SENTIMENTS)})
    return named.withColumn("Sentiment", label_of(argmax(scores))).drop(vector)


def class_ranks(df: DataFrame, key: str) -> DataFrame:
    """(key, rank, label, score): the classes of each row from the highest score down, no shuffle.

    The outer form, as a plain explode would add a filter on the array and score each text again.
    """
    ranks = F.posexplode_outer(ranked([F.col(c) for c in SENTIMENTS])).alias("place", "entry")
    return df.select(key, ranks).select(key, (F.col("place") + 1).alias("rank"), "entry.label", "entry.score")


def best_class(df: DataFrame, key: str) -> DataFrame:
    """(key, label, score): the best class of each row."""
    scores = F.array(*SENTIMENTS)
    return df.select(key, best_label(scores).alias("label"), F.array_max(scores).alias("score"))


def scores_by_label(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, score_map(F.array(*SENTIMENTS)).alias("scores"))
