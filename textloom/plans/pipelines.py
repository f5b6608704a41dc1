"""The jobs: preprocess a corpus, learn a sentence model, learn word vectors, train and evaluate a classifier."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import lexer
from ..functions.morphology import Morphology
from ..functions.normalize import Cleaner, clean_text
from ..functions.splitter import Model
from ..operators import classify, embeddings, features, sampling, sentences
from ..sources.tables import limit_rows, union_labeled


class WordTokenizer:
    """Cleaning, sentences, words and word forms of one text at a time."""

    def __init__(self, settings: dict, model: Model | None = None):
        self.cleaner = Cleaner(settings)
        self.lexer = lexer(tuple(settings["features"]))
        self.morphology = Morphology(settings.get("lemmatizer"), settings.get("stemmer"))
        self.model = model.adjusted(settings.get("abbreviations") or (), settings.get("not_starters") or ()) if model else None

    def words(self, text: str | None, clean: bool = True, stop_words: frozenset[str] = frozenset()) -> list[str]:
        text = self.cleaner.clean(text) if clean else (text or "").lower()
        out = self.morphology.words(self.lexer.tokens(text))
        return [w for w in out if w not in stop_words] if stop_words else out

    def sentences(self, text: str | None, stop_words: frozenset[str] = frozenset()) -> list[list[str]]:
        text = self.cleaner.clean(text, lower=False)
        raw = self.model.sentences(text) if self.model else [text]
        return [w for s in raw if s and (w := self.words(s, clean=False, stop_words=stop_words))]


def word_tokens(column: Column | str, settings: dict, stop_words: list[str] = ()) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = WordTokenizer(settings)
        for b in batches:
            yield pd.Series([own.words(t, stop_words=frozenset(stop_words)) for t in b], dtype=object)

    return run(column)


def sentence_tokens(column: Column | str, settings: dict, model: Model | None = None, stop_words: list[str] = ()) -> Column:
    """array<array<string>>; without a model each text is one sentence."""

    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = WordTokenizer(settings, model)
        for b in batches:
            yield pd.Series([own.sentences(t, frozenset(stop_words)) for t in b], dtype=object)

    return run(column)


def preprocess(labeled: DataFrame | None, unlabeled: DataFrame | None, config: dict, *, as_sentences: bool = False, model: Model | None = None) -> DataFrame:
    """X (tokens) and Y of labelled and unlabelled rows, sampled before any text is touched."""
    rows = union_labeled(labeled, unlabeled, config)
    own = config["preprocess"]
    if own["sample_labeled"]:
        keyed = rows.where("Y is not null").withColumn("__k", F.xxhash64("X"))
        rows = sampling.stratified_sample(keyed, own["sample_labeled"], "Y", "__k", own["random_state"]).drop("__k").unionByName(rows.where("Y is null"))
    if own["sample_unlabeled"]:
        keyed = rows.where("Y is null").withColumn("__k", F.xxhash64("X"))
        rows = rows.where("Y is not null").unionByName(sampling.reservoir_sample(keyed, own["sample_unlabeled"], "__k", own["random_state"]).drop("__k"))
    settings = config["tokenizer"]
    return rows.withColumn("X", sentence_tokens("X", settings, model) if as_sentences else word_tokens("X", settings))


def learn_sentence_model(rows: DataFrame, settings: dict, text_col: str = "X", least: int = 1) -> sentences.Learned:
    keyed = rows.select(F.monotonically_increasing_id().alias("doc"), clean_text(text_col, settings, lower=False).alias("t"))
    return sentences.learn(sentences.word_table(keyed.select("doc", sentences.training_text(F.col("t")).alias("t")), "doc", "t"), least)


def load_sentence_model(spark: SparkSession, path: str, max_types: int = sentences.MAX_TYPES) -> Model | None:
    """A saved model, or None with a warning (texts are then one sentence each) where there is none."""
    try:
        return sentences.load(spark, path).model(max_types)
    except AnalysisException:
        logging.getLogger(__name__).warning("no sentence model at %s", path)
        return None


def pretrain(corpus: DataFrame, config: dict, *, limit: int | None = None, workers: int = 1, id_col: str = "doc") -> DataFrame:
    """word, vector. corpus: id_col and X (array of sentences), as preprocess() gives."""
    own = config["pretrain"]
    corpus = limit_rows(corpus, limit, id_col)
    name = own["algorithm"] if own["algorithm"] == "glove" else own["embedding"]
    options = config[name]
    if own["algorithm"] == "glove":
        data = features.token_table(corpus, id_col, features.flatten_sentences("X"))
        return embeddings.learn("glove", "word2vec", data, workers, **{k: options[k] for k in ("size", "learning_rate", "epochs", "window")})
    data = features.sentence_labels(corpus, id_col, "X", own["labels"], own["split_by_sentence"]) if name == "doc2vec" else features.training_sentences(corpus, "X", own["split_by_sentence"])
    return embeddings.learn("word2vec", name, data, workers, **{k: options[k] for k in ("size", "min_count", "window", "seed", "sample") if k in options})


@dataclass
class Trained:
    model: CrossValidatorModel
    search: DataFrame
    report: DataFrame
    roc: DataFrame
    auc: DataFrame


def train(corpus: DataFrame, config: dict, vectors: DataFrame | None = None, *, id_col: str = "doc", values: dict | None = None, folds: int = 5) -> Trained:
    """A classifier of Y by X (array of sentences), with its search, report and ROC on held-out rows."""
    own = config["train"]
    way = classify.check_features(own["features"], vectors)
    rows = corpus.where("Y is not null")
    if own["sample_labeled"]:
        rows = sampling.stratified_sample(rows, own["sample_labeled"], "Y", id_col, own["random_state"])
    stop = features.english_stop_words() if own["stop_words"] else []
    data = rows.select(F.col(id_col).alias("doc"), F.col("Y").cast("double").alias("label"), features.filter_stop_words(features.flatten_sentences("X"), stop if way == "bow" else []).alias("tokens"), F.col("X").alias("__x"))
    if way != "bow":
        s = data.select("doc", F.posexplode("__x").alias("sentence", "w")) if own.get("split_by_sentence") else data.select("doc", F.lit(0).alias("sentence"), F.flatten("__x").alias("w"))
        words = s.select("doc", "sentence", F.explode("w").alias("term"))
        data = data.join(embeddings.document_vectors(words, vectors, stop).withColumnRenamed("vector", "embedding"), "doc")
        data = sampling.drop_missing(data, "embedding")
    split = sampling.train_test_split(data.drop("__x"), "doc", own["test_size"], own["random_state"])
    fit, held = split.where("split = 'train'"), split.where("split = 'test'")
    stages = classify.feature_stages(own["features"])
    model = classify.search(fit, own["classifier"], features=stages, folds=folds, scoring=own["scoring"], values=values, seed=own["random_state"], key="doc")
    said = model.transform(held)
    curve = classify.roc_curve(said.withColumn("score", vector_to_array("rawPrediction")[1]))
    return Trained(model, classify.search_report(model), classify.classification_report(said), curve, classify.roc_auc(curve))
