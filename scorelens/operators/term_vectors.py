"""Sparse hashed term vectors, trained and scored in the JVM.

A text becomes the list of its words' buckets (md5 of the word), repeats included: a sparse count vector whose
coordinates are written once for each word, so its length follows the text and not the number of buckets. Training counts
(label, bucket) pairs; scoring adds up a class's values at a text's buckets. The model has the shape of
:mod:`scorelens.operators.centroid`'s (classes x buckets values, both given by parameters), so that module's scorers take it as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions.hashing import md5_bucket
from scorelens.functions.text import words
from scorelens.operators.centroid import SCORE_DIGITS, settled

DIMS = 256


def term_buckets(text, dims: int = DIMS) -> Column:
    """Buckets of all words of the text, in text order."""
    return F.transform(words(text), lambda w: md5_bucket(w, dims).cast("int"))


def train_sparse_centroids(df: DataFrame, terms: str = "terms", label: str = "label", dims: int = DIMS, model: str = "centroid") -> DataFrame:
    """Model row (model, classes): each class's mean count of every bucket."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(terms).alias("terms"))
    texts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("texts"))
    counts = rows.select("label", F.explode("terms").alias("bucket")).groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("_n"))  # a count a bucket
    centroid = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.coalesce(F.try_element_at("_n", b), F.lit(0)) / F.col("texts"))
    classes = texts.join(maps, "label", "left").select("label", centroid.alias("centroid")).withColumn(
        "half_norm", F.lit(0.5) * F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x * x))
    return settled(classes.agg(F.lit(model).alias("model"), F.array_sort(F.collect_list(F.struct("label", "centroid", "half_norm"))).alias("classes")))


def predict_sparse(df: DataFrame, model: DataFrame, terms: str = "terms") -> DataFrame:
    """Add ``pred``: the class with the largest sparse dot product less half its squared norm (ties: the smallest label)."""
    dot = lambda c: F.aggregate(F.col(terms), F.lit(0.0), lambda acc, b: acc + F.element_at(c["centroid"], b + 1))
    scores = F.transform("_classes", lambda c: F.struct(F.round(dot(c) - c["half_norm"], SCORE_DIGITS).alias("score"), (-c["label"]).alias("neg_label")))
    best = df.withColumn("_classes", model.select("classes").scalar()).withColumn("_best", F.array_max(scores))
    return best.withColumn("pred", (-F.col("_best.neg_label")).cast("int")).drop("_classes", "_best")


def term_matrix(dims: int = DIMS):
    """For timed batch scorers: the bucket lists of one mini-batch as a count matrix."""
    def matrix(lists: pd.Series) -> np.ndarray:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate([*map(np.asarray, lists), np.zeros(0)]).astype(np.int64)
        return np.bincount(row * dims + flat, minlength=len(lists) * dims).reshape(len(lists), dims).astype(np.float64)
    return matrix
