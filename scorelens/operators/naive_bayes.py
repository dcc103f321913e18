"""Multinomial naive Bayes for texts, from exact term counts.

Training counts every (term, label) of the training texts by partial and final aggregates; the vocabulary is a table as long as
it needs to be and never leaves the cluster. Scoring joins a text's term counts with it by term: the table is broadcast where
it is counted to be small, and otherwise joined by shuffle, where AQE splits the terms that every text has.

Score of class c for a text: ``ln(P(c)) + sum over its vocabulary terms of tf * ln((n(term, c) + 1) / (N(c) + V))``.
Only counted (term, class) pairs meet in the join: the sum is ``sum tf * ln(n + 1) - T * ln(N(c) + V)`` with T the
text's number of vocabulary words. Scores are rounded to 9 digits; the largest wins and, on ties, the smallest label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.text import words
from scorelens.operators.centroid import SCORE_DIGITS, settled
from scorelens.operators.joins import checked_broadcast


@dataclass
class NaiveBayes:
    """``terms``: (term, counts array<struct<label, n>>); ``classes``: one row, array<struct<label, prior, total>>."""

    terms: DataFrame
    classes: DataFrame


def term_counts(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """(keys..., term, n): how often each lower-cased whitespace word occurs."""
    return df.select(*keys, F.explode(words(text)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def train(df: DataFrame, text: str = "content", label: str = "label") -> NaiveBayes:
    """Counts of the rows with a label; a label whose texts have no words keeps its prior."""
    labelled = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    counted = settled(term_counts(labelled, ["label"], "text"))
    terms = settled(counted.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("counts")))  # a count a class
    size = terms.agg(F.count(F.lit(1)).alias("v"))
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"))
    priors = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("texts"))
    each = priors.join(totals, "label", "left").select("label", F.log(F.col("texts") / priors.agg(F.sum("texts")).scalar()).alias("prior"),
                                                       F.log(F.coalesce("total", F.lit(0)) + size.scalar()).alias("total"))
    classes = settled(each).agg(F.array_sort(F.collect_list(F.struct("label", "prior", "total"))).alias("classes"))
    return NaiveBayes(terms, settled(classes))


def predict(df: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text: str = "content") -> DataFrame:
    """(id, pred, score) for each distinct id of ``df``; a text without known words gets the likeliest class.

    Rows that share an id are read as one text.
    """
    ids = df.select(F.col(id_col).alias("_id"))
    own = df.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
    met = settled(term_counts(own, ["_id"], "text").withColumnRenamed("n", "tf").join(checked_broadcast(model.terms), "term"))
    known = met.groupBy("_id").agg(F.sum("tf").alias("known"))
    likely = (met.select("_id", "tf", F.inline("counts")).groupBy("_id", "label")
              .agg(F.sum(F.col("tf") * F.log(F.col("n") + F.lit(1.0))).alias("gain")))
    gains = known.join(likely.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "gain"))).alias("gains")), "_id")  # a gain a class
    scored = ids.distinct().join(gains, "_id", "left").withColumn("_classes", model.classes.scalar())
    score = F.transform("_classes", lambda c: F.struct(
        F.round(c["prior"] + F.coalesce(F.try_element_at("gains", c["label"]), F.lit(0.0)) - F.coalesce("known", F.lit(0)) * c["total"], SCORE_DIGITS).alias("score"),
        (-c["label"]).alias("neg_label")))
    return scored.withColumn("_best", F.array_max(score)).select(F.col("_id").alias(id_col), (-F.col("_best.neg_label")).cast("int").alias("pred"),
                                                                 F.col("_best.score").alias("score"))
