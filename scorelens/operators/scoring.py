"""Pluggable vectorised scoring (Arrow batches), for models that are not Spark
expressions: the function sees a whole Arrow batch as numpy arrays.

The built-in scorer reproduces the centroid model (same rounding and tie-break)
so that its answers are checkable against the pure-Spark predictor.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from scorelens.operators.centroid import SCORE_DIGITS, model_matrix


def centroid_scorer(labels, centroids, half_norms):
    """numpy scorer: X (n x D) -> predicted labels (largest score, smallest label on ties)."""
    order = np.argsort(np.asarray(labels), kind="stable")
    lab = np.asarray(labels)[order]
    cm = np.asarray(centroids, dtype=np.float64)[order]
    hn = np.asarray(half_norms, dtype=np.float64)[order]

    def predict(x: np.ndarray) -> np.ndarray:
        scores = np.round(x.astype(np.float64) @ cm.T - hn, SCORE_DIGITS)
        return lab[np.argmax(scores, axis=1)].astype(np.int32)  # first max = smallest label

    return predict


def predict_batch_column(model: DataFrame, vec: str = "data", batch_size: int = 1024):
    """A ``predict_batch_udf`` column scoring ``vec`` with the centroid model.

    The K x D model is read once on the driver (bounded by classes x dims) and
    captured by the per-worker ``make_predict_fn``, like a broadcast model.
    """
    from pyspark.ml.functions import predict_batch_udf

    labels, cents, hns = model_matrix(model)

    def make_predict_fn():
        predict = centroid_scorer(labels, cents, hns)

        def fn(x: np.ndarray) -> np.ndarray:
            return predict(x)
        return fn

    dims = len(cents[0]) if cents else 0
    udf = predict_batch_udf(make_predict_fn, return_type=IntegerType(), batch_size=batch_size,
                            input_tensor_shapes=[[dims]])
    return udf(F.col(vec))


def score_batches_in_pandas(batched: DataFrame, model: DataFrame, vec: str = "data",
                            keys: tuple[str, ...] = ("batch_no",), matrix=None) -> DataFrame:
    """Score each mini-batch with one vectorised call and time that call.

    Input rows carry (id, label, vec, *keys); rows of a batch are co-located
    (hash on the keys) and sorted, so one batch is one call even when Arrow cuts
    a partition into several chunks. A batch is bounded by the batch size. Output rows: (id,
    *keys, label, pred, batch_duration, batch_rows). The measured seconds are data about the
    run, not results to compare exactly. ``matrix`` turns a mini-batch's ``vec`` values
    into the model's input (default: they are vectors).
    """
    matrix = matrix or (lambda values: np.stack(values.to_numpy()))
    labels, cents, hns = model_matrix(model)
    predict = centroid_scorer(labels, cents, hns)
    key_list = list(keys)
    schema = StructType([StructField("id", LongType())]
                        + [batched.schema[k] for k in key_list]
                        + [StructField("label", IntegerType()), StructField("pred", IntegerType()),
                           StructField("batch_duration", DoubleType()), StructField("batch_rows", IntegerType())])

    def score(g: pd.DataFrame) -> pd.DataFrame:
        x = matrix(g[vec])
        t0 = time.perf_counter()
        p = predict(x)
        secs = time.perf_counter() - t0
        part = g[["id", *key_list, "label"]].copy()
        part["pred"] = p
        part["batch_duration"] = secs
        part["batch_rows"] = len(g)
        return part

    def run(it):
        # Rows arrive sorted by the batch keys; an Arrow chunk may end inside a
        # batch, so the chunk's last batch is held back and completed by the next.
        carry = None
        for pdf in it:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = pdf[key_list].iloc[-1]
            tail = (pdf[key_list] == last).all(axis=1)
            carry = pdf[tail]
            done = pdf[~tail]
            if not done.empty:
                yield pd.concat([score(g) for _, g in done.groupby(key_list, sort=False)], ignore_index=True)
        if carry is not None and not carry.empty:
            yield pd.concat([score(g) for _, g in carry.groupby(key_list, sort=False)], ignore_index=True)

    colocated = batched.select("id", *key_list, "label", vec).repartition(*key_list).sortWithinPartitions(*key_list)
    return colocated.mapInPandas(run, schema)
