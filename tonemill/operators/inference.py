"""Distributed batch inference with a supplied model, and decoding of its logits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tonemill.functions.arrays import argmax, decode, named, softmax


def batch_logits(
    df: DataFrame,
    make_predict: Callable[[], Callable[..., np.ndarray]],
    inputs: list[str],
    input_shapes: list[list[int]] | None = None,
    batch_size: int = 32,
    output: str = "logits",
) -> DataFrame:
    """Append the model's logits. ``make_predict`` loads the model once per Python
    worker and returns a function from numpy batches to an (n, classes) array."""
    predict = predict_batch_udf(
        make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=input_shapes
    )
    return df.withColumn(output, predict(*inputs))


def classify_logits(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Append ``prediction`` and ``prob_<label>`` in canonical label order."""
    probabilities = df.withColumn("_p", softmax(F.col(logits)))
    return probabilities.select(
        *df.columns, decode(argmax(F.col(logits))).alias("prediction"), *named(F.col("_p"), "prob")
    )
