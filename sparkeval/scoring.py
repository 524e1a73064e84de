"""Batch scoring by a user's model: features to logits to one prediction row for each class."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def score_rows(rows: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, features: str = "features", batch: int = 1024) -> DataFrame:
    """rows once for each class with class_idx, logit and score (its sigmoid).

    make_model runs once in each Python worker, so that a large model is loaded there and not sent, and gives a function from a batch of feature
    rows (n x width) to logits (n x classes). Rows without features are left out.
    """
    logits = predict_batch_udf(make_model, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])
    scored = rows.where(F.col(features).isNotNull()).withColumn("__logits", logits(F.col(features).cast("array<double>")))
    each = scored.select(*[c for c in rows.columns if c != features], F.posexplode("__logits").alias("class_idx", "logit"))
    return each.withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))
