"""Bounded samples of labelled documents, and logistic fits in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> pd.DataFrame:
    """At most ``most`` labelled rows (text, y), chosen by a hash of their id; a documented bound on what reaches the driver.

    Rows with a null id or label teach nothing. An id with several labels teaches each of them once.
    """
    y = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").distinct()
    y = y.orderBy(F.xxhash64(F.col("i"), F.lit(seed)), "i", "y").limit(most)
    # The labelled side has a checked bound: at most ``most`` rows of two numbers.
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(y), "i")
    got = rows.orderBy(F.xxhash64(F.col("i"), F.lit(seed)), "i", "text").limit(most).toPandas()
    got["text"] = got["text"].fillna("")
    return got


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) by Newton's method; the ridge pulls all but the bias towards ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.zeros(x.shape[1]) if prior is None else np.append(prior, 0.0)
    pull = np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - prior))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
