"""What the two nearest-neighbour classifiers share: splitting the labelled rows and calibrating a vote."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import sample_by_hash


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled rows by hash of the id. Of labels that repeat an id the largest
    counts; rows with a NULL id, label or no document are left out."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    ids = sample_by_hash(ids, F.col("doc_id"), rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most ``rows`` short rows: a bounded broadcast, so no text is moved
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")


@dataclass
class Curve:
    """Probability of label 1 for a vote: logistic in the vote, fitted with both classes at their true weight."""

    slope: float = 8.0
    shift: float = -4.0

    def __call__(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30)))


def fitted_curve(vote: np.ndarray, label: np.ndarray) -> Curve:
    """Newton steps with a small ridge; with one class only, the default curve."""
    if len(set(label.tolist())) < 2:
        return Curve()
    x, b = np.stack([vote, np.ones(len(vote))], 1), np.array([8.0, -4.0])
    ridge = np.diag([1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ (b - [8.0, -4.0]))
        b = b + np.clip(step, -5, 5)
    return Curve(float(b[0]), float(b[1])) if b[0] > 0 else Curve()
