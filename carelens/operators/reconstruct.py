"""Reconstruction model (I3, I4): principal components fitted on all training rows.

``pyspark.ml.feature.PCA`` aggregates the covariance on the executors; only
6 x k numbers and six means reach the driver.  The error is a column expression
over the components, so scoring needs no Python and no shuffle.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PCA_COMPONENTS, VITALS
from .anomaly import PARAM_DIGITS, threshold_frame


@dataclass
class PcaModel:
    """Rows are projected on the components; what is left over is the error."""
    means: list
    residual: list            # 6 x 6: identity minus the projection
    threshold: float | None = None
    mean_error: float | None = None
    kind: str = "pca"

    @classmethod
    def fit(cls, train: DataFrame, k: int = PCA_COMPONENTS) -> "PcaModel":
        from pyspark.ml.feature import PCA, VectorAssembler
        rows = VectorAssembler(inputCols=VITALS, outputCol="_x").transform(train)
        pc = PCA(k=k, inputCol="_x", outputCol="_y").fit(rows).pc.toArray()
        m = train.agg(*[F.avg(v).alias(v) for v in VITALS]).first()
        left = np.round(np.eye(len(VITALS)) - pc @ pc.T, PARAM_DIGITS)
        model = cls([round(float(m[v]), PARAM_DIGITS) for v in VITALS], left.tolist())
        t = threshold_frame(train, model).first()
        model.threshold, model.mean_error = float(t["threshold"]), float(t["mean_error"])
        return model

    def error_columns(self, df: DataFrame, cols) -> DataFrame:
        """Add reconstruction_error (mean squared residual) for scaled vitals."""
        d = [F.col(c) - F.lit(m) for c, m in zip(cols, self.means)]
        left = [reduce(add, [F.lit(w) * x for w, x in zip(row, d)]) for row in self.residual]
        return df.withColumn("reconstruction_error", reduce(add, [x * x for x in left]) / F.lit(float(len(left))))

    def to_bytes(self) -> bytes:
        return json.dumps(asdict(self)).encode()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "PcaModel":
        return cls(**json.loads(blob))
