"""M-05…M-09: the regressors, as Spark MLlib estimators.

Every estimator is fit on the pooled rows of all series. The RBF support
vector model has no MLlib counterpart; it is re-aimed as standardise →
random Fourier features (Rahimi & Recht, 2007) → ridge, named "RBF Ridge".
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Model names and hyper-parameters.
LINEAR = "Linear Regression"
RIDGE = "Ridge Regression"
FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"
RBF = "RBF Ridge (RFF)"
MODEL_NAMES = [LINEAR, RIDGE, FOREST, BOOSTING, RBF]

RIDGE_ALPHA = 1.0
FOREST_TREES, FOREST_DEPTH, FOREST_MIN_LEAF = 150, 6, 2
BOOST_ITERS, BOOST_DEPTH, BOOST_RATE = 150, 4, 0.08
RBF_C = 500.0
RFF_COMPONENTS = 64
SEED = 42


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol):
    """x ↦ sqrt(2/D)·cos(W·x + b), W ~ N(0, 2γ), b ~ U(0, 2π); γ defaults to 1/d.

    Weights are seeded and small (D×d); the projection is one matrix product
    per Arrow batch in a pandas UDF, since a dense D×d transform has no
    vectorised built-in and 64 higher-order expressions run interpreted.
    """

    components = Param(Params._dummy(), "components", "D", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width (0 → 1/d)", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    dim = Param(Params._dummy(), "dim", "input dimension", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="scaled", outputCol="rff", components=RFF_COMPONENTS,
                 gamma=0.0, seed=SEED, dim=1):
        super().__init__()
        self._setDefault(components=RFF_COMPONENTS, gamma=0.0, seed=SEED, dim=1)
        self._set(**self._input_kwargs)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        d = self.getOrDefault(self.dim)
        n = self.getOrDefault(self.components)
        g = self.getOrDefault(self.gamma) or 1.0 / d
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        return rng.normal(0.0, math.sqrt(2 * g), size=(n, d)), rng.uniform(0.0, 2 * math.pi, size=n)

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b = self.weights()
        scale = math.sqrt(2.0 / len(b))
        wt = w.T.copy()

        @F.pandas_udf(ArrayType(DoubleType()))
        def project(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            z = scale * np.cos(np.vstack(x.to_numpy()) @ wt + b)
            return pd.Series(list(z))

        x = vector_to_array(F.col(self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(project(x)))


def ridge_reg_param(alpha: float, label_std: float, n: int) -> float:
    """MLlib regParam equal to an unscaled ridge penalty α on Σ residual².

    MLlib minimises 1/(2n)·Σr² + λ/2·‖β‖² on a label scaled by its std, so
    λ = α·std(y)/n reproduces the closed-form ridge solution.
    """
    return alpha * label_std / max(n, 1) if label_std > 0 else 0.0


def build(name: str, dim: int, label_std: float, n_train: int, features: str = "features",
          label: str = "revenue", trees: int = FOREST_TREES, iterations: int = BOOST_ITERS) -> Estimator:
    """One unfitted estimator by its name."""
    if name == LINEAR:
        return LinearRegression(featuresCol=features, labelCol=label, solver="normal", regParam=0.0)
    if name == RIDGE:
        return LinearRegression(featuresCol=features, labelCol=label, solver="normal",
                                elasticNetParam=0.0, standardization=False,
                                regParam=ridge_reg_param(RIDGE_ALPHA, label_std, n_train))
    if name == FOREST:
        return RandomForestRegressor(featuresCol=features, labelCol=label,
                                     numTrees=trees, maxDepth=FOREST_DEPTH,
                                     minInstancesPerNode=FOREST_MIN_LEAF,
                                     featureSubsetStrategy="all", seed=SEED)
    if name == BOOSTING:
        return GBTRegressor(featuresCol=features, labelCol=label,
                            maxIter=iterations, maxDepth=BOOST_DEPTH,
                            stepSize=BOOST_RATE, seed=SEED)
    if name == RBF:
        return Pipeline(stages=[
            StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True),
            RandomFourierFeatures(inputCol="_scaled", outputCol="_rff", dim=dim),
            LinearRegression(featuresCol="_rff", labelCol=label, solver="normal",
                             elasticNetParam=0.0, standardization=False,
                             regParam=ridge_reg_param(1.0 / RBF_C, label_std, n_train)),
        ])
    raise ValueError(f"unknown model {name!r}; choose from {MODEL_NAMES}")
