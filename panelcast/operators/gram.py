"""M-04…M-06: cross-validated linear and ridge models from additive sums.

A linear fit needs only the counts, sums and cross products of its rows, and these add
up over folds. One pass sums them per fold, and every fold's fit is the total minus the
fold's own part, solved on the driver (features squared). All folds and models are then
scored in one projection, each row by the coefficients that didn't see its fold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Share of the greatest eigenvalue below which standardised features depend on each other.
NULL = 1e-11


class Moments:
    """Count, sums and cross products of (features, label) about a fixed point."""

    def __init__(self, flat: np.ndarray, point: np.ndarray):
        self.flat, self.point = flat, point

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.flat + other.flat, self.point)

    def fit(self, alpha: float = 0.0) -> tuple[np.ndarray, float]:
        """Coefficients and intercept that minimise the squared error plus ``alpha`` times the squared coefficients.

        A feature without variance gets 0. Where features depend on each other exactly (the mean of
        three lags and the lags), the solution is the one of least norm, as a least-squares solver's is."""
        w = len(self.point)
        n, sums, cross = self.flat[0], self.flat[1:1 + w], self.flat[1 + w:].reshape(w, w)
        if n == 0:
            return np.zeros(w - 1), 0.0
        mean = sums / n
        centred = cross - n * np.outer(mean, mean)
        xx, xy = centred[:-1, :-1], centred[:-1, -1]
        size = np.sqrt(np.maximum(np.diag(xx), 0))
        live = size > 1e-12 * np.maximum(1.0, np.abs(self.point[:-1])) * np.sqrt(n)
        beta = np.zeros(w - 1)
        if live.any():
            s = size[live]
            a = xx[np.ix_(live, live)] / np.outer(s, s)
            values, vectors = np.linalg.eigh(a)
            free = vectors[:, values < NULL * values[-1]] / s[:, None]
            least = np.eye(len(s)) - free @ np.linalg.pinv(free) if free.size else np.eye(len(s))
            a = a + alpha * least / np.outer(s, s)
            beta[live] = least @ (np.linalg.lstsq(a, xy[live] / s, rcond=NULL)[0] / s)
        at = mean + self.point
        return beta, float(at[-1] - beta @ at[:-1])


def fold_moments(data: DataFrame, dim: int, label: str = "revenue") -> dict[int, Moments]:
    """Moments of every fold of ``data(features, fold, label)``; rows without a fold don't count."""
    rows = data.where("fold IS NOT NULL")
    means = rows.select(Summarizer.mean(F.col("features")).alias("m")).first()
    # A point amid the rows keeps the products small, whatever the features' scale.
    point = np.append(means["m"].toArray() if means["m"] is not None and means["m"].size else np.zeros(dim),
                      rows.agg(F.avg(label)).first()[0] or 0.0)
    w = dim + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            z = np.column_stack([x, b.column("y").to_numpy(zero_copy_only=False)]) - point
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                part = z[fold == f]
                flat = np.r_[len(part), part.sum(axis=0), (part.T @ part).ravel()]
                held[int(f)] = held.get(int(f), 0) + flat
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))],
                                         names=["fold", "flat"])

    parts = rows.select("fold", vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(sums, "fold int, flat array<double>")
    total = parts.select("fold", F.posexplode("flat").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v")).collect()
    out = {f: np.zeros(1 + w + w * w) for f in {r["fold"] for r in total}}
    for r in total:
        out[r["fold"]][r["i"]] = r["v"]
    return {f: Moments(v, point) for f, v in out.items()}


def fold_fits(moments: dict[int, Moments], folds: Iterable[int], alpha: float, expanding: bool = False) -> dict[int, tuple[np.ndarray, float]]:
    """Per fold the fit on the other folds, or with ``expanding`` on the earlier ones."""
    out = {}
    for f in folds:
        train = [m for g, m in moments.items() if (g < f if expanding else g != f)]
        total = train[0]
        for m in train[1:]:
            total = total + m
        out[f] = total.fit(alpha)
    return out


def fold_predictions(data: DataFrame, fits: dict[str, dict[int, tuple[np.ndarray, float]]], keep: Sequence[str] = (),
                     label: str = "revenue") -> DataFrame:
    """(keep…, model, fold, actual, predicted): each row scored by its fold's fit of every model, in one projection."""
    x = vector_to_array("features")

    def scored(by_fold):
        pairs = [c for f, (beta, b) in by_fold.items() for c in (F.lit(f), F.array(*[F.lit(float(v)) for v in [b, *beta]]))]
        weights = F.element_at(F.create_map(*pairs), F.col("fold"))
        dot = F.zip_with(F.slice(weights, 2, F.size(weights) - 1), "_x", lambda w, v: w * v)
        return F.aggregate(dot, F.get(weights, F.lit(0)), lambda a, v: a + v)
    entries = F.array(*[F.struct(F.lit(m).alias("model"), scored(by_fold).alias("predicted")) for m, by_fold in fits.items()])
    folds = sorted({f for by_fold in fits.values() for f in by_fold})
    return (data.where(F.col("fold").isin(folds)).select(*keep, "fold", F.col(label).alias("actual"), x.alias("_x"))
            .select(*keep, "fold", "actual", F.inline(entries)))
