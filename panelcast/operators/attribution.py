"""I-03, I-04, I-05: Shapley values that know their model.

- ``tree_rows``: path-dependent values of a forest or boosted trees, exact. A leaf's
  share depends on a row only through which of the path's features agree with it, so
  the shares of all patterns are tabled once per leaf and rows look them up, batch by
  batch. Features that a coalition leaves out follow the training rows down the tree,
  by the nodes' counts.
- ``dependent_linear_rows``: values of a linear model whose features depend on each
  other as jointly normal ones do: what a coalition doesn't hold is set to its
  conditional mean. Means and covariances are one aggregate; the values are linear in
  the row, so they are one projection.
- ``kernel_rows``: any model. Coalitions are drawn with the Shapley kernel's weights,
  scored against background rows, and each row's weighted least squares, constrained to
  add up, is solved in the task that holds its few sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.importance import SEED, donors
from panelcast.session import ensure_checkpoint_dir
from panelcast.sources.scratch import written

METHOD_TREE = "Tree attribution"
METHOD_DEPENDENT = "Linear attribution, dependent features"
METHOD_KERNEL = "Kernel attribution"
#: Leaves that one pass carries to the tasks, and path features up to which patterns are tabled.
LEAVES, TABLED = 100_000, 8
#: Features of the dependent linear case: all their subsets are solved on the driver.
MOST_FEATURES = 16


# ---------------------------------------------------------------- trees

def node_table(model) -> DataFrame:
    """(tree, id, cover, value, left, right, feature, threshold) of a fitted tree ensemble, values times tree weights."""
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark)}/trees-{model.uid}"
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    forest = hasattr(model, "trees") and "RandomForest" in type(model).__name__
    weights = [w / (sum(model.treeWeights) if forest else 1.0) for w in model.treeWeights]
    if spark.read.parquet(f"{path}/data").where("nodeData.split.numCategories >= 0").limit(1).count():
        raise ValueError("trees with categorical splits are not supported")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), F.get(n["impurityStats"], F.lit(0)).alias("cover"),
        (n["prediction"] * F.get(F.array(*map(F.lit, weights)), F.col("treeID"))).alias("value"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"))


class Leaves:
    """Leaves of some trees: per leaf its value and, per feature on its path, an interval (low, high]
    and the share of the training rows that the path's splits on the feature let pass."""

    def __init__(self, rows: Sequence):
        trees: dict = {}
        for r in rows:
            trees.setdefault(r["tree"], {})[r["id"]] = r
        self.base, by_width = 0.0, {}
        for nodes in trees.values():
            todo = [(nodes[0], {})]
            while todo:
                node, path = todo.pop()
                if node["left"] is None or node["left"] < 0:
                    self.base += node["value"] * np.prod([p[2] for p in path.values()])
                    by_width.setdefault(len(path), []).append((node["value"], [(f, *p) for f, p in path.items()]))
                    continue
                f, t = node["feature"], node["threshold"]
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                for child, bounds in ((nodes[node["left"]], (low, min(high, t))), (nodes[node["right"]], (max(low, t), high))):
                    todo.append((child, {**path, f: (*bounds, share * child["cover"] / node["cover"])}))
        self.groups = {m: (np.array([v for v, _ in leaves]), *(np.array([[p[i] for p in path] for _, path in leaves]) for i in range(4)))
                       for m, leaves in by_width.items() if m}

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of the rows of ``x``."""
        out = np.zeros(x.shape)
        for m, (value, feature, low, high, share) in self.groups.items():
            feature = feature.astype(int)
            table = _shares(_patterns(m)[None], share[:, None]) * value[:, None, None] if m <= TABLED else None
            for i in range(len(value)):
                mine = x[:, feature[i]]
                agrees = (mine > low[i]) & (mine <= high[i])
                out[:, feature[i]] += (table[i][agrees @ (1 << np.arange(m))] if table is not None
                                       else _shares(agrees.astype(float), share[i][None]) * value[i])
        return out


def _patterns(m: int) -> np.ndarray:
    return (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)


def _shares(agrees: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Value per feature of a leaf worth 1: the mean over all orders of what the feature's coming changes.

    Coalitions of one size enter through the coefficients of the product of (share + agrees t)."""
    m = agrees.shape[-1]
    agrees, share = np.broadcast_arrays(agrees, share)
    weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
    out = np.empty(agrees.shape)
    for j in range(m):
        by_size = [np.ones(agrees.shape[:-1])]
        for i in range(m):
            if i != j:
                z, o = share[..., i], agrees[..., i]
                grown = [by_size[0] * z, *(b * z + a * o for a, b in pairwise(by_size)), by_size[-1] * o]
                by_size = grown
        out[..., j] = (agrees[..., j] - share[..., j]) * sum(w * c for w, c in zip(weight, by_size))
    return out


def _long(found: DataFrame, feature_cols: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in feature_cols])
    return (found.select(*id_cols, F.posexplode("_phi").alias("_j", "shap"))
            .select(*id_cols, F.get(names, F.col("_j")).alias("feature"), "shap"))


def tree_rows(nodes: DataFrame, data: DataFrame, feature_cols: Sequence[str], id_cols: Sequence[str] = ("date",),
              leaves: int = LEAVES) -> DataFrame:
    """(id_cols…, feature, shap) of every row of ``data``; a row's values add up to its prediction minus the
    trees' mean over their training rows. ``nodes`` is a ``node_table``.

    The trees' nodes go to the tasks in slices of about ``leaves`` leaves, whose values are added up.
    """
    sizes = nodes.where("left < 0 OR left IS NULL").groupBy("tree").count().orderBy("tree").collect()  # one row per tree
    slices: list[list] = [[]]
    held = 0
    for tree, n in sizes:
        if slices[-1] and held + n > leaves:
            slices.append([])
            held = 0
        slices[-1].append(tree)
        held += n
    d = len(feature_cols)
    rows = data.select(*id_cols, vector_to_array("features").alias("_x"))
    kinds = ", ".join([*(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in id_cols), "_phi array<double>"])

    def run(part: Leaves):
        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                phi = part.values(x)
                cut = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, d), pa.int32()), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in id_cols), cut], names=[*id_cols, "_phi"])
        return values

    out = None
    for trees in slices:
        part = Leaves(nodes.where(F.col("tree").isin(trees)).collect())  # at most about two nodes a leaf
        found = _long(rows.mapInArrow(run(part), kinds), feature_cols, id_cols)
        out = found if out is None else out.unionByName(found)
    return out if len(slices) == 1 else out.groupBy(*id_cols, "feature").agg(F.sum("shap").alias("shap"))


# ---------------------------------------------------------------- linear, dependent features

def dependent_weights(coefficients: Sequence[float], covariance: np.ndarray) -> np.ndarray:
    """Matrix M with which a row's values are M (x - mean)."""
    beta, d = np.asarray(coefficients, float), len(coefficients)
    if d > MOST_FEATURES:
        raise ValueError(f"at most {MOST_FEATURES} features: every subset of them is solved")
    scale = np.sqrt(np.maximum(np.diag(covariance), 0))
    scale[scale == 0] = 1.0
    corr, b = covariance / np.outer(scale, scale), beta * scale
    known = np.zeros((1 << d, d))
    bits = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(bool)
    for s in range(1, 1 << d):
        a, o = np.flatnonzero(bits[s]), np.flatnonzero(~bits[s])
        own = corr[np.ix_(a, a)]
        known[s, a] = b[a]
        if len(o):
            target = corr[np.ix_(a, o)] @ b[o]
            try:
                low = np.linalg.cholesky(own)
                if np.diag(low).min() < 1e-6:
                    raise np.linalg.LinAlgError
                known[s, a] += np.linalg.solve(low.T, np.linalg.solve(low, target))
            except np.linalg.LinAlgError:  # features that repeat each other
                known[s, a] += np.linalg.pinv(own, rcond=1e-10) @ target
    size = bits.sum(axis=1)
    weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)] + [0.0])
    out = np.empty((d, d))
    for j in range(d):
        without = np.flatnonzero(~bits[:, j])
        out[j] = weight[size[without]] @ (known[without | 1 << j] - known[without])
    return out / scale


def moments(data: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the feature vector, from one aggregate of sums."""
    x = vector_to_array("features")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = data.select(x.alias("_x")).agg(
        *[F.avg(F.get("_x", F.lit(i))) for i in range(d)],
        *[F.covar_pop(F.get("_x", F.lit(i)), F.get("_x", F.lit(j))) for i, j in pairs]).first()
    mean, cov = np.array([v or 0.0 for v in row[:d]]), np.zeros((d, d))
    for (i, j), v in zip(pairs, row[d:]):
        cov[i, j] = cov[j, i] = v or 0.0
    return mean, cov


def dependent_linear_rows(coefficients: Sequence[float], data: DataFrame, feature_cols: Sequence[str],
                          id_cols: Sequence[str] = ("date",)) -> DataFrame:
    """(id_cols…, feature, shap); a row's values add up to its prediction minus the mean prediction."""
    mean, cov = moments(data, len(feature_cols))
    m = dependent_weights(coefficients, cov)
    apart = F.transform("_x", lambda v, i: v - F.get(F.array(*[F.lit(float(u)) for u in mean]), i))
    rows = data.select(*id_cols, vector_to_array("features").alias("_x")).select(*id_cols, apart.alias("_x"))
    phi = F.array(*[F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(w)) for w in r]), lambda v, w: v * w),
                                F.lit(0.0), lambda a, v: a + v) for r in m])
    return _long(rows.select(*id_cols, phi.alias("_phi")), feature_cols, id_cols)


# ---------------------------------------------------------------- any model

def kernel_rows(model, data: DataFrame, feature_cols: Sequence[str], id_cols: Sequence[str] = ("date",),
                samples: int = 50, background: int = 10, seed: int = SEED) -> DataFrame:
    """(id_cols…, feature, shap) by kernel-weighted least squares over ``samples`` coalitions a row.

    Coalitions come in pairs with their complements; each is scored against the same
    ``background`` rows (drawn from all of ``data``, as for permutation importance). A row's values add up to
    its prediction minus the mean prediction of its background; a linear model's are exact as soon as
    the coalitions span the features.
    """
    d = len(feature_cols)
    if d < 2 or samples < 2:
        raise ValueError("at least two features and two coalitions")
    base = written(data.select(F.struct(*[F.col(c) for c in id_cols]).alias("_rid"), vector_to_array("features").alias("_x")))
    sizes = np.array([1 / (k * (d - k)) for k in range(1, d)])
    limits = (np.cumsum(sizes) / sizes.sum()).tolist()
    draw = F.pmod(F.xxhash64("_rid", F.expr("_s div 2"), F.lit(seed + 3)), F.lit(1 << 30)) / float(1 << 30)
    size = F.lit(d - 1)
    for k, limit in reversed(list(enumerate(limits[:-1], 1))):
        size = F.when(draw < limit, k).otherwise(size)
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.struct(
        F.xxhash64("_rid", F.expr("_s div 2"), j, F.lit(seed + 11)).alias("h"), j.alias("j")))), lambda t: t["j"])
    # Coalition 0 holds nothing, 1 everything, later ones come in pairs.
    # The drawn features are bound by an outer transform, so they are drawn once a coalition.
    inside = F.get(F.transform(F.array(F.slice(order, F.lit(1), size)), lambda drawn: F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.when(F.col("_s") < 2, F.col("_s") == 1).otherwise(
            F.array_contains(drawn, j) == (F.col("_s") % 2 == 0)))), F.lit(0))
    others = donors(base, background, seed).groupBy("_rid").agg(F.first("_x").alias("_x"), F.collect_list("_d").alias("_ds"))
    coalitions = others.select("_rid", "_x", "_ds", F.explode(F.sequence(F.lit(0), F.lit(samples + 1))).alias("_s")).withColumn("_in", inside)
    mixed = F.transform("_ds", lambda other: F.zip_with(F.arrays_zip(F.col("_in"), F.col("_x")), other,
                                                        lambda own, o: F.when(own["_in"], own["_x"]).otherwise(o)))
    scored = model.transform(coalitions.select("_rid", "_s", "_in", F.explode(mixed).alias("_m"))
                             .select("_rid", "_s", "_in", array_to_vector("_m").alias("features")))
    per = scored.groupBy("_rid", "_s").agg(F.avg("prediction").alias("v"), F.first("_in").alias("z"))
    held = per.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("_s", "z", "v"))).alias("t")).select("_rid.*", "t.z", "t.v")
    kinds = ", ".join([*(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in id_cols), "_phi array<double>"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for z, v in zip(b.column("z").to_pylist(), b.column("v").to_pylist()):
                z, v = np.array(z[2:], float), np.array(v)
                nothing, gain = v[0], v[1] - v[0]
                # The last value is what the others leave of the gain.
                a = z[:, :-1] - z[:, -1:]
                y = v[2:] - nothing - z[:, -1] * gain
                phi = np.linalg.lstsq(a, y, rcond=None)[0]
                out.append([*phi.tolist(), float(gain - phi.sum())])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in id_cols), pa.array(out, pa.list_(pa.float64()))], names=[*id_cols, "_phi"])

    return _long(held.mapInArrow(solve, kinds), feature_cols, id_cols)


def mean_size(attributions: DataFrame, method: str) -> DataFrame:
    """Mean absolute value per feature (then ``normalise``)."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("shap")).alias("importance")).withColumn("method", F.lit(method))
