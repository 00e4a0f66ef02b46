"""Cross-validated linear families from Gram matrices.

One pass over the rows sums, per fold, the products of all pairs of (1,
features, targets). Everything else needs those few small matrices alone: the
training matrix of a fold is the total less the fold's own, every penalty is
solved from it, and a fold's squared error is a quadratic form in its own
matrix. Folds, penalties and the refit therefore cost no further pass.

Columns are centred at their mean (one aggregate row) before products are
taken, so that large offsets cost no digits. A matrix has (1 + features +
targets) squared cells whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.sources.readers import sample_key

#: Share of the absolute-value penalty of each family.
FAMILIES = {"RidgeCV": 0.0, "LassoCV": 1.0, "ElasticNetCV": 0.5, "RidgeClassifierCV": 0.0}
RIDGE_PENALTIES = (0.1, 1.0, 10.0)
PATH_LENGTH, PATH_RATIO = 100, 1e-3
#: Most columns (features and targets) of a matrix, and most classes of a classifier.
MOST_COLUMNS, MOST_CLASSES = 300, 100


@dataclass
class CrossValidated:
    """A fitted family: ``coefficients[t]`` and ``intercepts[t]`` per target (of a
    classifier: per class), the chosen ``penalty``, and ``path``: the penalties with
    the mean over folds of their squared error."""

    features: list[str]
    coefficients: list[list[float]]
    intercepts: list[float]
    penalty: float
    path: list[tuple[float, float]]
    classes: list | None = None

    def decision(self, t: int = 0) -> Column:
        """The linear form of target ``t`` as a column (null where a feature is)."""
        return sum((F.col(f"`{f}`").cast("double") * F.lit(w) for f, w in zip(self.features, self.coefficients[t])),
                   F.lit(self.intercepts[t]))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with ``out``: the value, or the class of the largest form (ties: the first class)."""
        if self.classes is None:
            return df.withColumn(out, self.decision())
        forms = [self.decision(t) for t in range(len(self.classes))]
        best = F.greatest(*forms) if len(forms) > 1 else forms[0]
        pick = F.when(best.isNull(), None)
        for form, c in zip(forms, self.classes):
            pick = pick.when(form == best, F.lit(c))
        return df.withColumn(out, pick)


def _matrices(x: DataFrame, width: int, folds: int) -> np.ndarray:
    """``folds`` matrices of products of ``x``'s rows (``__fold``, ``__v`` of ``width`` doubles)."""
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold = b.column("__fold").to_numpy(zero_copy_only=False)
            v = b.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for f in np.unique(fold):
                rows = v[fold == f]
                sums[int(f)] = sums.get(int(f), 0.0) + rows.T @ rows
        for f, m in sums.items():
            cells = m[upper]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), f, np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)],
                names=["fold", "cell", "s"])

    sums = x.select("__fold", "__v").mapInArrow(products, "fold int, cell int, s double") \
        .groupBy("fold", "cell").agg(F.sum("s").alias("s"))
    out = np.zeros((folds, width, width))
    # folds x cells rows: bounded by the number of columns
    for r in sums.collect():
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        out[r["fold"], i, j] = out[r["fold"], j, i] = r["s"]
    return out


def _moments(g: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means, features' covariances and covariances with the targets, both times rows."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mean, mean)
    return n, mean, c[:d, :d], c[:d, d:]


def _solve(cxx: np.ndarray, cxy: np.ndarray, n: float, penalty: float, share: float, start: np.ndarray) -> np.ndarray:
    """Weights (features x targets) at one penalty. Ridge: least squares plus penalty
    times squared weights; otherwise half the mean squared error plus penalty times
    (share * |w| + (1 - share) / 2 * w * w), by descent along coordinates."""
    d = len(cxx)
    if share == 0.0:
        return np.linalg.lstsq(cxx + penalty * np.eye(d), cxy, rcond=None)[0]
    a, b, w = cxx / n, cxy / n, start.copy()
    diag = np.diag(a)
    for t in range(b.shape[1]):
        left = b[:, t] - a @ w[:, t]
        scale = max(float(np.max(np.abs(b[:, t]), initial=0.0)), 1e-300)
        for _ in range(10_000):
            moved = 0.0
            for j in range(d):
                if diag[j] <= 0.0:
                    continue
                rho = left[j] + diag[j] * w[j, t]
                new = np.sign(rho) * max(abs(rho) - penalty * share, 0.0) / (diag[j] + penalty * (1.0 - share))
                step = new - w[j, t]
                if step:
                    left -= step * a[:, j]
                    w[j, t] = new
                    moved = max(moved, abs(step) * diag[j])
            if moved <= 1e-12 * scale:
                break
    return w


def _squared_error(g: np.ndarray, w: np.ndarray, mean: np.ndarray, d: int) -> float:
    """Mean over rows and targets of the squared error on a fold's own matrix."""
    k = w.shape[1]
    form = np.vstack([-(mean[d:] - mean[:d] @ w), -w, np.eye(k)])
    return float(np.sum((g @ form) * form) / (g[0, 0] * k))


def fit_cross_validated(df: DataFrame, features: list[str], label: str, family: str, id_col: str | None = None,
                        folds: int = 5, fold: Column | None = None, penalties: list[float] | None = None) -> CrossValidated:
    """The penalty with the smallest mean squared error over the folds (ties: the
    larger penalty), refitted on all rows.

    A row's fold is ``fold`` (0 to ``folds`` - 1) or, by ``id_col``, its hash; equal ids
    share a fold. Rows with a null or non-finite feature or label do not count; folds
    without rows do not either, and a table with rows in fewer than two folds raises.
    Without ``penalties`` ridge families take 0.1, 1 and 10, the others 100 values from
    the smallest that leaves every weight at 0 down to a thousandth of it. A classifier
    has one target of -1 and 1 per class; its classes, ``MOST_CLASSES`` at most, are sorted.
    """
    if family not in FAMILIES:
        raise ValueError(f"{family!r} is not a cross-validated family")
    if fold is None and id_col is None:
        raise ValueError("folds need an id column or a fold column")
    share, d = FAMILIES[family], len(features)
    fold = F.pmod(sample_key(id_col), F.lit(folds)) if fold is None else fold
    x = df.select(fold.cast("int").alias("__fold"), F.col(f"`{label}`").alias("__y"),
                  *[F.col(f"`{f}`").cast("double").alias(f"__x{i}") for i, f in enumerate(features)])
    xs = [f"__x{i}" for i in range(d)]
    classes = None
    if family == "RidgeClassifierCV":
        found = x.filter(F.col("__y").isNotNull()).select("__y").distinct().limit(MOST_CLASSES + 1).collect()
        classes = sorted(r["__y"] for r in found)
        if not 2 <= len(classes) <= MOST_CLASSES:
            raise ValueError(f"a classifier needs 2 to {MOST_CLASSES} classes")
        ys = [f"__y{i}" for i in range(len(classes))]
        x = x.select("__fold", *xs, *[F.when(F.col("__y") == F.lit(c), 1.0).when(F.col("__y").isNotNull(), -1.0).alias(y)
                                      for c, y in zip(classes, ys)])
    else:
        ys = ["__y0"]
        x = x.select("__fold", *xs, F.col("__y").cast("double").alias("__y0"))
    names = xs + ys
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"{len(names)} columns; {MOST_COLUMNS} at most")
    for c in names:
        x = x.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = x.filter(F.col("__fold").between(0, folds - 1))
    centre = x.agg(*[F.avg(c).alias(c) for c in names]).first()
    if centre[names[0]] is None:
        raise ValueError("no complete row")
    v = F.array(F.lit(1.0), *[F.col(c) - F.lit(centre[c]) for c in names])
    g = _matrices(x.select("__fold", v.alias("__v")), 1 + len(names), folds)
    g = g[g[:, 0, 0] > 0]
    if len(g) < 2:
        raise ValueError("rows in fewer than two folds")
    total = g.sum(axis=0)
    n, mean, cxx, cxy = _moments(total, d)
    if penalties is None:
        if share == 0.0:
            penalties = list(RIDGE_PENALTIES)
        else:
            most = float(np.max(np.abs(cxy)) / (n * share)) or 1e-12
            penalties = list(np.geomspace(most, most * PATH_RATIO, PATH_LENGTH))
    penalties = sorted(map(float, penalties), reverse=True)
    errors = np.zeros(len(penalties))
    for own in g:
        nt, mt, txx, txy = _moments(total - own, d)
        w = np.zeros_like(cxy)
        for i, p in enumerate(penalties):
            w = _solve(txx, txy, nt, p, share, w)
            errors[i] += _squared_error(own, w, mt, d) / len(g)
    best = int(np.argmin(errors))
    w = np.zeros_like(cxy)
    for p in penalties[:best + 1] if share else penalties[best:best + 1]:
        w = _solve(cxx, cxy, n, p, share, w)
    at = np.array([centre[c] for c in names])
    intercept = (mean[d:] + at[d:]) - (mean[:d] + at[:d]) @ w
    return CrossValidated(list(features), w.T.tolist(), intercept.tolist(), penalties[best],
                          [(p, float(e)) for p, e in zip(penalties, errors)], classes)
