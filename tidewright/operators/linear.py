"""Least squares on distributed sums, and its evaluation."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordered import with_ordinal
from tidewright.schema import ROW_ID, quoted


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def prediction(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coefficients):
            out = out + F.col(quoted(c)) * F.lit(float(w))
        return out


def _moments(df: DataFrame, features: list[str], target: str, group: Column | None = None) -> dict:
    """[1, x, y]' [1, x, y] by group: each task multiplies its rows batch by batch, and (p+2)(p+3)/2 sums a group meet.

    Null counts as 0.  x and y are taken about their overall means, so that sums
    keep their digits; ``_moved`` undoes it.
    """
    cells = [F.coalesce(F.col(quoted(c)).cast("double"), F.lit(0.0)) for c in (*features, target)]
    means = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cells)]).first()
    shift = np.array([0.0, *[m or 0.0 for m in means]])
    keyed = df.select((F.lit(0) if group is None else group).cast("long").alias("g"), *[(c - F.lit(float(m))).alias(f"x{k}") for k, (c, m) in enumerate(zip(cells, shift[1:]))])
    p = len(cells) + 1
    upper = np.triu_indices(p)

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(k).to_numpy(zero_copy_only=False) for k in range(1, p)]])
            g = b.column(0).to_numpy(zero_copy_only=False)
            for one in np.unique(g).tolist():
                own = x[g == one]
                sums[one] = sums.get(one, 0) + (own.T @ own)[upper]
        for one, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(values), pa.int64()), pa.array(np.arange(len(values))), pa.array(values)], ["g", "cell", "s"])

    out: dict = {}
    for r in keyed.where("g IS NOT NULL").mapInArrow(run, "g long, cell long, s double").groupBy("g", "cell").agg(F.sum("s").alias("s")).collect():
        m = out.setdefault(r["g"], np.zeros((p, p)))
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        m[i, j] = m[j, i] = r["s"]
    return {g: (m, shift) for g, m in out.items()}


def _moved(m: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The moments about zero of columns whose moments about ``shift`` are ``m``."""
    t = np.eye(len(shift))
    t[0] = shift
    t[0, 0] = 1.0
    return t.T @ m @ t


def _least_norm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of least norm of a w = b for a Gram matrix; its rank is judged with all columns scaled to one length."""
    size = np.sqrt(np.diag(a))
    size[size == 0] = 1.0
    values, vectors = np.linalg.eigh(a / np.outer(size, size))
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-10
    w = (vectors[:, keep] @ ((vectors[:, keep].T @ (b / size)) / values[keep])) / size
    free = vectors[:, ~keep] / size[:, None]
    if free.size:
        q, _ = np.linalg.qr(free)
        w -= q @ (q.T @ w)
    return w


def _solve(moments: tuple[np.ndarray, np.ndarray], centred: bool = False) -> np.ndarray:
    """Coefficients of least norm (intercept first); ``centred`` leaves the intercept out of the norm."""
    m, shift = moments
    if not centred:
        whole = _moved(m, shift)
        return _least_norm(whole[:-1, :-1], whole[:-1, -1])
    n = m[0, 0]
    mean = m[0, 1:] / n
    c = m[1:, 1:] - n * np.outer(mean, mean)
    w = _least_norm(c[:-1, :-1], c[:-1, -1])
    at = mean + shift[1:]
    return np.concatenate([[at[-1] - at[:-1] @ w], w])


def _measures(moments: tuple[np.ndarray, np.ndarray], beta: np.ndarray) -> tuple[float, float]:
    """(rmse, r2) of coefficients on the rows that a moment matrix sums up."""
    m, shift = moments
    n, syy, sy = m[0, 0], m[-1, -1], m[0, -1]
    about = np.array([beta[0] + shift[1:-1] @ beta[1:] - shift[-1], *beta[1:], -1.0])  # the error, from shifted columns
    rss = max(float(about @ m @ about), 0.0)
    total = syy - sy * sy / n if n else 0.0
    return (float(np.sqrt(rss / n)) if n else 0.0), (float(1 - rss / total) if total > 0 else 0.0)


def fit_linear(df: DataFrame, features: list[str], target: str, centred: bool = False) -> LinearModel:
    got = _moments(df, features, target)
    if not got:
        raise ValueError("no rows to fit")
    beta = _solve(got[0], centred)
    return LinearModel(tuple(features), float(beta[0]), tuple(map(float, beta[1:])))


def predict_linear(df: DataFrame, model: LinearModel, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, model.prediction())


def fold_by_hash(n_splits: int, seed: int = 42, key: str = ROW_ID) -> Column:
    return F.pmod(F.xxhash64(F.col(quoted(key)), F.lit(seed)), F.lit(n_splits)).cast("int")


def cross_validate(df: DataFrame, features: list[str], target: str, n_splits: int = 5, fold: Column | None = None, seed: int = 42) -> dict:
    """Per-fold rmse, mae, r2 and their means and population deviations.

    One job sums moments by fold; a fold's training moments are the total less
    its own.  One more pass takes the absolute errors of all folds.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    placed = df if fold is not None or ROW_ID in df.columns else with_ordinal(df)
    own = fold_by_hash(n_splits, seed) if fold is None else fold
    moments = _moments(placed, features, target, own)
    if sum(m[0, 0] for m, _ in moments.values()) < n_splits:
        raise ValueError("more folds than rows")
    total = sum(m for m, _ in moments.values())
    betas = {k: _solve((total - m, shift)) for k, (m, shift) in moments.items()}
    error = None
    for k, beta in betas.items():
        model = LinearModel(tuple(features), float(beta[0]), tuple(map(float, beta[1:])))
        e = F.abs(F.col(quoted(target)) - model.prediction())
        error = F.when(F.col("__fold") == k, e) if error is None else error.when(F.col("__fold") == k, e)
    maes = {r["__fold"]: r["mae"] for r in placed.withColumn("__fold", own).groupBy("__fold").agg(F.avg(error).alias("mae")).collect()}
    folds = []
    for k in sorted(moments):
        rmse, r2 = _measures(moments[k], betas[k])
        folds.append({"fold": int(k), "rows": int(moments[k][0][0, 0]), "rmse": rmse, "mae": float(maes[k]), "r2": r2})
    out: dict = {"folds": folds}
    for name in ("rmse", "mae", "r2"):
        values = [f[name] for f in folds]
        out |= {f"{name}_mean": float(np.mean(values)), f"{name}_std": float(np.std(values))}
    return out


def evaluate_split(df: DataFrame, features: list[str], target: str, share: float = 0.8, order: str = ROW_ID) -> dict:
    """rmse and r2 on the last rows of a model fitted on the first ``share`` of them; zeros for fewer than five rows."""
    n = df.count()
    if n < 5:
        return {"rmse": 0.0, "r2": 0.0, "training_time_s": 0.0}
    began = time.perf_counter()
    moments = _moments(df, features, target, (F.col(quoted(order)) >= int(n * share)).cast("int"))
    beta = _solve(moments[0], centred=True)
    rmse, r2 = _measures(moments[1], beta)
    return {"rmse": rmse, "r2": r2, "training_time_s": time.perf_counter() - began}
