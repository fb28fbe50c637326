"""Binomial mixed model with crossed random intercepts (logit, Laplace approximation).

The rows are first folded by Spark to cells: counts of successes and trials for each
combination of fixed effects and groups, so the fit works on a design of bounded size
(checked) whatever the number of rows.  Several models are fitted in parallel, one
group of ``applyInPandas`` each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 200_000
SINGULAR = 1e-4
SCHEMA = "model string, term string, estimate double, std_error double, z double, p_value double, log_likelihood double, random_sd string, converged boolean"


def cells(df: DataFrame, fixed: list[str], groups: list[str], outcome: str) -> DataFrame:
    """Successes and trials per cell; rows without an outcome are left out."""
    seen = df.filter(F.col(outcome).isNotNull())
    return seen.groupBy(*fixed, *groups).agg(F.sum(F.col(outcome).cast("bigint")).alias("successes"), F.count(F.lit(1)).alias("trials"))


def _modes(x, zs, y, n, beta, sds, start):
    """Random effects at their conditional modes, the penalised likelihood's curvature, and the Laplace log likelihood."""
    u = start
    z = np.concatenate(zs, axis=1) if zs else np.zeros((len(y), 0))
    scale = np.concatenate([np.full(q.shape[1], s) for q, s in zip(zs, sds, strict=True)]) if zs else np.zeros(0)
    zs_scaled = z * scale
    for _ in range(50):
        eta = x @ beta + zs_scaled @ u
        p = 1 / (1 + np.exp(-eta))
        grad = zs_scaled.T @ (y - n * p) - u
        hess = zs_scaled.T @ (zs_scaled * (n * p * (1 - p))[:, None]) + np.eye(len(u))
        step = np.linalg.solve(hess, grad) if len(u) else grad
        u = u + step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    eta = x @ beta + zs_scaled @ u
    log_lik = float((y * eta - n * np.logaddexp(0, eta)).sum() - 0.5 * u @ u)
    if len(u):
        log_lik -= 0.5 * float(np.linalg.slogdet(hess)[1])
    return u, log_lik


def _minimise(f, x0, steps=400):
    """Nelder-Mead."""
    k = len(x0)
    points = [np.array(x0, float)] + [np.array(x0, float) + 0.3 * np.eye(k)[i] for i in range(k)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-8:
            return points[0], values[0], True
        centre = np.mean(points[:-1], axis=0)
        tried = centre + (centre - points[-1])
        v = f(tried)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (tried, v)
        elif v < values[-2]:
            points[-1], values[-1] = tried, v
        else:
            inner = centre + 0.5 * (points[-1] - centre)
            w = f(inner)
            if w < values[-1]:
                points[-1], values[-1] = inner, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[0], values[0], False


def fit_cells(pdf: pd.DataFrame, fixed: list[str], groups: list[str]) -> dict:
    """Estimates on a frame of cells; groups whose spread vanishes are dropped, the last named first."""
    y, n = pdf["successes"].to_numpy(float), pdf["trials"].to_numpy(float)
    terms, columns = ["(Intercept)"], [np.ones(len(pdf))]
    for c in fixed:
        if pd.api.types.is_numeric_dtype(pdf[c]):
            terms.append(c)
            columns.append(pdf[c].to_numpy(float))
        else:
            for level in sorted(pdf[c].unique())[1:]:
                terms.append(f"{c}{level}")
                columns.append((pdf[c] == level).to_numpy(float))
    x, used = np.stack(columns, 1), list(groups)
    while True:
        zs = [pd.get_dummies(pdf[g]).to_numpy(float) for g in used]
        width = sum(z.shape[1] for z in zs)

        def objective(theta, zs=zs, width=width):
            return -_modes(x, zs, y, n, theta[: x.shape[1]], np.exp(theta[x.shape[1] :]), np.zeros(width))[1]

        start = np.concatenate([np.zeros(x.shape[1]), np.full(len(used), -0.5)])
        theta, value, done = _minimise(objective, start, 300 + 200 * len(start))
        theta, value, done = _minimise(objective, theta, 300 + 200 * len(start))
        sds = np.exp(theta[x.shape[1] :])
        if used and sds.min() < SINGULAR:
            used.pop(max(i for i, s in enumerate(sds) if s < SINGULAR))
            continue
        break
    k, h = x.shape[1], 1e-3
    hess = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            at = lambda a, b, i=i, j=j: objective(theta + a * h * np.eye(len(theta))[i] + b * h * np.eye(len(theta))[j])
            hess[i, j] = hess[j, i] = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * h * h)
    covariance = np.linalg.pinv(hess)
    return {"terms": terms, "beta": theta[:k], "covariance": covariance, "log_likelihood": -value, "sds": dict(zip(used, sds.tolist(), strict=True)), "converged": done}


def _p_two_sided(z: np.ndarray) -> np.ndarray:
    from math import erfc, sqrt

    return np.array([erfc(abs(v) / sqrt(2)) for v in z])


def fit(models: DataFrame, fixed: list[str], groups: list[str]) -> DataFrame:
    """One fit for each value of ``model``; ``models`` are cells with that column."""
    largest = models.groupBy("model").count().agg(F.max("count")).collect()[0][0] or 0
    if largest > MAX_CELLS:
        raise ValueError(f"a model has {largest} cells, more than {MAX_CELLS}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fit_cells(pdf.sort_values([*fixed, *groups]).reset_index(drop=True), fixed, groups)
        error = np.sqrt(np.diag(got["covariance"]))
        z = got["beta"] / error
        spread = ", ".join(f"{k}={v:.4f}" for k, v in got["sds"].items())
        return pd.DataFrame({
            "model": pdf["model"].iloc[0], "term": got["terms"], "estimate": got["beta"], "std_error": error, "z": z, "p_value": _p_two_sided(z),
            "log_likelihood": got["log_likelihood"], "random_sd": spread, "converged": got["converged"],
        })

    return models.groupBy("model").applyInPandas(run, SCHEMA)
