"""Logistic regression by Newton's method: each step is one aggregate over the rows; a k x k system is solved on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import Scratch
from tallyloom.stats.prob import chi2_sf, normal_sf


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    rows: int
    clusters: int | None = None

    def terms(self) -> list[dict]:
        """Estimate, standard error, z, p and odds ratio with interval for each name."""
        out = []
        for k, name in enumerate(self.names):
            se = float(np.sqrt(self.covariance[k, k]))
            z = float(self.beta[k] / se)
            out.append({"term": name, "estimate": float(self.beta[k]), "se": se, "z": z, "p": 2 * normal_sf(abs(z)), "odds_ratio": float(np.exp(self.beta[k])), "low": float(np.exp(self.beta[k] - 1.959963984540054 * se)), "high": float(np.exp(self.beta[k] + 1.959963984540054 * se))})
        return out

    def combination(self, weights: Sequence[float]) -> tuple[float, float, float]:
        """Estimate, standard error and p of a linear combination."""
        w = np.asarray(weights, float)
        value, se = float(w @ self.beta), float(np.sqrt(w @ self.covariance @ w))
        return value, se, 2 * normal_sf(abs(value / se))


def _sums(df: DataFrame, x: list[str], y: str, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Information matrix, gradient, log-likelihood and rows, weighted by counts."""
    k = len(x)
    eta = sum((F.col(c) * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0))
    with_eta = df.withColumn("__eta", F.greatest(F.least(eta, F.lit(700.0)), F.lit(-700.0)))
    p = 1 / (1 + F.exp(-F.col("__eta")))
    w = F.greatest(p * (1 - p), F.lit(1e-12)) * F.col("__n")
    gap = (F.col(y) - p) * F.col("__n")
    log = (F.col(y) * F.col("__eta") - F.greatest(F.col("__eta"), F.lit(0.0)) - F.log1p(F.exp(-F.abs(F.col("__eta"))))) * F.col("__n")
    cells = [F.sum(F.col(x[i]) * F.col(x[j]) * w) for i in range(k) for j in range(i, k)]
    row = with_eta.agg(*[c.alias(f"h{m}") for m, c in enumerate(cells)], *[F.sum(F.col(c) * gap).alias(f"g{m}") for m, c in enumerate(x)], F.sum(log).alias("log"), F.sum("__n").alias("n")).first()
    h = np.zeros((k, k))
    m = 0
    for i in range(k):
        for j in range(i, k):
            h[i, j] = h[j, i] = row[m]
            m += 1
    return h, np.array([row[m + i] for i in range(k)], float), float(row["log"]), int(row["n"])


def fit_logistic(df: DataFrame, terms: dict[str, Column], response: Column, most_steps: int = 100, tolerance: float = 1e-10, start: Sequence[float] | None = None) -> Fit:
    """Maximum likelihood fit; ``terms`` name the design's columns (give an intercept as ``F.lit(1.0)``). Rows with nulls are left out.

    Equal rows are counted into one first and written, so that each step reads
    distinct rows only and a lost executor loses none. ``start``: coefficients
    to begin with.
    """
    names = list(terms)
    x = [f"__x{k}" for k in range(len(names))]
    rows = df.select(*[c.cast("double").alias(a) for a, c in zip(x, terms.values(), strict=True)], response.cast("double").alias("__y")).dropna()
    counted = rows.groupBy(*x, "__y").agg(F.count("*").cast("double").alias("__n"))
    counted = Scratch(df.sparkSession, "logistic").table(counted, "counted")
    beta = np.zeros(len(names)) if start is None else np.array(start, float)
    for _ in range(most_steps):
        h, g, _, _ = _sums(counted, x, "__y", beta)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    h, _, log, n = _sums(counted, x, "__y", beta)
    return Fit(names, beta, np.linalg.inv(h), log, n)


def cluster_covariance(df: DataFrame, terms: dict[str, Column], response: Column, cluster: str, fit: Fit) -> Fit:
    """The fit with a cluster-robust covariance: scores are summed by cluster, then their products over clusters."""
    x = [c.cast("double") for c in terms.values()]
    eta = sum((c * float(b) for c, b in zip(x, fit.beta, strict=True)), F.lit(0.0))
    gap = response.cast("double") - 1 / (1 + F.exp(-eta))
    k = len(x)
    scores = df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(*[F.sum(c * gap).alias(f"s{m}") for m, c in enumerate(x)])
    row = scores.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
    g = row["g"]
    factor = g / (g - 1) * (fit.rows - 1) / (fit.rows - k)
    return Fit(fit.names, fit.beta, factor * fit.covariance @ meat @ fit.covariance, fit.log_likelihood, fit.rows, g)


def likelihood_ratio(full: Fit, reduced: Fit) -> dict:
    x, dof = 2 * (full.log_likelihood - reduced.log_likelihood), len(full.beta) - len(reduced.beta)
    return {"chi_square": x, "dof": dof, "p": chi2_sf(max(x, 0.0), dof)}


def trend(df: DataFrame, arm: Column, time: Column, event: Column, cluster: str) -> tuple[Fit, dict]:
    """Arm, centred time and their interaction, with cluster-robust errors, and the likelihood-ratio test of the interaction."""
    middle = df.select(F.avg(time)).first()[0]
    t = time - F.lit(float(middle))
    a = arm.cast("double")
    terms = {"intercept": F.lit(1.0), "arm": a, "time": t, "arm:time": a * t}
    full = fit_logistic(df, terms, event)
    reduced = fit_logistic(df, {k: v for k, v in terms.items() if k != "arm:time"}, event, start=full.beta[:3])
    return cluster_covariance(df, terms, event, cluster, full), likelihood_ratio(full, reduced)
