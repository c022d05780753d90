"""Tail probabilities, likelihood-ratio tests and variance inflation factors: small sums on the driver."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.plans.terms import Sum, parts


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared > x) for a whole number of degrees of freedom, as a finite sum."""
    if df <= 0 or x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        return math.exp(-h) * sum(h**j / math.factorial(j) for j in range(df // 2))
    return math.erfc(math.sqrt(h)) + math.exp(-h) * sum(h ** (j - 0.5) / math.gamma(j + 0.5) for j in range(1, (df - 1) // 2 + 1))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return math.nan if math.isnan(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The t with P(T < t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) / 2 > 1 - p and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) / 2 > 1 - p else (lo, mid)
    return (lo + hi) / 2


def p_text(p: float) -> str:
    """Four decimals, or a bound by a power of ten."""
    if math.isnan(p):
        return ""
    return f"{p:.4f}" if p >= 1e-4 else f"<1e-{-math.ceil(math.log10(p)) if p > 0 else 99:02d}"


@dataclass(frozen=True)
class LRTest:
    nobs: int
    deviance: tuple[float, ...]
    loglikelihood: tuple[float, ...]
    dof: tuple[int, ...]
    pval: tuple[float, ...]

    def chisq(self) -> list[float]:
        ll = self.loglikelihood
        return [math.nan, *(2 * abs(b - a) for a, b in zip(ll, ll[1:], strict=False))]

    def to_df(self, spark: SparkSession) -> DataFrame:
        clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
        rows = [tuple(map(clean, (i, *r))) for i, r in enumerate(zip(self.dof, self.loglikelihood, self.deviance, self.chisq(), self.pval, strict=True), 1)]
        return spark.createDataFrame(rows, "model int, dof long, loglikelihood double, deviance double, chisq double, pval double")

    def __str__(self) -> str:
        head = ["", "DOF", "ΔDOF", "LogLik", "Deviance", "Chisq", "p(>Chisq)"]
        body = []
        for i, (k, ll, dev, x, p) in enumerate(zip(self.dof, self.loglikelihood, self.deviance, self.chisq(), self.pval, strict=True)):
            more = str(abs(k - self.dof[i - 1])) if i else ""
            body.append([f"[{i + 1}]", str(k), more, f"{ll:.4f}", f"{dev:.4f}", "" if math.isnan(x) else f"{x:.4f}", p_text(p)])
        size = [max(len(r[j]) for r in [head, *body]) for j in range(len(head))]
        line = lambda r: "  ".join(c.rjust(w) for c, w in zip(r, size, strict=True))
        rule = "─" * (sum(size) + 2 * (len(size) - 1))
        return "\n".join([f"Likelihood-ratio test: {len(self.dof)} models fitted on {self.nobs} observations", rule, line(head), rule, *map(line, body), rule])


def lrtest(*models: Any, atol: float = 0.0) -> LRTest:
    """Compare nested models in order of their degrees of freedom, up or down."""
    if len(models) < 2:
        raise ValueError("a likelihood-ratio test needs two models at least")
    if len({type(getattr(m, "model", m)) for m in models}) > 1:
        raise ValueError("models of different types can't be compared")
    n, dof, ll = [m.nobs() for m in models], [m.dof() for m in models], [m.loglikelihood() for m in models]
    if len(set(n)) > 1:
        raise ValueError("models were fitted on different numbers of observations")
    up = dof[1] > dof[0]
    if any(a == b or (b > a) != up for a, b in zip(dof, dof[1:], strict=False)):
        raise ValueError("degrees of freedom must rise or fall strictly: the models aren't nested")
    order = list(models) if up else list(reversed(models))
    pairs = list(zip(order, order[1:], strict=False))
    nested = [check(large, atol=atol) if (check := getattr(small, "isnested", None)) else None for small, large in pairs]
    if any(known is not None and not known for known in nested):
        raise ValueError("the models aren't nested")
    if None in nested:
        kind = type(getattr(models[0], "model", models[0])).__name__
        warnings.warn(f"Could not check whether models are nested as model type {kind} does not implement isnested: results may not be meaningful", stacklevel=2)
    for small, large in pairs:
        a, b = small.loglikelihood(), large.loglikelihood()
        if b < a and not math.isclose(a, b, rel_tol=0.0 if atol else 1.5e-8, abs_tol=atol):
            raise ValueError("the log-likelihood must not fall as degrees of freedom rise")
    p = [math.nan, *(chi2_tail(2 * abs(y - x), abs(j - i)) for x, y, i, j in zip(ll, ll[1:], dof, dof[1:], strict=False))]
    return LRTest(n[0], tuple(m.deviance() for m in models), tuple(ll), tuple(dof), tuple(p))


def intercept_column(x: DataFrame) -> int:
    """The place of the first column that holds ones only, -1 if there is none: one aggregate over a model matrix."""
    names = [f"`{c.replace('`', '``')}`" for c in x.columns]
    row = x.agg(*[(F.min(c) == 1.0) & (F.max(c) == 1.0) & (F.count(c) == F.count(F.lit(1))) for c in names]).first() if names else ()
    return next((i for i, one in enumerate(row) if one), -1)


def normal_tail(z: float) -> float:
    """P(|Z| > |z|) of the standard normal distribution."""
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def _correlations(model: Any) -> tuple[np.ndarray, int]:
    names = list(model.coefnames())
    v = np.asarray(model.vcov(), float)
    at = names.index("(Intercept)") if "(Intercept)" in names else -1
    if at < 0 and hasattr(model, "modelmatrix"):
        at = intercept_column(model.modelmatrix())
    if at < 0:
        raise ValueError("variance inflation needs a model with an intercept")
    v = np.delete(np.delete(v, at, 0), at, 1)
    if len(v) < 2:
        raise ValueError("variance inflation needs two predictors at least")
    s = np.sqrt(np.diag(v))
    return v / np.outer(s, s), at


def vif(model: Any) -> np.ndarray:
    """Variance inflation of each predictor column."""
    r, _ = _correlations(model)
    return np.diag(np.linalg.inv(r))


def gvif(model: Any, scale: bool = False) -> np.ndarray:
    """Generalised variance inflation of each term; scaled to the power 1/(2 df)."""
    r, at = _correlations(model)
    matrix = next((p for p in parts(model.formula.rhs) if isinstance(p, Sum)), None)
    if matrix is None:
        raise ValueError("no matrix term in the formula")
    owner = [i for i, t in enumerate(matrix.terms) for _ in t.names()]
    del owner[at]
    whole, out = np.linalg.slogdet(r)[1], []
    for i in dict.fromkeys(owner):
        own = np.array([x == i for x in owner])
        log = np.linalg.slogdet(r[np.ix_(own, own)])[1] + np.linalg.slogdet(r[np.ix_(~own, ~own)])[1] - whole
        out.append(math.exp(log / (2 * own.sum()) if scale else log))
    return np.array(out)
