"""Fitting and predicting: ordinary least squares by one aggregate job, and adapters to pyspark.ml."""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designmat.operators.frame import ModelFrame
from designmat.operators.inference import normal_tail, p_text, t_quantile, t_two_sided
from designmat.plans.bind import RegressionModel
from designmat.plans.compile import both, columns, ref
from designmat.plans.terms import Categorical, Continuous, Interaction, TermBase, members, parts, shifted

#: Up to so many columns the products are plain aggregate expressions; beyond, each task sums blocks with numpy.
PLAIN = 60


def _centre(t: TermBase) -> list[float]:
    """A number near the mean of each column, known without data: keeps sums of squares from cancelling."""
    if isinstance(t, Continuous):
        return [t.mean if math.isfinite(t.mean) else 0.0]
    if isinstance(t, Categorical):
        return [sum(t.contrasts.column(j)) / len(t.contrasts.levels) for j in range(len(t.contrasts.names))]
    if isinstance(t, Interaction):
        out = np.ones(1)
        for x in t.terms:
            out = np.outer(_centre(x), out).ravel()
        return out.tolist()
    return [0.0] * t.width()


def gram(df: DataFrame, cols: list[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and products of columns, in one pass with partial sums before the shuffle."""
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    if p <= PLAIN:
        named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
        sums = [F.sum(f"c{i}").alias(f"s{i}") for i in range(p)] + [F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i, j in pairs]
        row = named.agg(F.count(F.lit(1)).alias("n"), *sums).first()
        n, s, q = row["n"], [row[f"s{i}"] or 0.0 for i in range(p)], {ij: row[f"p{ij[0]}_{ij[1]}"] or 0.0 for ij in pairs}
    else:

        def part(batches):
            import pandas as pd

            total, count = np.zeros((p + 1, p)), 0
            for b in batches:
                x = np.stack(b["x"].to_numpy())
                total[0] += x.sum(0)
                total[1:] += x.T @ x
                count += len(x)
            flat = np.concatenate([[count], total.ravel()])
            yield pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

        rows = df.select(F.array(*cols).alias("x")).mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(1 + p * (p + 1))
        for r in rows:
            flat[r["k"]] = r["v"]
        n, s, m = int(flat[0]), flat[1 : p + 1].tolist(), flat[p + 1 :].reshape(p, p)
        q = {(i, j): m[i, j] for i, j in pairs}
    out = np.zeros((p, p))
    for (i, j), v in q.items():
        out[i, j] = out[j, i] = v
    return n, np.array(s), out


class Estimated(RegressionModel):
    """What follows from coefficients, covariances and likelihoods of any fitted model."""

    exact_scale = False  # whether the dispersion is known, so that the normal distribution takes the place of t

    def stderror(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov()))

    def quantile(self, level: float) -> float:
        return NormalDist().inv_cdf((1 + level) / 2) if self.exact_scale else t_quantile((1 + level) / 2, self.dof_residual())

    def two_sided(self, t: float) -> float:
        return normal_tail(t) if self.exact_scale else t_two_sided(t, self.dof_residual())

    def confint(self, level: float = 0.95) -> np.ndarray:
        half = self.quantile(level) * self.stderror()
        return np.column_stack([self.coef() - half, self.coef() + half])

    def mean(self, eta: Column) -> Column:
        """The response that a linear predictor stands for."""
        return eta

    def r2(self, variant: str | None = None) -> float:
        """A pseudo R-squared: McFadden (the default), CoxSnell, Nagelkerke or devianceratio."""
        n = self.nobs()
        if variant == "devianceratio":
            return 1 - self.deviance() / self.nulldeviance()
        ll, null = self.loglikelihood(), self.nullloglikelihood()
        if variant in (None, "McFadden"):
            return 1 - ll / null
        snell = 1 - math.exp(2 * (null - ll) / n)
        if variant == "CoxSnell":
            return snell
        if variant == "Nagelkerke":
            return snell / (1 - math.exp(2 * null / n))
        raise ValueError(f"no R-squared called {variant}: McFadden, CoxSnell, Nagelkerke or devianceratio")

    def adjr2(self, variant: str | None = None) -> float:
        if variant == "devianceratio":
            return 1 - (self.deviance() / self.dof_residual()) / (self.nulldeviance() / (self.nobs() - 1))
        if variant in (None, "McFadden"):
            return 1 - (self.loglikelihood() - self.dof()) / self.nullloglikelihood()
        raise ValueError(f"no adjusted R-squared called {variant}: McFadden or devianceratio")


class OLS(Estimated):
    """Least squares by normal equations of centred columns; collinear columns are an error."""

    def __init__(self, coef, vcov, n: int, rss: float, tss: float, rss0: float, intercept: bool, inverse):
        self._coef, self._vcov, self._n, self._rss, self._tss, self._rss0 = coef, vcov, n, rss, tss, rss0
        self.intercept, self.inverse = intercept, inverse

    @classmethod
    def fit(cls, df: DataFrame, x: list[tuple[str, Column]], y: Column, centre: list[float], y_centre: float = 0.0) -> OLS:
        at = next((i for i, (n, _) in enumerate(x) if n == "(Intercept)"), None)
        keep = [i for i in range(len(x)) if i != at]
        c = np.array([centre[i] if at is not None else 0.0 for i in keep])
        y0 = y_centre if at is not None else 0.0
        cols = [x[i][1] - F.lit(float(m)) for i, m in zip(keep, c, strict=True)] + [y - F.lit(float(y0))]
        n, s, q = gram(df, cols)
        if n < len(x):
            raise ValueError(f"{n} rows can't determine {len(x)} coefficients")
        if at is not None:
            q = q - np.outer(s, s) / n
        a, b, yy = q[:-1, :-1], q[:-1, -1], max(q[-1, -1], 0.0)
        scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        unit = a / np.outer(scale, scale)
        if len(a) and np.linalg.matrix_rank(unit, hermitian=True, tol=1e-10) < len(a):
            raise ValueError(f"the columns are collinear: {', '.join(x[i][0] for i in keep)}")
        inv = np.linalg.inv(unit) / np.outer(scale, scale) if len(a) else np.zeros((0, 0))
        slopes = inv @ b
        rss = float(max(yy - slopes @ b, 0.0))
        df_left = n - len(x)
        coef, full = np.zeros(len(x)), np.zeros((len(x), len(x)))
        coef[keep] = slopes
        full[np.ix_(keep, keep)] = inv
        if at is not None:
            mean = c + s[:-1] / n
            coef[at] = y0 + s[-1] / n - slopes @ mean
            full[at, at] = 1 / n + mean @ inv @ mean
            full[at, keep] = full[keep, at] = -inv @ mean
        total = float(yy)
        return cls(coef, full * (rss / df_left if df_left else math.nan), n, rss, total, total, at is not None, full)

    def coef(self) -> np.ndarray:
        return self._coef

    def vcov(self) -> np.ndarray:
        return self._vcov

    def nobs(self) -> int:
        return self._n

    def dof(self) -> int:
        return len(self._coef) + 1

    def dof_residual(self) -> int:
        return self._n - len(self._coef)

    def deviance(self) -> float:
        return self._rss

    def nulldeviance(self) -> float:
        return self._tss

    def _ll(self, rss: float) -> float:
        return -self._n / 2 * (math.log(2 * math.pi * rss / self._n) + 1) if rss > 0 else math.inf

    def loglikelihood(self) -> float:
        return self._ll(self._rss)

    def nullloglikelihood(self) -> float:
        return self._ll(self._tss)

    def r2(self, variant: str | None = None) -> float:
        return 1 - self._rss / self._tss if variant is None else super().r2(variant)

    def adjr2(self, variant: str | None = None) -> float:
        return 1 - (1 - self.r2()) * (self._n - int(self.intercept)) / self.dof_residual() if variant is None else super().adjr2(variant)


class FittedModel:
    """A model, its frame and its formula; everything else asked of it is asked of the model."""

    def __init__(self, model: Any, frame: ModelFrame):
        self.model, self.frame, self.formula = model, frame, frame.formula

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") or name == "model":
            raise AttributeError(name)
        return getattr(self.model, name)

    def coefnames(self) -> list[str]:
        return self.frame.coefnames()

    def modelmatrix(self) -> DataFrame:
        return self.frame.modelmatrix()

    def response(self) -> DataFrame:
        return self.frame.response()

    def _predictors(self, df: DataFrame | None = None) -> list[Column]:
        """Columns of the matrix; of a table that has no variables but the matrix itself, its columns by name."""
        if df is not None and shifted(self.formula) and df.isStreaming:
            raise ValueError("lag and lead need the order of all rows, which a stream has not")
        needs = [v for p in parts(self.formula.rhs) for v in p.vars()]
        names = [n for n in self.coefnames() if n != "(Intercept)"]
        if df is not None and not set(needs) <= set(df.columns) and set(names) <= set(df.columns):
            return [F.lit(1.0) if n == "(Intercept)" else ref(n).cast("double") for n in self.coefnames()]
        return [c for _, c in both(self.formula, self.frame.at)[1]]

    def _dot(self, df: DataFrame | None = None) -> Column:
        out = F.lit(0.0)
        for c, b in zip(self._predictors(df), self.model.coef(), strict=True):
            out = out + c * F.lit(float(b))
        return out

    def _mean(self, eta: Column) -> Column:
        return self.model.mean(eta) if hasattr(self.model, "mean") else eta

    def predict(self, df: Any = None, interval: str | None = None, level: float = 0.95) -> Any:
        """All columns of a table and ``prediction`` on the scale of the response, null where a predictor is; with an
        interval ("confidence" or, for least squares, "prediction") also ``lower`` and ``upper``. The response isn't
        needed; unknown levels are errors. A table of the matrix's own columns, or an array of numbers with a column
        for each coefficient (which gives an array), does too."""
        if isinstance(df, np.ndarray | list):
            eta = np.asarray(df, float) @ self.model.coef()
            return self.model.mean_of(eta) if hasattr(self.model, "mean_of") else eta
        df = self.frame.data if df is None else df
        out = df.withColumn("prediction", self._mean(self._dot(df)))
        if interval is None:
            return out
        cols, v, spread = self._predictors(df), self.model.vcov(), F.lit(0.0)
        for i, x in enumerate(cols):
            for j in range(i, len(cols)):
                spread = spread + F.lit(float(v[i, j] * (1 if i == j else 2))) * x * cols[j]
        if interval == "prediction" and isinstance(self.model, OLS | Linear):
            spread = spread + F.lit(self.model.deviance() / self.model.dof_residual())
        elif interval != "confidence":
            raise ValueError("interval is confidence, or prediction for least squares")
        half = F.sqrt(F.greatest(spread, F.lit(0.0))) * F.lit(self.model.quantile(level))
        eta = self._dot(df)
        half = F.when(eta.isNotNull(), half)
        ends = self._mean(eta - half), self._mean(eta + half)
        return out.withColumns({"lower": F.least(*ends), "upper": F.greatest(*ends)})

    def fitted(self) -> DataFrame:
        return self.predict().select("prediction")

    def _left(self) -> Column:
        return columns(self.formula.lhs, self.frame.at)[0][1]

    def residuals(self) -> DataFrame:
        return self.frame.data.select((self._left() - self._mean(self._dot())).alias("residual"))

    def cooksdistance(self) -> DataFrame:
        cols, inv = [c for _, c in both(self.formula, self.frame.at)[1]], self.model.inverse
        h = F.lit(0.0)
        for i, x in enumerate(cols):
            for j in range(i, len(cols)):
                h = h + F.lit(float(inv[i, j] * (1 if i == j else 2))) * x * cols[j]
        e, mse = self._left() - self._dot(), self.model.deviance() / self.model.dof_residual()
        return self.frame.data.select((e * e / F.lit(len(cols) * mse) * h / ((1 - h) * (1 - h))).alias("cooks_distance"))

    def isnested(self, other: FittedModel, atol: float = 0.0) -> bool | None:
        """Whether the columns of this model are combinations of the other's, for the same response and rows.

        Columns of equal names and codings need no data. Otherwise one aggregate of products shows whether anything
        of this model's columns is left beside their projection on the other's.
        """
        if str(self.formula.lhs) != str(other.formula.lhs) or self.nobs() != other.nobs():
            return False
        mine, theirs = (both(m.formula, m.frame.at)[1] for m in (self, other))
        told = {n: str(c) for n, c in theirs}
        left = [c for n, c in mine if told.get(n) != str(c)]
        if not left:
            return True
        if self.frame.at.order_by or other.frame.at.order_by:
            return None
        p = len(theirs)
        n, s, q = gram(other.frame.data, [c for _, c in theirs] + left)
        scale = np.sqrt(np.where(np.diag(q) > 0, np.diag(q), 1.0))
        unit = q / np.outer(scale, scale)
        rest = unit[p:, p:] - unit[p:, :p] @ np.linalg.pinv(unit[:p, :p], rcond=1e-12, hermitian=True) @ unit[:p, p:]
        return bool((np.abs(np.diag(rest)) <= max(1e-8, atol)).all())

    def coeftable(self) -> list[dict]:
        """Estimates, and errors and intervals where the model has covariances."""
        names, coef = self.coefnames(), self.model.coef()
        if not hasattr(self.model, "vcov"):
            return [{"name": n, "coef": float(b)} for n, b in zip(names, coef, strict=True)]
        out = []
        for n, b, s, (lo, hi) in zip(names, coef, self.model.stderror(), self.model.confint(), strict=True):
            t = b / s if s > 0 else math.nan
            out.append({"name": n, "coef": float(b), "stderror": float(s), "t": float(t), "p": self.model.two_sided(t), "lower": float(lo), "upper": float(hi)})
        return out

    def __str__(self) -> str:
        rows = self.coeftable()
        z = "z" if getattr(self.model, "exact_scale", False) else "t"
        head = ["", "Coef.", "Std. Error", z, f"Pr(>|{z}|)", "Lower 95%", "Upper 95%"] if rows and "p" in rows[0] else ["", "Coef."]
        body = [[r["name"], f"{r['coef']:.6g}"] if "p" not in r else [r["name"], *(f"{r[k]:.6g}" for k in ("coef", "stderror")), f"{r['t']:.2f}", p_text(r["p"]), *(f"{r[k]:.6g}" for k in ("lower", "upper"))] for r in rows]
        size = [max(len(r[j]) for r in [head, *body]) for j in range(len(head))]
        line = lambda r: "  ".join([r[0].ljust(size[0]), *(c.rjust(w) for c, w in zip(r[1:], size[1:], strict=True))])
        rule = "─" * (sum(size) + 2 * (len(size) - 1))
        return "\n".join([type(self.model).__name__, "", str(self.formula), "", "Coefficients:", rule, line(head), rule, *map(line, body), rule])


def fit(model: type, f: Any, df: DataFrame, contrasts: dict | None = None, order_by: Any = (), partition_by: Any = (), **options: Any) -> FittedModel:
    """Drop missing rows, bind, and fit. A model type has ``fit(df, x, y, centre, y_centre)`` for named columns."""
    frame = ModelFrame(f, df, model, contrasts, order_by, partition_by)
    y, x = both(frame.formula, frame.at)
    if len(y) != 1:
        raise ValueError(f"the response has {len(y)} columns; one is needed")
    centre = [c for p in parts(frame.formula.rhs) for t in members(p) for c in _centre(t)]
    data, left = frame.data, y[0][1]
    if frame.at.order_by:  # window columns can't stand inside an aggregate, and rows off the edge are left out
        data = data.select(left.alias("y"), *[c.alias(f"x{i}") for i, (_, c) in enumerate(x)]).na.drop()
        left, x = F.col("y"), [(n, F.col(f"x{i}")) for i, (n, _) in enumerate(x)]
    return FittedModel(model.fit(data, x, left, centre, _centre(frame.formula.lhs)[0], **options), frame)


def _split(names: list[str], fitted: Any) -> np.ndarray:
    own = dict(zip([n for n in names if n != "(Intercept)"], fitted.coefficients.toArray(), strict=True))
    return np.array([fitted.intercept if n == "(Intercept)" else own[n] for n in names])


def _assembled(df: DataFrame, x: list, y: Column) -> tuple[DataFrame, list]:
    from designmat.sources.tables import vector

    inner = [(n, c) for n, c in x if n != "(Intercept)"]
    return vector(df.withColumn("_y", y), inner, keep=["_y"]), inner


#: The mean by the linear predictor, and its slope as a function of both, by link.
LINKS = {
    "identity": (lambda e: e, lambda e, m: F.lit(1.0)),
    "log": (F.exp, lambda e, m: m),
    "inverse": (lambda e: 1 / e, lambda e, m: -m * m),
    "sqrt": (lambda e: e * e, lambda e, m: 2 * e),
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e, m: m * (1 - m)),
    "cloglog": (lambda e: 1 - F.exp(-F.exp(e)), lambda e, m: F.exp(e - F.exp(e))),
}
CANONICAL = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse"}
VARIANCE = {"gaussian": lambda m: F.lit(1.0), "binomial": lambda m: m * (1 - m), "poisson": lambda m: m, "gamma": lambda m: m * m}


class GLM(Estimated):
    """Adapter to pyspark.ml's generalised linear regression, on the columns of a formula.

    Predictions are on the scale of the response. Covariances come from one more aggregate, of the weighted products
    of the columns, made when first asked for. Families gaussian, binomial, poisson and gamma; all links but probit.
    """

    def __init__(self, fitted: Any, names: list[str], df: DataFrame, cols: list[Column]):
        self.fitted, self._df, self._cols = fitted, df, cols
        self._coef, self._vcov = _split(names, fitted), None
        self.family = fitted.getFamily()
        self.link = fitted.getLink() if fitted.isDefined(fitted.link) else CANONICAL[self.family]
        self.exact_scale = self.family in ("binomial", "poisson")
        self.summary = fitted.summary

    @classmethod
    def fit(cls, df: DataFrame, x: list, y: Column, centre: list, y_centre: float = 0.0, **options: Any) -> GLM:
        from pyspark.ml.regression import GeneralizedLinearRegression

        family = options.get("family", "gaussian")
        if family not in CANONICAL or options.get("link") not in (None, *LINKS):
            raise ValueError(f"families are {', '.join(CANONICAL)} and links {', '.join(LINKS)}")
        data, inner = _assembled(df, x, y)
        if not inner:
            raise ValueError("a generalised linear model needs a predictor beside the intercept")
        model = GeneralizedLinearRegression(labelCol="_y", fitIntercept=len(inner) < len(x), **options).fit(data)
        return cls(model, [n for n, _ in x], df, [c for _, c in x])

    def mean(self, eta: Column) -> Column:
        return LINKS[self.link][0](eta)

    def mean_of(self, eta: np.ndarray) -> np.ndarray:
        return {"identity": lambda e: e, "log": np.exp, "inverse": lambda e: 1 / e, "sqrt": np.square, "logit": lambda e: 1 / (1 + np.exp(-e)), "cloglog": lambda e: 1 - np.exp(-np.exp(e))}[self.link](eta)

    def coef(self) -> np.ndarray:
        return self._coef

    def vcov(self) -> np.ndarray:
        if self._vcov is None:
            eta = F.lit(0.0)
            for c, b in zip(self._cols, self._coef, strict=True):
                eta = eta + c * F.lit(float(b))
            named = self._df.select(eta.alias("eta"), *[c.alias(f"x{i}") for i, c in enumerate(self._cols)])
            mean = LINKS[self.link][0](F.col("eta"))
            slope = LINKS[self.link][1](F.col("eta"), mean)
            weight = F.abs(slope) / F.sqrt(VARIANCE[self.family](mean))
            _, _, q = gram(named, [F.col(f"x{i}") * weight for i in range(len(self._cols))])
            scale = np.sqrt(np.diag(q))
            self._vcov = np.linalg.inv(q / np.outer(scale, scale)) / np.outer(scale, scale) * self.summary.dispersion
        return self._vcov

    def nobs(self) -> int:
        return self.summary.numInstances

    def _scale(self) -> int:
        return int(not self.exact_scale)

    def dof(self) -> int:
        return len(self._coef) + self._scale()

    def dof_residual(self) -> int:
        return self.nobs() - len(self._coef)

    def deviance(self) -> float:
        return self.summary.deviance

    def nulldeviance(self) -> float:
        return self.summary.nullDeviance

    def loglikelihood(self) -> float:
        return self.dof() - self.summary.aic / 2

    def nullloglikelihood(self) -> float:
        if self.family == "gaussian":
            return -self.nobs() / 2 * (math.log(2 * math.pi * self.nulldeviance() / self.nobs()) + 1)
        if not self.exact_scale:
            raise ValueError("the null log-likelihood of a gamma model needs a fit of its own")
        return self.loglikelihood() - (self.nulldeviance() - self.deviance()) / 2


class Linear(OLS):
    """Adapter to pyspark.ml's linear regression, for options that OLS lacks (elastic net, l-bfgs, huber loss).

    Without a penalty the statistics are those of least squares; with one, covariances aren't defined."""

    def __init__(self, fitted: Any, names: list[str], ols: OLS | None, penalty: bool):
        self.fitted, self.summary, self._coef = fitted, fitted.summary, _split(names, fitted)
        self._n, self.penalty = self.summary.numInstances, penalty
        self._rss = float(self.summary.meanSquaredError * self._n)
        total = self.summary.r2
        self._tss = self._rss / (1 - total) if total < 1 else math.inf
        self.intercept = "(Intercept)" in names
        self._vcov, self.inverse = (ols._vcov, ols.inverse) if ols else (np.full((len(names),) * 2, math.nan), None)

    @classmethod
    def fit(cls, df: DataFrame, x: list, y: Column, centre: list, y_centre: float = 0.0, **options: Any) -> Linear:
        from pyspark.ml.regression import LinearRegression

        data, inner = _assembled(df, x, y)
        model = LinearRegression(labelCol="_y", fitIntercept=len(inner) < len(x), **options).fit(data)
        penalty = bool(options.get("regParam")) or options.get("loss") == "huber"
        return cls(model, [n for n, _ in x], None if penalty else OLS.fit(df, x, y, centre, y_centre), penalty)
