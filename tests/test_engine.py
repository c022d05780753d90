"""Binding, full-rank promotion, matrices, functions, frames, lag and lead, models, on small tables."""

import math
import warnings

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from designmat.errors import ColumnNotFoundError, EmptyColumnError, LevelError, LevelMismatchError, UnboundTermError
from designmat.functions.registry import formula_function, lenient
from designmat.operators.frame import ModelFrame, ModelMatrix, modelcols, modelmatrix, response
from designmat.operators.inference import chi2_tail, gvif, lrtest, t_quantile, t_two_sided, vif
from designmat.operators.models import GLM, OLS, Linear, fit, gram
from designmat.plans import catalogue
from designmat.plans.bind import StatisticalModel, apply_schema
from designmat.plans.contrasts import Dummy, Effects, Hypothesis
from designmat.plans.parser import formula
from designmat.plans.schema import Schema, schema
from designmat.plans.terms import Categorical, Continuous, TermBase, Var, describe, formula_of, lag
from designmat.sources.tables import from_rows
from designmat.streaming.project import stream_matrix


def rows(df):
    return [list(r) for r in df.collect()]


@pytest.fixture(scope="module")
def d4(spark):
    return from_rows(spark, {"y": [1, 2, 3, 4], "x1": [5, 6, 7, 8], "x2": [9, 10, 11, 12], "x3": [13, 14, 15, 16], "x4": [17, 18, 19, 20]})


@pytest.fixture(scope="module")
def cube(spark):
    x, y, z = [*"abababab"], [*"ccddccdd"], [*"eeeeffff"]
    return from_rows(spark, {"x": x, "y": y, "z": z, "n": [float(i) for i in range(1, 9)]})


E = {v: Effects() for v in "xyz"}


@pytest.mark.parametrize("text,names", [
    ("n ~ 0 + x", ["x: a", "x: b"]), ("n ~ 1 + x", ["(Intercept)", "x: b"]), ("n ~ x", ["(Intercept)", "x: b"]),
    ("n ~ 1 + x + x&y", ["(Intercept)", "x: b", "x: a & y: d", "x: b & y: d"]), ("n ~ 0 + x&y", ["x: a & y: c", "x: b & y: c", "x: a & y: d", "x: b & y: d"]),
    ("n ~ 0 + x&y + x&z", ["x: a & y: c", "x: b & y: c", "x: a & y: d", "x: b & y: d", "x: a & z: f", "x: b & z: f"]),
    ("n ~ 0 + x + x&y + x&z", ["x: a", "x: b", "x: a & y: d", "x: b & y: d", "x: a & z: f", "x: b & z: f"]),
])
def test_full_rank(cube, text, names):
    f = ModelFrame(text, cube, contrasts=E)
    m = np.array(rows(f.modelmatrix()))
    assert f.coefnames() == names and np.linalg.matrix_rank(m) == len(names) and f.formula.width()[1] == len(names)


def test_three_way_identity(cube):
    assert np.allclose(rows(ModelFrame("n ~ 0 + x&y&z", cube, contrasts=E).modelmatrix()), np.eye(8))
    f = ModelFrame("n ~ 0 + x&y + x&z + x&y&z", cube, contrasts=E)
    assert len(f.coefnames()) == 8 and np.linalg.matrix_rank(np.array(rows(f.modelmatrix()))) == 8


def test_no_promotion_without_model(cube):
    assert modelmatrix("n ~ 0 + x", cube, hints=E).columns == ["x: b"]


class NoIntercept(StatisticalModel):
    implicit_intercept, drop_intercept = False, True


def test_traits(cube):
    assert ModelFrame("n ~ 0 + x", cube, model=NoIntercept).coefnames() == ["x: b"]
    with pytest.raises(ValueError, match="no intercept"):
        ModelFrame("n ~ 1 + x", cube, model=NoIntercept)
    with pytest.raises(ValueError, match="1, 0 and -1"):
        ModelFrame("n ~ 2 + x", cube)


def test_forms_agree(d4):
    text = "y ~ 1 + x1 + x2*x3"
    wide = rows(modelmatrix(text, d4))
    assert wide == [[1.0, *map(float, (a, b, c, b * c))] for a, b, c in zip(range(5, 9), range(9, 13), range(13, 17), strict=True)]
    for form in ("vector", "sparse"):
        assert [r[0].toArray().tolist() for r in modelmatrix(text, d4, form=form).collect()] == wide
    long = {(r["y"], r["col"]): r["value"] for r in modelmatrix(text, d4, form="long", keep=("y",)).collect()}
    assert long == {(i, j): v for i, row in enumerate(wide, 1) for j, v in enumerate(row, 1) if v}
    m = ModelMatrix(ModelFrame(text, d4))
    assert m.assign == [1, 2, 3, 4, 5] and m.names == ["(Intercept)", "x1", "x2", "x3", "x2 & x3"]
    one = d4.limit(1)
    assert rows(modelmatrix(apply_schema(formula(text), schema(d4)).rhs, one)) == wide[:1]


def test_functions(spark):
    df = from_rows(spark, {"a": [0.0, 1.0, 4.0], "b": [0.0, 0.0, 2.0], "s": ["abc", "f", "éa"]})
    got = rows(modelmatrix("0 ~ log(a) + sqrt(a) + a / b + a ^ 2 + length(s) + gt_e(s) + ifelse(a > b, 1, 0)", df))
    assert got[0][0] == -math.inf and math.isnan(got[0][2]) and got[1][2] == math.inf and got[2][:4] == [math.log(4), 2.0, 2.0, 16.0]
    assert [r[4:] for r in got] == [[3.0, 0.0, 0.0], [1.0, 1.0, 1.0], [2.0, 1.0, 1.0]]
    with pytest.raises(PySparkException, match="log"):
        rows(modelmatrix("0 ~ log(a - 1)", df))
    with lenient():
        assert rows(modelmatrix("0 ~ log(a - 1)", df))[0] == [None]
    with pytest.raises(ValueError, match="registered"):
        modelmatrix("0 ~ nosuch(a)", df)
    formula_function("twice")(lambda c: c * 2)
    assert rows(modelmatrix("0 ~ twice(a)", df)) == [[0.0], [2.0], [8.0]]


def test_protect(d4):
    m = modelmatrix("y ~ protect(x1 + x2) + log(protect(x1 * x2))", d4)
    assert m.columns == ["x1 + x2", "log(protect(x1 * x2))"] and rows(m)[0] == [14.0, math.log(45)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m = modelmatrix("y ~ 1 - unprotect(x1 & x2)", d4)
    assert m.columns == ["1 - unprotect(x1 & x2)"] and rows(m)[0] == [1.0 - 45.0]


class Odd(TermBase):
    is_matrix_term = False

    def __init__(self, name):
        self.name = name

    def names(self):
        return [f"odd {self.name}"]

    def vars(self):
        return [self.name]

    def columns(self):
        return [F.col(self.name) % 2]


def test_own_terms(d4):
    f = apply_schema(formula_of("y", Var("x1") + Odd("x2")), Schema({"y": Continuous("y"), "x1": Continuous("x1")}))
    assert len(f.rhs) == 2 and [x.columns for x in modelcols(f.rhs, d4)] == [["x1"], ["odd x2"]]
    assert modelmatrix("y ~ poly(x1, 3)", d4).columns == ["x1^1", "x1^2", "x1^3"]
    with pytest.raises(ValueError):
        modelmatrix("y ~ poly(x1, x2)", d4)


def test_schema(spark, d4):
    s = schema(d4, formula("y ~ x1 + log(x2)"))
    assert list(s) == ["y", "x1"] and s["y"] == Continuous("y", 2.5, 5 / 3, 1.0, 4.0)
    df = from_rows(spark, {"b": [True, False, True], "i": [3, 1, 2], "f": [1.5, 2.0, float("nan")], "s": ["b", "a", None], "l": [[1], [2], [3]]})
    s = schema(df, ["b", "i", "f", "s"], {"i": "categorical", "s": Dummy(base="b")})
    assert isinstance(s["b"], Continuous) and s["i"].names() == ["i: 2", "i: 3"] and s["s"].names() == ["s: a"] and math.isnan(s["f"].mean)
    assert schema(df, ["i"], {"i": s["i"]})["i"] == s["i"]
    for bad, error in [(lambda: schema(df, ["l"]), TypeError), (lambda: schema(df, ["i"], {"i": Dummy}), TypeError), (lambda: schema([1]), TypeError),
                       (lambda: schema(df.limit(0), ["i"]), EmptyColumnError), (lambda: schema(df, ["ss"]), ColumnNotFoundError),
                       (lambda: schema(df, ["s"], max_levels=1), LevelError), (lambda: schema(df, ["s"], {"s": Dummy(levels=["a", "c"])}), LevelMismatchError)]:
        with pytest.raises(error):
            bad()
    with pytest.raises(ColumnNotFoundError, match="^There isn't a variable called 'aab' in your data; the nearest names appear to be: aaa, bbb$"):
        schema(from_rows(spark, {"yyy": [1], "aaa": [1], "bbb": [1]}), ["aab"])
    with pytest.raises(UnboundTermError):
        modelcols(Var("y"), d4)
    meta = df.withMetadata("s", {"ml_attr": {"type": "nominal", "vals": ["b", "a"]}})
    assert schema(meta, ["s"])["s"].contrasts.levels == ("b", "a")
    assert "y(continuous)" in describe(ModelFrame("y ~ x1", d4).formula)


def test_missing_rows(spark):
    df = from_rows(spark, {"y": [1.0, 2.0, None, 4.0], "x": ["a", "b", "c", "a"], "o": [None, 1, 1, 1]})
    f = ModelFrame("y ~ x", df)
    assert f.coefnames() == ["(Intercept)", "x: b"] and f.modelmatrix().count() == 3 and f.response().columns == ["y"]
    assert modelmatrix("y ~ x", df).count() == 4
    with pytest.warns(UserWarning, match="hasn't: q"):
        f.setcontrasts(x=Effects(), q=Effects())
    assert rows(f.modelmatrix()) == [[1.0, -1.0], [1.0, 1.0], [1.0, -1.0]]
    assert response("x ~ y", df).columns == ["x: b", "x: c"]


def test_shifts(spark):
    df = from_rows(spark, {"t": list(range(1, 11)), "x": list(range(1, 11)), "g": [1] * 5 + [2] * 5})
    one = lambda text, **k: [r[0] for r in modelmatrix(text, df, order_by="t", **k).collect()]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert one("x ~ lag(x, 1)") == [None, *map(float, range(1, 10))] and one("x ~ lead(x, 2)") == [*map(float, range(3, 11)), None, None]
        assert one("x ~ lag(x, -1)") == one("x ~ lead(x)") and one("x ~ lag(x, 0)") == list(map(float, range(1, 11))) and one("x ~ lag(x, 20)") == [None] * 10
        assert one("x ~ lag(lag(x, 1), 2)") == one("x ~ lag(x, 3)") and one("x ~ protect(x - lag(x))") == [None, *[1.0] * 9]
        assert rows(modelmatrix(lag("x", 2), df, order_by="t"))[2] == [1.0]
    assert one("x ~ lag(x)", partition_by="g") == [None, 1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0, 8.0, 9.0]
    with pytest.warns(UserWarning, match="one task"):
        one("x ~ lag(x)")
    cat = from_rows(spark, {"t": [1, 2, 3, 4], "y": [1, 2, 3, 4], "x": [*"ABAC"]})
    m = modelmatrix("y ~ 1 + lag(x, 2)", cat, order_by="t", partition_by=F.lit(1))
    assert m.columns == ["(Intercept)", "x: B_lag2", "x: C_lag2"] and rows(m)[2:] == [[1.0, 0.0, 0.0], [1.0, 1.0, 0.0]]
    for text in ("x ~ lag(x, g)", "x ~ lag(x, 1, 2)", "x ~ lag(x, 1.5)", "x ~ lag()"):
        with pytest.raises(ValueError):
            modelmatrix(text, df, order_by="t")
    with pytest.raises(ValueError, match="order_by"):
        modelmatrix("x ~ lag(x)", df)


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    n = 300
    x, z, g = rng.normal(1e6, 1, n), rng.normal(size=n), rng.choice(list("abc"), n)
    y = 2 + 3 * (x - 1e6) - z + (g == "b") + rng.normal(size=n)
    df = spark.createDataFrame([(float(i), float(j), float(k), str(m)) for i, j, k, m in zip(y, x, z, g, strict=True)], "y double, x double, z double, g string")
    m = fit(OLS, "y ~ x + z*g", df)
    X = np.array(rows(m.modelmatrix()))
    beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    assert np.allclose(m.coef()[1:], beta[1:], rtol=1e-6) and np.isclose(m.deviance(), rss[0]) and m.nobs() == n and m.dof_residual() == n - 7
    C = X - X.mean(0)
    C[:, 0] = 1
    assert np.allclose(m.vcov()[1:, 1:], (np.linalg.inv(C.T @ C) * rss[0] / (n - 7))[1:, 1:], rtol=1e-6)
    pred = np.array([r["prediction"] for r in m.predict(df).collect()])
    assert np.allclose(pred, X @ beta, atol=1e-5) and np.allclose([r[0] for r in rows(m.residuals())], y - pred)
    assert m.isnested(fit(OLS, "y ~ x + z*g + z^2", df)) and 0 < m.r2() < 1 and m.adjr2() < m.r2() and len(m.coeftable()) == 7 and "Coef." in str(m)
    table = m.predict(df.limit(5), interval="prediction").collect()
    assert all(r["lower"] < r["prediction"] < r["upper"] for r in table) and all(r[0] >= 0 for r in rows(m.cooksdistance()))
    with pytest.raises(ValueError, match="collinear"):
        fit(OLS, "y ~ z + protect(2 * z)", df)
    glm = fit(GLM, "y ~ z + g", df)
    assert np.allclose(glm.coef(), fit(OLS, "y ~ z + g", df).coef(), rtol=1e-6)
    cols = [F.col("z") * k for k in range(1, 71)]
    a, b = gram(df, cols), gram(df, cols[:3])
    assert a[0] == b[0] and np.allclose(a[1][:3], b[1]) and np.allclose(a[2][:3, :3], b[2])


def test_predict_rules(spark):
    df = from_rows(spark, {"y": [1.0, 2.0, 4.0, 3.0], "x": [*"abca"]})
    m = fit(OLS, "y ~ x", df)
    new = from_rows(spark, {"x": ["c", None, "a"]})
    assert [r["prediction"] for r in m.predict(new).collect()] == [pytest.approx(4.0), None, pytest.approx(2.0)]
    with pytest.raises(PySparkException, match="level not seen before"):
        m.predict(from_rows(spark, {"x": ["z"]})).collect()
    cells = fit(OLS, "y ~ 0 + x", df)
    assert np.allclose(cells.coef(), [2.0, 2.0, 4.0])
    h = fit(OLS, "y ~ x", df, contrasts={"x": Hypothesis({"b-a": [-1, 1, 0], "c-b": [0, -1, 1]}, levels=["a", "b", "c"])})
    assert np.allclose(h.coef()[1:], [0.0, 2.0]) and h.coefnames()[1:] == ["x: b-a", "x: c-b"]


class Fixed:
    def __init__(self, ll, dof, nobs=4, vcov=None, names=(), f=None):
        self.ll, self.k, self.n, self.v, self.c, self.formula = ll, dof, nobs, vcov, names, f

    def loglikelihood(self):
        return self.ll

    def deviance(self):
        return -self.ll

    def dof(self):
        return self.k

    def nobs(self):
        return self.n

    def vcov(self):
        return self.v

    def coefnames(self):
        return list(self.c)


class Nested(Fixed):
    def isnested(self, other, atol=0.0):
        return self.k < other.k


def test_lrtest():
    r = lrtest(Nested(-14.0, 1), Nested(-3.26, 2))
    assert math.isnan(r.pval[0]) and r.pval[1] == pytest.approx(3.57538284869704e-6)
    assert str(r).splitlines()[-2].split() == ["[2]", "2", "1", "-3.2600", "3.2600", "21.4800", "<1e-05"] and str(r).startswith("Likelihood-ratio test: 2 models fitted on 4 observations\n──")
    assert lrtest(Nested(-3.26, 2), Nested(-14.0, 1)).pval[1] == r.pval[1]
    with pytest.warns(UserWarning, match="Could not check whether models are nested as model type Fixed does not implement isnested"):
        assert lrtest(Fixed(-30.0, 0), Fixed(-10.86, 1)).pval[1] == pytest.approx(6.128757581368316e-10)
    for bad in ((Nested(-1, 1),), (Nested(-1, 1), Fixed(-1, 2)), (Nested(-1, 1), Nested(-1, 2, 5)), (Nested(-1, 1), Nested(-0.5, 1)), (Nested(-1.0, 1), Nested(-2.0, 2))):
        with pytest.raises(ValueError):
            lrtest(*bad)


def test_likelihoods_are_checked_after_unknown_nesting():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(ValueError, match="log-likelihood"):
            lrtest(Fixed(-1.0, 1), Fixed(-2.0, 2))
        assert lrtest(Fixed(-1.0, 1), Fixed(-1.00000001, 2)).pval[1] == pytest.approx(1, abs=1e-3)
        assert lrtest(Fixed(-1.0, 1), Fixed(-1.01, 2), atol=1).pval[1] < 1


def test_signs_beside_names_and_powers():
    assert str(formula("y ~ protect(x!=1)").rhs) == "protect(x != 1)" and str(formula("y ~ protect(f!(x))").rhs) == "protect(f!(x))"
    assert str(formula("y ~ protect(-2^2)").rhs) == "protect(-(2 ^ 2))" and str(formula("y ~ protect(-2 * x)").rhs) == "protect(-2 * x)"


def test_many_levels(spark):
    from designmat.plans.contrasts import Helmert

    df = spark.range(700).selectExpr("id", "cast(id % 70 as string) as g", "id % 70 as k")
    for name in "gk":
        for coding in (Dummy(), Effects(), Helmert()):
            f = ModelFrame(f"id ~ 1 + {name}", df, contrasts={name: coding})
            wide = {r["id"]: list(r)[1:] for r in f.modelmatrix(keep=("id",)).collect()}
            long = {(r["id"], r["col"]): r["value"] for r in f.modelmatrix(form="long", keep=("id",)).collect()}
            assert long == {(i, j): v for i, r in wide.items() for j, v in enumerate(r, 1) if v}
            m = f.schema[name].contrasts
            assert all(wide[i][1:] == m.row(str(i % 70) if name == "g" else i % 70).tolist() for i in range(70))
            with pytest.raises(PySparkException, match="level not seen before"):
                f.modelmatrix(df.withColumn(name, (df[name] + 100).cast(df.schema[name].dataType)), form="long", keep=("id",)).collect()
            null = f.modelmatrix(df.limit(1).withColumn(name, F.lit(None).cast(df.schema[name].dataType)))
            assert rows(null) == [[1.0] + [None] * 69]


def test_level_is_looked_up_once_a_row(spark):
    from designmat.plans.contrasts import Helmert

    df = spark.range(400).selectExpr("id", "cast(id % 200 as string) as g")
    for coding in (Dummy(), Effects(), Helmert()):
        x = modelmatrix("id ~ 0 + g", df, hints={"g": coding})
        made = x._jdf.queryExecution().optimizedPlan().projectList()
        shared = spark._jvm.org.apache.spark.sql.catalyst.expressions.EquivalentExpressions(False)
        for i in range(199):
            shared.addExprTree(made.apply(i).child(), getattr(shared, "addExprTree$default$2")())
        found = shared.getCommonSubexpressions()
        once = next(found.apply(i).toString() for i in range(found.length()) if "level not seen" in found.apply(i).toString())
        assert all("level not seen" not in (own := made.apply(i).toString().replace(once, "")) and " g#" not in own for i in range(199))
        with pytest.raises(PySparkException, match="level not seen before in g: 300"):
            m = ModelFrame("id ~ 1 + g", df, contrasts={"g": coding})
            m.modelmatrix(df.limit(1).withColumn("g", F.lit("300"))).select("`g: 7`").collect()


def test_decimal_levels(spark):
    df = spark.range(40).selectExpr("id", "case when id % 20 < 19 then cast(id % 20 / 4.0 as decimal(8, 2)) end as g")
    f = ModelFrame("id ~ 1 + g", df, contrasts={"g": Effects()})
    wide = {r["id"]: list(r)[1:] for r in f.modelmatrix(df, keep=("id",)).collect()}
    assert all(wide[i][1:] == (f.schema["g"].contrasts.matrix[i % 20].tolist() if i % 20 < 19 else [None] * 18) for i in range(40))
    long = {(r["id"], r["col"]): r["value"] for r in f.modelmatrix(df, form="long", keep=("id",)).collect()}
    assert long == {(i, j): v for i, r in wide.items() for j, v in enumerate(r, 1) if v != 0}


def test_glm_against_pyspark(spark):
    df = spark.range(400).selectExpr("cast(id % 7 as double) / 3 as x", "cast(id % 3 = 0 or id % 7 > 4 as double) as y", "1 + cast(id % 11 as double) as z")
    for family, left, more in (("binomial", "y", {}), ("poisson", "z", {}), ("gamma", "z", {"link": "log"}), ("binomial", "y", {"link": "cloglog"}), ("gaussian", "z", {}), ("poisson", "z", {"link": "sqrt"})):
        m = fit(GLM, f"{left} ~ x", df, family=family, **more)
        own = [r["prediction"] for r in m.fitted.__func__(m).collect()]
        assert np.allclose(own, [r["prediction"] for r in m.model.fitted.transform(modelmatrix(f"{left} ~ 0 + x", df, form="vector")).collect()])
        errors = m.model.summary.coefficientStandardErrors
        assert np.allclose(m.stderror(), [errors[-1], *errors[:-1]], rtol=1e-4) and np.isfinite(m.loglikelihood()) and m.dof_residual() == 398
        assert len(m.coeftable()) == 2 and "Pr(>" in str(m) and 0 <= m.r2("devianceratio") <= 1
        low = m.predict(df.limit(1), interval="confidence").first()
        assert low["lower"] <= low["prediction"] <= low["upper"] and np.allclose(m.predict(np.array([[1.0, 0.5]])), m.predict(from_rows(spark, {"x": [0.5]})).first()["prediction"])
    a, b = fit(Linear, "z ~ x", df), fit(OLS, "z ~ x", df)
    assert np.allclose(a.coef(), b.coef()) and np.allclose(a.vcov(), b.vcov()) and a.r2() == pytest.approx(b.r2()) and "Coef." in str(a)
    assert np.isnan(fit(Linear, "z ~ x", df, regParam=0.1).stderror()).all()


def test_vif_on_known_covariances(spark):
    v = np.array([[1.0, 0.2, 0.1], [0.2, 2.0, 0.5], [0.1, 0.5, 1.0]])
    r2 = 0.25 / 2
    assert np.allclose(vif(Fixed(0, 0, vcov=v, names=["(Intercept)", "a", "b"])), [1 / (1 - r2)] * 2)
    f = apply_schema(formula("y ~ 1 + a + b"), Schema({n: Continuous(n) for n in "yab"}))
    m = Fixed(0, 0, vcov=v, names=["(Intercept)", "a", "b"], f=f)
    assert np.allclose(gvif(m), vif(m)) and np.allclose(gvif(m, scale=True), np.sqrt(vif(m)))
    for names, cov in ((["a", "b", "c"], v), (["(Intercept)", "a"], v[:2, :2])):
        with pytest.raises(ValueError):
            vif(Fixed(0, 0, vcov=cov, names=names))


def test_tails():
    assert chi2_tail(3.84145882, 1) == pytest.approx(0.05) and chi2_tail(5.99146455, 2) == pytest.approx(0.05) and chi2_tail(7.81472790, 3) == pytest.approx(0.05)
    assert t_quantile(0.975, 10) == pytest.approx(2.228138852) and t_two_sided(2.228138852, 10) == pytest.approx(0.05) and t_quantile(0.5, 3) == pytest.approx(0, abs=1e-9)


def test_streams(spark, tmp_path):
    from_rows(spark, {"y": [1.0, 2.0], "x": ["a", "b"]}).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    f = apply_schema(formula("y ~ 1 + x"), schema(stored, ["y", "x"]))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(TypeError):
        schema(stream, ["x"])
    with pytest.raises(TypeError):
        stream_matrix("y ~ x", stream)
    with pytest.raises(ValueError):
        stream_matrix("y ~ lag(y)", stream, schema(stored))
    q = stream_matrix(f, stream).writeStream.format("memory").queryName("m").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(rows(spark.table("m"))) == [[1.0, 1.0, 0.0], [2.0, 1.0, 1.0]]


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_catalogue_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a == b or all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for x, y in zip(a, b, strict=True))


def test_plans(spark):
    """Only the formula's columns are read; a matrix is one projection without a shuffle."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = ModelFrame("l_extendedprice ~ l_quantity*l_returnflag", df).modelmatrix()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "l_tax" not in plan and "Python" not in plan and "IsNotNull(l_quantity)" in plan
    assert isinstance(schema(df, ["l_returnflag"])["l_returnflag"], Categorical)
