"""More queries of the catalogue: models, wide and sparse codings, run-time formulas, rules, questions to terms, errors."""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.errors import near_names
from designmat.functions.registry import formula_function, lenient, syntax
from designmat.operators.frame import ModelFrame, ModelMatrix, missing_omit, modelcols, modelmatrix, response
from designmat.operators.inference import gvif, intercept_column, lrtest, vif
from designmat.operators.models import GLM, OLS, Linear, fit, gram
from designmat.plans.bind import RegressionModel, StatisticalModel, apply_schema
from designmat.plans.catalogue import LINE, ONE, Q, R, S, T, case, is_, matrix, query, rounded, table_of
from designmat.plans.compile import columns
from designmat.plans.contrasts import Custom, Dummy, Effects, Helmert, Hypothesis, SeqDiff, SparseMatrix, code, hypothesis_matrix, needs_intercept
from designmat.plans.parser import formula
from designmat.plans.schema import Schema, schema
from designmat.plans.terms import (
    Const, Continuous, Interaction, Sum, TermBase, Var, call, describe, drop_term, formula_of, has_intercept, has_response, interact, lag, lead, leaves,
    omits_intercept, plus, star, symbols, term, term_names,
)
from designmat.sources.tables import from_rows
from designmat.streaming.project import stream_matrix

# --- models ---------------------------------------------------------------------------------------------------

GROUPS = "SELECT o_orderpriority AS g, count(*)::DOUBLE AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS p FROM orders GROUP BY 1"
LOGIT = "o_done ~ 1 + o_orderpriority"


def done(t) -> DataFrame:
    return t("orders").withColumn("o_done", (F.col("o_orderstatus") == "F").cast("double"))


@query(f"WITH g AS ({GROUPS}) SELECT o_orderkey, round(p, 6) AS prediction FROM orders JOIN g ON o_orderpriority = g")
def glm_predict(t, spark):
    m = fit(GLM, LOGIT, done(t), family="binomial", tol=1e-10)
    return m.predict(t("orders").select("o_orderkey", "o_orderpriority")).select("o_orderkey", F.round("prediction", 6).alias("prediction"))


@query(f"""WITH g AS ({GROUPS}), b AS (SELECT ln(p / (1 - p)) AS l, 1 / (n * p * (1 - p)) AS v FROM g WHERE g = '1-URGENT')
SELECT '(Intercept)' AS name, round(l, 5) AS coef, round(sqrt(v), 5) AS stderror FROM b UNION ALL
SELECT 'o_orderpriority: ' || g, round(ln(p / (1 - p)) - l, 5), round(sqrt(v + 1 / (n * p * (1 - p))), 5) FROM g, b WHERE g <> '1-URGENT'""")
def glm_coef(t, spark):
    m = fit(GLM, LOGIT, done(t), family="binomial", tol=1e-10)
    return spark.createDataFrame([(r["name"], round(r["coef"], 5), round(r["stderror"], 5)) for r in m.coeftable()], "name string, coef double, stderror double")


BERNOULLI = f"""WITH g AS ({GROUPS}), a AS (SELECT sum(n) AS n, sum(n * p) / sum(n) AS p FROM g),
l AS (SELECT sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) AS ll FROM g), z AS (SELECT n * (p * ln(p) + (1 - p) * ln(1 - p)) AS null_ll, n FROM a)"""


@query(f"""{BERNOULLI} SELECT name, round(value, 4) AS value FROM l, z, LATERAL (VALUES ('deviance', -2 * ll), ('dof', 5.0), ('dof_residual', n - 5), ('loglikelihood', ll),
('nobs', n), ('nulldeviance', -2 * null_ll), ('nullloglikelihood', null_ll), ('r2', 1 - ll / null_ll), ('adjr2', 1 - (ll - 5) / null_ll), ('CoxSnell', 1 - exp(2 * (null_ll - ll) / n)), ('devianceratio', 1 - ll / null_ll)) AS v(name, value)""")
def glm_statistics(t, spark):
    m = fit(GLM, LOGIT, done(t), family="binomial", tol=1e-10)
    names = ["deviance", "dof", "dof_residual", "loglikelihood", "nobs", "nulldeviance", "nullloglikelihood", "r2", "adjr2"]
    return table_of(spark, [*names, "CoxSnell", "devianceratio"], [*(getattr(m, n)() for n in names), m.r2("CoxSnell"), m.r2("devianceratio")])


@query(f"{BERNOULLI} SELECT round(2 * (ll - null_ll), 3) AS chisq, round(exp(-(ll - null_ll)) * (1 + (ll - null_ll)), 5) AS pval FROM l, z")
def glm_lrtest(t, spark):
    full = fit(GLM, LOGIT, done(t), family="binomial", tol=1e-10)

    class Null:  # the mean alone, in closed form
        model = full.model
        nobs, deviance, loglikelihood = full.nobs, full.nulldeviance, full.nullloglikelihood
        dof, isnested = staticmethod(lambda: 1), staticmethod(lambda other, atol=0.0: True)

    r = lrtest(Null(), full)
    return spark.createDataFrame([(round(r.chisq()[1], 3), round(r.pval[1], 5))], "chisq double, pval double")


RATES = "SELECT o_orderstatus AS g, avg(o_totalprice) AS m FROM orders GROUP BY 1"


@query(f"WITH g AS ({RATES}) SELECT 'o_orderstatus: ' || g AS name, round(ln(m), 5) AS value FROM g")
def glm_gamma_log(t, spark):
    m = fit(GLM, "o_totalprice ~ 0 + o_orderstatus", t("orders"), family="gamma", link="log", tol=1e-10)
    return table_of(spark, m.coefnames(), m.coef(), 5)


@query(f"{LINE.replace('SELECT', 'WITH r AS (SELECT', 1)}) SELECT x AS name, round(v, 3) AS value FROM r, LATERAL (VALUES ('(Intercept)', a), ('o_custkey', b)) AS w(x, v)")
def linear_adapter(t, spark):
    m = fit(Linear, "o_totalprice ~ o_custkey", t("orders"))
    return table_of(spark, m.coefnames(), m.coef(), 3)


WITH = f"WITH r AS ({LINE})"


@query(f"""{WITH} SELECT name, round(v, 4) AS value FROM r, LATERAL (VALUES ('coef (Intercept)', a), ('coef o_custkey', b), ('stderror (Intercept)', sqrt(rss / (n - 2) * (1.0 / n + m * m / sxx))),
('stderror o_custkey', sqrt(rss / (n - 2) / sxx)), ('t o_custkey', b / sqrt(rss / (n - 2) / sxx))) AS w(name, v)""")
def coeftable_ols(t, spark):
    one, two = fit(OLS, "o_totalprice ~ o_custkey", t("orders")).coeftable()
    return table_of(spark, ["coef (Intercept)", "coef o_custkey", "stderror (Intercept)", "stderror o_custkey", "t o_custkey"], [one["coef"], two["coef"], one["stderror"], two["stderror"], two["t"]])


@query(f"""{WITH}, y AS (SELECT regr_syy(o_totalprice, o_custkey) AS tss FROM orders) SELECT name, round(v, 6) AS value FROM r, y, LATERAL (VALUES ('r2', 1 - rss / tss), ('adjr2', 1 - (rss / (n - 2)) / (tss / (n - 1))),
('devianceratio', 1 - rss / tss), ('McFadden', 1 - (ln(2 * pi() * rss / n) + 1) / (ln(2 * pi() * tss / n) + 1)), ('CoxSnell', 1 - rss / tss), ('dof', 3.0), ('dof_residual', n - 2.0), ('nobs', n)) AS w(name, v)""")
def ols_statistics(t, spark):
    m = fit(OLS, "o_totalprice ~ o_custkey", t("orders"))
    kinds = ["devianceratio", "McFadden", "CoxSnell"]
    return table_of(spark, ["r2", "adjr2", *kinds, "dof", "dof_residual", "nobs"], [m.r2(), m.adjr2(), *map(m.r2, kinds), m.dof(), m.dof_residual(), m.nobs()], 6)


@query(f"{WITH} SELECT round(o_totalprice - a - b * o_custkey, 3) AS residual FROM orders, r")
def residuals_table(t, spark):
    return rounded(fit(OLS, "o_totalprice ~ o_custkey", t("orders")).residuals(), 3)


@query(f"{WITH} SELECT round(a + b * o_custkey, 3) AS prediction FROM orders, r")
def fitted_values(t, spark):
    return rounded(fit(OLS, "o_totalprice ~ o_custkey", t("orders")).fitted(), 3)


@query(f"{WITH}, h AS (SELECT power(o_totalprice - a - b * o_custkey, 2) AS e, 1.0 / n + (o_custkey - m) ** 2 / sxx AS h, rss / (n - 2) AS s FROM orders, r) SELECT round(e / (2 * s) * h / ((1 - h) * (1 - h)), 8) AS cooks_distance FROM h")
def cooks_distance(t, spark):
    return rounded(fit(OLS, "o_totalprice ~ o_custkey", t("orders")).cooksdistance(), 8)


@query(f"{WITH} SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, round(a + b * o_custkey, 3) AS prediction FROM orders, r")
def predict_matrix(t, spark):
    """A model asked with the matrix's own columns: none of its variables (here o_custkey doubled) is in the table."""
    m = fit(OLS, "o_totalprice ~ protect(o_custkey * 2)", t("orders"))
    x = t("orders").select((F.col("o_custkey") * 2).alias("o_custkey * 2"))
    return m.predict(x).select((F.col("`o_custkey * 2`") / 2).alias("o_custkey"), F.round("prediction", 3).alias("prediction"))


@query(f"""SELECT i, j, round(i * j * s) AS product FROM (SELECT sum({T} * {T})::DOUBLE AS s FROM lineitem), (VALUES (1, 1), (1, 70), (35, 70), (70, 70)) AS v(i, j)""")
def gram_seventy_columns(t, spark):
    """Products of more columns than plain aggregate expressions are made for."""
    _, _, q = gram(t("lineitem"), [F.col(T) * k for k in range(1, 71)])
    return spark.createDataFrame([(i, j, float(round(q[i - 1, j - 1]))) for i, j in ((1, 1), (1, 70), (35, 70), (70, 70))], "i int, j int, product double")


@query("SELECT * FROM (VALUES ('cells in cell means', true), ('line in cells', false), ('mean in line', true), ('other rows', false), ('recoded', true)) AS v(pair, nested)")
def isnested_pairs(t, spark):
    d = t("orders")
    m = {f: fit(OLS, f"o_totalprice ~ {f}", d) for f in ("1", "o_custkey", "1 + o_orderstatus", "0 + o_orderstatus")}
    effects = fit(OLS, "o_totalprice ~ o_orderstatus", d, contrasts={"o_orderstatus": Effects()})
    some = fit(OLS, "o_totalprice ~ o_custkey", d.where("o_custkey % 2 = 0"))
    pairs = {
        "mean in line": (m["1"], m["o_custkey"]), "line in cells": (m["o_custkey"], m["1 + o_orderstatus"]), "cells in cell means": (m["1 + o_orderstatus"], m["0 + o_orderstatus"]),
        "recoded": (effects, m["1 + o_orderstatus"]), "other rows": (m["1"], some),
    }
    return spark.createDataFrame([(k, bool(a.isnested(b))) for k, (a, b) in pairs.items()], "pair string, nested boolean")


@query("SELECT * FROM (VALUES ('1 + q', 0), ('q + one', 1), ('q', -1)) AS v(columns, place)")
def intercept_columns(t, spark):
    d = t("lineitem").withColumn("one", F.lit(1.0))
    tried = {"1 + q": "1 + l_quantity", "q + one": "0 + l_quantity + one", "q": "0 + l_quantity"}
    return spark.createDataFrame([(k, intercept_column(modelmatrix(f"l_tax ~ {f}", d))) for k, f in tried.items()], "columns string, place int")


# --- codings --------------------------------------------------------------------------------------------------

THOUSAND = "(SELECT *, CAST(l_partkey % 1000 AS VARCHAR) AS part FROM lineitem)"


def parted(df: DataFrame) -> DataFrame:
    return df.withColumn("part", (F.col("l_partkey") % 1000).cast("string"))


@query(f"SELECT l_orderkey, l_partkey, name, 1::DOUBLE AS value FROM {THOUSAND}, LATERAL (VALUES ('(Intercept)'), ('part: ' || part)) AS v(name) WHERE name <> 'part: 0'")
def mm_thousand_levels(t, spark):
    """A factor of a thousand levels in long form: a lookup a row, no thousand columns."""
    return modelmatrix("l_tax ~ 1 + part", parted(t("lineitem")), form="long", keep=("l_orderkey", "l_partkey")).drop("col")


@query(f"""WITH l AS (SELECT DISTINCT CAST(o_custkey % 200 AS VARCHAR) AS g FROM orders), c AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS g, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
SELECT 'g: ' || l.g AS name, coalesce(c.n, 0) - (SELECT n FROM c WHERE g = '0') AS total FROM l LEFT JOIN c ON l.g = c.g WHERE l.g <> '0'""")
def mm_effects_200_levels(t, spark):
    """Wide effects coding of 200 levels, summed by column."""
    d = t("orders").withColumn("g", (F.col("o_custkey") % 200).cast("string"))
    x = modelmatrix("o_totalprice ~ 0 + g", d, hints={"g": Effects()})
    sums = x.agg(*[F.sum(f"`{c}`").alias(f"c{i}") for i, c in enumerate(x.columns)])
    return sums.select(F.explode(F.arrays_zip(F.split(F.lit("\x01".join(x.columns)), "\x01").alias("name"), F.array(*sums.columns).alias("total"))).alias("e")).select("e.name", "e.total")


matrix("mm_sparse_contrasts", "lineitem", "l_tax ~ 1 + l_returnflag", {"(Intercept)": ONE, f"{R}: N": case(R, ["A", "N", "R"], [0, 2, 0]), f"{R}: R": case(R, ["A", "N", "R"], [0, 0, -3])}, hints={R: Custom(SparseMatrix([{}, {0: 2.0}, {1: -3.0}], 2))})


@query("SELECT * FROM (VALUES ('dummy', '1 0 0; -1 1 0; -1 0 1'), ('effects', '-1/3 2/3 -1/3; -1/3 -1/3 2/3'), ('hypothesis', '-1 1 0; -1 0 1'), ('seqdiff', '-1 1 0; 0 -1 1')) AS v(coding, weights)")
def hypothesis_weights(t, spark):
    levels = ["A", "N", "R"]
    tried = {"dummy": Dummy(), "effects": Effects(), "seqdiff": SeqDiff(), "hypothesis": Hypothesis({"N-A": [-1, 1, 0], "R-A": [-1, 0, 1]}, levels=levels)}
    text = lambda w: "; ".join(" ".join(map(str, r)) for r in (w.tolist() if isinstance(w, np.ndarray) else w))
    return spark.createDataFrame([(k, text(hypothesis_matrix(code(c, levels)))) for k, c in tried.items()], "coding string, weights string")


@query("SELECT * FROM (VALUES ('dummy', true), ('effects', false), ('helmert', false), ('seqdiff', false)) AS v(coding, needed)")
def needs_intercept_table(t, spark):
    tried = {"dummy": Dummy(), "effects": Effects(), "helmert": Helmert(), "seqdiff": SeqDiff()}
    return spark.createDataFrame([(k, needs_intercept(code(c, list("abcd")).matrix)) for k, c in tried.items()], "coding string, needed boolean")


# --- run-time formulas and terms ------------------------------------------------------------------------------

@query(f"SELECT {ONE} AS \"(Intercept)\", {Q} AS {Q}, {T} AS {T}, {Q} * {T} AS \"{Q} & {T}\" FROM lineitem")
def formula_at_run_time(t, spark):
    names = [Q, T]
    f = formula_of("l_extendedprice", sum([term(1), *map(term, names), interact(*map(term, names))]))
    return modelmatrix(f, t("lineitem"))


@query(f"SELECT ln({T} + 1) AS \"log({T} + 1)\", {Q} + {T} AS \"{Q} + {T}\" FROM lineitem")
def calls_at_run_time(t, spark):
    return modelmatrix(plus(call("log", call("+", T, 1)), call("+", Q, T)), t("lineitem"))


@query(f"SELECT {Q} AS {Q}, {T} AS {T} FROM lineitem")
def modelcols_of_terms(t, spark):
    d = t("lineitem")
    s = schema(d, [Q, T])
    return modelcols(apply_schema((Var(Q), Var(T)), s), d)


@query("SELECT CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def modelcols_of_a_formula(t, spark):
    d = t("orders")
    y, x = modelcols(apply_schema(formula("o_totalprice ~ o_custkey"), schema(d, ["o_totalprice", "o_custkey"])), d)
    assert y.columns == ["o_totalprice"]
    return x


@query(f"SELECT {Q} AS {Q} FROM lineitem")
def interaction_with_one(t, spark):
    return modelmatrix(f"l_tax ~ {Q} & 1", t("lineitem"))


matrix("mm_compare_unspaced", "lineitem", "l_tax ~ 0 + protect(l_linenumber!=1) + protect(-2^2 * l_tax)", {"l_linenumber != 1": "CAST(l_linenumber <> 1 AS DOUBLE)", "-(2 ^ 2) * l_tax": f"-4.0::DOUBLE * {T}"})


@formula_function("squared_and_plain", term_level=True)
def _squared_and_plain(x: TermBase) -> TermBase:
    """A function of terms: a term and its square."""
    return plus(x, call("^", x, 2)) if isinstance(x, Var) else plus(x, call("^", Var(x.name), 2))


@query(f"SELECT {Q} AS {Q}, {Q} * {Q} AS \"{Q} ^ 2\" FROM lineitem")
def function_of_terms(t, spark):
    return modelmatrix(f"l_tax ~ squared_and_plain({Q})", t("lineitem"))


@syntax("halved")
def _halved(c, s, bind):
    return call("/", c.args[0], 2, text=f"{c.args[0]} halved")


class Halver(RegressionModel):
    """A kind of model to which halved means something else."""


@syntax("halved", Halver)
def _halved_twice(c, s, bind):
    return call("/", c.args[0], 4, text=f"{c.args[0]} quartered")


@query(f"SELECT {ONE} AS \"(Intercept)\", {Q} / 2 AS \"{Q} halved\" FROM lineitem")
def own_syntax(t, spark):
    return modelmatrix(f"l_tax ~ 1 + halved({Q})", t("lineitem"))


@query(f"SELECT {ONE} AS \"(Intercept)\", {Q} / 4 AS \"{Q} quartered\" FROM lineitem")
def own_syntax_by_model(t, spark):
    return ModelFrame(f"l_tax ~ halved({Q})", t("lineitem"), model=Halver).modelmatrix()


class Bare(StatisticalModel):
    implicit_intercept, drop_intercept = False, True


@query(f"SELECT {is_(R, 'N')} AS \"{R}: N\", {is_(R, 'R')} AS \"{R}: R\" FROM lineitem")
def model_without_intercept(t, spark):
    return ModelFrame(f"l_tax ~ 0 + {R}", t("lineitem"), model=Bare).modelmatrix()


class Parity(TermBase):
    """An own term that stands beside the matrix."""

    is_matrix_term = False

    def __init__(self, name: str):
        self.name = name

    def names(self) -> list[str]:
        return [f"{self.name} is odd"]

    def vars(self) -> list[str]:
        return [self.name]

    def columns(self) -> list:
        return [F.col(self.name) % 2]


@query("SELECT CAST(l_linenumber % 2 AS DOUBLE) AS \"l_linenumber is odd\" FROM lineitem")
def own_terms(t, spark):
    d = t("lineitem")
    f = apply_schema(formula_of(T, plus(Var(Q), Parity("l_linenumber"))), schema(d, [Q, T]))
    return modelcols(f.rhs, d)[1]


@query("SELECT count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 7) IS NOT NULL")
def rows_without_missing(t, spark):
    left = missing_omit(t("lineitem").withColumn("k", F.nullif("l_linenumber", F.lit(7))), f"{T} ~ k")
    return left.agg(F.count("*").alias("n"))


@query("SELECT o_totalprice FROM orders")
def response_column(t, spark):
    return response("o_totalprice ~ o_custkey", t("orders"))


@query("SELECT * FROM (VALUES (1, 1.5::DOUBLE, 0.0::DOUBLE), (2, 2.5::DOUBLE, 1.0::DOUBLE), (3, 3.5::DOUBLE, 0.0::DOUBLE)) AS v(k, x, \"g: b\")")
def literal_rows(t, spark):
    return modelmatrix("0 ~ x + g", from_rows(spark, {"k": [1, 2, 3], "x": [1.5, 2.5, 3.5], "g": ["a", "b", "a"]}), keep=("k",)).withColumn("k", F.col("k").cast("int"))


# --- functions and floating-point rules -----------------------------------------------------------------------

matrix("mm_func_date", "orders", "o_totalprice ~ 0 + year(o_orderdate) + month(o_orderdate) + hour(o_orderdate)", {f"{f}(o_orderdate)": f"CAST({f}(o_orderdate) AS DOUBLE)" for f in ("year", "month", "hour")})
matrix("mm_func_array", "embeddings", "label ~ 0 + size(embedding) + element_at(embedding, 1)", {"size(embedding)": "CAST(len(embedding) AS DOUBLE)", "element_at(embedding, 1)": "CAST(embedding[1] AS DOUBLE)"})
matrix("mm_func_math", "lineitem", "l_tax ~ 0 + sqrt(l_quantity) + floor(l_extendedprice) + abs(l_tax - 1) + l_linenumber % 3 + l_linenumber ÷ 2", {
    "sqrt(l_quantity)": "sqrt(l_quantity)", "floor(l_extendedprice)": "floor(l_extendedprice)", "abs(l_tax - 1)": "abs(l_tax - 1)", "l_linenumber % 3": "CAST(l_linenumber % 3 AS DOUBLE)", "l_linenumber ÷ 2": "CAST(l_linenumber // 2 AS DOUBLE)",
}, digits=8)
matrix("mm_func_text", "part", "p_size ~ 0 + startswith(p_type, prefix) + contains(upper(p_name), letter)", {"startswith(p_type, prefix)": "CAST(starts_with(p_type, 'P') AS DOUBLE)", "contains(upper(p_name), letter)": "CAST(contains(upper(p_name), 'A') AS DOUBLE)"}, prepare=lambda df: df.withColumns({"prefix": F.lit("P"), "letter": F.lit("A")}))



@query("SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def mm_func_json(t, spark):
    return modelmatrix('value ~ 0 + get_json_object(props, "$.k")', t("events")).toDF("k")


RULES = [
    ("log(zero)", "-Infinity"), ("log(minus)", None), ("sqrt(minus)", None), ("one / zero", "Infinity"), ("minus / zero", "-Infinity"), ("zero / zero", "NaN"), ("protect(big + big)", "1.8446744073709552E19"),
    ("log(gone)", None), ("protect(one + gone)", None), ("one % zero", "NaN"), ("log1p(minus)", "-Infinity"), ("round(half)", "2.0"),
]


def values(rows: list[tuple], names: str) -> str:
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


@query(values(RULES, "expression, value"))
def floating_point_rules(t, spark):
    """Values outside a function's domain are null here; in the strict mode they are errors (see failures)."""
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"zero": 0, "one": 1, "minus": -1, "big": 2**63 - 1, "half": 2.5}.items()], F.lit(None).cast("int").alias("gone"))
    with lenient():
        made = [columns(apply_schema(formula(f"0 ~ {e}").rhs, Schema()))[0][1] for e, _ in RULES]
    cells = F.array(*[F.struct(F.lit(e).alias("expression"), c.cast("string").alias("value")) for (e, _), c in zip(RULES, made, strict=True)])
    return d.select(F.explode(cells).alias("r")).select("r.*")


@query("SELECT 'n' AS variable, 'NaN' AS mean, 'NaN' AS variance, 'NaN' AS minimum, 'NaN' AS maximum UNION ALL SELECT 'x', '2.0', 'NaN', '2.0', '2.0'")
def schema_of_odd_numbers(t, spark):
    out = {}
    for name, v in (("n", [1.0, math.nan]), ("x", [2.0])):
        out |= schema(spark.createDataFrame([(i,) for i in v], f"{name} double"), [name])
    text = lambda v: "NaN" if math.isnan(v) else str(v)
    return spark.createDataFrame([(n, text(c.mean), text(c.var), text(c.min), text(c.max)) for n, c in out.items()], "variable string, mean string, variance string, minimum string, maximum string")


# --- a stream -------------------------------------------------------------------------------------------------

@query("SELECT o_totalprice, CAST(1 AS DOUBLE) AS \"(Intercept)\", CAST(o_orderstatus = 'O' AS DOUBLE) AS \"o_orderstatus: O\", CAST(o_orderstatus = 'P' AS DOUBLE) AS \"o_orderstatus: P\" FROM orders")
def stream_of_orders(t, spark):
    """The rows of a table as a stream, each made to a row of the matrix, to files that are read again."""
    orders = t("orders")
    s = schema(orders, ["o_totalprice", "o_orderstatus"])
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top}/stream-{uuid.uuid4().hex}"
    orders.select("o_totalprice", "o_orderstatus").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    made = stream_matrix("o_totalprice ~ 1 + o_orderstatus", stream, s)
    plain = [f"c{i}" for i in range(len(made.columns))]
    made.toDF(*plain).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").toDF(*made.columns)


# --- questions to terms and errors ----------------------------------------------------------------------------

def _facts() -> list[tuple[str, Any]]:
    f = formula("y ~ 1 + a + b&c + log(d)")
    a, b = Var("a"), Var("b")
    s = Schema({n: Continuous(n, 1.0, 1.0, 0.0, 2.0) for n in "yab"} | {"g": schema_of("g", ["u", "v", "w"])})
    bound = apply_schema(formula("y ~ 1 + a + g"), s)
    return [
        ("terms", [str(x) for x in leaves(f)]), ("variables", f.vars()), ("symbols", sorted(map(str, symbols(interact(a, b))))), ("drop a term", str(drop_term(f, Var("a")))),
        ("has intercept", [has_intercept(f), has_intercept(formula("y ~ 0 + a"))]), ("omits intercept", [omits_intercept(formula("y ~ 0 + a")), omits_intercept(formula("y ~ -1 + a")), omits_intercept(f)]),
        ("has response", [has_response(f), has_response(formula("0 ~ a"))]), ("width", list(bound.width())), ("names of terms", term_names(bound)[1]), ("printed", str(f)), ("described", describe(bound).replace("\n", "|")),
        ("equal formulas", [formula("y ~ a + b") == formula("y~a+b"), formula("y ~ a + b") == formula("y ~ b + a")]), ("equal terms", [a == Var("a"), Const(1) == Const(2)]), ("sum of terms", str(plus(a, b, a))),
        ("star", str(star(a, b, Var("c")))), ("matrix term", [bound.rhs.is_matrix_term, len(bound.rhs.terms)]), ("near names", near_names("returnflg", ["l_returnflag", "returnflags", "tax"])), ("term of text", str(term("x y"))),
        ("term of a number", str(term(1))), ("interaction with one", str(interact(a, Const(1)))), ("lag", lag("a", 2).offset), ("lead", lead("a", 2).offset), ("set of terms", len({a, Var("a"), b, interact(a, b), interact(a, b)})),
        ("interaction of a sum", str(interact(Sum((a, b)), Var("c")))), ("nested interaction", str(interact(interact(a, b), a)) == str(Interaction((a, b)))), ("several sides", str(formula("y ~ (a + b) & c"))),
        ("levels of a coding", list(code(Dummy(base="v"), ["u", "v", "w"]).names)), ("row of a coding", code(Effects(), ["u", "v", "w"]).row("u").tolist()), ("equal codings", [code(Dummy(), ["u", "v"]) == code(Dummy(), ["u", "v"]), Dummy() == Effects()]),
        ("schema by hand", [s["g"].names(), Schema({"a": s["a"]}).merge({"b": s["b"]})["b"].name]),
    ]


def schema_of(name: str, levels: list[str]):
    from designmat.plans.terms import Categorical

    return Categorical(name, code(Dummy(), levels))


FACTS = [
    ("terms", "['y', '1', 'a', 'd', 'b', 'c']"), ("variables", "['y', 'a', 'd', 'b', 'c']"), ("symbols", "['a', 'b']"), ("drop a term", "y ~ 1 + log(d) + b & c"), ("has intercept", "[True, False]"),
    ("omits intercept", "[True, True, False]"), ("has response", "[True, False]"), ("width", "[1, 4]"), ("names of terms", "['(Intercept)', 'a', 'g']"), ("printed", "y ~ 1 + a + log(d) + b & c"),
    ("described", "Response:|  y(continuous)|Predictors:|  1|  a(continuous)|  g(Dummy:3→2)"), ("equal formulas", "[True, False]"), ("equal terms", "[True, False]"), ("sum of terms", "a + b"),
    ("star", "a + b + a & b + c + a & c + b & c + a & b & c"), ("matrix term", "[True, 3]"), ("near names", "['returnflags']"), ("term of text", "`x y`"), ("term of a number", "1"), ("interaction with one", "a"),
    ("lag", "2"), ("lead", "-2"), ("set of terms", "3"), ("interaction of a sum", "a & c + b & c"), ("nested interaction", "True"), ("several sides", "y ~ a & c + b & c"), ("levels of a coding", "['u', 'w']"),
    ("row of a coding", "[-1.0, -1.0]"), ("equal codings", "[True, False]"), ("schema by hand", "[['g: v', 'g: w'], 'b']"),
]


@query(values(FACTS, "question, answer"))
def questions_to_terms(t, spark):
    return spark.createDataFrame([(k, str(v)) for k, v in _facts()], "question string, answer string")


def _failing(t, spark) -> dict[str, Callable[[], Any]]:
    d, none = t("orders"), t("orders").limit(0)
    line = lambda text, **k: modelmatrix(text, d, **k)
    ols = fit(OLS, "o_totalprice ~ o_orderstatus", d.where("o_orderstatus <> 'P'"))
    one, two = fit(OLS, "o_totalprice ~ 1", d), fit(OLS, "o_totalprice ~ o_custkey", d)
    status = lambda c: schema(d, ["o_orderstatus"], {"o_orderstatus": c})
    return {
        "E1 no sides": lambda: formula("a + b"), "E2 interpolation": lambda: formula("y ~ $a"), "E3 constant in an interaction": lambda: formula("y ~ a & 2"), "E4 constant as a term": lambda: line("o_totalprice ~ 2 + o_custkey"),
        "E5 unbound": lambda: Var("a").width(), "E6 no table": lambda: schema([1, 2]), "E7 class of a coding": lambda: status(Dummy), "E8 levels differ": lambda: status(Dummy(levels=["F", "O"])),
        "E9 base": lambda: status(Dummy(base="X")), "E9 one level": lambda: schema(d.where("o_orderstatus = 'F'"), ["o_orderstatus"]), "E9 repeated levels": lambda: status(Dummy(levels=["F", "F", "O"])),
        "E10 size of a coding": lambda: status(Custom([[1, 0], [0, 1]])), "E11 column": lambda: line("o_totalprice ~ o_custky"), "E12 empty": lambda: schema(none, ["o_custkey"]),
        "E12 empty within a call": lambda: modelmatrix("0 ~ log(o_custkey)", none), "E13 intercept": lambda: ModelFrame("o_totalprice ~ 1 + o_custkey", d, model=Bare), "E14 steps": lambda: line("o_totalprice ~ lag(o_custkey, 1.5)", order_by="o_orderkey"),
        "E14 arguments": lambda: line("o_totalprice ~ lag(o_custkey, 1, 2)", order_by="o_orderkey"), "E15 level": lambda: ols.predict(d).collect(), "E16 one model": lambda: lrtest(one),
        "E16 other rows": lambda: lrtest(one, fit(OLS, "o_totalprice ~ o_custkey", d.where("o_custkey % 2 = 0"))), "E16 not nested": lambda: lrtest(two, fit(OLS, "o_totalprice ~ o_orderstatus", d)),
        "E17 nesting unknown": lambda: lrtest(Plain(-30.0, 1), Plain(-10.0, 2)), "E18 contrasts of no variable": lambda: ModelFrame("o_totalprice ~ o_orderstatus", d).setcontrasts(nothing=Effects()),
        "E19 no intercept": lambda: vif(fit(OLS, "o_totalprice ~ 0 + o_custkey", d)), "E19 one column": lambda: vif(two), "E20 no matrix": lambda: gvif(Plain(0.0, 2, ["(Intercept)", "a", "b"])),
        "log of a negative": lambda: line("0 ~ log(o_custkey - 100000000)").collect(), "likelihood falls": lambda: lrtest(Plain(-10.0, 1), Plain(-30.0, 2)), "schema of a stream": lambda: schema(spark.readStream.format("rate").load(), ["value"]),
        "lag on a stream": lambda: stream_matrix("value ~ lag(value)", spark.readStream.format("rate").load(), Schema({"value": Continuous("value")})), "unknown function": lambda: line("0 ~ nosuch(o_custkey)"),
    }


class Plain:
    """A model of which only the likelihood is known."""

    def __init__(self, ll: float, dof: int, names: list[str] = ()):
        self.ll, self.k, self.of = ll, dof, names
        self.formula = formula_of("y", Parity("a"))
        self.formula = type(self.formula)(self.formula.lhs, Parity("a"))

    def loglikelihood(self) -> float:
        return self.ll

    def deviance(self) -> float:
        return -2 * self.ll

    def dof(self) -> int:
        return self.k

    def nobs(self) -> int:
        return 10

    def coefnames(self) -> list[str]:
        return list(self.of)

    def vcov(self) -> np.ndarray:
        return np.eye(len(self.of))


FAILURES = [
    ("E1 no sides", "FormulaSyntaxError"), ("E2 interpolation", "FormulaSyntaxError"), ("E3 constant in an interaction", "ValueError"), ("E4 constant as a term", "ValueError"), ("E5 unbound", "UnboundTermError"), ("E6 no table", "TypeError"),
    ("E7 class of a coding", "TypeError"), ("E8 levels differ", "LevelMismatchError"), ("E9 base", "LevelError"), ("E9 one level", "LevelError"), ("E9 repeated levels", "LevelError"), ("E10 size of a coding", "ValueError"),
    ("E11 column", "ColumnNotFoundError"), ("E12 empty", "EmptyColumnError"), ("E12 empty within a call", "EmptyColumnError"), ("E13 intercept", "ValueError"), ("E14 steps", "ValueError"), ("E14 arguments", "ValueError"),
    ("E15 level", "USER_RAISED_EXCEPTION"), ("E16 one model", "ValueError"), ("E16 other rows", "ValueError"), ("E16 not nested", "ValueError"), ("E17 nesting unknown", "UserWarning"), ("E18 contrasts of no variable", "UserWarning"),
    ("E19 no intercept", "ValueError"), ("E19 one column", "ValueError"), ("E20 no matrix", "ValueError"), ("log of a negative", "USER_RAISED_EXCEPTION"), ("likelihood falls", "ValueError"), ("schema of a stream", "TypeError"),
    ("lag on a stream", "ValueError"), ("unknown function", "ValueError"),
]


@query(values(FAILURES, "failure, error"))
def failures(t, spark):
    """What each kind of mistake raises or warns of."""
    out = []
    for name, f in _failing(t, spark).items():
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            try:
                f()
                kind = next((w.category.__name__ for w in seen if issubclass(w.category, UserWarning)), "none")
            except PySparkException as e:
                kind = (e.getCondition() or type(e).__name__).partition(".")[0]
            except Exception as e:  # the kind of error is the answer
                kind = type(e).__name__
        out.append((name, kind))
    return spark.createDataFrame(out, "failure string, error string")


__all__ = ["FACTS", "FAILURES", "ModelMatrix", "SparkSession"]
