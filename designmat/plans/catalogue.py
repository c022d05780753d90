"""Queries of the formula engine and their DuckDB twins, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.operators.frame import ModelFrame, modelmatrix, response
from designmat.operators.inference import gvif, lrtest, vif
from designmat.operators.models import OLS, fit
from designmat.plans.contrasts import Custom, Dummy, Effects, Helmert, Hypothesis, SeqDiff
from designmat.plans.parser import formula
from designmat.plans.schema import schema
from designmat.plans.terms import Var, drop_term, term_names
from designmat.sources.tables import read
from designmat.streaming.project import stream_matrix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGS, STATUS = ["A", "N", "R"], ["F", "O", "P"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(sql: str | None = None):
    """Register a function (tables, spark) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: read(spark, f"{d}/{t}.parquet"), spark)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def matrix(name: str, table: str, text: str, sql: dict[str, str], digits: int | None = None, frame: bool = False, prepare=lambda df: df, source: str | None = None, **options) -> None:
    """Register a model matrix and the SQL expression of each of its columns."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = prepare(read(spark, f"{d}/{table}.parquet"))
        out = ModelFrame(text, df, contrasts=options.get("hints")).modelmatrix() if frame else modelmatrix(text, df, **options)
        return rounded(out, digits)

    QUERIES[name] = run
    wrap = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    ORACLE_SQL[name] = f"SELECT {', '.join(f'{wrap(e)} AS "{n}"' for n, e in sql.items())} FROM {source or table}"


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    return df if digits is None else df.select([F.round(F.col(f"`{c}`"), digits).alias(c) for c in df.columns])


def is_(c: str, v: str) -> str:
    return f"CAST({c} = '{v}' AS DOUBLE)"


def case(c: str, levels: list[str], values: list[float]) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN '{x}' THEN CAST({v} AS DOUBLE)" for x, v in zip(levels, values, strict=True)) + " END"


def coded(c: str, levels: list[str], rows: list[list[float]], names: list[str]) -> dict[str, str]:
    return {"(Intercept)": ONE} | {f"{c}: {n}": case(c, levels, [r[j] for r in rows]) for j, n in enumerate(names)}


ONE = "CAST(1 AS DOUBLE)"
Q, R, S, T = "l_quantity", "l_returnflag", "l_linestatus", "l_tax"
matrix("mm_continuous", "lineitem", "l_extendedprice ~ 1 + l_quantity + l_tax", {"(Intercept)": ONE, Q: Q, T: T})
matrix("mm_implicit_intercept", "lineitem", "l_extendedprice ~ l_quantity", {"(Intercept)": ONE, Q: Q}, frame=True)
matrix("mm_no_intercept", "lineitem", "l_extendedprice ~ 0 + l_quantity", {Q: Q}, frame=True)
matrix("mm_dummy", "lineitem", "l_extendedprice ~ 1 + l_quantity + l_returnflag", {"(Intercept)": ONE, Q: Q} | {f"{R}: {x}": is_(R, x) for x in "NR"})
matrix("mm_dummy_base", "lineitem", "l_tax ~ 1 + l_returnflag", {"(Intercept)": ONE} | {f"{R}: {x}": is_(R, x) for x in "AN"}, hints={R: Dummy(base="R")})
matrix("mm_dummy_levels", "lineitem", "l_tax ~ 1 + l_returnflag", {"(Intercept)": ONE} | {f"{R}: {x}": is_(R, x) for x in "AN"}, hints={R: Dummy(levels=["R", "A", "N"])})
matrix("mm_effects", "orders", "o_totalprice ~ 1 + o_orderstatus", coded("o_orderstatus", STATUS, [[-1, -1], [1, 0], [0, 1]], ["O", "P"]), hints={"o_orderstatus": Effects()})
matrix("mm_effects_base", "orders", "o_totalprice ~ 1 + o_orderstatus", coded("o_orderstatus", STATUS, [[1, 0], [0, 1], [-1, -1]], ["F", "O"]), hints={"o_orderstatus": Effects(base="P")})
HELMERT = [[-1, -1, -1, -1], [1, -1, -1, -1], [0, 2, -1, -1], [0, 0, 3, -1], [0, 0, 0, 4]]
matrix("mm_helmert", "orders", "o_totalprice ~ 1 + o_orderpriority", coded("o_orderpriority", PRIORITY, HELMERT, PRIORITY[1:]), hints={"o_orderpriority": Helmert()})
matrix("mm_helmert_base3", "orders", "o_totalprice ~ 1 + o_orderpriority", coded("o_orderpriority", PRIORITY, [HELMERT[i] for i in (2, 0, 1, 3, 4)], [PRIORITY[i] for i in (0, 1, 3, 4)]), hints={"o_orderpriority": Helmert(base=PRIORITY[2])})
matrix("mm_seqdiff", "orders", "o_totalprice ~ 1 + o_orderpriority", coded("o_orderpriority", PRIORITY, [[-0.8, -0.6, -0.4, -0.2], [0.2, -0.6, -0.4, -0.2], [0.2, 0.4, -0.4, -0.2], [0.2, 0.4, 0.6, -0.2], [0.2, 0.4, 0.6, 0.8]], PRIORITY[1:]), digits=9, hints={"o_orderpriority": SeqDiff()})
matrix("mm_hypothesis", "lineitem", "l_tax ~ 1 + l_returnflag", {"(Intercept)": ONE, f"{R}: N-A": f"(CASE {R} WHEN 'A' THEN -1 WHEN 'N' THEN 2 ELSE -1 END)/3.0::DOUBLE", f"{R}: R-A": f"(CASE {R} WHEN 'A' THEN -1 WHEN 'N' THEN -1 ELSE 2 END)/3.0::DOUBLE"}, digits=9, hints={R: Hypothesis({"N-A": [-1, 1, 0], "R-A": [-1, 0, 1]}, levels=FLAGS)})
matrix("mm_custom_contrasts", "lineitem", "l_tax ~ 1 + l_returnflag", coded(R, FLAGS, [[1, 0], [0, 2], [-1, 3]], ["N", "R"]), hints={R: Custom([[1, 0], [0, 2], [-1, 3]])})
matrix("mm_fullrank_main", "lineitem", "l_tax ~ 0 + l_returnflag", {f"{R}: {x}": is_(R, x) for x in FLAGS}, frame=True)
matrix("mm_fullrank_inter", "lineitem", "l_tax ~ 1 + l_returnflag + l_returnflag&l_linestatus", {"(Intercept)": ONE} | {f"{R}: {x}": is_(R, x) for x in "NR"} | {f"{R}: {x} & {S}: O": f"{is_(R, x)} * {is_(S, 'O')}" for x in FLAGS}, frame=True)
BIG = "(SELECT *, CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS z FROM lineitem)"
matrix("mm_fullrank_two_inter", "lineitem", "l_tax ~ 0 + l_returnflag&l_linestatus + l_returnflag&z", {f"{R}: {x} & {S}: {y}": f"{is_(R, x)} * {is_(S, y)}" for y in "FO" for x in FLAGS} | {f"{R}: {x} & z: lo": f"{is_(R, x)} * {is_('z', 'lo')}" for x in FLAGS}, frame=True, prepare=lambda df: df.withColumn("z", F.when(F.col(Q) > 25, "hi").otherwise("lo")), source=BIG)
STAR2 = {"(Intercept)": ONE, Q: Q} | {f"{R}: {x}": is_(R, x) for x in "NR"} | {f"{Q} & {R}: {x}": f"{Q} * {is_(R, x)}" for x in "NR"}
matrix("mm_star2", "lineitem", "l_extendedprice ~ 1 + l_quantity*l_returnflag", STAR2)
matrix("mm_star3", "lineitem", "l_extendedprice ~ 1 + l_quantity*l_returnflag*l_linestatus", STAR2 | {f"{S}: O": is_(S, "O"), f"{Q} & {S}: O": f"{Q} * {is_(S, 'O')}"} | {f"{R}: {x} & {S}: O": f"{is_(R, x)} * {is_(S, 'O')}" for x in "NR"} | {f"{Q} & {R}: {x} & {S}: O": f"{Q} * {is_(R, x)} * {is_(S, 'O')}" for x in "NR"})
matrix("mm_cont_inter", "lineitem", "l_extendedprice ~ 1 + l_quantity & l_tax", {"(Intercept)": ONE, f"{Q} & {T}": f"{Q} * {T}"})
matrix("mm_distributive", "lineitem", "l_orderkey ~ 1 + (l_quantity + l_tax) & (l_discount + l_extendedprice)", {"(Intercept)": ONE} | {f"{a} & {b}": f"{a} * {b}" for a in (Q, T) for b in ("l_discount", "l_extendedprice")})
matrix("mm_func_log", "lineitem", "l_tax ~ 1 + log(l_extendedprice)", {"(Intercept)": ONE, "log(l_extendedprice)": "ln(l_extendedprice)"}, digits=8)
matrix("mm_func_arith", "lineitem", "l_tax ~ 0 + l_quantity^2 + l_extendedprice / l_quantity", {"l_quantity ^ 2": f"{Q} * {Q}", "l_extendedprice / l_quantity": f"l_extendedprice / {Q}"})
matrix("mm_func_nested", "lineitem", "l_tax ~ 0 + log(1 + sqrt(l_quantity))", {"log(1 + sqrt(l_quantity))": f"ln(1 + sqrt({Q}))"}, digits=8)
matrix("mm_func_string", "part", "p_size ~ 0 + length(p_name) + gt_e(p_type)", {"length(p_name)": "CAST(length(p_name) AS DOUBLE)", "gt_e(p_type)": "CAST(len(list_filter(string_split(p_type, ''), lambda c: c > 'e')) > 0 AS DOUBLE)"})
matrix("mm_func_compare", "lineitem", "l_tax ~ 0 + ifelse(l_quantity >= 25, l_tax, -l_discount)", {"ifelse(l_quantity >= 25, l_tax, -l_discount)": f"CASE WHEN {Q} >= 25 THEN {T} ELSE -l_discount END"})
matrix("mm_bitor", "lineitem", "l_tax ~ 0 + protect(l_linenumber | l_partkey)", {"l_linenumber | l_partkey": "CAST(l_linenumber | l_partkey AS DOUBLE)"})
matrix("mm_protect", "lineitem", "l_tax ~ 0 + protect(l_quantity + l_tax)", {"l_quantity + l_tax": f"{Q} + {T}"})
matrix("mm_unprotect", "lineitem", "l_extendedprice ~ 1 - unprotect(l_quantity & l_tax)", {"1 - unprotect(l_quantity & l_tax)": f"1 - {Q} * {T}"})
matrix("mm_poly", "lineitem", "l_tax ~ 1 + poly(l_quantity, 3)", {"(Intercept)": ONE, "l_quantity^1": Q, "l_quantity^2": f"{Q} * {Q}", "l_quantity^3": f"{Q} * {Q} * {Q}"})
matrix("mm_bool", "lineitem", "l_tax ~ 1 + big", {"(Intercept)": ONE, "big": f"CAST({Q} > 25 AS DOUBLE)"}, prepare=lambda df: df.withColumn("big", F.col(Q) > 25))
matrix("mm_int_as_categorical", "lineitem", "l_tax ~ 1 + l_linenumber", {"(Intercept)": ONE} | {f"l_linenumber: {k}": f"CAST(l_linenumber = {k} AS DOUBLE)" for k in range(2, 8)}, hints={"l_linenumber": "categorical"})
EVENTS = ["click", "purchase", "signup", "view"]
NULLED = "(SELECT *, nullif(event_type, 'error') AS e FROM events) WHERE e IS NOT NULL"
matrix("omit_missing", "events", "value ~ 1 + e", {"(Intercept)": ONE} | {f"e: {x}": is_("e", x) for x in EVENTS[1:]}, frame=True, prepare=lambda df: df.withColumn("e", F.nullif("event_type", F.lit("error"))), source=NULLED)
matrix("omit_level_lost", "lineitem", "l_tax ~ 1 + l_returnflag", {"(Intercept)": ONE, f"{R}: N": is_(R, "N")}, frame=True, prepare=lambda df: df.withColumn(T, F.when(F.col(R) != "R", F.col(T))), source=f"lineitem WHERE {R} <> 'R'")


@query("SELECT round(ln(o_totalprice), 8) AS \"log(o_totalprice)\" FROM orders")
def resp_log(t, spark):
    return rounded(response("log(o_totalprice) ~ 1", t("orders")), 8)


@query(f"SELECT {is_('o_orderstatus', 'O')} AS \"o_orderstatus: O\", {is_('o_orderstatus', 'P')} AS \"o_orderstatus: P\" FROM orders")
def resp_categorical(t, spark):
    return response("o_orderstatus ~ 1", t("orders"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, round(avg({c}), 3) AS mean, round(var_samp({c}), 2) AS variance, min({c}) AS minimum, max({c}) AS maximum FROM lineitem" for c in NUMBERS))
def schema_stats(t, spark):
    found = schema(t("lineitem"), NUMBERS)
    return spark.createDataFrame([(n, round(c.mean, 3), round(c.var, 2), c.min, c.max) for n, c in found.items()], "variable string, mean double, variance double, minimum double, maximum double")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS position, x AS level FROM (SELECT DISTINCT {c} AS x FROM orders)" for c in ("o_orderstatus", "o_orderpriority")))
def schema_levels(t, spark):
    found = schema(t("orders"), ["o_orderstatus", "o_orderpriority"])
    rows = [(n, i, x) for n, c in found.items() for i, x in enumerate(c.contrasts.levels, 1)]
    return spark.createDataFrame(rows, "variable string, position int, level string")


def shifted(name: str, text: str, sql: dict[str, str], prepare=lambda df: df, source: str = "events") -> None:
    """A lag or lead over each user's events, with the event's key beside it."""
    QUERIES[name] = lambda spark, d: modelmatrix(text, prepare(read(spark, f"{d}/events.parquet")), order_by="event_id", partition_by="user_id", keep=("event_id",))
    ORACLE_SQL[name] = f"SELECT event_id, {', '.join(f'{e} AS "{n}"' for n, e in sql.items())} FROM {source}"


def over(e: str) -> str:
    return f"{e} OVER (PARTITION BY user_id ORDER BY event_id)"


shifted("lag1", "value ~ 0 + lag(value)", {"value_lag1": over("lag(value)")})
shifted("lead2", "value ~ 0 + lead(value, 2)", {"value_lead2": over("lead(value, 2)")})
shifted("lag_negative", "value ~ 0 + lag(value, -1) + lag(value, 0)", {"value_lag-1": over("lead(value)"), "value_lag0": "value"})
shifted("lag_nested", "value ~ 0 + lag(lag(value, 1), 2)", {"value_lag1_lag2": over("lag(value, 3)")})
shifted("lag_categorical", "value ~ 0 + lag(event_type, 2)", {f"event_type: {x}_lag2": over(f"lag({is_('event_type', x)}, 2)") for x in ("error", "purchase", "signup", "view")})
shifted("lag_diff", "value ~ 0 + protect(value - lag(value))", {"value - lag(value)": f"value - {over('lag(value)')}"})
shifted("lag_interaction", "value ~ 0 + lag(value & w)", {"value & w_lag1": over("lag(value * 2)")}, prepare=lambda df: df.withColumn("w", F.lit(2.0)))


@query("SELECT l_orderkey, l_linenumber, c.col, c.name, c.value FROM (SELECT l_orderkey, l_linenumber, unnest([{'col': 1, 'name': '(Intercept)', 'value': 1::DOUBLE}, {'col': 2, 'name': 'l_quantity', 'value': l_quantity}, {'col': 3, 'name': 'l_returnflag: N', 'value': CAST(l_returnflag = 'N' AS DOUBLE)}, {'col': 4, 'name': 'l_returnflag: R', 'value': CAST(l_returnflag = 'R' AS DOUBLE)}]) AS c FROM lineitem) WHERE c.value <> 0")
def mm_long_sparse(t, spark):
    return modelmatrix("l_tax ~ 1 + l_quantity + l_returnflag", t("lineitem"), form="long", keep=("l_orderkey", "l_linenumber"))


@query("SELECT sum(1::DOUBLE) AS total_1, round(sum(l_quantity), 2) AS total_2, CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS total_3 FROM lineitem")
def mm_vector(t, spark):
    from pyspark.ml.functions import vector_to_array

    v = modelmatrix("l_tax ~ 1 + l_quantity + l_returnflag", t("lineitem"), form="sparse").select(vector_to_array("features").alias("v"))
    return v.agg(*[F.round(F.sum(F.col("v")[i]), 2).alias(f"total_{i + 1}") for i in range(3)])


@query("SELECT * FROM (VALUES (1, '(Intercept)', 1), (2, 'l_quantity', 2), (3, 'l_returnflag: N', 3), (4, 'l_returnflag: R', 3), (5, 'l_quantity & l_returnflag: N', 4), (6, 'l_quantity & l_returnflag: R', 4)) AS v(col, name, term)")
def mm_assign(t, spark):
    f = ModelFrame("l_tax ~ l_quantity*l_returnflag", t("lineitem"))
    rows = [(i, n, a) for i, (n, a) in enumerate(zip(f.coefnames(), f.assign(), strict=True), 1)]
    return spark.createDataFrame(rows, "col int, name string, term int")


def table_of(spark, names, values, digits=4):
    return spark.createDataFrame([(n, round(float(v), digits)) for n, v in zip(names, values, strict=True)], "name string, value double")


@query("SELECT '(Intercept)' AS name, round(regr_intercept(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem")
def ols_simple(t, spark):
    m = fit(OLS, "l_extendedprice ~ l_quantity", t("lineitem"))
    return table_of(spark, m.coefnames(), m.coef())


TWO = """WITH c AS (SELECT covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_tax, l_extendedprice) AS by_, var_pop(l_quantity) AS aa, var_pop(l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab FROM lineitem)
SELECT 'l_quantity' AS name, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 3) AS value FROM c UNION ALL SELECT 'l_tax', round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 3) FROM c"""


@query(TWO)
def ols_two(t, spark):
    m = fit(OLS, "l_extendedprice ~ l_quantity + l_tax", t("lineitem"))
    return table_of(spark, m.coefnames()[1:], m.coef()[1:], 3)


@query("SELECT 'o_orderstatus: ' || o_orderstatus AS name, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY o_orderstatus")
def ols_dummy(t, spark):
    m = fit(OLS, "o_totalprice ~ 0 + o_orderstatus", t("orders"))
    return table_of(spark, m.coefnames(), m.coef())


LINE = "SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a, regr_sxx(o_totalprice, o_custkey) AS sxx, avg(o_custkey) AS m, count(*) AS n, regr_syy(o_totalprice, o_custkey) - regr_sxy(o_totalprice, o_custkey) ** 2 / regr_sxx(o_totalprice, o_custkey) AS rss FROM orders"


@query(f"WITH r AS ({LINE}) SELECT o_orderkey, round(a + b * o_custkey, 3) AS prediction FROM orders, r")
def predict_table(t, spark):
    m = fit(OLS, "o_totalprice ~ o_custkey", t("orders"))
    return m.predict(t("orders").select("o_orderkey", "o_custkey")).select("o_orderkey", F.round("prediction", 3).alias("prediction"))


@query(f"WITH r AS ({LINE}) SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN round(a + b * o_custkey, 3) END AS prediction FROM orders, r")
def predict_nulls(t, spark):
    m = fit(OLS, "o_totalprice ~ o_custkey", t("orders"))
    return m.predict(t("orders").withColumn("o_custkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")))).select("o_orderkey", F.round("prediction", 3).alias("prediction"))


@query(f"WITH r AS ({LINE}) SELECT o_orderkey, round((1.0 / n + (o_custkey - m) ** 2 / sxx) * rss / (n - 2), 1) AS squared FROM orders, r")
def predict_interval(t, spark):
    from designmat.operators.inference import t_quantile

    m = fit(OLS, "o_totalprice ~ o_custkey", t("orders"))
    out = m.predict(t("orders").select("o_orderkey", "o_custkey"), interval="confidence")
    half = (F.col("upper") - F.col("lower")) / 2 / t_quantile(0.975, m.dof_residual())
    return out.select("o_orderkey", F.round(half * half, 1).alias("squared"))


@query("WITH r AS (SELECT corr(l_quantity, l_quantity * l_quantity) ** 2 AS r2 FROM lineitem) SELECT x AS name, round(1 / (1 - r2), 4) AS value FROM r, (VALUES ('l_quantity'), ('l_quantity ^ 2')) AS v(x)")
def vif_two(t, spark):
    m = fit(OLS, "l_extendedprice ~ l_quantity + l_quantity^2", t("lineitem"))
    return table_of(spark, m.coefnames()[1:], vif(m))


def _gvif(power: str) -> str:
    # Price against a factor of two columns: 1 / (1 - R2) of the price on the factor is the inflation of either.
    return f"WITH g AS (SELECT o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m, avg(o_totalprice) OVER () AS a FROM orders), r AS (SELECT sum((m - a) ** 2) / sum((y - a) ** 2) AS r2 FROM g) SELECT x AS name, round((1 / (1 - r2)) ** {power}, 6) AS value FROM r, (VALUES ('o_totalprice', 1.0), ('o_orderstatus', 2.0)) AS v(x, df)"


@query(_gvif("1.0"))
def gvif_terms(t, spark):
    m = fit(OLS, "o_custkey ~ o_totalprice + o_orderstatus", t("orders"))
    return table_of(spark, ["o_totalprice", "o_orderstatus"], gvif(m), 6)


@query(_gvif("(1 / (2 * df))"))
def gvif_scaled(t, spark):
    m = fit(OLS, "o_custkey ~ o_totalprice + o_orderstatus", t("orders"))
    return table_of(spark, ["o_totalprice", "o_orderstatus"], gvif(m, scale=True), 6)


LL = "-n / 2.0 * (ln(2 * pi() * rss / n) + 1)"


@query(f"""WITH g AS (SELECT o_totalprice AS y, avg(o_totalprice) OVER () AS a, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS b FROM orders),
s AS (SELECT 1 AS model, 2 AS dof, count(*) AS n, sum((y - a) ** 2) AS rss FROM g UNION ALL SELECT 2, 4, count(*), sum((y - b) ** 2) FROM g),
l AS (SELECT model, dof, {LL} AS ll FROM s), d AS (SELECT model, dof, ll, 2 * (ll - lag(ll) OVER (ORDER BY model)) AS x FROM l)
SELECT CAST(model AS INTEGER) AS model, CAST(dof AS BIGINT) AS dof, round(ll, 3) AS loglikelihood, round(x, 4) AS chisq, round(exp(-x / 2), 6) AS pval FROM d""")
def lrtest_pair(t, spark):
    a, b = fit(OLS, "o_totalprice ~ 1", t("orders")), fit(OLS, "o_totalprice ~ 1 + o_orderstatus", t("orders"))
    out = lrtest(a, b).to_df(spark)
    return out.select("model", "dof", F.round("loglikelihood", 3).alias("loglikelihood"), F.round("chisq", 4).alias("chisq"), F.round("pval", 6).alias("pval"))


@query("SELECT * FROM (VALUES (1, '(Intercept)'), (2, 'l_quantity'), (3, 'l_returnflag: N'), (4, 'l_returnflag: R'), (5, 'l_linestatus: O'), (6, 'log(l_tax + 1)'), (7, 'l_returnflag: N & l_linestatus: O'), (8, 'l_returnflag: R & l_linestatus: O')) AS v(position, name)")
def coefnames_table(t, spark):
    f = ModelFrame("l_extendedprice ~ l_quantity + l_returnflag*l_linestatus + log(l_tax + 1)", t("lineitem"))
    return spark.createDataFrame(list(enumerate(f.coefnames(), 1)), "position int, name string")


@query("SELECT * FROM (VALUES (0, 'l_extendedprice'), (1, '(Intercept)'), (2, 'l_quantity'), (3, 'l_returnflag'), (4, 'l_quantity & l_returnflag')) AS v(position, name)")
def termnames_table(t, spark):
    y, x = term_names(ModelFrame("l_extendedprice ~ l_quantity*l_returnflag", t("lineitem")).formula)
    return spark.createDataFrame([(0, y), *enumerate(x, 1)], "position int, name string")


@query("SELECT CAST(1 AS DOUBLE) AS \"(Intercept)\", l_tax FROM lineitem")
def drop_term_mm(t, spark):
    return modelmatrix(drop_term(formula("l_extendedprice ~ 1 + l_quantity + l_tax"), Var("l_quantity")), t("lineitem"))


@query("SELECT o_totalprice, CAST(1 AS DOUBLE) AS \"(Intercept)\", CAST(o_orderstatus = 'O' AS DOUBLE) AS \"o_orderstatus: O\", CAST(o_orderstatus = 'P' AS DOUBLE) AS \"o_orderstatus: P\" FROM orders")
def stream_projection(t, spark):
    """A bound formula on a table as on a stream: the same projection."""
    orders = t("orders")
    return stream_matrix("o_totalprice ~ 1 + o_orderstatus", orders, schema(orders, ["o_totalprice", "o_orderstatus"]))


@query("SELECT CAST(1 AS DOUBLE) AS \"(Intercept)\", CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 1 ELSE 0 END::DOUBLE AS \"l_returnflag: N\", CASE l_returnflag WHEN 'A' THEN -1 WHEN 'R' THEN 1 ELSE 0 END::DOUBLE AS \"l_returnflag: R\" FROM lineitem")
def set_contrasts(t, spark):
    return ModelFrame("l_tax ~ l_returnflag", t("lineitem")).setcontrasts(l_returnflag=Effects()).modelmatrix()


from designmat.plans import catalogue_models  # noqa: E402, F401  # registers its queries beside these
