"""Registered queries of the additive-model engine and their SQL equivalents.

The tables were generated without nulls and without models, so missing values are made with NULLIF rules and the scoring
queries use a model with literal coefficients; queries that fit models have no SQL form.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothspan.contract import Contract, Execution, Feature, Model, Search, Validation, candidates, plan_rows
from smoothspan.operators import explain, folds, metrics, profile, scoring, search
from smoothspan.operators.design import Design, bind, resolve_categories
from smoothspan.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
STATUS = ["F", "O", "P"]
PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priorities(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """The order priorities, sorted: a declared vocabulary taken from the data."""
    row = _table(spark, sf_dir, "orders").agg(F.array_sort(F.collect_set("o_orderpriority"))).first()
    return tuple(row[0])


def _round(c: Column, n: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, n) + F.lit(0.0)


# Profiles.


@query(
    """
    SELECT c AS "column", count(*) AS n_rows, CAST(count(*) - count(v) AS BIGINT) AS missing, count(DISTINCT v) AS n_unique,
           CASE WHEN count(DISTINCT v) <= 1 THEN 'exclude' WHEN kind = 'n' AND count(DISTINCT v) <= 10 THEN 'categorical'
                WHEN kind IN ('s', 'i') AND count(DISTINCT v) / CAST(greatest(count(*), 1) AS DOUBLE) > 0.98 THEN 'exclude'
                WHEN kind = 's' OR count(DISTINCT v) <= 10 THEN 'categorical' ELSE 'smooth' END AS recommended_role,
           min(x) AS minimum, median(x) AS median, max(x) AS maximum
    FROM (
      SELECT 'o_orderkey' AS c, 'i' AS kind, CAST(o_orderkey AS VARCHAR) AS v, CAST(o_orderkey AS DOUBLE) AS x FROM orders
      UNION ALL SELECT 'o_custkey', 'i', CAST(o_custkey AS VARCHAR), CAST(o_custkey AS DOUBLE) FROM orders
      UNION ALL SELECT 'o_orderstatus', 's', o_orderstatus, NULL FROM orders
      UNION ALL SELECT 'o_totalprice', 'n', CAST(o_totalprice AS VARCHAR), o_totalprice FROM orders
      UNION ALL SELECT 'o_orderdate', 's', CAST(o_orderdate AS VARCHAR), NULL FROM orders
      UNION ALL SELECT 'o_orderpriority', 's', o_orderpriority, NULL FROM orders)
    GROUP BY c, kind"""
)
def profile_columns_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_statistics(_table(spark, sf_dir, "orders")).drop("dtype")


@query(
    """
    WITH long AS (SELECT 'l_returnflag' AS c, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
                  UNION ALL SELECT 'l_quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem)
    SELECT "column", value, n, rank FROM (
      SELECT c AS "column", v AS value, count(*) AS n, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v NULLS FIRST) AS rank FROM long GROUP BY c, v)
    WHERE rank <= 10"""
)
def value_counts_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long"))
    return profile.top_values(lines, ["l_returnflag", "l_linestatus", "l_quantity"])


@query(
    """
    SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM
    (SELECT user_id, event_type, date_trunc('hour', ts) AS h FROM events) GROUP BY user_id, event_type, h)"""
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(_table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("h")))


@query("SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS percent FROM labels GROUP BY toxic")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_distribution(_table(spark, sf_dir, "labels"), "toxic")


# Folds.

_FOLDS_SQL = """
    WITH r AS (SELECT o_orderkey, o_orderstatus, repeat, 1 + (row_number() OVER (PARTITION BY repeat ORDER BY o_orderstatus,
                 md5('42-' || repeat || '-' || o_orderkey), CAST(o_orderkey AS VARCHAR)) - 1) % 5 AS fold
               FROM orders, (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) t(repeat))"""


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return folds.assign_folds(orders, "o_orderstatus", "o_orderkey", 5, 2, 42)


@query(_FOLDS_SQL + "SELECT repeat, fold, o_orderstatus, count(*) AS n FROM r GROUP BY 1, 2, 3")
def fold_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir).groupBy("repeat", "fold", "o_orderstatus").agg(F.count("*").alias("n"))


@query(_FOLDS_SQL + "SELECT * FROM r")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir).select("o_orderkey", "o_orderstatus", "repeat", "fold")


@query("SELECT CAST(0 AS BIGINT) AS violations, count(*) * 5 * 2 AS manifest_rows FROM orders")
def fold_coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = _folds(spark, sf_dir).withColumn("row_index", F.col("o_orderkey"))
    manifest = folds.split_manifest(assigned, "o_orderkey", 5)
    bad = folds.manifest_violations(manifest, _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index")), 5, 2)
    total = bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return total.crossJoin(manifest.agg(F.count("*").alias("manifest_rows")))


# Design blocks.


def _design(pairs: tuple = ()) -> Design:
    features = {
        "o_totalprice": Feature("smooth"),
        "c_acctbal": Feature("smooth"),
        "doy": Feature("linear"),
    }
    return Design(features, 4, 3, list(pairs), 0.5)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    orders = _table(spark, sf_dir, "orders").withColumn("doy", F.dayofyear("o_orderdate").cast("double"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def _basis_sql(x: str, lo: str, hi: str, knots: int, degree: int) -> list[str]:
    from math import comb, factorial

    at = f"((least(greatest({x}, {lo}), {hi}) - {lo}) / (({hi} - {lo}) / {float(knots - 1)}e0))"
    out = []
    for j in range(knots + degree - 2):
        terms = [f"({(-1) ** k * comb(degree + 1, k) / factorial(degree)!r}e0 * pow(greatest({at} + {float(degree - j - k)}e0, 0e0), {degree}))" for k in range(degree + 2)]
        out.append("(" + " + ".join(terms) + ")")
    return out


_JOINED_SQL = """
    WITH o AS (SELECT orders.*, c_acctbal, c_mktsegment, CAST(dayofyear(o_orderdate) AS DOUBLE) AS doy FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT min(o_totalprice) AS lo1, max(o_totalprice) AS hi1, min(c_acctbal) AS lo2, max(c_acctbal) AS hi2, avg(doy) AS m, stddev_pop(doy) AS sd FROM o)"""


def _long_sql(columns: list[str], key: str, source: str) -> str:
    parts = [f"SELECT {key}, CAST({i} AS BIGINT) AS pos, round({c}, 6) + 0e0 AS value FROM {source}" for i, c in enumerate(columns)]
    return "\n UNION ALL ".join(parts)


def _long(df: DataFrame, key: str, columns: list[Column]) -> DataFrame:
    long = df.select(key, F.posexplode(F.array(*columns)).alias("pos", "value"))
    return long.select(key, F.col("pos").cast("long").alias("pos"), _round(F.col("value")).alias("value"))


@query(_JOINED_SQL + _long_sql(_basis_sql("o_totalprice", "lo1", "hi1", 4, 3), "o_orderkey", "o, s"))
def spline_basis_totalprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    design = Design({"o_totalprice": Feature("smooth")}, 4, 3).fit(orders)
    return _long(orders, "o_orderkey", design.columns())


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) + 0e0 AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def standardize_acctbal(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    design = Design({"c_acctbal": Feature("linear")}).fit(customers)
    return customers.select("c_custkey", _round(design.columns()[0]).alias("z"))


@query(
    """
    WITH levels AS (SELECT o_orderpriority AS level, row_number() OVER (ORDER BY o_orderpriority) - 2 AS pos FROM (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT o_orderkey, pos, CASE WHEN o_orderpriority = level THEN 1e0 ELSE 0e0 END AS value FROM orders, levels WHERE pos >= 0"""
)
def onehot_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    design = Design({"o_orderpriority": Feature("categorical", categories=_priorities(spark, sf_dir))}).fit(orders)
    return _long(orders, "o_orderkey", design.columns())


@query(
    """
    WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders),
    fills AS (SELECT (SELECT median(price) FROM n) AS p, (SELECT priority FROM n WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1) AS q)
    SELECT o_orderkey, round(coalesce(price, p), 6) + 0e0 AS price, coalesce(priority, q) AS priority FROM n, fills"""
)
def impute_median_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"),
    )
    design = Design({"price": Feature("linear", "median"), "priority": Feature("categorical", "most_frequent", _priorities(spark, sf_dir))}).fit(orders)
    return orders.select("o_orderkey", _round(design._filled("price")).alias("price"), design._filled("priority").alias("priority"))


_PAIR_SQL = [f"{a} * {b} * 0.5e0" for a in _basis_sql("o_totalprice", "lo1", "hi1", 2, 2) for b in _basis_sql("c_acctbal", "lo2", "hi2", 2, 2)]


@query(_JOINED_SQL + _long_sql(_PAIR_SQL, "o_orderkey", "o, s"))
def tensor_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal")
    features = {"o_totalprice": Feature("smooth"), "c_acctbal": Feature("smooth")}
    design = Design(features, 2, 2, [("o_totalprice", "c_acctbal")], 0.5).fit(orders)
    return _long(orders, "o_orderkey", design.columns()[4:])


# Scoring with literal coefficients: z = standardized price, w = standardized day of the year.

_WEIGHTS = [[0.0, 0.0], [0.8, -0.5], [-0.3, 0.9]]
_BIAS = [0.1, -0.2, 0.05]


def _literal_model(orders: DataFrame) -> scoring.AdditiveModel:
    design = Design({"o_totalprice": Feature("linear"), "doy": Feature("linear")}).fit(orders)
    return scoring.AdditiveModel(design, STATUS, np.array(_BIAS), np.array(_WEIGHTS))


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("doy", F.dayofyear("o_orderdate").cast("double"))
    return orders.select(F.col("o_orderkey").alias("scenario_id"), "o_orderstatus", "o_totalprice", "doy")


_SCORES_SQL = """
    WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(dayofyear(o_orderdate) AS DOUBLE) AS doy FROM orders),
    s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(doy) AS m2, stddev_pop(doy) AS s2 FROM o),
    z AS (SELECT o_orderkey AS scenario_id, o_orderstatus, (o_totalprice - m1) / s1 AS z, (doy - m2) / s2 AS w FROM o, s),
    e AS (SELECT *, 0.1e0 AS score_F, 0.8e0 * z - 0.5e0 * w - 0.2e0 AS score_O, -0.3e0 * z + 0.9e0 * w + 0.05e0 AS score_P FROM z),
    p AS (SELECT *, exp(score_F) / t AS p_F, exp(score_O) / t AS p_O, exp(score_P) / t AS p_P FROM (SELECT *, exp(score_F) + exp(score_O) + exp(score_P) AS t FROM e))"""


@query(
    _SCORES_SQL
    + "SELECT scenario_id, round(score_F, 6) + 0e0 AS score_F, round(score_O, 6) + 0e0 AS score_O, round(score_P, 6) + 0e0 AS score_P, round(p_F, 6) AS probability_F, round(p_O, 6) AS probability_O, round(p_P, 6) AS probability_P FROM p"
)
def score_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _scenarios(spark, sf_dir)
    found = scoring.predict(orders, _literal_model(orders), check=False)
    return found.select("scenario_id", *[_round(F.col(f"{k}_{c}")).alias(f"{k}_{c}") for k in ("score", "probability") for c in STATUS])


@query(
    _SCORES_SQL
    + """, r AS (SELECT scenario_id, c, p, row_number() OVER (PARTITION BY scenario_id ORDER BY p DESC, c) AS rank FROM (
      SELECT scenario_id, 'F' AS c, p_F AS p FROM p UNION ALL SELECT scenario_id, 'O', p_O FROM p UNION ALL SELECT scenario_id, 'P', p_P FROM p))
    SELECT scenario_id, max(c) FILTER (WHERE rank = 1) AS predicted_class, round(max(p) FILTER (WHERE rank = 1), 6) AS maximum_probability,
           max(c) FILTER (WHERE rank = 2) AS second_highest_class, round(max(p) FILTER (WHERE rank = 2), 6) AS second_highest_probability,
           round(max(p) FILTER (WHERE rank = 1) - max(p) FILTER (WHERE rank = 2), 6) + 0e0 AS confidence_margin,
           round(sum(-p * ln(p)), 6) AS prediction_entropy, round(sum(-p * ln(p)) / ln(3), 6) AS normalized_entropy, round(sum(p), 6) AS probability_sum
    FROM r GROUP BY scenario_id"""
)
def prediction_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _scenarios(spark, sf_dir)
    found = scoring.predict(orders, _literal_model(orders), check=False)
    names = list(scoring.diagnostics(STATUS))
    words = {"predicted_class", "second_highest_class"}
    return found.select("scenario_id", *[F.col(n) if n in words else _round(F.col(n)).alias(n) for n in names])


_LONG_SQL = (
    _SCORES_SQL
    + """, t AS (
      SELECT scenario_id, 'F' AS class, 'intercept' AS component, 1e0 AS v, 0.1e0 AS b FROM z UNION ALL SELECT scenario_id, 'O', 'intercept', 1e0, -0.2e0 FROM z
      UNION ALL SELECT scenario_id, 'P', 'intercept', 1e0, 0.05e0 FROM z
      UNION ALL SELECT scenario_id, 'F', 'main_linear__o_totalprice', z, 0e0 FROM z UNION ALL SELECT scenario_id, 'O', 'main_linear__o_totalprice', z, 0.8e0 FROM z
      UNION ALL SELECT scenario_id, 'P', 'main_linear__o_totalprice', z, -0.3e0 FROM z
      UNION ALL SELECT scenario_id, 'F', 'main_linear__doy', w, 0e0 FROM z UNION ALL SELECT scenario_id, 'O', 'main_linear__doy', w, -0.5e0 FROM z
      UNION ALL SELECT scenario_id, 'P', 'main_linear__doy', w, 0.9e0 FROM z)"""
)


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _scenarios(spark, sf_dir)
    return explain.contributions(orders.drop("o_orderstatus"), _literal_model(orders))


@query(
    _LONG_SQL
    + """SELECT scenario_id, class, component, CASE WHEN component = 'intercept' THEN 'intercept' ELSE 'linear' END AS component_type, replace(component, 'main_linear__', '') AS component_group,
         round(v, 6) + 0e0 AS transformed_value, b AS coefficient, round(v * b, 6) + 0e0 AS contribution FROM t"""
)
def contributions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _contributions(spark, sf_dir)
    return long.select("scenario_id", "class", "component", "component_type", "component_group", _round(F.col("transformed_value")).alias("transformed_value"), "coefficient", _round(F.col("contribution")).alias("contribution"))


@query(
    _LONG_SQL
    + """SELECT scenario_id, class, component, CAST(rank AS BIGINT) AS rank, round(c, 6) + 0e0 AS contribution FROM (
      SELECT *, v * b AS c, row_number() OVER (PARTITION BY scenario_id, class ORDER BY abs(v * b) DESC, component) AS rank FROM t) WHERE rank <= 2"""
)
def contributions_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = explain.top_contributions(_contributions(spark, sf_dir), 2)
    return top.select("scenario_id", "class", "component", F.col("rank").cast("long").alias("rank"), _round(F.col("contribution")).alias("contribution"))


@query(_LONG_SQL + "SELECT scenario_id, class, round(sum(v * b), 6) + 0e0 AS reconstructed_score, true AS within_tolerance FROM t GROUP BY 1, 2")
def score_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = explain.score_summary(_contributions(spark, sf_dir))
    return summary.select("scenario_id", "class", _round(F.col("reconstructed_score")).alias("reconstructed_score"), (F.col("absolute_score_error") <= explain.TOLERANCE).alias("within_tolerance"))


@query("SELECT count(*) * 3 AS n, true AS within_tolerance FROM orders")
def link_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _scenarios(spark, sf_dir)
    long = explain.verify_link(orders, _literal_model(orders))
    return long.agg(F.count("*").alias("n"), (F.max("error") <= explain.TOLERANCE).alias("within_tolerance"))


@query(_SCORES_SQL + "SELECT scenario_id, o_orderstatus, round(z, 6) + 0e0 AS main_linear__o_totalprice, round(w, 6) + 0e0 AS main_linear__doy FROM z")
def transform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _scenarios(spark, sf_dir)
    found = scoring.transform(orders, _literal_model(orders))
    return found.select("scenario_id", "o_orderstatus", *[_round(F.col(c)).alias(c) for c in ("main_linear__o_totalprice", "main_linear__doy")])


@query(
    """
    SELECT c.class || '_versus_A' AS comparison, c.component, round(c.b - a.b, 6) + 0e0 AS coefficient
    FROM (VALUES ('A', 'intercept', 0.5e0), ('A', 'x', 1.25e0), ('B', 'intercept', -0.25e0), ('B', 'x', 2e0), ('C', 'intercept', 0e0), ('C', 'x', -1e0)) c(class, component, b)
    JOIN (VALUES ('intercept', 0.5e0), ('x', 1.25e0)) a(component, b) USING (component) WHERE c.class <> 'A'"""
)
def class_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("A", "intercept", 0.5), ("A", "x", 1.25), ("B", "intercept", -0.25), ("B", "x", 2.0), ("C", "intercept", 0.0), ("C", "x", -1.0)]
    table = spark.createDataFrame(rows, "class string, component string, coefficient double")
    return explain.contrasts(table, "A").withColumn("coefficient", _round(F.col("coefficient")))


# Metrics over rule-based predictions.

_RULE_SQL = """
    WITH p AS (SELECT o_orderkey AS row_id, 1 + o_orderkey % 2 AS repeat, 1 + (o_orderkey // 2) % 5 AS fold, o_orderstatus AS observed,
                 CASE WHEN o_orderkey % 11 < 6 THEN o_orderstatus WHEN o_totalprice > 200000 THEN 'O' ELSE 'F' END AS predicted, 0.2e0 + (o_orderkey % 7) / 10e0 AS p_true FROM orders),
    k AS (SELECT repeat, fold, class, count(*) FILTER (WHERE observed <> class AND predicted <> class) AS tn, count(*) FILTER (WHERE observed <> class AND predicted = class) AS fp,
            count(*) FILTER (WHERE observed = class AND predicted <> class) AS fn, count(*) FILTER (WHERE observed = class AND predicted = class) AS tp
          FROM p, (VALUES ('F'), ('O'), ('P')) c(class) GROUP BY 1, 2, 3),
    m AS (SELECT *, CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS sensitivity, CASE WHEN tn + fp = 0 THEN 0e0 ELSE tn / CAST(tn + fp AS DOUBLE) END AS specificity,
            CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS prec, CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1, tp + fn AS support FROM k),
    f AS (SELECT a.*, b.* EXCLUDE (repeat, fold) FROM
            (SELECT repeat, fold, avg(-ln(p_true)) AS log_loss, avg(CASE WHEN predicted = observed THEN 1e0 ELSE 0e0 END) AS accuracy FROM p GROUP BY 1, 2) a
            JOIN (SELECT repeat, fold, avg(sensitivity) FILTER (WHERE support > 0) AS balanced_accuracy, avg(f1) FILTER (WHERE support + fp > 0) AS macro_f1, avg(specificity) AS macro_specificity,
                    sum(support * specificity) / CAST(sum(support) AS DOUBLE) AS weighted_specificity FROM m GROUP BY 1, 2) b ON a.repeat = b.repeat AND a.fold = b.fold)"""


def _rule_predictions(spark: SparkSession, sf_dir: str, other: bool = False) -> DataFrame:
    k = F.col("o_orderkey")
    right = k % 11 < (4 if other else 6)
    return _table(spark, sf_dir, "orders").select(
        k.alias("row_id"),
        (1 + k % 2).alias("repeat"),
        (1 + F.expr("o_orderkey div 2") % 5).alias("fold"),
        F.col("o_orderstatus").alias("observed"),
        F.when(right, F.col("o_orderstatus")).when(F.col("o_totalprice") > 200000, "O").otherwise("F").alias("predicted"),
        (F.lit(0.2) + (k % 7) / 10.0).alias("p_true"),
    )


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    doubles = {n for n, t in df.dtypes if t == "double"} - set(keys)
    return df.select(*[_round(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])


@query(
    _RULE_SQL
    + "SELECT o.class AS observed, q.class AS predicted, count(p.row_id) AS n FROM (VALUES ('F'), ('O'), ('P')) o(class) CROSS JOIN (VALUES ('F'), ('O'), ('P')) q(class) LEFT JOIN p ON p.observed = o.class AND p.predicted = q.class GROUP BY 1, 2"
)
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_rule_predictions(spark, sf_dir), STATUS).select("observed", "predicted", "n")


@query(
    _RULE_SQL
    + """SELECT o.class AS observed, q.class AS predicted, round(CASE WHEN s.n = 0 THEN 0e0 ELSE count(p.row_id) / CAST(s.n AS DOUBLE) END, 6) AS share
         FROM (VALUES ('F'), ('O'), ('P')) o(class) CROSS JOIN (VALUES ('F'), ('O'), ('P')) q(class) JOIN (SELECT observed, count(*) AS n FROM p GROUP BY 1) s ON s.observed = o.class
         LEFT JOIN p ON p.observed = o.class AND p.predicted = q.class GROUP BY 1, 2, s.n"""
)
def confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_rule_predictions(spark, sf_dir), STATUS).select("observed", "predicted", _round(F.col("share")).alias("share"))


@query(
    _RULE_SQL
    + """SELECT repeat, fold, class, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive, round(sensitivity, 6) AS sensitivity,
         round(specificity, 6) AS specificity, round(prec, 6) AS precision, round(f1, 6) AS f1, support FROM m"""
)
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.class_metrics(_rule_predictions(spark, sf_dir), STATUS, ["repeat", "fold"]), [])


@query(
    _RULE_SQL
    + "SELECT repeat, fold, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)
    + " FROM f"
)
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.fold_metrics(_rule_predictions(spark, sf_dir), STATUS, ["repeat", "fold"]), [])


@query(
    _RULE_SQL
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(coalesce(stddev_samp({m}), 0e0), 6) AS std, round(median({m}), 6) AS median, round(min({m}), 6) AS min, round(max({m}), 6) AS max FROM f"
        for m in metrics.METRICS
    )
)
def fold_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.fold_metrics(_rule_predictions(spark, sf_dir), STATUS, ["repeat", "fold"])
    return _rounded(metrics.metric_summary(table, []), [])


@query(
    _RULE_SQL
    + "SELECT class, "
    + ", ".join(
        f"round(avg({c}), 6) AS {m}_mean, round(coalesce(stddev_samp({c}), 0e0), 6) AS {m}_std, round(median({c}), 6) AS {m}_median, round(min({c}), 6) AS {m}_min, round(max({c}), 6) AS {m}_max"
        for m, c in (("sensitivity", "sensitivity"), ("specificity", "specificity"), ("precision", "prec"), ("f1", "f1"))
    )
    + ", round(avg(support), 6) AS mean_fold_support, CAST(sum(support) AS BIGINT) AS total_oof_support FROM m GROUP BY class"
)
def class_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.class_metrics(_rule_predictions(spark, sf_dir), STATUS, ["repeat", "fold"])
    return _rounded(metrics.class_summary(table, []), [])


@query("SELECT count(DISTINCT o_orderkey) AS unique_rows, count(DISTINCT o_orderkey % 2) AS repeats, count(*) AS prediction_rows FROM orders")
def oof_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.oof_counters(_rule_predictions(spark, sf_dir))


_OTHER_SQL = _RULE_SQL.replace("% 11 < 6", "% 11 < 4").replace("WITH p AS", "p2 AS").replace("FROM p,", "FROM p2,").replace("FROM p GROUP", "FROM p2 GROUP")
for _name in ("k", "m", "f"):
    _OTHER_SQL = _OTHER_SQL.replace(f" {_name} AS (", f" {_name}2 AS (").replace(f"FROM {_name}", f"FROM {_name}2")


@query(
    _RULE_SQL
    + ","
    + _OTHER_SQL.replace("FROM m2atted", "")
    + " UNION ALL ".join(
        f"SELECT '{m}_difference' AS metric, round(avg(f2.{m} - f.{m}), 6) + 0e0 AS mean, round(coalesce(stddev_samp(f2.{m} - f.{m}), 0e0), 6) + 0e0 AS std, round(median(f2.{m} - f.{m}), 6) + 0e0 AS median FROM f JOIN f2 USING (repeat, fold)"
        for m in metrics.METRICS[:4]
    )
)
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (metrics.fold_metrics(_rule_predictions(spark, sf_dir, o), STATUS, ["repeat", "fold"]) for o in (False, True))
    return _rounded(metrics.compare_summary(metrics.compare(left, right)), [])


# Grids, plans and names.

_GRID = Search((3, 4), (2, 3), (0.1, 1.0), (0.5, 1.0))
_GRID_SQL = """
    SELECT k AS n_knots, d AS degree, c AS C, s AS interaction_scale, 1e0 + ((k * 7 + d * 3 + CAST(c * 10 AS BIGINT) + CAST(s * 2 AS BIGINT)) % 5) / 10e0 AS mean_log_loss,
           row_number() OVER (ORDER BY k, d, c, s) - 1 AS ordinal
    FROM (VALUES (CAST(3 AS BIGINT)), (CAST(4 AS BIGINT))) a(k), (VALUES (CAST(2 AS BIGINT)), (CAST(3 AS BIGINT))) b(d), (VALUES (0.1e0), (1e0)) e(c), (VALUES (0.5e0), (1e0)) g(s)"""


def _trials(spark: SparkSession) -> DataFrame:
    grid = spark.createDataFrame(candidates(_GRID, True), "ordinal long, n_knots long, degree long, C double, interaction_scale double")
    loss = 1.0 + ((F.col("n_knots") * 7 + F.col("degree") * 3 + F.round(F.col("C") * 10).cast("long") + F.round(F.col("interaction_scale") * 2).cast("long")) % 5) / 10.0
    return grid.withColumn("mean_log_loss", loss)


@query(f"SELECT ordinal, n_knots, degree, C, interaction_scale, round(mean_log_loss, 6) AS mean_log_loss FROM ({_GRID_SQL})")
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark).withColumn("mean_log_loss", _round(F.col("mean_log_loss")))


@query(f"SELECT ordinal, n_knots, degree, C, interaction_scale FROM ({_GRID_SQL}) ORDER BY mean_log_loss, ordinal LIMIT 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_candidate(_trials(spark), []).select("ordinal", "n_knots", "degree", "C", "interaction_scale")


def _contract(path: str, validation: Validation = Validation(), grid: Search = Search()) -> Contract:
    features = {"o_totalprice": Feature("smooth"), "c_acctbal": Feature("smooth"), "doy": Feature("linear"), "o_orderpriority": Feature("categorical")}
    models = (Model("main_effects"), Model("pairwise", "all_eligible"))
    return Contract("order status", path, "o_orderstatus", features, models, "o_orderkey", validation, grid, Execution(1)).validate()


@query(
    """
    SELECT model, CAST(n AS BIGINT) AS candidates, CAST(n * 5 * 15 + n * 5 AS BIGINT) AS estimated_fits
    FROM (VALUES ('main_effects', 3 * 2 * 4), ('pairwise', 3 * 2 * 4 * 2)) t(model, n)"""
)
def plan_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(plan_rows(_contract("orders")), "model string, candidates long, estimated_fits long")


_NAMES = ("intercept", "main_spline__x1__basis_0", "main_linear__x_2", "main_categorical__x3_low", "interaction__a:b__basis_0:1", "other")


@query(
    "SELECT component, CASE WHEN component = 'intercept' THEN 'intercept' WHEN component LIKE 'main\\_spline\\_\\_%' ESCAPE '\\' THEN 'smooth' WHEN component LIKE 'main\\_linear\\_\\_%' ESCAPE '\\' THEN 'linear' "
    "WHEN component LIKE 'main\\_categorical\\_\\_%' ESCAPE '\\' THEN 'categorical' WHEN component LIKE 'interaction\\_\\_%' ESCAPE '\\' THEN 'interaction' ELSE 'other' END AS component_type, "
    "string_split(regexp_replace(component, '^(main_spline|main_linear|main_categorical|interaction)__', ''), '__basis_')[1] AS component_group FROM (VALUES "
    + ", ".join(f"('{n}')" for n in _NAMES)
    + ") t(component)"
)
def component_type_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in _NAMES], "component string")
    c = F.col("component")
    return names.select(c, explain.component_type(c).alias("component_type"), explain.component_group(c).alias("component_group"))


@query("SELECT o_orderkey, o_orderstatus AS label FROM orders")
def onehot_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _table(spark, sf_dir, "orders").select("o_orderkey", *[(F.col("o_orderstatus") == s).cast("int").alias(s) for s in STATUS])
    tables.check_indicators(coded, STATUS, exactly_one=True)
    return tables.collapse_one_hot(coded, STATUS, "label")


@query(
    """
    SELECT o_orderpriority, round(avg(-ln(0.2e0 + (o_orderkey % 7) / 10e0)), 6) + 0e0 AS log_loss, round(avg(CASE WHEN o_totalprice > 200000 THEN 1e0 ELSE 0e0 END), 6) AS share
    FROM orders GROUP BY 1"""
)
def log_loss_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lit(0.2) + (F.col("o_orderkey") % 7) / 10.0
    return _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        _round(F.avg(-F.ln(F.greatest(p, F.lit(metrics.CLIP))))).alias("log_loss"), _round(F.avg((F.col("o_totalprice") > 200000).cast("double"))).alias("share")
    )


@query(_SCORES_SQL + ", r AS (SELECT CASE WHEN p_F >= p_O AND p_F >= p_P THEN 'F' WHEN p_O >= p_P THEN 'O' ELSE 'P' END AS c FROM p) SELECT class, count(c) AS n FROM (VALUES ('F'), ('O'), ('P')) s(class) LEFT JOIN r ON c = class GROUP BY 1")
def predicted_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _scenarios(spark, sf_dir)
    return scoring.predicted_class_counts(scoring.predict(orders, _literal_model(orders), check=False), STATUS)


# Fitted models: no SQL form.

_QUICK = (Validation(3, 1, 3, 42), Search((3,), (2,), (0.1, 1.0), (1.0,)))


def _cross_validated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Contract]:
    contract = _contract("orders", *_QUICK)
    raw = _orders(spark, sf_dir)
    bound = bind(raw, contract)
    features = resolve_categories(raw, contract)
    assigned = folds.assign_folds(bound.select("row_index", "row_id", "y"), "y", "row_id", 3, 1, 42)
    tasks = search.fold_tasks(contract, contract.models[0])
    return search.run_predictions(bound, assigned, contract, features, tasks, STATUS), contract


@query()
def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _cross_validated(spark, sf_dir)
    return found.select("model_id", "repeat", "fold", "row_id", "observed", "predicted", "p_true")


@query()
def nested_cv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fold_metrics(oof_predictions(spark, sf_dir), STATUS, ["model_id", "repeat", "fold"])


@query()
def final_fit_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = _contract("orders", *_QUICK)
    raw = _orders(spark, sf_dir)
    model, _ = search.final_fit(bind(raw, contract), contract, resolve_categories(raw, contract), contract.models[1], STATUS)
    return explain.components(spark, model)


@query()
def binary_quality_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    raw = labels.join(docs, "doc_id")
    features = {"n_chars": Feature("smooth"), "lang": Feature("categorical")}
    contract = Contract("quality", "labels", "quality", features, (Model("main"),), "doc_id", *_QUICK, Execution(1)).validate()
    bound = bind(raw, contract)
    assigned = folds.assign_folds(bound.select("row_index", "row_id", "y"), "y", "row_id", 3, 1, 42)
    found = search.run_predictions(bound, assigned, contract, resolve_categories(raw, contract), search.fold_tasks(contract, contract.models[0]), ["0", "1"])
    return metrics.class_metrics(found, ["0", "1"], ["model_id", "repeat", "fold"])


@query()
def distributed_fit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster-wide solver on the whole table."""
    raw = _orders(spark, sf_dir).withColumn("y", F.col("o_orderstatus"))
    design = _design().fit(raw)
    from smoothspan.operators.solver import fit_mllib

    fit = fit_mllib(raw, design.vector(), "y", STATUS, 0.1, max_iter=100, tol=1e-8)
    b, w = fit.normal_form()
    return explain.components(spark, scoring.AdditiveModel(design, STATUS, b, w))


@query()
def demo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.demo_table(spark, 300, 42)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold class metrics of the main-effects model of the order status."""
    return metrics.class_metrics(oof_predictions(spark, sf_dir), STATUS, ["model_id", "repeat", "fold"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["flagship", "oracle_sql", "queries"]
