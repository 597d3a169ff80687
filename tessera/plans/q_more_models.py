"""Queries of boosting (E11), extremely randomised trees (E9), AdaBoost.R2 (E8), pairwise SVM probabilities (E4),
searches with refit (M9, M10), balanced folds (M8), report averages (M4), silhouette (M13), smooth curves (C2, C9)
and p-values (T1-T12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, chartdata, dispatch, ensembles_extra, evaluate, extra_trees, models, prep, smooth, stats, tuning
from .registry import register
from .tables import round_doubles, table

NUM, CAT = ["o_totalprice", "o_custkey"], ["o_orderpriority"]
CODE = "ascii(o_orderstatus)"  # F 70, O 79, P 80


def _split(spark, sf):
    sp = prep.stratified_split(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 0.2, 42)
    # 0, 1, 2 for F, O, P
    sp = models.gathered(sp.withColumn("y", F.expr(f"CASE {CODE} WHEN 70 THEN 0 WHEN 79 THEN 1 ELSE 2 END")))
    return sp.where("split = 'train'"), sp.where("split = 'test'")


@register("e11_boosting")
def q_e11_boosting(spark, sf):
    train, test = _split(spark, sf)
    out = None
    for style in boosting.STYLES:
        pred = boosting.boost(train, NUM, "y", style=style, n_estimators=3).transform(test)
        pred = pred.select(F.lit(style).alias("model"), "o_orderkey", "y", "prediction")
        out = pred if out is None else out.union(pred)
    return out


@register("e11_boosting_regression")
def q_e11_boosting_regression(spark, sf):
    train, test = _split(spark, sf)
    out = None
    for style in boosting.STYLES:
        pred = boosting.boost(train, ["o_custkey", "y"], "o_totalprice", "regression", style).transform(test)
        pred = pred.select(F.lit(style).alias("model"), "o_orderkey", "prediction")
        out = pred if out is None else out.union(pred)
    return out


@register("e09_extra_trees")
def q_e09_extra_trees(spark, sf):
    train, test = _split(spark, sf)
    model = extra_trees.extra_trees(train, NUM, "y", n_estimators=20)
    return model.transform(test).select("o_orderkey", "y", "prediction", F.array_max("raw").alias("share"))


@register("e08_adaboost_r2")
def q_e08_adaboost_r2(spark, sf):
    train, test = _split(spark, sf)
    model = ensembles_extra.adaboost_r2(train, ["o_custkey", "y"], "o_totalprice", n_estimators=10)
    return model.transform(test).select("o_orderkey", "o_totalprice", "prediction")


@register("m10_sequential_search")
def q_m10_sequential_search(spark, sf):
    train, test = _split(spark, sf)
    found = tuning.sequential_search(train, NUM, CAT, "o_orderstatus", "o_orderkey", "logistic_regression", n_trials=14, test=test)
    best = F.col("params") == F.lit(tuning.shown(found.best_params))
    return found.trials.withColumn("test_score", F.when(best, F.lit(found.test_score)))


@register("m10_sequential_regression")
def q_m10_sequential_regression(spark, sf):
    train, test = _split(spark, sf)
    space = {"alpha": ("log_float", 1e-3, 1e3), "l1_ratio": ("float", 0.0, 1.0)}
    found = tuning.sequential_search(train, ["o_custkey", "y"], CAT, "o_totalprice", "o_orderkey", "elastic_net", "regression",
                                     space, n_trials=12, k=2, test=test)
    return found.trials


@register("m09_grid_refit")
def q_m09_grid_refit(spark, sf):
    train, test = _split(spark, sf)
    found = tuning.grid_search(train, NUM, CAT, "o_orderstatus", "o_orderkey", "logistic_regression", test=test)
    best = F.col("params") == F.lit(tuning.shown(found.best_params))
    return found.trials.withColumn("test_score", F.when(best, F.lit(found.test_score)))


@register("m08_kfold_balanced")
def q_m08_kfold_balanced(spark, sf):
    """Folds with classes weighted, cut and made up, on a number and a category."""
    c = table(spark, sf, "customer").withColumn("y", (F.col("c_acctbal") > 7000).cast("int"))
    out = None
    for strategy in ("none", "class_weight", "undersample", "smote"):
        cv = models.kfold_cv("classification", c, ["c_nationkey"], ["c_mktsegment"], "y", "c_custkey", "logistic_regression", 2, strategy)
        cv = cv.withColumn("strategy", F.lit(strategy))
        out = cv if out is None else out.union(cv)
    return out


_RULE = "CASE WHEN o_totalprice > 200000 THEN 'O' WHEN o_totalprice > 100000 THEN 'F' ELSE 'P' END"


@register("m04_report_averages", f"""
WITH p AS (SELECT o_orderstatus AS y, {_RULE} AS p FROM orders),
c AS (SELECT y AS class FROM p UNION SELECT p FROM p),
r AS (SELECT class, (SELECT count(*) FROM p WHERE y = class AND p = class) AS tp, (SELECT count(*) FROM p WHERE p = class) AS pr,
  (SELECT count(*) FROM p WHERE y = class) AS support FROM c),
s AS (SELECT class, CASE WHEN pr = 0 THEN 0 ELSE tp / pr END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, tp, pr, support FROM r),
f AS (SELECT class, precision, recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support, tp FROM s),
u AS (SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def q_m04_report_averages(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.expr(_RULE))
    return round_doubles(evaluate.report_with_averages(o, "o_orderstatus", "p"))


@register("m13_silhouette", """
WITH x AS (SELECT c_custkey AS k, c_mktsegment AS c, c_acctbal / 1000.0 AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer),
z AS (SELECT c, count(*) AS n FROM x GROUP BY c),
d AS (SELECT x.k, x.c AS own, y.c AS c, sum(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) AS s FROM x, x y GROUP BY ALL),
e AS (SELECT k, own, max(CASE WHEN c = own THEN s / (z.n - 1) END) AS a, min(CASE WHEN c <> own THEN s / z.n END) AS b FROM d JOIN z USING (c) GROUP BY ALL)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, CAST(0 AS DOUBLE) AS std_error, count(*) AS n_scored,
  CAST((SELECT count(*) FROM z) AS INT) AS n_clusters, CAST(0 AS BIGINT) AS n_noise FROM e""")
def q_m13_silhouette(spark, sf):
    c = table(spark, sf, "customer").withColumn("a", F.col("c_acctbal") / 1000.0)
    return round_doubles(smooth.silhouette(c, ["a", "c_nationkey"], "c_mktsegment", "c_custkey"))


@register("c09_density_curve", """
WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL),
s AS (SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v GROUP BY g),
c AS (SELECT g, least(floor((v - lo) / ((hi - lo) / 2048)), 2047) AS b, count(*) AS c FROM v JOIN s USING (g) GROUP BY ALL),
k AS (SELECT g, c, lo + (b + 0.5) * ((hi - lo) / 2048) AS mid FROM c JOIN s USING (g)),
p AS (SELECT *, unnest(range(100)) AS point FROM s),
q AS (SELECT *, lo - 3 * h + point * (hi + 3 * h - (lo - 3 * h)) / 99 AS x FROM p)
SELECT q.g AS "group", CAST(point AS INT) AS point, round(any_value(x), 4) AS x,
  round(sum(c * exp(-0.5 * ((x - mid) / h) * ((x - mid) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 10) AS density
FROM q JOIN k USING (g) GROUP BY q.g, point""")
def q_c09_density_curve(spark, sf):
    out = smooth.density_curve(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return out.select("group", "point", F.round("x", 4).alias("x"), F.round("density", 10).alias("density"))


@register("c02_lowess")
def q_c02_lowess(spark, sf):
    return smooth.lowess(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


_OLS = "o_totalprice / 1000 - b0 - b1 * o_custkey"


@register("t03_ols_summary", f"""
WITH b AS (SELECT regr_intercept(o_totalprice / 1000, o_custkey) AS b0, regr_slope(o_totalprice / 1000, o_custkey) AS b1, count(*) AS n,
  regr_r2(o_totalprice / 1000, o_custkey) AS r2 FROM orders),
e AS (SELECT o_orderkey, {_OLS} AS e, lag({_OLS}) OVER (ORDER BY o_orderkey) AS e0 FROM orders, b),
f AS (SELECT any_value(n) AS n, any_value(r2) AS r2, sum((e - e0) * (e - e0)) / sum(e * e) AS dw, sum(e * e) AS sse FROM e, b),
l AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1) AS llf FROM f)
SELECT term, round(value, 6) AS value FROM (
  SELECT 'r2' AS term, r2 AS value FROM l UNION ALL SELECT 'durbin_watson', dw FROM l UNION ALL SELECT 'n', n FROM l
  UNION ALL SELECT 'f_stat', r2 / ((1 - r2) / (n - 2)) FROM l UNION ALL SELECT 'aic', 4 - 2 * llf FROM l
  UNION ALL SELECT 'bic', 2 * ln(n) - 2 * llf FROM l UNION ALL SELECT 'const:coef', b0 FROM b UNION ALL SELECT 'o_custkey:coef', b1 FROM b)""")
def q_t03_ols_summary(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.col("o_totalprice") / 1000)
    out = smooth.ols_summary(o, "y", ["o_custkey"], "o_orderkey")
    wanted = ["r2", "durbin_watson", "n", "f_stat", "aic", "bic", "const:coef", "o_custkey:coef"]
    return out.where(F.col("term").isin(wanted)).select("term", F.round("value", 6).alias("value"))


@register("t12_p_values")
def q_t12_p_values(spark, sf):
    """p-values of the correlations of three columns, by all three methods."""
    c = table(spark, sf, "supplier")
    out = None
    for method in ("pearson", "spearman", "kendall"):
        r = stats.correlation(c, ["s_suppkey", "s_nationkey", "s_acctbal"], method).select(F.lit(method).alias("method"), "col_a", "col_b", "n", "r", "p_value")
        out = r if out is None else out.union(r)
    return round_doubles(out)


@register("c11_model_bars")
def q_c11_model_bars(spark, sf):
    train, test = _split(spark, sf)
    return chartdata.model_bars(models.compare_models("classification", train, test, NUM, [], "o_orderstatus", ["naive_bayes", "lda"]))


_R_PEARSON = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")))


@register("u01_tool_correlation", _R_PEARSON)
def q_u01_tool_correlation(spark, sf):
    """A tool called by name with a comma list."""
    out = dispatch.run("CorrelationAnalysis", table(spark, sf, "lineitem"), "l_quantity, l_extendedprice, l_discount, pearson")
    return round_doubles(out.select("col_a", "col_b", "n", "r"))


@register("u02_action_records", """
SELECT 0 AS step, 'statistics' AS module, 'ok' AS status, (SELECT count(*) FROM (SELECT 1)) AS rows
UNION ALL SELECT 1, 'visualization', 'ok', (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus IS NOT NULL)
UNION ALL SELECT 2, 'variable_analysis', 'ok', (SELECT count(*) FROM (DESCRIBE orders))
UNION ALL SELECT 3, 'statistics', 'failed', CAST(NULL AS BIGINT)""")
def q_u02_action_records(spark, sf):
    actions = [("statistics", {"analysis_type": "anova", "target_columns": ["o_orderstatus", "o_totalprice"]}),
               ("visualization", {"chart_type": "bar", "x_col": "o_orderstatus"}), ("variable_analysis", None),
               ("statistics", {"analysis_type": "chi_square", "target_columns": ["o_orderstatus"]})]
    return dispatch.run_actions(table(spark, sf, "orders"), actions).select("step", "module", "status", "rows")
