"""Statistical-test queries (T1-T12). Outputs drop the p-value column where DuckDB has no
distribution function; p-values are covered by pytest against published values."""

from __future__ import annotations


from ..functions.exprs import CORR_ELSE, CORR_LADDER, CRAMER_ELSE, CRAMER_LADDER, ETA_ELSE, ETA_LADDER, ladder_sql
from ..operators import stats
from .q_profile import LI_NULLS_SQL, lineitem_nulls
from .registry import register
from .tables import round_doubles, table

_T_COLS = ["test", "statistic", "df1", "df2", "effect_size", "effect_label"]


def _test_out(df):
    return round_doubles(df.select(*_T_COLS))


@register("t01_ttest_ind", """
WITH s AS (SELECT count(l_discount) AS n1, avg(l_discount) AS m1, var_samp(l_discount) AS v1,
                  count(l_tax) AS n2, avg(l_tax) AS m2, var_samp(l_tax) AS v2 FROM lineitem)
SELECT 'ttest_ind' AS test,
  round((m1 - m2) / sqrt((((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1.0 / n1 + 1.0 / n2)), 6) AS statistic,
  CAST(n1 + n2 - 2 AS DOUBLE) AS df1, CAST(NULL AS DOUBLE) AS df2, CAST(NULL AS DOUBLE) AS effect_size,
  CAST(NULL AS VARCHAR) AS effect_label FROM s""")
def q_t01_ttest_ind(spark, sf):
    return _test_out(stats.ttest_ind(table(spark, sf, "lineitem"), "l_discount", "l_tax"))


@register("t02_ttest_1samp", """
SELECT 'ttest_1samp' AS test, round(avg(c_acctbal) / (stddev_samp(c_acctbal) / sqrt(count(c_acctbal))), 6) AS statistic,
  CAST(count(c_acctbal) - 1 AS DOUBLE) AS df1, CAST(NULL AS DOUBLE) AS df2, CAST(NULL AS DOUBLE) AS effect_size,
  CAST(NULL AS VARCHAR) AS effect_label FROM customer""")
def q_t02_ttest_1samp(spark, sf):
    return _test_out(stats.ttest_1samp(table(spark, sf, "customer"), "c_acctbal"))


@register("t03_ols_simple", """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0,
                  regr_count(l_extendedprice, l_quantity) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx,
                  regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy,
                  avg(l_quantity) AS mx FROM lineitem),
e AS (SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s)
SELECT 'const' AS term, round(b0, 6) AS coef, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) AS std_err,
       round(b0 / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) AS t FROM e
UNION ALL
SELECT 'l_quantity', round(b1, 6), round(sqrt(s2 / sxx), 6), round(b1 / sqrt(s2 / sxx), 6) FROM e""")
def q_t03_ols_simple(spark, sf):
    coef, _ = stats.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return round_doubles(coef.select("term", "coef", "std_err", "t"))


@register("t03_ols_multi")
def q_t03_ols_multi(spark, sf):
    coef, model = stats.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return coef


@register("t04_chi_square", f"""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem
           WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL),
ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
tot AS (SELECT sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM c),
x AS (SELECT sum(power(o - ra * cb / n, 2) / (ra * cb / n)) + (any_value(n) - sum(ra * cb / n)) AS chi2,
             any_value(n) AS n, any_value(r) AS r, any_value(k) AS k
      FROM c JOIN ra USING (a) JOIN cb USING (b), tot)
SELECT 'chi_square' AS test, round(chi2, 6) AS statistic, CAST((r - 1) * (k - 1) AS DOUBLE) AS df1,
  CAST(NULL AS DOUBLE) AS df2, round(sqrt(chi2 / (n * (least(r, k) - 1))), 6) AS effect_size,
  {ladder_sql('sqrt(chi2 / (n * (least(r, k) - 1)))', CRAMER_LADDER, CRAMER_ELSE)} AS effect_label FROM x""")
def q_t04_chi_square(spark, sf):
    return _test_out(stats.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@register("t04_chi_square_yates", f"""
WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS o FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
n AS (SELECT sum(o) AS n FROM c),
cells AS (SELECT ra.a, cb.b, ra.ra * cb.cb / n.n AS e, coalesce(c.o, 0) AS o FROM ra, cb, n LEFT JOIN c ON c.a = ra.a AND c.b = cb.b),
x AS (SELECT sum(power(greatest(abs(o - e) - least(0.5, abs(o - e)), 0), 2) / e) AS chi2 FROM cells)
SELECT 'chi_square' AS test, round(chi2, 6) AS statistic, 1.0::DOUBLE AS df1, CAST(NULL AS DOUBLE) AS df2,
  round(sqrt(chi2 / (SELECT n FROM n)), 6) AS effect_size,
  {ladder_sql('sqrt(chi2 / (SELECT n FROM n))', CRAMER_LADDER, CRAMER_ELSE)} AS effect_label FROM x""")
def q_t04_chi_square_yates(spark, sf):
    return _test_out(stats.chi_square(table(spark, sf, "labels"), "quality", "toxic"))


_ANOVA_SQL = """
WITH g AS (SELECT c_mktsegment AS grp, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS m2
           FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL GROUP BY c_mktsegment),
v AS (SELECT * FROM g WHERE n >= 2),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS gm FROM v),
ga AS (SELECT avg(c_acctbal) AS gma FROM customer),
s AS (SELECT any_value(k) AS k, any_value(nn) AS nn, sum(n * power(m - gm, 2)) AS ssb, sum(m2) AS ssw,
             sum(n * power(m - gma, 2)) AS ssb_a, sum(m2 + n * power(m - gma, 2)) AS sst_a FROM v, t, ga)"""


@register("t06_anova", _ANOVA_SQL + f"""
SELECT 'anova' AS test, round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS statistic, CAST(k - 1 AS DOUBLE) AS df1,
  CAST(nn - k AS DOUBLE) AS df2, round(ssb_a / sst_a, 6) AS effect_size,
  {ladder_sql('ssb_a / sst_a', ETA_LADDER, ETA_ELSE)} AS effect_label FROM s""")
def q_t06_anova(spark, sf):
    return _test_out(stats.anova(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


@register("t07_tukey_hsd", """
WITH g AS (SELECT c_mktsegment AS grp, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS m2
           FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL GROUP BY c_mktsegment),
t AS (SELECT sum(m2) / (sum(n) - count(*)) AS mse FROM g)
SELECT a.grp AS group1, b.grp AS group2, round(b.m - a.m, 6) AS meandiff,
  round(sqrt(mse / 2.0 * (1.0 / a.n + 1.0 / b.n)), 6) AS std_err,
  round(abs(b.m - a.m) / sqrt(mse / 2.0 * (1.0 / a.n + 1.0 / b.n)), 6) AS q
FROM g a JOIN g b ON a.grp < b.grp, t""")
def q_t07_tukey_hsd(spark, sf):
    out = stats.tukey_hsd(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return round_doubles(out.select("group1", "group2", "meandiff", "std_err", "q"))


@register("t07_tukey_many_groups", """
WITH g AS (SELECT p_size AS grp, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) * count(*) AS m2
           FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY p_size),
t AS (SELECT sum(m2) / (sum(n) - count(*)) AS mse FROM g)
SELECT CAST(a.grp AS VARCHAR) AS group1, CAST(b.grp AS VARCHAR) AS group2, round(b.m - a.m, 6) AS meandiff,
  round(sqrt(mse / 2.0 * (1.0 / a.n + 1.0 / b.n)), 6) AS std_err
FROM g a JOIN g b ON a.grp < b.grp, t""")
def q_t07_tukey_many_groups(spark, sf):
    out = stats.tukey_hsd(table(spark, sf, "part"), "p_size", "p_retailprice")
    return round_doubles(out.select("group1", "group2", "meandiff", "std_err"))


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_pairs_sql(method: str) -> str:
    pairs = [(CORR_COLS[i], CORR_COLS[j]) for i in range(len(CORR_COLS)) for j in range(i + 1, len(CORR_COLS))]
    if method == "pearson":
        body = " UNION ALL ".join(
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
            f"corr({a}, {b}) AS r FROM li" for a, b in pairs)
    else:
        parts = []
        for a, b in pairs:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, corr(rx, ry) AS r FROM ("
                f"SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
                f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry "
                f"FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM li "
                f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")
        body = " UNION ALL ".join(parts)
    return f"""WITH {LI_NULLS_SQL}, c AS ({body})
SELECT col_a, col_b, CAST(n AS BIGINT) AS n, round(r, 6) AS r, {ladder_sql('abs(r)', CORR_LADDER, CORR_ELSE)} AS strength FROM c"""


@register("t09_pearson", _corr_pairs_sql("pearson"))
def q_t09_pearson(spark, sf):
    out = stats.correlation(lineitem_nulls(spark, sf), CORR_COLS, "pearson")
    return round_doubles(out.select("col_a", "col_b", "n", "r", "strength"))


@register("t10_spearman", _corr_pairs_sql("spearman"))
def q_t10_spearman(spark, sf):
    out = stats.correlation(lineitem_nulls(spark, sf), CORR_COLS, "spearman")
    return round_doubles(out.select("col_a", "col_b", "n", "r", "strength"))





KENDALL_COLS = ["c_custkey", "c_nationkey", "c_acctbal"]


def _kendall_sql() -> str:
    pairs = [(KENDALL_COLS[i], KENDALL_COLS[j]) for i in range(3) for j in range(i + 1, 3)]
    parts = []
    for a, b in pairs:
        parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, any_value(n) AS n,
  sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt((any_value(n) * (any_value(n) - 1) / 2.0 - any_value(tx))
        * (any_value(n) * (any_value(n) - 1) / 2.0 - any_value(ty))) AS r
FROM (SELECT row_number() OVER () AS id, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM customer
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL) p
JOIN (SELECT row_number() OVER () AS id, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM customer
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q ON p.id < q.id,
 (SELECT count(*) AS n FROM customer WHERE {a} IS NOT NULL AND {b} IS NOT NULL) nn,
 (SELECT coalesce(sum(t * (t - 1) / 2.0), 0) AS tx FROM (SELECT count(*) AS t FROM customer WHERE {b} IS NOT NULL GROUP BY {a})) ax,
 (SELECT coalesce(sum(t * (t - 1) / 2.0), 0) AS ty FROM (SELECT count(*) AS t FROM customer WHERE {a} IS NOT NULL GROUP BY {b})) ay""")
    return "WITH k AS (" + " UNION ALL ".join(parts) + ") SELECT col_a, col_b, CAST(n AS BIGINT) AS n, round(r, 6) AS r FROM k"


@register("t11_kendall", _kendall_sql())
def q_t11_kendall(spark, sf):
    out = stats.correlation(table(spark, sf, "customer"), KENDALL_COLS, "kendall")
    return round_doubles(out.select("col_a", "col_b", "n", "r"))
