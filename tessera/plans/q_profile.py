"""Profiling, cleaning and chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, profile
from .registry import register
from .tables import round_doubles, table

NUM8 = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_COLS = NUM8[:4] + ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                      "l_shipdate"]

# lineitem with deterministic missing values (every row kept; no column of the driver
# table has nulls, so the cleaning operators need some): quantity null for order keys
# divisible by 7, discount by 11, return flag by 13.
LI_NULLS_SQL = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""


def lineitem_nulls(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")

    def nul(c, m):
        return F.when(F.pmod(k, F.lit(m)) == 0, F.lit(None)).otherwise(F.col(c)).alias(c)

    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", nul("l_quantity", 7), "l_extendedprice",
                     nul("l_discount", 11), "l_tax", nul("l_returnflag", 13), "l_linestatus", "l_shipdate")


def _unpivot_sql(src: str, cols, cast="DOUBLE", include_nulls=False) -> str:
    sel = ", ".join(f"CAST({c} AS {cast}) AS {c}" for c in cols)
    if include_nulls:
        return f"(SELECT feature, value FROM (SELECT {sel} FROM {src}) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(cols)})))"
    return f"(UNPIVOT (SELECT {sel} FROM {src}) ON {', '.join(cols)} INTO NAME feature VALUE value)"


@register("a01_table_shape", f"""WITH {LI_NULLS_SQL}
SELECT count(*) AS n_rows, 11 AS n_cols,
  CAST(count(*) - count(l_quantity) + count(*) - count(l_discount) + count(*) - count(l_returnflag) AS BIGINT) AS total_missing,
  8 AS n_numeric, 2 AS n_categorical FROM li""")
def q_a01_table_shape(spark, sf):
    return profile.table_shape(lineitem_nulls(spark, sf))


@register("a02_missing_report", f"""WITH {LI_NULLS_SQL},
m AS (SELECT count(*) AS n, {', '.join(f"count(*) - count({c}) AS {c}" for c in LI_COLS)} FROM li)
SELECT "column", CAST(missing AS BIGINT) AS missing, round(CAST(missing AS DOUBLE) * 100.0 / n, 6) AS missing_rate
FROM (UNPIVOT m ON {', '.join(LI_COLS)} INTO NAME "column" VALUE missing)""")
def q_a02_missing_report(spark, sf):
    return round_doubles(profile.missing_report(lineitem_nulls(spark, sf)))


@register("a03_describe_numeric", f"""
SELECT feature AS "column", count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max
FROM {_unpivot_sql('lineitem', NUM8)} GROUP BY feature""")
def q_a03_describe_numeric(spark, sf):
    return round_doubles(profile.describe_numeric(table(spark, sf, "lineitem"), NUM8))


PART_STR = ["p_name", "p_brand", "p_type"]


@register("a04_describe_categorical", f"""
WITH vc AS (SELECT feature, value, count(*) AS cnt FROM {_unpivot_sql('part', PART_STR, 'VARCHAR')} GROUP BY ALL)
SELECT feature AS "column", CAST(sum(cnt) AS BIGINT) AS count, count(*) AS "unique",
  first(value ORDER BY cnt DESC, value ASC) AS top, max(cnt) AS freq FROM vc GROUP BY feature""")
def q_a04_describe_categorical(spark, sf):
    return profile.describe_categorical(table(spark, sf, "part"), PART_STR)


@register("a07_numeric_summary", f"""WITH {LI_NULLS_SQL},
l AS {_unpivot_sql('li', NUM8, include_nulls=True)}
SELECT feature AS "column", count(value) AS count, count(*) - count(value) AS missing,
  round(CAST(count(*) - count(value) AS DOUBLE) * 100.0 / count(*), 6) AS missing_rate,
  count(DISTINCT value) AS n_unique, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max
FROM l GROUP BY feature""")
def q_a07_numeric_summary(spark, sf):
    return round_doubles(profile.numeric_summary(lineitem_nulls(spark, sf), NUM8))


@register("a08_categorical_summary", f"""WITH {LI_NULLS_SQL},
l AS {_unpivot_sql('li', ['l_returnflag', 'l_linestatus'], 'VARCHAR', include_nulls=True)},
vc AS (SELECT feature, value, count(*) AS cnt FROM l GROUP BY ALL)
SELECT feature AS "column", CAST(sum(CASE WHEN value IS NOT NULL THEN cnt ELSE 0 END) AS BIGINT) AS count,
  CAST(sum(CASE WHEN value IS NULL THEN cnt ELSE 0 END) AS BIGINT) AS missing,
  round(CAST(sum(CASE WHEN value IS NULL THEN cnt ELSE 0 END) AS DOUBLE) * 100.0 / sum(cnt), 6) AS missing_rate,
  count(value) AS n_unique, first(value ORDER BY cnt DESC, value ASC) FILTER (WHERE value IS NOT NULL) AS mode,
  coalesce(max(cnt) FILTER (WHERE value IS NOT NULL), 0) AS mode_freq
FROM vc GROUP BY feature""")
def q_a08_categorical_summary(spark, sf):
    return round_doubles(profile.categorical_summary(lineitem_nulls(spark, sf), ["l_returnflag", "l_linestatus"]))


_LI_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
             "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
             "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@register("a08_column_overview", f"""WITH {LI_NULLS_SQL},
s AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, '{t}' AS dtype, '{'categorical' if t in ('string', 'timestamp_ntz') else 'numeric'}' AS kind, count(*) - count({c}) AS missing, count(*) AS n, count(DISTINCT {c}) AS n_unique FROM li" for c, t in _LI_TYPES.items())})
SELECT col AS "column", dtype, CAST(missing AS BIGINT) AS missing, round(CAST(missing AS DOUBLE) * 100.0 / n, 6) AS missing_rate,
  CAST(n_unique AS BIGINT) AS n_unique, kind, '' AS description FROM s""")
def q_a08_column_overview(spark, sf):
    return round_doubles(profile.column_overview(lineitem_nulls(spark, sf)))


@register("a09_outlier_report", f"""
WITH l AS {_unpivot_sql('lineitem', NUM8)},
st AS (SELECT feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
              avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY feature),
b AS (SELECT feature, q1 - 1.5 * (q3 - q1) AS il, q3 + 1.5 * (q3 - q1) AS iu, m - 3 * s AS sl, m + 3 * s AS su FROM st WHERE n >= 4),
c AS (SELECT b.feature, count(*) FILTER (WHERE l.value < il OR l.value > iu) AS ic,
             count(*) FILTER (WHERE l.value < sl OR l.value > su) AS sc, any_value(il) AS il, any_value(iu) AS iu,
             any_value(sl) AS sl, any_value(su) AS su FROM l JOIN b USING (feature) GROUP BY b.feature)
SELECT feature AS "column", ic AS iqr_count, round(il, 6) AS iqr_lower, round(iu, 6) AS iqr_upper, sc AS sigma_count,
  round(sl, 6) AS sigma_lower, round(su, 6) AS sigma_upper FROM c WHERE ic > 0 OR sc > 0""")
def q_a09_outlier_report(spark, sf):
    return round_doubles(profile.outlier_report(table(spark, sf, "lineitem"), NUM8))


@register("p11_outlier_rows", """
WITH st AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, st
WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)""")
def q_p11_outlier_rows(spark, sf):
    return profile.outlier_rows(table(spark, sf, "lineitem"), "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_extendedprice")


@register("a10_value_counts", """
SELECT l_quantity AS value, count(*) AS count FROM lineitem WHERE l_quantity IS NOT NULL
GROUP BY l_quantity ORDER BY count DESC, value ASC LIMIT 10""")
def q_a10_value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "lineitem"), "l_quantity", 10)


@register("a11_crosstab", """
SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL""")
def q_a11_crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("a12_group_stats", """
SELECT c_mktsegment, count(c_acctbal) AS count, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
def q_a12_group_stats(spark, sf):
    return round_doubles(profile.group_stats(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


@register("a16_class_distribution", """
SELECT CAST(o_orderstatus AS VARCHAR) AS class, count(*) AS count,
  round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS ratio
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def q_a16_class_distribution(spark, sf):
    return profile.class_distribution(table(spark, sf, "orders"), "o_orderstatus")


def _hist_sql(src: str, col: str, bins_expr: str, group: str | None = None, density: bool = False) -> str:
    g_sel = f", CAST({group} AS VARCHAR) AS grp" if group else ""
    g_key = "grp, " if group else ""
    cells = ("(SELECT DISTINCT grp FROM x) g, " if group else "")
    dens = (", round(CAST(coalesce(c.cnt, 0) AS DOUBLE) / (sum(coalesce(c.cnt, 0)) OVER ("
            + ("PARTITION BY d.grp" if group else "") + ") * (upper - lower)), 6) AS density") if density else ""
    d_grp = "d.grp AS \"group\", " if group else ""
    join_g = "AND c.grp = d.grp " if group else ""
    return f"""
WITH x AS (SELECT CAST({col} AS DOUBLE) AS v{g_sel} FROM {src} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
st AS (SELECT count(*) AS n, min(v) AS mn0, max(v) AS mx0 FROM x),
p AS (SELECT {bins_expr} AS b, CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn,
             CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx FROM st),
e AS (SELECT b, list_transform(range(0, b + 1), lambda k: CASE WHEN k = b THEN mx ELSE k * ((mx - mn) / b) + mn END) AS edges FROM p),
bins AS (SELECT {g_key}CAST(i AS INTEGER) AS bin_id, edges[i] AS lower, edges[i + 1] AS upper
         FROM {cells}(SELECT edges, unnest(range(1, b + 1)) AS i FROM e)),
c AS (SELECT {g_key}CAST(1 + len(list_filter(e.edges[2:e.b], lambda t: t <= x.v)) AS INTEGER) AS bin_id, count(*) AS cnt
      FROM x, e GROUP BY ALL)
SELECT {d_grp}d.bin_id, round(d.lower, 6) AS lower, round(d.upper, 6) AS upper, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count{dens}
FROM bins d LEFT JOIN c ON c.bin_id = d.bin_id {join_g}"""


@register("a17_histogram", _hist_sql("lineitem", "l_extendedprice", "least(30, greatest(5, n // 10))"))
def q_a17_histogram(spark, sf):
    return round_doubles(profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("c01_histogram_grouped", _hist_sql("lineitem", "l_extendedprice", "30", group="l_returnflag"))
def q_c01_histogram_grouped(spark, sf):
    return round_doubles(profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", bins=30,
                                           group="l_returnflag"))


@register("c09_density_histogram", _hist_sql("orders", "o_totalprice", "30", density=True))
def q_c09_density_histogram(spark, sf):
    return round_doubles(profile.histogram(table(spark, sf, "orders"), "o_totalprice", bins=30, density=True))


@register("p14_chart_recommendation", f"""WITH {LI_NULLS_SQL},
s AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, '{'categorical' if t in ('string', 'timestamp_ntz') else 'numeric'}' AS kind, count({c}) AS cnt, count(DISTINCT {c}) AS nu FROM li" for c, t in _LI_TYPES.items())})
SELECT col AS "column", kind, CASE WHEN kind = 'numeric' THEN
  CASE WHEN CAST(nu AS DOUBLE) / greatest(cnt, 1) < 0.05 OR nu <= 10 THEN 'bar' WHEN nu > 30 THEN 'histogram' ELSE 'box' END
  ELSE CASE WHEN nu <= 6 THEN 'pie' ELSE 'bar' END END AS chart FROM s""")
def q_p14_chart_recommendation(spark, sf):
    return profile.chart_recommendation(lineitem_nulls(spark, sf))


@register("p15_target_guess", f"""
WITH d AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {i} AS ord, count(DISTINCT {c}) AS nu, {str(t not in ('string', 'timestamp_ntz')).upper()} AS isnum FROM orders" for i, (c, t) in enumerate([('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')]))}),
t AS (SELECT coalesce((SELECT col FROM d WHERE isnum AND nu <= 5 ORDER BY ord LIMIT 1), 'o_orderpriority') AS target)
SELECT col AS "column", CASE WHEN col = target THEN 'target' ELSE 'feature' END AS role, CAST(ord AS INTEGER) AS ord FROM d, t""")
def q_p15_target_guess(spark, sf):
    return profile.target_guess(table(spark, sf, "orders"))


# ---------------------------------------------------------------------------
# Cleaning (P4-P9)
# ---------------------------------------------------------------------------

@register("p04_convert_type", """
SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice,
       CAST(l_discount AS VARCHAR) AS l_discount FROM lineitem""")
def q_p04_convert_type(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    li = clean.convert_type(li, "l_extendedprice", "int")
    return clean.convert_type(li, "l_discount", "str")


@register("p05_to_datetime", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END AS raw,
       TRY_CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END AS TIMESTAMP) AS parsed
FROM orders""")
def q_p05_to_datetime(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("n/a")).otherwise(F.col("o_orderdate").cast("string"))
    o = o.select("o_orderkey", raw.alias("raw"), raw.alias("parsed"))
    return clean.to_datetime(o, "parsed").withColumn("parsed", F.col("parsed").cast("timestamp_ntz"))


@register("p06_replace_value", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 1.0 THEN 100.0 ELSE l_quantity END AS l_quantity FROM lineitem""")
def q_p06_replace_value(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    out, _n = clean.replace_value(li, "l_quantity", "1", "100")
    return out


def _fill_sql(stat: str) -> str:
    agg = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)",
           "mode": "(SELECT min(v) FROM (SELECT {c} AS v, count(*) AS n FROM li WHERE {c} IS NOT NULL GROUP BY v) "
                   "WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM li WHERE {c} IS NOT NULL GROUP BY {c})))"}[stat]
    q = agg.format(c="l_quantity")
    d = agg.format(c="l_discount")
    if stat == "mode":
        st = f"st AS (SELECT {q} AS fq, {d} AS fd)"
    else:
        st = f"st AS (SELECT {q} AS fq, {d} AS fd FROM li)"
    return f"""WITH {LI_NULLS_SQL}, {st}
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, fq), 6) AS l_quantity, round(coalesce(l_discount, fd), 6) AS l_discount,
  l_returnflag FROM li, st"""


def _fill_query(strategy):
    def q(spark, sf):
        li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
        return round_doubles(clean.fill_missing(li, strategy, ["l_quantity", "l_discount", "l_returnflag"]))
    return q


for _s in ("mean", "median", "mode"):
    register(f"p07_fill_{_s}", _fill_sql(_s))(_fill_query(_s))


@register("p07_fill_drop", f"""WITH {LI_NULLS_SQL}
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM li
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL""")
def q_p07_fill_drop(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return clean.fill_missing(li, "drop", ["l_quantity", "l_discount", "l_returnflag"])


@register("p08_fill_per_column", f"""WITH {LI_NULLS_SQL},
s1 AS (SELECT quantile_cont(l_quantity, 0.5) AS fq FROM li),
kept AS (SELECT * FROM li WHERE l_discount IS NOT NULL),
s2 AS (SELECT avg(l_tax) AS ft FROM kept)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, fq), 6) AS l_quantity, round(l_discount, 6) AS l_discount,
  coalesce(l_returnflag, 'U') AS l_returnflag, round(coalesce(l_tax, ft), 6) AS l_tax FROM kept, s1, s2""")
def q_p08_fill_per_column(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag",
                                          "l_tax")
    out = clean.fill_missing_per_column(li, {
        "l_quantity": {"strategy": "median"},
        "l_discount": {"strategy": "drop"},
        "l_returnflag": {"strategy": "fill_value", "fill_value": "U"},
        "l_tax": {"strategy": "mean"},
    })
    return round_doubles(out)


@register("p09_dropna", f"""WITH {LI_NULLS_SQL}
SELECT l_quantity, l_discount, l_returnflag FROM li
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL""")
def q_p09_dropna(spark, sf):
    return clean.dropna_guard(lineitem_nulls(spark, sf), ["l_quantity", "l_discount", "l_returnflag"])



@register("a06_api_summary", f"""WITH {LI_NULLS_SQL},
n AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM li" for c in NUM8)}),
vc AS (SELECT feature, value, count(*) AS cnt FROM (SELECT feature, value FROM (SELECT CAST(l_returnflag AS VARCHAR) AS l_returnflag, CAST(l_linestatus AS VARCHAR) AS l_linestatus FROM li) UNPIVOT (value FOR feature IN (l_returnflag, l_linestatus))) GROUP BY ALL),
c AS (SELECT feature AS col, count(*) AS "unique", first(value ORDER BY cnt DESC, value ASC) AS top, max(cnt) AS freq FROM vc GROUP BY feature),
o AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing, '{'categorical' if t in ('string', 'timestamp_ntz') else 'numeric'}' AS kind FROM li" for c, t in _LI_TYPES.items())})
SELECT o.col AS "column", dtype, missing, kind, n.mean, n.std, n.min, n.max, c."unique", c.top, c.freq
FROM o LEFT JOIN n ON n.col = o.col LEFT JOIN c ON c.col = o.col""")
def q_a06_api_summary(spark, sf):
    return round_doubles(profile.api_summary(lineitem_nulls(spark, sf)))
