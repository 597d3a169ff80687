"""Streaming query (ST1): daily PSI of events.value against the first week's edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import PSI_ELSE, PSI_LADDER, ladder_sql
from ..streaming import drift_stream
from .registry import qs_sql, register
from .tables import round_doubles, table, ts

BASELINE_END = "2024-01-08"


@register("st1_stream_psi", f"""
WITH b AS (SELECT value AS v FROM events WHERE ts < TIMESTAMP '{BASELINE_END}' AND value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT list_sort(list_distinct(quantile_cont(v, {qs_sql(10)}))) AS edges FROM b),
qq AS (SELECT len(edges) - 1 AS k, edges[2:len(edges) - 1] AS inner_edges FROM q),
bc AS (SELECT CAST(1 + len(list_filter(qq.inner_edges, lambda x: x < b.v)) AS INTEGER) AS bin_id, count(*) AS c FROM b, qq GROUP BY 1),
bd AS (SELECT CAST(i AS INTEGER) AS bin_id FROM (SELECT unnest(range(1, k + 1)) AS i FROM qq)),
be AS (SELECT bd.bin_id, (coalesce(bc.c, 0) + CAST(0.5 AS DOUBLE)) / ((SELECT count(*) FROM b) + CAST(0.5 AS DOUBLE) * (SELECT k FROM qq)) AS e_pct
       FROM bd LEFT JOIN bc USING (bin_id)),
a AS (SELECT date_trunc('day', ts) AS ws, value AS v FROM events WHERE ts >= TIMESTAMP '{BASELINE_END}' AND value IS NOT NULL AND NOT isnan(value)),
ac AS (SELECT ws, CAST(1 + len(list_filter(qq.inner_edges, lambda x: x < a.v)) AS INTEGER) AS bin_id, count(*) AS c FROM a, qq GROUP BY ALL),
cells AS (SELECT w.ws, bd.bin_id FROM (SELECT DISTINCT ws FROM a) w, bd),
f AS (SELECT cells.ws, cells.bin_id, coalesce(ac.c, 0) AS c, be.e_pct FROM cells LEFT JOIN ac USING (ws, bin_id) JOIN be USING (bin_id)),
g AS (SELECT *, sum(c) OVER (PARTITION BY ws) AS n FROM f),
p AS (SELECT ws, any_value(n) AS n, sum(((c + CAST(0.5 AS DOUBLE)) / (n + CAST(0.5 AS DOUBLE) * (SELECT k FROM qq)) - e_pct)
        * ln(((c + CAST(0.5 AS DOUBLE)) / (n + CAST(0.5 AS DOUBLE) * (SELECT k FROM qq))) / e_pct)) AS psi FROM g GROUP BY ws)
SELECT ws AS window_start, ws + INTERVAL 1 DAY AS window_end, CAST(n AS BIGINT) AS n_actual, round(psi, 6) AS psi,
       {ladder_sql('psi', PSI_LADDER, PSI_ELSE)} AS stability FROM p""")
def q_st1_stream_psi(spark, sf):
    path = f"{sf.rstrip('/')}/events.parquet"
    baseline = table(spark, sf, "events").where(F.col("ts") < ts(BASELINE_END))
    stream = drift_stream.events_stream(spark, path).where(F.col("ts") >= ts(BASELINE_END))
    return round_doubles(drift_stream.stream_psi(spark, stream, baseline, "value", "ts", "1 day", "1 hour", 10))
