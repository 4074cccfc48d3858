"""DuckDB twins for the metric operators fed with fixture predictions."""
from __future__ import annotations

from .. import config
from .dataset import CLEAN_CTE, SPLIT_CTE

PRED_CTE = SPLIT_CTE + """,
pr AS (SELECT h1, h2, label, CASE WHEN h1 % 10 <> 0 THEN label ELSE (label + 1) % 5 END AS prediction,
         (h2 % 7 = 0) AS flagged FROM split WHERE is_test),
cm AS (SELECT label AS t, prediction AS p, count(*) AS n FROM pr GROUP BY label, prediction),
cls AS (SELECT t AS c FROM cm UNION SELECT p FROM cm),
per AS (
  SELECT c, coalesce(sum(n) FILTER (WHERE t = c AND p = c), 0) AS tp, coalesce(sum(n) FILTER (WHERE p = c AND t <> c), 0) AS fp,
    coalesce(sum(n) FILTER (WHERE t = c AND p <> c), 0) AS fn
  FROM cls LEFT JOIN cm ON cm.t = cls.c OR cm.p = cls.c GROUP BY c),
rep AS (
  SELECT c AS class, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall, CAST(tp + fn AS BIGINT) AS support
  FROM per),
rep2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
         FROM rep)"""

CLASS_REPORT_SQL = "WITH " + PRED_CTE + "\nSELECT class, precision, recall, support, f1 FROM rep2"
CLASS_SUMMARY_SQL = ("WITH " + PRED_CTE + """
SELECT (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM pr) AS accuracy,
  round(sum(f1 * support) / sum(support), 10) AS f1_weighted, round(avg(f1), 10) AS f1_macro FROM rep2""")
DETECTOR_SQL = ("WITH " + PRED_CTE + """
SELECT coalesce(avg(CASE WHEN label <> 0 THEN CAST(flagged AS DOUBLE) END), 0.0) AS detection_rate,
  coalesce(avg(CASE WHEN label = 0 THEN CAST(flagged AS DOUBLE) END), 0.0) AS false_positive_rate FROM pr""")
RUNNING_ACC_SQL = ("WITH " + PRED_CTE + """
SELECT h1, h2, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) OVER w / count(*) OVER w AS running_accuracy
FROM pr WINDOW w AS (ORDER BY h1, h2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

# error function by the rational approximation 7.1.26 of Abramowitz and Stegun
SPLIT_GAINS_SQL = ("WITH " + CLEAN_CTE + """,
u AS (SELECT label AS y, unnest([""" + ", ".join(
    f"{{'f': '{f}', 'x': CAST(coalesce({f}, 0) AS DOUBLE)}}" for f in config.FEATURE_NAMES) + """], recursive := true) FROM cleaned WHERE label IS NOT NULL),
s AS (SELECT f, y, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mu, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM u GROUP BY f, y),
t AS (SELECT f, i, min(lo) + (max(hi) - min(lo)) * i / CAST(11 AS DOUBLE) AS cut FROM s, range(1, 11) AS r(i)
      GROUP BY f, i HAVING max(hi) > min(lo)),
z AS (SELECT t.f, i, cut, n, lo, hi, mu, sd, abs(cut - mu) / nullif(sd, 0) / sqrt(2) AS d FROM t JOIN s ON s.f = t.f),
e AS (SELECT *, 1 / (1 + CAST(0.3275911 AS DOUBLE) * d) AS k FROM z),
c AS (SELECT f, i, n, n * CASE WHEN cut < lo THEN 0 WHEN cut >= hi THEN 1 WHEN sd = 0 THEN CAST(mu <= cut AS INT)
        ELSE 0.5::DOUBLE + sign(cut - mu) * 0.5::DOUBLE * (1 - k * (0.254829592::DOUBLE + k * (-0.284496736::DOUBLE
          + k * (1.421413741::DOUBLE + k * (-1.453152027::DOUBLE + k * 1.061405429::DOUBLE)))) * exp(-d * d)) END AS l FROM e),
g AS (SELECT f, i, sum(n) AS n, sum(l) AS l, -sum(n * log2(n / tot)) AS h_all, -sum(CASE WHEN l > 0 THEN l * log2(l / nullif(lt, 0)) ELSE 0 END) AS h_left,
        -sum(CASE WHEN n - l > 0 THEN (n - l) * log2((n - l) / nullif(tot - lt, 0)) ELSE 0 END) AS h_right
      FROM (SELECT *, sum(n) OVER w AS tot, sum(l) OVER w AS lt FROM c WINDOW w AS (PARTITION BY f, i)) GROUP BY f, i)
SELECT f AS feature, round(max((h_all - h_left - h_right) / n), 6) AS gain FROM g GROUP BY f""")
