"""SQL-callable functions (``CREATE TEMPORARY FUNCTION ... RETURN expr``).

SQL UDFs are inlined by Catalyst like any expression: no Python at run
time.  Bodies restate the Column versions in SQL text; the tests and the
``sql_functions`` query check them against the same DuckDB twin.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from .. import config


def _q(s: str) -> str:
    return "'" + s.replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    scope = " ".join(f"WHEN startswith(ip, {_q(p)}) THEN {_q(lab)}" for p, lab in config.PRIVATE_PREFIXES)
    rep_priv = " OR ".join(f"startswith(ip, {_q(p)})" for p in config.REPUTATION_PRIVATE)
    tlds = "array(" + ", ".join(_q(t) for t in config.COMMON_TLDS) + ")"
    risk = " ".join(f"WHEN score >= {lo} THEN {_q(nm)}" for lo, nm in config.RISK_LEVELS[:-1])
    return {
        "shannon_entropy": """(s STRING) RETURNS DOUBLE RETURN
  CASE WHEN length(s) > 0 THEN -aggregate(transform(split(s, ''), c -> log2(size(filter(split(s, ''), x -> x = c))
    / length(s))), 0D, (a, t) -> a + t) / length(s) ELSE 0D END""",
        "ip_scope": f"(ip STRING) RETURNS STRING RETURN CASE {scope} END",
        "reputation_private": f"(ip STRING) RETURNS BOOLEAN RETURN {rep_priv}",
        "domain_label": f"""(q STRING) RETURNS STRING RETURN
  CASE WHEN size(filter(split(lower(TRIM(TRAILING '.' FROM q)), '[.]'), p -> NOT array_contains({tlds}, p)
         AND length(p) > 2)) > 0
       THEN element_at(filter(split(lower(TRIM(TRAILING '.' FROM q)), '[.]'), p -> NOT array_contains({tlds}, p)
         AND length(p) > 2), -1) END""",
        "dga_reason": """(label STRING) RETURNS STRING RETURN
  CASE WHEN label IS NULL THEN NULL
       WHEN label RLIKE '^[0-9a-fA-F]{8,}$' THEN 'hex-pattern label'
       WHEN shannon_entropy(label) > 3.8 THEN format_string('high entropy (%.2f)', shannon_entropy(label))
       WHEN lower(label) RLIKE '[^aeiou]{5,}' THEN 'consonant cluster'
       WHEN length(label) >= 25 THEN format_string('long label (%d chars)', length(label))
       WHEN length(label) > 6 AND (length(label) - length(translate(label, 'aeiou', ''))) / length(label) < 0.15
         THEN 'low vowel ratio' END""",
        "threat_score": """(a BIGINT, n BIGINT, p BIGINT, r BIGINT, s BIGINT) RETURNS DOUBLE RETURN
  CASE WHEN a + n > 0 THEN signum((a / (a + n)) * 0.45D + least(p / 50.0D, 1.0D) * 0.25D
        + least(r / 100.0D, 1.0D) * 0.20D + least(s / 5.0D, 1.0D) * 0.10D)
      * floor(abs(((a / (a + n)) * 0.45D + least(p / 50.0D, 1.0D) * 0.25D + least(r / 100.0D, 1.0D) * 0.20D
        + least(s / 5.0D, 1.0D) * 0.10D) * 100) * 10D + 0.5D) / 10D ELSE 0D END""",
        "risk_level": f"(score DOUBLE) RETURNS STRING RETURN CASE {risk} ELSE '{config.RISK_LEVELS[-1][1]}' END",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions on ``spark``; returns their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
