"""DuckDB twins of the dataset cleaning and split operators."""
from __future__ import annotations

from .. import config
from ..fixtures import FLOW_CSV_RAW_SQL
from ..operators.dataset import P31, _mult

PRESENT = ["flow_duration", "total_fwd_packets", "init_win_bytes_backward", "fwd_iat_min", "flow_bytes_s",
           "flow_iat_mean"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LABEL_CASE = ("CASE regexp_replace(label_raw, '^\\s+|\\s+$', '', 'g') "
              + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in config.CSV_LABEL_MAP.items())
              + f" ELSE {config.UNMAPPED_LABEL_ID} END")


def _finite(c: str) -> str:
    return f"({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) <> 'inf'::DOUBLE)"


def _feat(f: str) -> str:
    src = f if f in PRESENT else "0.0::DOUBLE"
    low = f.lower()
    return src if ("min" in low or "iat" in low) else f"greatest({src}, 0.0::DOUBLE)"


NORM_CTE = f"""raw AS ({FLOW_CSV_RAW_SQL}),
norm AS (SELECT *, CAST({LABEL_CASE} AS INTEGER) AS label,
  (regexp_replace(label_raw, '^\\s+|\\s+$', '', 'g') IN ({", ".join(_q(k) for k in config.CSV_LABEL_MAP)})) AS label_mapped
  FROM raw)"""
OK = " AND ".join(_finite(c) for c in PRESENT)
CLEAN_CTE = NORM_CTE + f""",
cleaned AS (SELECT {", ".join(f"{_feat(f)} AS {f}" for f in config.FEATURE_NAMES)}, label FROM norm WHERE {OK})"""

CSV_CLEANED_SQL = "WITH " + CLEAN_CTE + "\nSELECT * FROM cleaned"
CLEAN_STATS_SQL = ("WITH " + NORM_CTE + f"\nSELECT count(*) AS rows_before, count(*) FILTER (WHERE {OK}) AS rows_after, "
                   "count(*) FILTER (WHERE NOT label_mapped) AS unmapped_labels FROM norm")
LABEL_DIST_SQL = ("WITH " + CLEAN_CTE + """
SELECT label, count(*) AS count, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM cleaned) * 100.0, 2) AS pct
FROM cleaned GROUP BY label ORDER BY count DESC, label""")


def hash_sql(seed: int) -> str:
    acc = "CAST(0 AS BIGINT)"
    for i, c in enumerate(config.FEATURE_NAMES + ["label"]):
        v = f"coalesce(TRY_CAST(floor({c} * 1000) AS BIGINT), 0)"
        pv = f"((({v}) % {P31} + {P31}) % {P31})"
        acc = f"((({acc}) + {pv} * {_mult(i, seed)}) % {P31})"
    return acc


SPLIT_CTE = CLEAN_CTE + f""",
hashed AS (SELECT *, {hash_sql(42)} AS h1, {hash_sql(43)} AS h2 FROM cleaned),
split AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h1, h2)
            <= ceil(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM hashed)"""
SPLIT_SQL = "WITH " + SPLIT_CTE + "\nSELECT h1, h2, label, is_test FROM split"
CLASS_WEIGHTS_SQL = ("WITH " + SPLIT_CTE + """,
tr AS (SELECT * FROM split WHERE NOT is_test)
SELECT label, CAST((SELECT count(*) FROM tr) AS DOUBLE) / ((SELECT count(DISTINCT label) FROM tr) * count(*)) AS weight
FROM tr GROUP BY label""")
SCALER_SQL = ("WITH " + SPLIT_CTE + ",\ntr AS (SELECT * FROM split WHERE NOT is_test)\n" + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END, 6) AS std FROM tr"
    for f in config.FEATURE_NAMES))
