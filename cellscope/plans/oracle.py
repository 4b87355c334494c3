"""Independent SQL (DuckDB dialect) for every registered query.

Written in the direct relational form of the original jobs (self-join
free ranking is the only liberty taken; the spatial credit uses the literal
four lookups), over the driver's raw tables, so agreement is meaningful.
"""

from __future__ import annotations

from . import params as P

_HOURS = ",\n  ".join(
    f'max(CASE WHEN HOUR_OF_DAY = {h} THEN INDEX_1KM END) AS "{h}"' for h in range(24))

_PRELUDE = f"""
WITH raw AS (
  SELECT CAST(user_id AS VARCHAR) AS SUBSCRIBER_ID,
         strftime(ts, '%Y%m%d%H%M%S') AS CALL_TIME,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 25 AS VARCHAR) AS INDEX_1KM
  FROM events
), parsed AS (
  SELECT SUBSCRIBER_ID, try_strptime(CALL_TIME, '%Y%m%d%H%M%S') AS CALL_TIMESTAMP, INDEX_1KM
  FROM raw
), cdr AS (
  SELECT SUBSCRIBER_ID, CALL_TIMESTAMP, INDEX_1KM,
         CAST(year(CALL_TIMESTAMP) AS INTEGER) AS YEAR,
         CAST(ceil(dayofyear(CAST(CALL_TIMESTAMP AS DATE)
                   + CAST(6 - dayofweek(CALL_TIMESTAMP) AS INTEGER)) / 7.0) AS INTEGER) AS WEEK_OF_YEAR,
         CAST(dayofyear(CALL_TIMESTAMP) AS INTEGER) AS DATE_OF_YEAR,
         CAST(hour(CALL_TIMESTAMP) AS INTEGER) AS HOUR_OF_DAY
  FROM parsed
), classed AS (
  SELECT *, CASE WHEN HOUR_OF_DAY IS NULL THEN ''
                 WHEN HOUR_OF_DAY < 5 OR HOUR_OF_DAY >= 21 THEN 'HOME_HOUR'
                 ELSE 'WORK_HOUR' END AS HW_TIME_FILTER
  FROM cdr
), presence AS (
  SELECT DISTINCT SUBSCRIBER_ID, INDEX_1KM, WEEK_OF_YEAR, DATE_OF_YEAR, HW_TIME_FILTER
  FROM classed
), counts AS (
  SELECT HW_TIME_FILTER, SUBSCRIBER_ID, INDEX_1KM, CAST(count(*) AS BIGINT) AS APPEARANCE_COUNT
  FROM presence WHERE HW_TIME_FILTER IN ('HOME_HOUR', 'WORK_HOUR')
  GROUP BY HW_TIME_FILTER, SUBSCRIBER_ID, INDEX_1KM
), top1 AS (
  SELECT HW_TIME_FILTER, SUBSCRIBER_ID, INDEX_1KM, APPEARANCE_COUNT AS MAX_APPEARANCE_COUNT
  FROM (SELECT *, row_number() OVER (PARTITION BY SUBSCRIBER_ID, HW_TIME_FILTER
                                     ORDER BY APPEARANCE_COUNT DESC, INDEX_1KM ASC NULLS LAST) AS rn
        FROM counts WHERE SUBSCRIBER_ID IS NOT NULL) t
  WHERE rn = 1
), ties AS (
  SELECT c.HW_TIME_FILTER, c.SUBSCRIBER_ID, c.INDEX_1KM, c.APPEARANCE_COUNT AS MAX_APPEARANCE_COUNT
  FROM counts c
  JOIN (SELECT SUBSCRIBER_ID, HW_TIME_FILTER, max(APPEARANCE_COUNT) AS m
        FROM counts GROUP BY SUBSCRIBER_ID, HW_TIME_FILTER) x
    ON c.SUBSCRIBER_ID = x.SUBSCRIBER_ID AND c.HW_TIME_FILTER = x.HW_TIME_FILTER
   AND c.APPEARANCE_COUNT = x.m
), adj AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS ADJ_INDEX_1KM,
         CASE WHEN n_nationkey - 5 >= 0 THEN CAST(n_nationkey - 5 AS VARCHAR) END AS ADJ_1,
         CASE WHEN n_nationkey + 5 < 25 THEN CAST(n_nationkey + 5 AS VARCHAR) END AS ADJ_2,
         CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey - 1 AS VARCHAR) END AS ADJ_3,
         CASE WHEN n_nationkey % 5 <> 4 THEN CAST(n_nationkey + 1 AS VARCHAR) END AS ADJ_4
  FROM nation
), spatial AS (
  SELECT c.HW_TIME_FILTER, c.SUBSCRIBER_ID, c.INDEX_1KM,
         CAST(coalesce(a1.APPEARANCE_COUNT, 0) AS BIGINT) AS ADJ_1_APPEARANCE_COUNT,
         CAST(coalesce(a2.APPEARANCE_COUNT, 0) AS BIGINT) AS ADJ_2_APPEARANCE_COUNT,
         CAST(coalesce(a3.APPEARANCE_COUNT, 0) AS BIGINT) AS ADJ_3_APPEARANCE_COUNT,
         CAST(coalesce(a4.APPEARANCE_COUNT, 0) AS BIGINT) AS ADJ_4_APPEARANCE_COUNT,
         CAST(coalesce(a1.APPEARANCE_COUNT, 0) + coalesce(a2.APPEARANCE_COUNT, 0)
            + coalesce(a3.APPEARANCE_COUNT, 0) + coalesce(a4.APPEARANCE_COUNT, 0) AS BIGINT) AS ADJ_APPEARANCE,
         CAST(c.APPEARANCE_COUNT + (coalesce(a1.APPEARANCE_COUNT, 0) + coalesce(a2.APPEARANCE_COUNT, 0)
            + coalesce(a3.APPEARANCE_COUNT, 0) + coalesce(a4.APPEARANCE_COUNT, 0)) / 2.0 AS DOUBLE) AS APPEARANCE_COUNT
  FROM counts c
  LEFT JOIN adj ON c.INDEX_1KM = adj.ADJ_INDEX_1KM
  LEFT JOIN counts a1 ON a1.INDEX_1KM = adj.ADJ_1 AND a1.SUBSCRIBER_ID = c.SUBSCRIBER_ID AND a1.HW_TIME_FILTER = c.HW_TIME_FILTER
  LEFT JOIN counts a2 ON a2.INDEX_1KM = adj.ADJ_2 AND a2.SUBSCRIBER_ID = c.SUBSCRIBER_ID AND a2.HW_TIME_FILTER = c.HW_TIME_FILTER
  LEFT JOIN counts a3 ON a3.INDEX_1KM = adj.ADJ_3 AND a3.SUBSCRIBER_ID = c.SUBSCRIBER_ID AND a3.HW_TIME_FILTER = c.HW_TIME_FILTER
  LEFT JOIN counts a4 ON a4.INDEX_1KM = adj.ADJ_4 AND a4.SUBSCRIBER_ID = c.SUBSCRIBER_ID AND a4.HW_TIME_FILTER = c.HW_TIME_FILTER
), spatial_top1 AS (
  SELECT HW_TIME_FILTER, SUBSCRIBER_ID, INDEX_1KM, APPEARANCE_COUNT AS MAX_APPEARANCE_COUNT
  FROM (SELECT *, row_number() OVER (PARTITION BY SUBSCRIBER_ID, HW_TIME_FILTER
                                     ORDER BY APPEARANCE_COUNT DESC, INDEX_1KM ASC NULLS LAST) AS rn
        FROM spatial WHERE SUBSCRIBER_ID IS NOT NULL) t
  WHERE rn = 1
), cells AS (
  SELECT CAST(n_nationkey % 5 AS VARCHAR) AS LONGITUDE,
         CAST(n_nationkey // 5 AS VARCHAR) AS LATITUDE,
         lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS DSD_CODE4,
         r_name AS PROVINCE_NAME,
         n_name AS DISTRICT_NAME,
         'DS_' || CAST(n_nationkey AS VARCHAR) AS DS_NAME,
         CAST(n_nationkey AS VARCHAR) AS LOCATION_ID,
         CAST(n_nationkey + 1 AS VARCHAR) AS BTS_AREA
  FROM nation JOIN region ON n_regionkey = r_regionkey
), hourly_counts AS (
  SELECT SUBSCRIBER_ID, HOUR_OF_DAY, INDEX_1KM, CAST(count(*) AS BIGINT) AS COUNT_IN_1KM_CELL
  FROM cdr WHERE YEAR = {P.HOURLY_YEAR} AND DATE_OF_YEAR = {P.HOURLY_DAY}
  GROUP BY SUBSCRIBER_ID, HOUR_OF_DAY, INDEX_1KM
), hourly_top AS (
  SELECT SUBSCRIBER_ID, INDEX_1KM, HOUR_OF_DAY
  FROM (SELECT *, row_number() OVER (PARTITION BY SUBSCRIBER_ID, HOUR_OF_DAY
                                     ORDER BY COUNT_IN_1KM_CELL DESC, INDEX_1KM ASC NULLS LAST) AS rn
        FROM hourly_counts WHERE SUBSCRIBER_ID IS NOT NULL) t
  WHERE rn = 1
), regional AS (
  SELECT c.SUBSCRIBER_ID, c.CALL_TIMESTAMP, c.INDEX_1KM, a.LONGITUDE, a.LATITUDE, a.DSD_CODE4,
         a.PROVINCE_NAME, a.DISTRICT_NAME, a.DS_NAME, a.LOCATION_ID, a.BTS_AREA
  FROM cdr c JOIN cells a ON a.LOCATION_ID = c.INDEX_1KM
  WHERE a.PROVINCE_NAME = '{P.PROVINCE}'
    AND c.CALL_TIMESTAMP BETWEEN TIMESTAMP '{P.PERIOD_START:%Y-%m-%d %H:%M:%S}'
                             AND TIMESTAMP '{P.PERIOD_END:%Y-%m-%d %H:%M:%S}'
), chosen AS (
  SELECT SUBSCRIBER_ID FROM (SELECT DISTINCT SUBSCRIBER_ID FROM regional WHERE SUBSCRIBER_ID IS NOT NULL) u
  ORDER BY md5('{P.SAMPLE_SEED}:' || SUBSCRIBER_ID), SUBSCRIBER_ID
  LIMIT {P.SAMPLE_USERS}
)
"""


def _home_work(loc: str) -> str:
    return f"""
SELECT coalesce(h.SUBSCRIBER_ID, w.SUBSCRIBER_ID) AS SUBSCRIBER_ID,
       h.INDEX_1KM AS HOME_INDEX_1KM, h.MAX_APPEARANCE_COUNT AS HOME_APPEARANCE_COUNT,
       w.INDEX_1KM AS WORK_INDEX_1KM, w.MAX_APPEARANCE_COUNT AS WORK_APPEARANCE_COUNT
FROM (SELECT * FROM {loc} WHERE HW_TIME_FILTER = 'HOME_HOUR') h
FULL OUTER JOIN (SELECT * FROM {loc} WHERE HW_TIME_FILTER = 'WORK_HOUR') w
  ON h.SUBSCRIBER_ID = w.SUBSCRIBER_ID"""


def _home_work_factored(loc: str) -> str:
    """The full-outer-join pair rows of ``_home_work``, then per subscriber
    the distinct cells of each side, sorted (null last, written as a mark) and
    joined by ','; a side absent from the pairs stays null."""
    def side(label: str) -> str:
        return f"""
  string_agg(coalesce(cell, '\\N'), ',' ORDER BY cell NULLS LAST) FILTER (WHERE side = '{label}')
    AS {label}_INDEX_1KM,
  max(cnt) FILTER (WHERE side = '{label}') AS {label}_APPEARANCE_COUNT"""
    return f"""
SELECT SUBSCRIBER_ID,{side("HOME")},{side("WORK")}
FROM (
  SELECT DISTINCT SUBSCRIBER_ID, 'HOME' AS side, HOME_INDEX_1KM AS cell, HOME_APPEARANCE_COUNT AS cnt
  FROM ({_home_work(loc)}) pairs WHERE HOME_APPEARANCE_COUNT IS NOT NULL
  UNION ALL
  SELECT DISTINCT SUBSCRIBER_ID, 'WORK', WORK_INDEX_1KM, WORK_APPEARANCE_COUNT
  FROM ({_home_work(loc)}) pairs WHERE WORK_APPEARANCE_COUNT IS NOT NULL) sides
GROUP BY SUBSCRIBER_ID"""


_RESIDENTS_TIES = """
  (SELECT HW_TIME_FILTER, INDEX_1KM AS LOCATION_ID, CAST(count(*) AS BIGINT) AS COUNT_IN_1KM_CELL
   FROM ties GROUP BY HW_TIME_FILTER, INDEX_1KM)"""



def _spatial_stages() -> str:
    """The stage tables by the four lookups: neighbours, then the counts in the
    first one to four of them, then those with 0 for null."""
    names = [f"ADJ_{i}_APPEARANCE_COUNT" for i in (1, 2, 3, 4)]
    lookups = "\n".join(
        f"  LEFT JOIN counts a{i} ON a{i}.INDEX_1KM = adj.ADJ_{i} AND a{i}.SUBSCRIBER_ID = c.SUBSCRIBER_ID"
        f" AND a{i}.HW_TIME_FILTER = c.HW_TIME_FILTER" for i in (1, 2, 3, 4))
    found = f"""
(SELECT c.*, adj.ADJ_1, adj.ADJ_2, adj.ADJ_3, adj.ADJ_4,
        {", ".join(f"a{i}.APPEARANCE_COUNT AS {n}" for i, n in enumerate(names, 1))}
 FROM counts c LEFT JOIN adj ON c.INDEX_1KM = adj.ADJ_INDEX_1KM
{lookups}) joined"""
    stages = {"appearanceJoinedAdjacentCell": ["CAST(NULL AS BIGINT)"] * 4}
    for upto in (1, 2, 3, 4):
        stages[f"adj_{upto}"] = names[:upto] + ["CAST(NULL AS BIGINT)"] * (4 - upto)
    stages["na_filled"] = [f"coalesce({n}, 0)" for n in names]
    return "\nUNION ALL\n".join(
        f"SELECT '{stage}' AS STAGE, HW_TIME_FILTER, SUBSCRIBER_ID, INDEX_1KM, APPEARANCE_COUNT, "
        f"ADJ_1, ADJ_2, ADJ_3, ADJ_4, {', '.join(f'{e} AS {n}' for e, n in zip(columns, names))} FROM {found}"
        for stage, columns in stages.items())


_BODIES = {
    "cdr_enriched": "SELECT * FROM cdr",
    "cdr_week_range": f"SELECT * FROM cdr WHERE WEEK_OF_YEAR BETWEEN {P.WEEKS[0]} AND {P.WEEKS[1]}",
    "hour_class": "SELECT SUBSCRIBER_ID, CALL_TIMESTAMP, INDEX_1KM, HOUR_OF_DAY, HW_TIME_FILTER FROM classed",
    "daily_presence": "SELECT * FROM presence",
    "appearance_counts": "SELECT * FROM counts",
    "top_locations_with_ties": "SELECT * FROM ties",
    "top_location": "SELECT * FROM top1",
    "residents_per_cell": """
SELECT HW_TIME_FILTER, INDEX_1KM AS LOCATION_ID, CAST(count(*) AS BIGINT) AS COUNT_IN_1KM_CELL
FROM top1 GROUP BY HW_TIME_FILTER, INDEX_1KM""",
    "home_work_joined": _home_work("top1"),
    "home_work_with_ties": _home_work_factored("ties"),
    "spatial_appearance": "SELECT * FROM spatial",
    "spatial_top_location": "SELECT * FROM spatial_top1",
    "spatial_home_work": _home_work("spatial_top1"),
    "hourly_cell_counts": "SELECT * FROM hourly_counts",
    "hourly_top_cell": "SELECT * FROM hourly_top",
    "hourly_trajectory": f"SELECT SUBSCRIBER_ID,\n  {_HOURS}\nFROM hourly_top GROUP BY SUBSCRIBER_ID",
    "residents_map": f"""
SELECT r.HW_TIME_FILTER, c.LOCATION_ID, c.LATITUDE, c.LONGITUDE, r.COUNT_IN_1KM_CELL
FROM {_RESIDENTS_TIES} r JOIN cells c ON r.LOCATION_ID = c.LOCATION_ID""",
    "regional_records": "SELECT * FROM regional",
    "user_sample": "SELECT * FROM regional WHERE SUBSCRIBER_ID IN (SELECT SUBSCRIBER_ID FROM chosen)",
    "oversized_ids": f"SELECT * FROM raw WHERE length(SUBSCRIBER_ID) > {P.OVERSIZE_LENGTH}",
    "csv_round_trip": "SELECT * FROM top1",
    "adjacency_source": "SELECT * FROM adj",
    "cdr_excluding_files": "SELECT * FROM cdr",
    "cells_source": "SELECT * FROM cells",
    "csv_single_file": """
SELECT HW_TIME_FILTER, INDEX_1KM AS LOCATION_ID, CAST(count(*) AS BIGINT) AS COUNT_IN_1KM_CELL,
       CAST(1 AS BIGINT) AS PART_FILES
FROM top1 GROUP BY HW_TIME_FILTER, INDEX_1KM""",
    "spatial_stages": _spatial_stages(),
    "csv_versioned": """
SELECT SUBSCRIBER_ID, INDEX_1KM, MAX_APPEARANCE_COUNT,
       CASE HW_TIME_FILTER WHEN 'HOME_HOUR' THEN 1 ELSE 2 END AS VERSION
FROM top1""",
    "unreadable_files": """
SELECT 'records_a' AS NAME, true AS READABLE, NULL AS ERROR_KIND, CAST(count(*) AS BIGINT) AS ROWS
FROM raw WHERE CALL_TIME < '20240116000000'
UNION ALL
SELECT 'records_b', true, NULL, CAST(count(*) AS BIGINT)
FROM raw WHERE CALL_TIME >= '20240116000000' OR CALL_TIME IS NULL
UNION ALL SELECT 'part-99999-corrupt.snappy.parquet', false, 'BAD_FOOTER', NULL
UNION ALL SELECT 'part-99998-empty.snappy.parquet', false, 'NO_BYTES', NULL
UNION ALL SELECT 'part-99997-rowless.snappy.parquet', true, NULL, 0
UNION ALL SELECT 'part-99996-extra+column %.snappy.parquet', false, 'BAD_DATA', NULL""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _PRELUDE + body for name, body in _BODIES.items()}
