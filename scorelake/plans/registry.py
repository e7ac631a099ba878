"""A small registry: query name -> (Spark callable, optional DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOTES_SQL = """
base AS (
  SELECT CAST(FLOOR(user_id / 15) AS INT) AS piece_id,
         CAST(user_id % 4 AS INT) AS part_idx,
         CAST(1 + event_id % 2 AS VARCHAR) AS voice,
         CAST(day(ts) - 1 AS INT) AS measure_idx,
         CAST(FLOOR((hour(ts) * 60 + minute(ts)) / 90) * 0.25 AS DOUBLE) AS offset_ql,
         event_type = 'error' AS is_rest,
         CAST(CASE event_type WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.5
              WHEN 'signup' THEN 1.0 WHEN 'purchase' THEN 2.0 ELSE 0.5 END AS DOUBLE) AS dur_ql,
         CAST(36 + CAST(ROUND(value * 100) AS BIGINT) % 49 AS INT) AS ps_all,
         CASE event_id % 13 WHEN 0 THEN 'start' WHEN 2 THEN 'stop' END AS tie_all,
         event_id
  FROM events),
notes AS (
  SELECT piece_id, part_idx, voice, measure_idx,
         ROW_NUMBER() OVER (PARTITION BY piece_id
           ORDER BY part_idx, measure_idx, voice, offset_ql, event_id) - 1 AS note_idx,
         CAST(measure_idx * 4 AS DOUBLE) AS measure_onset_ql, offset_ql,
         measure_idx * 4 + offset_ql AS onset_ql, dur_ql,
         CAST((measure_idx * 4 + offset_ql) * 1024 AS BIGINT) AS onset_tick,
         CAST(dur_ql * 1024 AS BIGINT) AS dur_tick, is_rest,
         CASE WHEN NOT is_rest THEN ps_all END AS ps,
         CASE WHEN NOT is_rest THEN ps_all % 12 END AS pc,
         CASE WHEN NOT is_rest THEN CAST(FLOOR(ps_all / 12) AS INT) - 1 END AS octave,
         CASE WHEN NOT is_rest THEN
           CASE ps_all % 12 WHEN 0 THEN 'C' WHEN 1 THEN 'C#' WHEN 2 THEN 'D' WHEN 3 THEN 'D#'
             WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN 'F#' WHEN 7 THEN 'G' WHEN 8 THEN 'G#'
             WHEN 9 THEN 'A' WHEN 10 THEN 'A#' ELSE 'B' END END AS name,
         CASE WHEN NOT is_rest THEN tie_all END AS tie, event_id
  FROM base),
heard AS (SELECT * FROM notes WHERE NOT is_rest)"""

OUT_SQL = """
kept AS (
  SELECT *, ps + CASE WHEN event_id % 5 = 0 THEN 12 ELSE 0 END AS ps2,
         CASE WHEN event_id % 7 = 0 THEN dur_ql * 2 ELSE dur_ql END AS dur2
  FROM notes WHERE NOT is_rest AND event_id % 3 <> 0),
out_notes AS (
  SELECT piece_id, CASE WHEN ps2 >= 60 THEN 1 ELSE 2 END AS staff, measure_idx, offset_ql, onset_ql,
         onset_tick, dur2 AS dur_ql, CAST(dur2 * 1024 AS BIGINT) AS dur_tick,
         ps2 AS ps, ps2 % 12 AS pc, CAST(FLOOR(ps2 / 12) AS INT) - 1 AS octave, name, tie, event_id AS out_id
  FROM kept)"""

MOTIF_SQL = """
motif_notes AS (
  SELECT * REPLACE (CASE ps % 4 WHEN 0 THEN 62 WHEN 1 THEN 67 ELSE 60 END AS ps,
                    CASE ps % 4 WHEN 0 THEN 2 WHEN 1 THEN 7 ELSE 0 END AS pc,
                    4 AS octave,
                    CASE ps % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'G' ELSE 'C' END AS name,
                    CASE WHEN dur_ql = 2.0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS dur_ql,
                    CASE WHEN dur_ql = 2.0 THEN 1024 ELSE 256 END::BIGINT AS dur_tick)
  FROM heard)"""


def with_sql(*parts: str) -> str:
    """``WITH`` clause from CTE blocks; the last part is the body."""
    *ctes, body = parts
    return "WITH " + ",\n".join([NOTES_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


def rounded(c: Column | str, places: int = 6) -> Column:
    """Fixed decimals for values compared with the SQL twin; adding 0.0 turns a
    negative zero into a plain one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)


def joined(c: Column | str, sep: str = ",") -> Column:
    """An array as one string, so both engines hash it alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
