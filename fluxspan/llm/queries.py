"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from fluxspan.llm import leakage, moderation, packing, quantiles, runs
from fluxspan.shared import table


def p1_found(spark, d):
    return runs.repeated_runs(runs.collapse_runs(table(spark, d, "segments")))


def p1_runs(spark, d):
    return runs.run_durations(runs.collapse_runs(table(spark, d, "segments")), table(spark, d, "flight_rows"))


def _rounded(df):
    """Percentiles to nine decimals, to compare with SQL; the operators don't round."""
    return df.withColumns({c: F.round(c, 9) for c in df.columns if re.fullmatch(r"p\d\d", c)})


def p3_percentiles(spark, d):
    return _rounded(quantiles.segment_percentiles(table(spark, d, "flight_rows"), table(spark, d, "segments")))


def p3_daily_percentiles(spark, d):
    daily = quantiles.daily_sketches(table(spark, d, "flight_rows"), table(spark, d, "segments"), table(spark, d, "flights"))
    named = daily.withColumn("flown_on", F.col("flown_on").cast("string"))
    return _rounded(quantiles.percentiles(named, ["flown_on", "maneuver", "heading"], (5, 50, 95)))


def p6_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "container_plans"))


def p6_fill(spark, d):
    return packing.container_fill(p6_containers(spark, d))


def p7_found(spark, d):
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark, d):
    """Leaked items with the number of documents that carry them."""
    found = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(found, "item_id")


def _scored(spark, d):
    return moderation.score_documents(table(spark, d, "documents"), moderation.train(table(spark, d, "moderation_samples")))


def p8_found(spark, d):
    return moderation.flagged(_scored(spark, d))


def p8_scores(spark, d):
    return _scored(spark, d)


def p8_source_rates(spark, d):
    return moderation.source_rates(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p3_daily_percentiles, p3_percentiles, p6_containers, p6_fill, p7_found, p7_items, p8_found, p8_scores, p8_source_rates)}


# -- SQL ------------------------------------------------------------------
_WORD = "regexp_replace(regexp_replace(lower(maneuver), 'maneuver|leg', '', 'g'), '[^a-z]', '', 'g')"
_MANEUVER = f"CASE WHEN {_WORD} IN ('steady', 'pitch', 'roll', 'yaw') THEN {_WORD} " + " ".join(f"WHEN damerau_levenshtein({_WORD}, '{m}') <= 1 THEN '{m}'" for m in ("steady", "pitch", "roll", "yaw")) + " END"
_TEXT = r"upper(regexp_replace(heading, '[\s\x{00A0}.()]+$|^[\s\x{00A0}.()]+', '', 'g'))"
_POINT = f"regexp_replace({_TEXT}, '(BOUND|ERN|WARDS?)$', '')"
_NUMBER = rf"regexp_extract({_TEXT}, '^([+-]?[0-9]+(?:\.[0-9]*)?)\s*(?:°|DEG(?:REES?)?\.?)?$', 1)"
_DEGREES = f"(((TRY_CAST({_NUMBER} AS DOUBLE) % 360) + 360) % 360)"
_HEADING = (
    "CASE " + " ".join(f"WHEN {_POINT} IN ('{a}', '{w}') THEN '{a}'" for a, w in (("N", "NORTH"), ("E", "EAST"), ("S", "SOUTH"), ("W", "WEST")))
    + f" WHEN {_DEGREES} <= 45 OR {_DEGREES} >= 315 THEN 'N' WHEN {_DEGREES} <= 135 THEN 'E' WHEN {_DEGREES} <= 225 THEN 'S' WHEN {_DEGREES} < 315 THEN 'W' END"
)
_USABLE = "flight_id IS NOT NULL AND start_idx IS NOT NULL AND end_idx IS NOT NULL AND end_idx > start_idx"
_RUNS = f"""
records AS (SELECT DISTINCT flight_id, maneuver, heading, start_idx, end_idx FROM segments WHERE {_USABLE}),
meant AS (SELECT flight_id, start_idx, end_idx, coalesce(maneuver, '') AS tm, coalesce(heading, '') AS th, {_MANEUVER} AS m, {_HEADING} AS h FROM records),
ranked AS (SELECT *, CASE WHEN m IS NOT NULL AND h IS NOT NULL THEN m || '_' || h END AS label,
  row_number() OVER (PARTITION BY flight_id ORDER BY start_idx, end_idx, m NULLS FIRST, h NULLS FIRST, tm, th) AS rn FROM meant),
marked AS (SELECT *, CASE WHEN label IS NOT NULL AND label = lag(label) OVER (PARTITION BY flight_id ORDER BY rn) THEN 0 ELSE 1 END AS fresh FROM ranked),
stretched AS (SELECT *, sum(fresh) OVER (PARTITION BY flight_id ORDER BY rn) AS stretch FROM marked),
reached AS (SELECT *, max(end_idx) OVER (PARTITION BY flight_id, stretch ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stretched),
numbered AS (SELECT *, sum(CASE WHEN fresh = 1 OR start_idx > reach + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY rn) AS run FROM reached),
runs AS (SELECT flight_id, m AS maneuver, h AS heading, min(start_idx) AS start_idx, max(end_idx) AS end_idx, count(*) AS n_records FROM numbered WHERE label IS NOT NULL GROUP BY flight_id, run, m, h)
"""
_LOG_G = math.log((1 + quantiles.ERROR) / (1 - quantiles.ERROR))
_G = (1 + quantiles.ERROR) / (1 - quantiles.ERROR)
_LABELLED = f"""
meant AS (SELECT flight_id, start_idx, end_idx, {_MANEUVER} AS maneuver, {_HEADING} AS heading FROM segments WHERE {_USABLE}),
once AS (SELECT DISTINCT flight_id, row_idx, delta_b FROM flight_rows WHERE flight_id IS NOT NULL AND row_idx IS NOT NULL),
covered AS (SELECT DISTINCT o.flight_id, o.row_idx, o.delta_b, s.maneuver, s.heading FROM once o JOIN meant s
  ON o.flight_id = s.flight_id AND o.row_idx >= s.start_idx AND o.row_idx < s.end_idx
  WHERE s.maneuver IS NOT NULL AND s.heading IS NOT NULL AND o.delta_b IS NOT NULL AND NOT isnan(o.delta_b) AND NOT isinf(o.delta_b))
"""


def _percentile_sql(keys: str, percents, source: str) -> str:
    value = f"CASE WHEN b = 0 THEN 0.0 ELSE sign(b) * {2 * _G / (_G + 1)!r} * pow({_G!r}, abs(b) - 100001) END"
    picks = ", ".join(f"min(CASE WHEN upto * 100 >= total * {p} THEN b END) AS b{p}" for p in percents)
    out = ", ".join("round(" + value.replace("(b)", f"(b{p})").replace("b = 0", f"b{p} = 0") + f", 9) AS p{p:02d}" for p in percents)
    return f"""WITH {_LABELLED}, bucketed AS (
  SELECT {keys}, CASE WHEN delta_b > 0 THEN 100000 + CAST(ceil(ln(abs(delta_b)) / {_LOG_G!r}) AS INT) WHEN delta_b < 0 THEN -100000 - CAST(ceil(ln(abs(delta_b)) / {_LOG_G!r}) AS INT) ELSE 0 END AS b, count(*) AS n
  FROM {source} GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM bucketed),
picked AS (SELECT {keys}, CAST(max(total) AS BIGINT) AS n, {picks} FROM ranked GROUP BY {keys})
SELECT {keys}, n, {out} FROM picked"""


SQL = {
    "p1_found": f"WITH {_RUNS} SELECT flight_id, start_idx AS run_start_idx, end_idx AS run_end_idx FROM runs WHERE n_records > 1",
    "p1_runs": f"""WITH {_RUNS} SELECT r.flight_id, r.maneuver, r.heading, r.start_idx, r.end_idx, r.n_records, r.end_idx - r.start_idx AS n_rows, round(max(f.time_s) - min(f.time_s), 6) AS seconds
FROM runs r LEFT JOIN (SELECT flight_id, row_idx, time_s FROM flight_rows WHERE time_s IS NOT NULL AND NOT isnan(time_s)) f ON f.flight_id = r.flight_id AND f.row_idx >= r.start_idx AND f.row_idx < r.end_idx
GROUP BY ALL""",
    "p3_percentiles": _percentile_sql("maneuver, heading", quantiles.PERCENTS, "covered"),
    "p3_daily_percentiles": _percentile_sql("flown_on, maneuver, heading", (5, 50, 95), "(SELECT c.*, CAST(f.flown_on AS VARCHAR) AS flown_on FROM covered c LEFT JOIN (SELECT DISTINCT flight_id, flown_on FROM flights) f ON c.flight_id = f.flight_id)"),
}
