"""Queries over the recorded flights and their files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxspan.operators.regrid import regular_grid
from fluxspan.operators.spikes import implausible_readings
from fluxspan.shared import table
from fluxspan.sources.rejects import FIELDS, accepted, load_records, rejected


def _implausible(spark, d):
    return implausible_readings(table(spark, d, "flight_rows"), table(spark, d, "flights"), table(spark, d, "aircraft"))


def p2_found(spark, d):
    return _implausible(spark, d).select("flight_id", "row_idx", "channel")


def p2_rates(spark, d):
    """Implausible readings per flight, channel and rule."""
    flags = [F.count_if(F.col(c)).alias(f"n_{c}") for c in ("out_of_limits", "stuck", "spike")]
    return _implausible(spark, d).groupBy("flight_id", "channel").agg(F.count("*").alias("n"), *flags)


def p4_found(spark, d):
    return regular_grid(table(spark, d, "flight_rows")).where("status = 'filled'").select("flight_id", "cell", "channel")


def p4_grid(spark, d):
    return regular_grid(table(spark, d, "flight_rows"))


def p5_found(spark, d):
    return rejected(load_records(table(spark, d, "raw_lines")))


def p5_loaded(spark, d):
    return accepted(load_records(table(spark, d, "raw_lines")))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p4_found, p4_grid, p5_found, p5_loaded)}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)"
_NUMERIC = r"'[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?'"


def _per_delimiter(template: str) -> str:
    return "CASE WHEN delim = ',' THEN " + template.replace("<d>", ",") + " ELSE " + template.replace("<d>", ";") + " END"


_FIELD = '"(?:[^"]|"")*"|[^"<d>]*'
_WELL = _per_delimiter(f"regexp_full_match(line, '(?:{_FIELD})(?:<d>(?:{_FIELD}))*')")
_PARTS = _per_delimiter(f"regexp_extract_all('<d>' || line, '<d>({_FIELD})', 1)")
_BARE = """regexp_replace(line, '"(?:[^"]|"")*"', '', 'g')"""


def _pick(column: str) -> str:
    raw = f"parts[list_position(names, '{column}')]"
    plain = f"""CASE WHEN {raw} LIKE '"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '""', '"') ELSE {raw} END"""
    return f"trim({plain}, {_BLANK})"


def _number(column: str) -> str:
    return f"CASE WHEN regexp_full_match(t_{column}, {_NUMERIC}) AND isfinite(TRY_CAST(t_{column} AS DOUBLE)) THEN TRY_CAST(t_{column} AS DOUBLE) END"


_PARSED = f"""
heads AS (SELECT file_id, ltrim(coalesce(arg_min(raw_line, line_id), ''), chr(65279)) AS head FROM raw_lines WHERE line_no = 0 GROUP BY file_id),
named AS (SELECT file_id, delim, list_transform(string_split(head, delim), lambda x: trim(x, ' "')) AS names
  FROM (SELECT *, CASE WHEN length(head) - length(replace(head, ';', '')) > length(head) - length(replace(head, ',', '')) THEN ';' ELSE ',' END AS delim FROM heads)),
lines AS (SELECT r.line_id, r.file_id, r.line_no, r.flight_id, coalesce(r.raw_line, '') AS line, n.delim, n.names FROM raw_lines r JOIN named n ON r.file_id = n.file_id WHERE r.line_no > 0),
cut AS (SELECT *, {_WELL} AS well, length({_BARE}) - length(replace({_BARE}, delim, '')) + 1 AS found, CASE WHEN {_WELL} THEN {_PARTS} END AS parts FROM lines),
texts AS (SELECT *, {", ".join(f"{_pick(c)} AS t_{c}" for c in FIELDS)} FROM cut),
numbers AS (SELECT *, {", ".join(f"{_number(c)} AS n_{c}" for c in FIELDS)} FROM texts),
judged AS (SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN found <> len(names) THEN 'column_count'
  WHEN n_time IS NULL OR n_B_total IS NULL OR n_B_total <= 0 OR (list_contains(names, 'pitch_rate') AND n_pitch_rate IS NULL) THEN 'bad_value' END AS reason FROM numbers)
"""
_NOTE = """CASE WHEN parts[list_position(names, 'note')] LIKE '"%' THEN replace(substr(parts[list_position(names, 'note')], 2, length(parts[list_position(names, 'note')]) - 2), '""', '"') ELSE parts[list_position(names, 'note')] END"""

SQL = {
    "p4_found": """WITH used AS (
  SELECT flight_id, time_s, 'b_total' AS channel FROM flight_rows WHERE flight_id IS NOT NULL AND time_s IS NOT NULL AND NOT isnan(time_s) AND b_total IS NOT NULL AND NOT isnan(b_total)
  UNION ALL SELECT flight_id, time_s, 'b_x' FROM flight_rows WHERE flight_id IS NOT NULL AND time_s IS NOT NULL AND NOT isnan(time_s) AND b_x IS NOT NULL AND NOT isnan(b_x)),
steps AS (SELECT flight_id, channel, time_s, lead(time_s) OVER (PARTITION BY flight_id, channel ORDER BY time_s) AS later FROM used),
gaps AS (SELECT flight_id, channel, CAST(floor(time_s) AS BIGINT) + 1 AS a, CAST(floor(later) AS BIGINT) - 1 AS z FROM steps WHERE later - time_s <= 900)
SELECT flight_id, unnest(range(a, z + 1)) AS cell, channel FROM gaps WHERE z >= a""",
    "p5_found": f"WITH {_PARSED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_loaded": f"WITH {_PARSED} SELECT line_id, file_id, line_no, flight_id, {', '.join(f'n_{c} AS {c}' for c in FIELDS)}, {_NOTE} AS note FROM judged WHERE reason IS NULL",
}
