import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fluxspan.sources import rejects
from fluxspan.sources.rejects import decimals, accepted, load_records, parse_records, read_header, rejected

HEADER = "time,B_total,note"


def judge(line, header=HEADER):
    """The rule, character by character."""
    names, d = read_header(header)
    fields, i, line = [], 0, line or ""
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return "quoting"
                if line[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            if j + 1 < len(line) and line[j + 1] != d:
                return "quoting"
            fields.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
        else:
            j = line.find(d, i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
            i = j
        if i >= len(line):
            break
        i += 1
    if len(fields) != len(names):
        return "column_count"
    for c in ("time", "B_total", "pitch_rate"):
        if c in names:
            text = fields[names.index(c)].strip()
            if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text, re.A) or not np.isfinite(float(text)):
                return "bad_value"
            if c == "B_total" and float(text) <= 0:
                return "bad_value"
    return None


def parse(lines, header=HEADER):
    n = len(lines)
    return parse_records(pd.DataFrame({"line_id": range(n), "file_id": 1, "line_no": range(1, n + 1), "flight_id": 1, "raw_line": lines, "header": header}))


CASES = ['1,2,x', '1,2,"a,b"', '1,2,"a\nb"', '1,2,"say ""hi"""', '"1","2","x"', '1,2,"open', '1,2,"x"y', '1,2,a"b', '1,2', '1,2,3,4', '', 'x,2,', '1,0,', '1,-5,', '1,1e999,', ' 1 , 2.5 ,', '1,.5,', '1,5.,', '1,.,', '1,+3e-2,', '"",2,', '""x,2,', '1,2,""', '1,2,"""', '1,2,""""', 'NaN,2,', '1,inf,', '１,2,', '1,2, "x"']


def test_cases():
    out = parse(CASES)
    assert [None if r is None else r for r in out["reason"]] == [judge(c) for c in CASES]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text(alphabet='12.e,;" a\nü', max_size=14), min_size=1, max_size=12), st.sampled_from([HEADER, "time;B_total;note", '"B_total","time"', "﻿time,B_total,pitch_rate"]))
def test_any_text(lines, header):
    assert list(parse(lines, header)["reason"]) == [judge(x, header) for x in lines]


def test_values_and_headers():
    row = parse(['"2.5","1e3","say ""hi"""'], '﻿"B_total","time","note"').iloc[0]
    assert (row["time"], row["B_total"], row["note"]) == (1000.0, 2.5, 'say "hi"')
    assert np.isnan(row["pitch_rate"])
    assert read_header("a;b;c,d") == (["a", "b", "c,d"], ";")


def test_loading(spark):
    rows = [(1, 1, 0, 5, HEADER), (9, 1, 0, 5, "other"), (2, 1, 1, 5, "1,2,ok"), (3, 1, 2, 5, None), (4, 1, 3, 5, '1,2,"x'), (5, 2, 1, 5, "1,2,3"), (6, 1, None, 5, "1,2,3"), (7, 1, 4, None, "3,-1,x" + "y" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "line_id bigint, file_id bigint, line_no int, flight_id bigint, raw_line string, reason string")
    loaded = load_records(df)
    assert {(r.line_id, r.reason) for r in rejected(loaded).collect()} == {(3, "column_count"), (4, "quoting"), (5, "column_count"), (7, "bad_value")}
    assert [(r.line_id, r.time, r.B_total, r.note, r.lat) for r in accepted(loaded).collect()] == [(2, 1.0, 2.0, "ok", None)]
    assert load_records(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 5000])
def test_hot_file(spark, n):
    df = spark.range(n).selectExpr("id + 1 as line_id", "1L as file_id", "cast(id as int) as line_no", "1L as flight_id", f"case when id = 0 then '{HEADER}' else '1,2,x' end as raw_line")
    assert accepted(load_records(df)).count() == n - 1


def test_decimals():
    texts = pa.array(["+1.5", "1e400", " 5. ", ".5", "-.25E+2", "x", "", "1,5", "0x10", "inf", "1_0", "+", "\n7\t", None])
    got = decimals(texts)
    assert got[[0, 2, 3, 4, 12]].tolist() == [1.5, 5.0, 0.5, -25.0, 7.0] and np.isnan(got).sum() == 9


def test_long_files_meet_their_header_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rejects, "LINES", 3)
    rows = [(0, 1, 0, "time,B_total")] + [(i, 1, i, f"{i},50000.5") for i in range(1, 11)] + [(99, 2, 4, "1,2")]
    df = spark.createDataFrame([(a, b, c, 7, d, "clash") for a, b, c, d in rows], "line_id bigint, file_id bigint, line_no int, flight_id bigint, raw_line string, chunk string")
    out = {r.line_id: (r.time, r.reason) for r in rejects.load_records(df).collect()}
    assert out == {**{i: (float(i), None) for i in range(1, 11)}, 99: (None, "column_count")}
