"""Loading delimited records with rejects, by structural indexing.

A batch of records is laid out in one byte buffer.  Quote bytes are marked, the
running parity of quotes within each record tells which bytes stand inside a
quoted field, and from it follow the true delimiters and the record ends.
Malformed quoting, wrong field counts and invalid values become reasons; all
other records become typed rows.  The structure of a whole batch is found with
a handful of numpy passes, and each column's fields are cut out of the buffer,
tested and converted as one array; no record is scanned by a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, NEWLINE, COMMA, SEMICOLON = 0x22, 0x0A, 0x2C, 0x3B
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# fixed values: the spelling of the recording columns in the files
FIELDS = ("time", "lat", "lon", "alt", "B_total", "B_x", "B_y", "B_z", "heading", "pitch", "roll", "roll_rate", "pitch_rate", "yaw_rate")
CHECKED = ("time", "B_total", "pitch_rate")
LINES = 50_000  # records of a file that meet their header in one place
BLANKS = " \t\r\n\x0b\x0c ﻿"

OUTPUT = "line_id bigint, file_id bigint, line_no int, flight_id bigint, " + ", ".join(f"{c} double" for c in FIELDS) + ", note string, reason string"


def structure(lines: list[bytes], delimiters: np.ndarray):
    """Buffer, record starts, quoting faults and true delimiter positions.

    ``delimiters`` holds one byte value per record.  Returns (buffer, starts,
    ends, faulty, cuts, cut_record): the bytes of record i are
    ``buffer[starts[i]:ends[i]]``; ``cuts`` are the positions of delimiters
    outside quotes, in order, and ``cut_record`` the records they belong to.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    buffer = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    ends = starts + sizes
    record = np.repeat(np.arange(len(lines)), sizes + 1)
    quote = buffer == QUOTE
    quote[ends] = False
    seen = np.cumsum(quote)
    before = seen - quote  # quotes ahead of a byte, in the whole buffer
    parity = (before - before[starts][record]) & 1
    separator = buffer == delimiters[record]
    separator[ends] = True
    cut = separator & (parity == 0)
    at = np.flatnonzero(quote)
    opening = at[parity[at] == 0]
    closing = at[parity[at] == 1]
    closes = np.zeros(len(buffer) + 1, bool)
    closes[closing] = True
    first = np.zeros(len(buffer), bool)
    first[starts[sizes > 0]] = True
    previous = np.maximum(opening - 1, 0)
    starts_field = first[opening] | cut[previous] | closes[previous]
    follows = _closes_field(cut, quote, closing, ends, record)
    faulty = np.zeros(len(lines), bool)
    faulty[record[opening[~starts_field]]] = True
    faulty[record[closing[~follows]]] = True
    faulty |= parity[ends] == 1
    inner = cut.copy()
    inner[ends] = False
    cuts = np.flatnonzero(inner)
    return buffer, starts, ends, faulty, cuts, record[cuts]


def _closes_field(cut, quote, closing, ends, record) -> np.ndarray:
    """Whether each closing quote is followed by a delimiter, the record's end
    or another quote.  The byte after it has even parity, so ``cut`` holds."""
    nxt = closing + 1
    return cut[nxt] | quote[nxt] | (nxt == ends[record[closing]])


def read_header(line: str | None) -> tuple[list[str], str]:
    """Column names and delimiter of a header record; it may be quoted or start
    with a byte-order mark.  Of comma and semicolon the more frequent wins."""
    text = (line or "").lstrip("﻿")
    delimiter = ";" if text.count(";") > text.count(",") else ","
    names = [n.strip(BLANKS) for n in text.split(delimiter)]
    return [n[1:-1].replace('""', '"') if len(n) > 1 and n[0] == n[-1] == '"' else n for n in names], delimiter


def cut_out(buffer: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Texts of the byte ranges a..b, unquoted where they begin with a quote."""
    ends = np.r_[0, np.cumsum(b - a)]
    data = buffer[np.repeat(a - ends[:-1], b - a) + np.arange(ends[-1])]
    texts = pa.Array.from_buffers(pa.string(), len(a), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    quoted = pc.starts_with(texts, '"')
    if not pc.any(quoted).as_py():
        return texts
    return pc.if_else(quoted, pc.replace_substring(pc.utf8_slice_codeunits(texts, 1, -1), '""', '"'), texts)


def decimals(texts: pa.Array) -> np.ndarray:
    """Values of decimal numbers; NaN for any other text and for values that
    overflow."""
    texts = pc.utf8_trim(texts, BLANKS)
    valid = pc.match_substring_regex(texts, DECIMAL)
    plain = pc.if_else(valid, pc.replace_substring_regex(texts, r"^\+", ""), None)
    try:
        numbers = pc.cast(plain, pa.float64())
    except pa.ArrowInvalid:  # a value beyond the range of double
        numbers = pa.array([None if t is None else float(t) for t in plain.to_pylist()], pa.float64())
    numbers = numbers.to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isfinite(numbers), numbers, np.nan)


def parse_records(pdf: pd.DataFrame) -> pd.DataFrame:
    """Typed rows and reasons for one batch with columns line_id, file_id,
    line_no, flight_id, raw_line, header."""
    n = len(pdf)
    raw = [b"" if x is None or x is pd.NA else x.encode("utf-8", "replace") for x in pdf["raw_line"]]
    header_code, header_texts = pd.factorize(pdf["header"], use_na_sentinel=False)
    headers = [read_header(h if isinstance(h, str) else None) for h in header_texts]
    delimiters = np.array([COMMA if d == "," else SEMICOLON for _, d in headers], np.uint8)[header_code]
    expected = np.array([len(names) for names, _ in headers])[header_code]
    buffer, starts, ends, faulty, cuts, cut_record = structure(raw, delimiters)
    found = np.bincount(cut_record, minlength=n) + 1
    reason = np.full(n, None, object)
    reason[found != expected] = "column_count"
    reason[faulty] = "quoting"
    first_cut = np.searchsorted(cut_record, np.arange(n))
    good = np.equal(reason, None)

    out = {c: pdf[c].to_numpy() for c in ("line_id", "file_id", "line_no", "flight_id")}
    place = {c: np.array([names.index(c) if c in names else -1 for names, _ in headers])[header_code] for c in (*FIELDS, "note")}

    def text_of(column: str, which: np.ndarray) -> pa.Array:
        k = place[column][which]
        base = first_cut[which] + k
        a = np.where(k == 0, starts[which], cuts[np.maximum(base - 1, 0)] + 1 if len(cuts) else 0)
        b = np.where(k == expected[which] - 1, ends[which], cuts[np.minimum(base, max(len(cuts) - 1, 0))] if len(cuts) else 0)
        return cut_out(buffer, a, b)

    bad = np.zeros(n, bool)
    for column in FIELDS:
        values = np.full(n, np.nan)
        which = np.flatnonzero(good & (place[column] >= 0))
        if len(which):
            numbers = decimals(text_of(column, which))
            finite = ~np.isnan(numbers)
            values[which[finite]] = numbers[finite]
            if column in CHECKED:
                bad[which[~finite]] = True
            if column == "B_total":
                bad[which[finite & (numbers <= 0)]] = True
        if column in ("time", "B_total"):
            bad |= good & (place[column] < 0)
        out[column] = values
    reason[good & bad] = "bad_value"
    note = np.full(n, None, object)
    which = np.flatnonzero(good & (place["note"] >= 0))
    if len(which):
        note[which] = text_of("note", which).to_pylist()
    out["note"], out["reason"] = note, reason
    return pd.DataFrame(out)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("line_id", pa.int64()), ("file_id", pa.int64()), ("line_no", pa.int32()), ("flight_id", pa.int64())] + [(c, pa.float64()) for c in FIELDS] + [("note", pa.string()), ("reason", pa.string())]
    )
    for batch in batches:
        if batch.num_rows:
            ids = batch.select(["line_id", "file_id", "line_no", "flight_id"])
            parsed = parse_records(batch.select(["raw_line", "header"]).to_pandas().assign(line_id=0, file_id=0, line_no=0, flight_id=0))
            columns = [ids.column(i).cast(schema.field(i).type) for i in range(4)]
            columns += [pa.array(parsed[c].to_numpy(), pa.float64(), from_pandas=True) for c in FIELDS]
            columns += [pa.array(parsed[c].tolist(), pa.string()) for c in ("note", "reason")]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def load_records(raw_lines: DataFrame) -> DataFrame:
    """All records with line_no > 0: typed columns, and ``reason`` for the
    rejects (``quoting``, ``column_count``, ``bad_value``; the first that
    applies), null for valid rows.

    The header of each file reaches its records by a join on (file_id, chunk of
    line numbers); it is listed once per ``LINES`` lines the file has, so a file
    that holds a large share of all records is spread over as many tasks as it
    needs.  Defined results: a null ``raw_line`` counts as an empty record; of
    several header deliveries the one with the smallest line_id holds; records of
    a file without header have column count 1 to match and no checked columns, so
    they are rejected; a column other than the checked ones that is no number
    becomes null; rows with null line_no are left out; empty input gives no rows.
    """
    chunk = lambda n: F.floor(n / F.lit(LINES))
    headers = raw_lines.where("line_no = 0").groupBy("file_id").agg(F.min_by("raw_line", "line_id").alias("header"))
    lengths = raw_lines.where("line_no > 0").groupBy("file_id").agg(F.max("line_no").alias("lines"))
    listed = headers.join(lengths, "file_id").select("file_id", "header", F.explode(F.sequence(F.lit(0).cast("bigint"), chunk(F.col("lines")))).alias("chunk"))
    records = raw_lines.where("line_no > 0").select("line_id", "file_id", "line_no", "flight_id", "raw_line", chunk(F.col("line_no")).alias("chunk"))
    joined = records.join(listed, ["file_id", "chunk"], "left").select("line_id", "file_id", "line_no", "flight_id", "raw_line", "header")
    return joined.mapInArrow(_parse_batches, OUTPUT)


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason is null").drop("reason")


def rejected(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason is not null").select("line_id", "reason")
