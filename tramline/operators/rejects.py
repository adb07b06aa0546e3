"""Rows that fail to parse: valid lines as typed rows, the others with the reason.

Blocks of lines are parsed at once by Arrow's CSV reader. A block whose records and lines
do not come out even, because a quote swallowed what follows it, is bisected, down to
single records if need be. All stretches that did come out even are checked as whole
columns; a column's mask cuts out the records that fail it, so that good records never
leave the columnar path. Only isolated records go through the strict reader, which names
the field and the reason.

Defined cases: a null line, an unknown or null feed and an empty line are rejects; a
null line_id stays null; repeated lines are each judged; very long lines are read whole;
an empty table gives no rows; columns that the operator doesn't use are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t"


@dataclass(frozen=True)
class Contract:
    """The fields of a feed in order, and the check of each that has one."""

    feed: str
    fields: tuple[str, ...]
    checks: dict[str, str] = field(default_factory=dict)


LEGS = Contract(
    "legs",
    ("service_date", "card_id", "transfer_id", "ride_dtm", "alight_dtm", "serial_num", "mode_code", "transfer_count", "route_id", "origin_stop_id", "destination_stop_id", "passengers", "source_label"),
    {"service_date": "date", "card_id": "filled", "transfer_id": "filled", "ride_dtm": "time", "origin_stop_id": "stop", "destination_stop_id": "stop", "passengers": "positive"},
)
DAILY_OD = Contract(
    "daily_od",
    ("date", "hour", "origin_stop_id", "destination_stop_id", "passengers"),
    {"date": "date", "hour": "hour", "origin_stop_id": "stop", "destination_stop_id": "stop", "passengers": "positive"},
)
CONTRACTS = (LEGS, DAILY_OD)
NUMBERS = {"positive": ("double", pa.float64()), "hour": ("int", pa.int32())}
#: RE2 and re read these alike.
SHAPES = {"date": r"[0-9]{8}", "stop": r"[0-9]{9}(?:\.0)?", "positive": r"[0-9]+(?:\.[0-9]+)?", "hour": r"[0-9]{1,2}"}
REASONS = {"date": "not a real date", "filled": "empty", "time": "unreadable time", "stop": "not a nine-digit stop id", "positive": "not a number above 0", "hour": "not an hour 0-23"}


def _days(ymd: pa.Array) -> np.ndarray:
    """True where eight digits form a real date."""
    v = ymd.cast(pa.int64()).to_numpy(zero_copy_only=False)
    y, m, d = v // 10000, v // 100 % 100, v % 100
    last = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))
    return (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= last)


def _flags(mask) -> np.ndarray:
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)


def _digits_of_time(col: pa.Array) -> pa.Array:
    t = pc.replace_substring_regex(pc.replace_substring_regex(col, r"\.0\z", ""), "[^0-9]", "")
    n = pc.utf8_length(t)
    return pc.if_else(pc.equal(n, 12), pc.binary_join_element_wise(t, "00", ""), pc.if_else(pc.equal(n, 10), pc.binary_join_element_wise(t, "0000", ""), t))


def bulk(lines: pa.Array, contract: Contract) -> tuple[pa.Table, list[int]] | None:
    """(rows, places of lines with another number of fields) if every line is a record of its own, else None.

    lines hold no line breaks, so a quote can only make records fewer than lines.
    """
    uneven: list[int] = []

    def skip(row) -> str:
        uneven.append(row.number - 1)
        return "skip"

    read = pacsv.read_csv(
        BytesIO(("\n".join(lines.to_pylist()) + "\n").encode()),
        pacsv.ReadOptions(column_names=contract.fields, use_threads=False, block_size=max(1 << 20, lines.nbytes * 2)),
        pacsv.ParseOptions(ignore_empty_lines=False, invalid_row_handler=skip),
        pacsv.ConvertOptions(column_types={f: pa.string() for f in contract.fields}, strings_can_be_null=False),
    )
    return (read, uneven) if read.num_rows + len(uneven) == len(lines) else None


def bisect(lines: pa.Array, contract: Contract, start: int = 0) -> Iterator[tuple[int, int, pa.Table | None, list[int]]]:
    """(first line, lines, rows, places of uneven lines) of stretches that came out even; rows is None for a record that never does."""
    got = bulk(lines, contract)
    if got is not None:
        yield start, len(lines), *got
    elif len(lines) == 1:
        yield start, 1, None, [0]
    else:
        half = len(lines) // 2
        yield from bisect(lines.slice(0, half), contract, start)
        yield from bisect(lines.slice(half), contract, start + half)


def _quotes_ok(lines: pa.Array) -> np.ndarray:
    """True where nothing but wholly enclosed fields has quotes: without those no quote is left."""
    quoted = _flags(pc.match_substring(lines, '"'))
    ok = np.ones(len(lines), bool)
    if quoted.any():
        apart = pc.binary_join_element_wise("", pc.replace_substring(lines.filter(pa.array(quoted)), ",", ",,"), "", ",")
        ok[quoted] = ~_flags(pc.match_substring(pc.replace_substring_regex(apart, ',"(?:[^"]|"")*",', ","), '"'))
    return ok


def _checked(col: pa.Array, check: str | None) -> tuple[pa.Array, np.ndarray | None]:
    """(typed column, mask of the values that pass); values that don't are replaced by some that can be typed."""
    if check is None:
        return col, None
    if check == "filled":
        return col, _flags(pc.not_equal(col, ""))
    if check == "time":
        t = _digits_of_time(col)
        ok = _flags(pc.equal(pc.utf8_length(t), 14))
        t = pc.if_else(pa.array(ok), t, "00010101000000")
        clock = pc.utf8_slice_codeunits(t, 8, 14).cast(pa.int64()).to_numpy(zero_copy_only=False)
        return col, ok & _days(pc.utf8_slice_codeunits(t, 0, 8)) & (clock // 10000 < 24) & (clock // 100 % 100 < 60) & (clock % 100 < 60)
    ok = _flags(pc.match_substring_regex(col, rf"\A(?:{SHAPES[check]})\z"))
    if check == "date":
        return col, ok & _days(pc.if_else(pa.array(ok), col, "00010101"))
    if check in NUMBERS:
        typed = pc.if_else(pa.array(ok), col, "0").cast(NUMBERS[check][1])
        return typed, ok & _flags(pc.greater(typed, 0.0) if check == "positive" else pc.less(typed, 24))
    return col, ok


def parse_block(lines: pa.Array, contract: Contract) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """(places of the valid lines, their typed columns, places of the isolated records for the strict reader)."""
    lines = pc.replace_substring_regex(lines, r"\r\z", "")
    # Null and empty lines, and those with a break inside, are no records that stand in one line.
    apart = _flags(pc.or_kleene(pc.equal(pc.fill_null(lines, ""), ""), pc.match_substring_regex(pc.fill_null(lines, ""), "[\r\n\\x00]")))
    at = np.flatnonzero(~apart)
    whole = lines.take(pa.array(at))
    places, tables, isolated = [], [], [np.flatnonzero(apart)]
    for start, n, rows, uneven in bisect(whole, contract) if len(whole) else ():
        here = np.arange(start, start + n)
        isolated.append(at[here[uneven]])
        if rows is not None:
            places.append(np.delete(here, uneven))
            tables.append(rows)
    if not tables:
        return np.array([], int), [pa.array([], _types((contract,))[f][1]) for f in contract.fields], np.sort(np.concatenate(isolated))
    places, rows = np.concatenate(places), pa.concat_tables(tables).combine_chunks()
    ok, cols = _quotes_ok(whole)[places], []
    for name in contract.fields:
        col = rows[name].combine_chunks()
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        col, mask = _checked(pc.utf8_trim(col, BLANKS), contract.checks.get(name))
        ok = ok if mask is None else ok & mask
        cols.append(col)
    kept = pa.array(ok)
    return at[places[ok]], [c.filter(kept) for c in cols], np.sort(np.concatenate([*isolated, at[places[~ok]]]))


def _split(line: str) -> list[str]:
    """Fields of one line; ValueError names the broken rule."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    raise ValueError("quote not closed")
                if line[j + 1 : j + 2] != '"':
                    break
                j += 2
            fields.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
            if i < n and line[i] != ",":
                raise ValueError("text after a closing quote")
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                raise ValueError("quote inside an open field")
            fields.append(line[i:j])
            i = j
        if i >= n:
            return fields
        i += 1


def _real_day(s: str) -> bool:
    try:
        date(int(s[:4]), int(s[4:6]), int(s[6:]))
    except ValueError:
        return False
    return True


def _valid(check: str, v: str) -> bool:
    if check == "time":
        t = re.sub("[^0-9]", "", v[:-2] if v.endswith(".0") else v)
        t += {12: "00", 10: "0000"}.get(len(t), "")
        return len(t) == 14 and _real_day(t[:8]) and t[8:10] < "24" and t[10:12] < "60" and t[12:] < "60"
    if check == "filled":
        return v != ""
    if not re.fullmatch(SHAPES[check], v):
        return False
    return {"date": lambda: _real_day(v), "positive": lambda: float(v) > 0, "hour": lambda: int(v) < 24}.get(check, lambda: True)()


def diagnose(line: str | None, contract: Contract | None) -> tuple[str | None, str | None, list | None]:
    """(reason, field, None) of a bad line, or (None, None, typed values) of a good one."""
    if contract is None:
        return "unknown feed", "feed", None
    if line is None:
        return "no line", None, None
    try:
        values = _split(line.removesuffix("\r"))
    except ValueError as e:
        return str(e), None, None
    if len(values) != len(contract.fields):
        return ("too few fields" if len(values) < len(contract.fields) else "too many fields"), None, None
    out: list = []
    for name, raw in zip(contract.fields, values, strict=True):
        v, check = raw.strip(BLANKS), contract.checks.get(name)
        if check and not _valid(check, v):
            return ("empty" if v == "" else REASONS[check]), name, None
        out.append(float(v) if check == "positive" else int(v) if check == "hour" else v)
    return None, None, out


def _types(contracts: tuple[Contract, ...]) -> dict[str, tuple[str, pa.DataType]]:
    return {f: NUMBERS.get(c.checks.get(f, ""), ("string", pa.string())) for c in contracts for f in c.fields}


def parse_lines(raw: DataFrame, contracts: tuple[Contract, ...] = CONTRACTS, block: int = 2048) -> DataFrame:
    """Every line once: line_id, feed, file_name, line_no, reason, field, then the typed fields of all contracts.

    reason is null for valid lines; the typed fields are null for rejects and for fields of other feeds.
    """
    kinds, by_feed = _types(contracts), {c.feed: c for c in contracts}
    keys = ["line_id", "feed", "file_name", "line_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feeds = batch.column("feed")
            for feed in pc.unique(feeds).to_pylist():
                mask = pc.is_null(feeds) if feed is None else pc.fill_null(pc.equal(feeds, feed), False)
                part = batch.filter(mask)
                contract = by_feed.get(feed)
                for at in range(0, part.num_rows, block):
                    yield from typed(part.slice(at, block), contract)

    def typed(part: pa.RecordBatch, contract: Contract | None) -> Iterator[pa.RecordBatch]:
        lines = part.column("raw_text")
        good, cols, isolated = parse_block(lines, contract) if contract else ((), [], range(part.num_rows))
        if len(good):
            yield build(part.take(pa.array(good)), dict(zip(contract.fields, cols, strict=True)), None, None)
        if len(isolated):
            said = [diagnose(lines[int(i)].as_py(), contract) for i in isolated]
            values = {f: [x[2][i] if x[2] else None for x in said] for i, f in enumerate(contract.fields)} if contract else {}
            yield build(part.take(pa.array(isolated, pa.int64())), {f: pa.array(v, kinds[f][1]) for f, v in values.items()}, [x[0] for x in said], [x[1] for x in said])

    def build(rows: pa.RecordBatch, cols: dict[str, pa.Array], reason, where) -> pa.RecordBatch:
        n = rows.num_rows
        given = [rows.column(k) for k in keys] + [pa.array(reason or [None] * n, pa.string()), pa.array(where or [None] * n, pa.string())]
        given += [cols[f] if f in cols else pa.nulls(n, t) for f, (_, t) in kinds.items()]
        return pa.RecordBatch.from_arrays(given, [*keys, "reason", "field", *kinds])

    schema = "line_id long, feed string, file_name string, line_no int, reason string, field string, " + ", ".join(f"`{f}` {t}" for f, (t, _) in kinds.items())
    typed_in = raw.select(F.col("line_id").cast("long"), F.col("feed").cast("string"), F.col("file_name").cast("string"), F.col("line_no").cast("int"), F.col("raw_text").cast("string"))
    return typed_in.mapInArrow(run, schema)


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that cannot be loaded, with the reason and the field at fault (null: the line's form)."""
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "feed", "file_name", "line_no", "reason", "field")


def loaded(parsed: DataFrame, contract: Contract) -> DataFrame:
    """The typed rows of one feed."""
    return parsed.filter(F.col("reason").isNull() & (F.col("feed") == contract.feed)).select("line_id", "file_name", "line_no", *contract.fields)
