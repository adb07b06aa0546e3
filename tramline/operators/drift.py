"""Schemas that drift between files: one consistent table and a report of each change.

The records of a file are read where they lie and folded to one header set per file: each
header with the mask of the value types seen. The masks form a promotion lattice (nothing
< integer < decimal < text, boolean < text) whose join is the bitwise or. Files of a feed
are compared in the order of their dates, and all files are cast to the join of their types.

Defined cases: a null or unreadable record counts as a record without keys; a key that
occurs twice in a record counts with both values; null values give a field but no type;
arrays and objects count as text; files of a feed that share a date are one file under the
smallest of their names; a null feed is a feed of its own, and a null date comes first;
repeated records change nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT, INTEGER, DECIMAL, BOOLEAN = 1, 2, 4, 8
#: Types of the unified table; decimals keep 26 digits before the point, so that ids that meet decimals keep theirs.
SPARK_TYPES = {"integer": "decimal(38,0)", "decimal": "decimal(38,12)", "boolean": "boolean", "text": "string"}
#: Columns of the unified table beside the fields.
OWN = ("record_id", "feed", "file_name", "file_date", "rest", "unfit", "unread")


class _Raw(str):
    """JSON as written."""


class _Int(_Raw):
    """A number without point, as written."""


class _Dec(_Raw):
    """A number with point or exponent, as written."""


class _Object(list):
    """The pairs of an object."""


_decoder = json.JSONDecoder(parse_int=_Int, parse_float=_Dec, parse_constant=_Dec, object_pairs_hook=_Object)


def normal_header(h: str) -> str:
    """A header without byte order mark, outer blanks and case."""
    return h.replace("﻿", "").strip().lower()


def _pairs(record: str | None) -> list[tuple] | None:
    """The pairs of a record in their order; none if it isn't a readable object."""
    try:
        pairs = None if record is None else _decoder.decode(record)
    except (ValueError, RecursionError):
        return None
    return pairs if isinstance(pairs, _Object) else None


def _mask(v) -> int:
    if v is None:
        return 0
    if isinstance(v, bool):
        return BOOLEAN
    return INTEGER if isinstance(v, _Int) else (DECIMAL if "." in v else INTEGER) if isinstance(v, _Dec) else TEXT


def _text(v) -> str:
    """A value as text: strings as they are, numbers as written, else JSON; without recursion, since the nesting may be deep."""
    if isinstance(v, str):
        return str(v)
    out, todo = [], [v]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            opened, closed = "{}" if isinstance(v, _Object) else "[]"
            parts = [_Raw(opened)]
            for i, x in enumerate(v):
                key = json.dumps(x[0], ensure_ascii=False) + ": " if opened == "{" else ""
                parts += [_Raw((", " if i else "") + key), x[1] if key else x]
            todo += reversed([*parts, _Raw(closed)])
        else:
            out.append(v if isinstance(v, _Raw) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _exact(number: str, places: int) -> bool:
    """True if no digit is lost behind so many decimal places."""
    if "e" not in number and "E" not in number and len(number.partition(".")[2]) <= places:
        return True
    try:
        n = Decimal(number).as_tuple()
    except InvalidOperation:
        return False
    digits = "".join(map(str, n.digits)).rstrip("0")
    return isinstance(n.exponent, int) and (not digits or n.exponent + len(n.digits) - len(digits) >= -places)


def _strings(values: list) -> pa.Array:
    """Halves of surrogate pairs, which JSON can escape but no UTF-8 holds, come out as U+FFFD."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v and v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())


def alias_table(aliases: DataFrame) -> DataFrame:
    """header (normal), canonical: every alias and canonical name once. An alias beats a name's own spelling, of two canonical names the smaller counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(normal_header(h), c, k) for c, alias in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for h, k in ((alias, 0), (c, 1))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["header", "canonical", "own"])

    rows = aliases.select("canonical_name", "alias").filter("alias is not null and canonical_name is not null").mapInArrow(run, "header string, canonical string, own int")
    return rows.groupBy("header").agg(F.min_by("canonical", F.struct("own", "canonical")).alias("canonical"))


def file_schemas(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per file and field: feed, file_date, file_name, field_name, headers (sorted), mask of types; aliases as alias_table gives them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*k, m) for k, m in seen.items()]
            seen.clear()
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([*(_strings(c) for c in cols[:4]), pa.array(cols[4], pa.int32())], ["feed", "file_date", "file_name", "header", "mask"])

        for b in batches:
            for feed, date, name, rec in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                pairs = _pairs(rec)
                if not pairs:
                    seen.setdefault((feed, date, name, None), 0)
                for h, v in pairs or ():
                    k = (feed, date, name, h)
                    seen[k] = seen.get(k, 0) | _mask(v)
            if len(seen) > 50_000:  # a state that outgrows the task's share is sent on and merged later
                yield flush()
        yield flush()

    raw = records.select(*(F.col(c).cast("string") for c in ("feed", "file_date", "file_name", "record_json")))
    seen = raw.mapInArrow(scan, "feed string, file_date string, file_name string, header string, mask int")
    seen = seen.groupBy("feed", "file_date", "file_name", "header").agg(F.bit_or("mask").alias("mask"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            normal = [None if h is None else normal_header(h) for h in b.column("header").to_pylist()]
            yield b.set_column(3, "header", pa.array(normal, pa.string()))

    # One row per file and header: far fewer than records.
    named = seen.mapInArrow(name, "feed string, file_date string, file_name string, header string, mask int").join(aliases, "header", "left").withColumn("field_name", F.coalesce("canonical", "header"))
    # A file has as many fields as headers, so the sets stay small.
    return named.groupBy("feed", "file_date", "field_name").agg(F.min("file_name").alias("file_name"), F.array_sort(F.collect_set("header")).alias("headers"), F.bit_or("mask").alias("mask"))


def type_name(mask: Column) -> Column:
    """The join in the lattice as a name; null where there is no type."""
    return F.when(mask == 0, None).when(mask == INTEGER, "integer").when(mask.isin(DECIMAL, DECIMAL | INTEGER), "decimal").when(mask == BOOLEAN, "boolean").otherwise("text")


def changes(schemas: DataFrame) -> DataFrame:
    """feed, file_date, file_name, field_name, change_kind, before, after: each file against the one before it in its feed."""
    files = schemas.groupBy("feed", "file_date").agg(F.min("file_name").alias("file_name"))
    # One row per file: a feed has one file per date.
    w = Window.partitionBy("feed").orderBy(F.col("file_date").asc_nulls_first())
    files = files.withColumn("_first", F.row_number().over(w) == 1).withColumn("_next_date", F.lead("file_date").over(w)).withColumn("_next_name", F.lead("file_name").over(w))
    fields = schemas.filter("field_name is not null").select("feed", "file_date", "field_name", F.struct("headers", type_name(F.col("mask")).alias("type")).alias("f"))
    here = _on_file(fields, files)
    now = here.filter(~F.col("_first")).select("feed", "file_date", "file_name", "field_name", F.col("f").alias("new"), F.lit(None).cast(fields.schema["f"].dataType).alias("old"))
    # Each file's fields are also the old state of the next file, so both sides meet in one aggregation.
    then = here.filter(F.col("_next_name").isNotNull()).select("feed", F.col("_next_date").alias("file_date"), F.col("_next_name").alias("file_name"), "field_name", F.lit(None).cast(fields.schema["f"].dataType).alias("new"), F.col("f").alias("old"))
    both = now.unionByName(then).groupBy("feed", "file_date", "file_name", "field_name").agg(F.first("new", ignorenulls=True).alias("new"), F.first("old", ignorenulls=True).alias("old"))
    new, old = F.col("new"), F.col("old")
    here_and_there = new.isNotNull() & old.isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(old.isNull(), F.lit("added")),
            F.when(new.isNull(), F.lit("removed")),
            F.when(here_and_there & (new["headers"] != old["headers"]), F.lit("renamed")),
            F.when(here_and_there & new["type"].isNotNull() & old["type"].isNotNull() & (new["type"] != old["type"]), F.lit("retyped")),
        )
    )
    out = both.select("feed", "file_date", "file_name", "field_name", F.explode(kinds).alias("change_kind"), "old", "new")
    told = lambda s: F.when(F.col("change_kind") == "retyped", s["type"]).otherwise(F.array_join(s["headers"], "|"))
    return out.select("feed", "file_date", "file_name", "field_name", "change_kind", told(F.col("old")).alias("before"), told(F.col("new")).alias("after"))


def _on_file(fields: DataFrame, files: DataFrame) -> DataFrame:
    k = files.select(F.col("feed").alias("_feed"), F.col("file_date").alias("_date"), "file_name", "_first", "_next_date", "_next_name")
    return fields.join(k, fields["feed"].eqNullSafe(k["_feed"]) & fields["file_date"].eqNullSafe(k["_date"])).drop("_feed", "_date")


def union_schema(schemas: DataFrame, fields: list[str]) -> dict[str, str]:
    """The join of each field's types over all files, as a Spark type; one small aggregate, one row per field."""
    got = schemas.filter(F.col("field_name").isin(fields)).groupBy("field_name").agg(F.bit_or("mask").alias("mask")).select("field_name", type_name(F.col("mask")).alias("t")).collect()
    types = {r.field_name: SPARK_TYPES.get(r.t, "string") for r in got}
    return {f: types.get(f, "string") for f in fields}


def columns(schemas: DataFrame, aliases: DataFrame, fields: list[str]) -> list[str]:
    """fields, then the other canonical names that occur in files, in their order; a name that is a column's already, but for case, gets no column."""
    named = schemas.select("field_name").distinct().join(aliases.select(F.col("canonical").alias("field_name")).distinct(), "field_name", "left_semi")
    out, taken = list(fields), {c.lower() for c in (*fields, *OWN, "_rough")}
    # One row per canonical name.
    for name in sorted(r.field_name for r in named.collect()):
        if name.lower() not in taken:
            out.append(name)
            taken.add(name.lower())
    return out


def _quoted(field: str) -> str:
    return "`" + field.replace("`", "``") + "`"


def unified(records: DataFrame, schemas: DataFrame, types: dict[str, str]) -> DataFrame:
    """record_id, feed, file_name, file_date, the fields of types in the union schema, rest, unfit and unread; between them they hold every value that isn't null.

    rest has field_name and value, as text, of all that the columns do not hold: other fields, further values of a field and values that do not fit.
    unfit has the fields whose value does not fit its type and so is null, or rounded to its places. unread is a record that is no readable object.
    Of several headers of one field in a record the first value that isn't null counts. Integers that meet decimals or text keep their digits.
    """
    fields = list(types)
    places = {f: int(t[:-1].split(",")[1]) for f, t in types.items() if t.startswith("decimal")}
    # The aliases that occur; any other header is its own field.
    spelt = schemas.select(F.explode("headers").alias("h"), "field_name").filter("h <> field_name").distinct().collect()
    aliases = {r.h: r.field_name for r in spelt}
    pair = pa.struct([("field_name", pa.string()), ("value", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {f: [None] * b.num_rows for f in fields}
            names, values, ends, rough, unread = [], [], [0], [], []
            for i, rec in enumerate(b.column("record_json").to_pylist()):
                pairs, lossy = _pairs(rec), []
                for h, v in pairs or ():
                    if v is None:
                        continue
                    f, v = aliases.get(n := normal_header(h), n), _text(v)
                    if f in cols and cols[f][i] is None:
                        cols[f][i] = v
                        if f in places and not _exact(v, places[f]):
                            lossy.append(f)
                    elif f not in cols or cols[f][i] != v:
                        names.append(f)
                        values.append(v)
                ends.append(len(names))
                rough.append(lossy)
                unread.append(rec if pairs is None else None)
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([_strings(names), _strings(values)], fields=list(pair)))
            more = [*(_strings(cols[f]) for f in fields), rest, pa.array(rough, pa.list_(pa.string())), pa.array(unread, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in OWN[:4]] + more, [*OWN[:4], *fields, "rest", "_rough", "unread"])

    raw = records.select(F.col("record_id").cast("long").alias("record_id"), *(F.col(c).cast("string").alias(c) for c in ("feed", "file_name", "file_date", "record_json")))
    told = "rest array<struct<field_name: string, value: string>>, _rough array<string>, unread string"
    text = raw.mapInArrow(read, ", ".join(["record_id long, feed string, file_name string, file_date string", *(f"{_quoted(f)} string" for f in fields), told]))
    cols = {f: F.col(_quoted(f)) for f in fields}
    cast = {f: c if types[f] == "string" else c.try_cast(types[f]) for f, c in cols.items()}
    misfit = {f: cols[f].isNotNull() & (cast[f].isNull() | F.array_contains("_rough", f)) for f in fields if types[f] != "string"}
    unfit = F.array_compact(F.array(*(F.when(m, F.lit(f)) for f, m in misfit.items()))) if misfit else F.lit([]).cast("array<string>")
    lost = [F.when(m, F.struct(F.lit(f).alias("field_name"), cols[f].alias("value"))) for f, m in misfit.items()]
    rest = F.concat(F.array_compact(F.array(*lost)), "rest") if lost else F.col("rest")
    return text.select(*OWN[:4], *(c.alias(f) for f, c in cast.items()), rest.alias("rest"), unfit.alias("unfit"), "unread")
