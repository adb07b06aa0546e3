"""Delimited files as they are delivered: any encoding, delimiter, header spelling; plain, gzip or zip.

Archives are unpacked as they are read, never whole. What cannot be read, or only with
letters replaced, is told by deliveries().
"""

from __future__ import annotations

import codecs
import csv
import gzip
import io
import re
import sys
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "cp949", "latin-1")
DELIMITERS = ",\t;|"
SNIFF_BYTES = 256 << 10


def normal_header(h: str) -> str:
    """A header without byte order mark, zero-width marks, quotes and outer blanks."""
    return h.replace("﻿", "").replace("​", "").strip().strip("\"'").strip()


def resolve_headers(headers: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Canonical name -> header: exact spellings first, then letters and digits only."""
    bare = lambda s: re.sub(r"[\W_]", "", s).lower()
    exact, loose = {}, {}
    for h in headers:
        exact.setdefault(normal_header(h), h)
        loose.setdefault(bare(normal_header(h)), h)
    out = {}
    for name, known in aliases.items():
        hit = next((exact[a] for a in known if a in exact), None) or next((loose[bare(a)] for a in known if bare(a) in loose), None)
        if hit is not None:
            out[name] = hit
    return out


def sniff(head: bytes, known: str | None = None) -> tuple[str, str, list[str]]:
    """(encoding, delimiter, header) from the first bytes of a file; the encoding is the first that reads them, if not known."""
    cut = head.rsplit(b"\n", 1)[0] if len(head) >= SNIFF_BYTES else head
    for encoding in (known,) if known else ENCODINGS:
        try:
            text = cut.decode(encoding, "replace" if known else "strict")
            break
        except UnicodeDecodeError:
            continue
    first = text.split("\n", 1)[0].rstrip("\r")
    delimiter = max(DELIMITERS, key=first.count)
    return encoding, delimiter, [normal_header(h) for h in next(csv.reader([first], delimiter=delimiter), [])]


DAMAGE = (OSError, EOFError, zlib.error, zipfile.BadZipFile)


def _decoded(stream: BinaryIO, encoding: str, errors: str = "strict", step: int = 1 << 20) -> bool:
    """Whether the encoding reads all of the stream."""
    decoder = codecs.getincrementaldecoder(encoding)(errors)
    try:
        while block := stream.read(step):
            decoder.decode(block)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return False
    return True


def encoding_of(opened: Callable[[], BinaryIO]) -> tuple[str, bool]:
    """(encoding, whether it reads every letter): the first of several bytes a letter that reads all of a file; else, where bytes are damaged or single, the one that its beginning shows."""
    for encoding in ENCODINGS[:-1]:
        if _decoded(opened(), encoding):
            return encoding, True
    head = opened().read(SNIFF_BYTES)
    encoding = ENCODINGS[-1] if head.isascii() else sniff(head)[0]
    return encoding, encoding == ENCODINGS[-1]


def _members(path: str, content: bytes) -> Iterator[tuple[str, Callable[[], BinaryIO]]]:
    """(name, opener) of each file in a delivery; errors in DAMAGE where it cannot be read."""
    name = path.rsplit("/", 1)[-1]
    if path.lower().endswith(".zip") or zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for member in sorted(z.namelist()):
                if member.lower().endswith((".csv", ".txt")):
                    yield member, lambda member=member: z.open(member)
    elif path.lower().endswith(".gz"):
        yield name[:-3], lambda: gzip.open(io.BytesIO(content))
    else:
        yield name, lambda: io.BytesIO(content)


@dataclass
class Delivery:
    """A file or archive member, how it is to be read, and why it is not."""

    member: str | None
    opened: Callable[[], BinaryIO] | None = None
    encoding: str | None = None
    whole: bool = True
    delimiter: str | None = None
    at: dict[str, int] | None = None
    problem: str | None = None

    def rows(self) -> Iterator[list[str]]:
        reader = csv.reader(io.TextIOWrapper(self.opened(), self.encoding, errors="replace", newline=""), delimiter=self.delimiter)
        next(reader, None)
        yield from reader


def _looked_at(member: str, opened: Callable[[], BinaryIO], aliases: dict[str, list[str]], required: list[str]) -> Delivery:
    encoding, whole = encoding_of(opened)
    _, delimiter, header = sniff(opened().read(SNIFF_BYTES), encoding)
    found = resolve_headers(header, aliases)
    missing = [r for r in required if r not in found]
    at = {n: header.index(normal_header(h)) for n, h in found.items()}
    return Delivery(member, opened, encoding, whole, delimiter, at, f"no header for {', '.join(missing)}" if missing else None)


def _delivered(source: str, content: bytes, aliases: dict[str, list[str]], required: list[str]) -> Iterator[Delivery]:
    csv.field_size_limit(sys.maxsize)
    try:
        for member, opened in _members(source, content):
            try:
                d = _looked_at(member, opened, aliases, required)
            except (*DAMAGE, RuntimeError) as e:
                d = Delivery(member, problem=f"damaged: {type(e).__name__}")
            yield d
    except DAMAGE as e:
        yield Delivery(None, problem=f"damaged: {type(e).__name__}")


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_delimited(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str], glob: str = "*", rows: int = 50_000) -> DataFrame:
    """source_file, member and the canonical fields as text of every file (or zip member) below path whose header has the required fields.

    Files are spread over tasks whole, as gzip and zip cannot be split; each is read in blocks of rows. Damaged archives and files without the header give no rows here but a problem in deliveries().
    """
    names = list(aliases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                source = b.column(0)[i].as_py()
                for d in _delivered(source, b.column(1)[i].as_py(), aliases, required):
                    block: list[list[str]] = []
                    for row in () if d.problem else d.rows():
                        block.append(row)
                        if len(block) >= rows:
                            yield _batch(source, d.member, block, names, d.at)
                            block = []
                    if block:
                        yield _batch(source, d.member, block, names, d.at)

    return _binary(spark, path, glob).mapInArrow(run, "source_file string, member string, " + ", ".join(f"`{n}` string" for n in names))


def deliveries(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str], glob: str = "*") -> DataFrame:
    """source_file, member, encoding, delimiter, n_rows, replaced, problem of every file (or zip member): replaced says that letters could not be read, problem why it gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                source = b.column(0)[i].as_py()
                out += [(source, d.member, d.encoding, d.delimiter, None if d.problem else sum(1 for _ in d.rows()), not d.whole, d.problem) for d in _delivered(source, b.column(1)[i].as_py(), aliases, required)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["source_file", "member", "encoding", "delimiter", "n_rows", "replaced", "problem"])

    return _binary(spark, path, glob).mapInArrow(run, "source_file string, member string, encoding string, delimiter string, n_rows long, replaced boolean, problem string")


def _batch(source: str, member: str, block: list[list[str]], names: list[str], at: dict[str, int]) -> pa.RecordBatch:
    cols = [[r[at[n]] if n in at and at[n] < len(r) else None for r in block] for n in names]
    return pa.RecordBatch.from_arrays([pa.array([source] * len(block), pa.string()), pa.array([member] * len(block), pa.string()), *(pa.array(c, pa.string()) for c in cols)], ["source_file", "member", *names])


def file_date(name: str = "member"):
    """The first eight digits of a file's name as its date, six as a month."""
    d = F.regexp_extract(name, r"(20[0-9]{6}|20[0-9]{4})", 1)
    return F.when(d != "", d)


def files_for_days(files: DataFrame, days: DataFrame, name: str = "member", date: str = "file_date", day: str = "date") -> DataFrame:
    """day, name: for each day its daily file, else the file of its month, else null; of several the last by name."""
    each = files.filter(F.length(date).isin(6, 8)).groupBy(F.col(date).alias("__d")).agg(F.max(name).alias("__n"))
    of = lambda n, c: each.filter(F.length("__d") == n).select(F.col("__d").alias(f"__{c}d"), F.col("__n").alias(f"__{c}"))
    met = days.select(day).distinct().join(of(8, "day"), F.col(day) == F.col("__dayd"), "left").join(of(6, "month"), F.left(day, F.lit(6)) == F.col("__monthd"), "left")
    return met.select(day, F.coalesce("__day", "__month").alias(name))


def prefer_daily(rows: DataFrame, date: str = "file_date", day: str = "date") -> DataFrame:
    """Of a day's rows those of its daily file, where there is one; a monthly file gives the days that have none."""
    daily = rows.filter(F.length(date) == 8).select(F.col(date).alias("__d")).distinct()
    monthly = rows.filter(F.length(date) == 6).join(daily, F.col(day) == F.col("__d"), "left_anti")
    return rows.filter(F.length(date) == 8).unionByName(monthly)


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Plain or gzip CSV with header, all text, split by Spark where the codec allows."""
    return spark.read.option("header", "true").option("sep", sep).option("encoding", encoding).option("recursiveFileLookup", "true").csv(path)


def dates_in(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.regexp_replace(column, "[-/]", "").alias("date")).filter(F.col("date").rlike(r"^[0-9]{8}\z")).distinct()
