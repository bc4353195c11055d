"""CSV sources and existing tables as rows of a collection."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Field
from ..functions.canonical import stored_value
from ..session import ship

BAD = "_ragged"
BITS = 33  # of a record's place in its piece of a source
LAST = (1 << BITS) - 1
WITHIN = re.compile(r'[^"]*+(?:""[^"]*+)*+')
AFTER = re.compile(r'"[^,]*+,')
OPEN = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+"[^"]*+(?:""[^"]*+)*+')


def header(spark: SparkSession, path: str) -> list[str]:
    """The first record's cells, as they are, over however many lines it goes: as
    many are read as close it."""
    some = 8
    while True:
        lines = [r.value + "\n" for r in spark.read.text(path).limit(some).collect()]
        taken: list[str] = []
        row = next((r for r in csv.reader(x for x in lines if not taken.append(x)) if r), [])
        if len(lines) < some or row and len(taken) < len(lines):
            return row
        some *= 8


def check_utf8(spark: SparkSession, path: str) -> None:
    """An error if the file has bytes that aren't UTF-8; the CSV reader would put
    marks in their place.  It costs a scan of the raw lines."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    if bad:
        raise ValueError(f"{path}: not UTF-8")


def _options(width: int, multiline: bool) -> tuple[str, dict[str, str]]:
    schema = ", ".join(f"c{i} string" for i in range(width)) + f", {BAD} string"
    return schema, {"multiLine": str(multiline).lower(), "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}


def cells(spark: SparkSession, path: str, width: int, multiline: bool) -> DataFrame:
    """_place and columns c0.. of a source, by position; BAD holds a record with fewer
    or more cells.  ``multiline`` lets quoted cells hold line feeds.

    A source is a CSV file or a folder of them, in order of their names, each beneath
    a header.  Spark splits files into pieces of whole lines.  Whether a piece begins
    within quotes is told by those before it: one scan (which also looks for bytes that
    aren't UTF-8) finds how each piece ends if it begins within quotes and if not, and
    the driver goes through the pieces, a row each.  _place is the number of a piece
    and that of the record in it, from 0 and without gaps."""
    schema, options = _options(width, multiline)
    first = spark.read.option("lineSep", "\n").text(path).select(F.col("value").endswith("\r").alias("crlf"), F.locate("\r", "value").between(1, F.length("value") - 1).alias("cr")).first()
    if first is not None and first["cr"]:  # lines end otherwise: files aren't split
        check_utf8(spark, path)
        raw = spark.read.schema(schema).options(header=True, enforceSchema=True, **options).csv(path)
        return raw.select(F.monotonically_increasing_id().alias("_place"), "*")
    ship(spark)
    where = F.struct("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64(where).alias("piece"), where.alias("at"), "value")
    ends = lines.select("piece", "at.*", F.is_valid_utf8("value").alias("valid"), F.when(F.is_valid_utf8("value") & F.contains("value", F.lit('"')), F.col("value")).alias("value"))
    found = ends.mapInPandas(_ends(multiline), "piece long, path string, start long, valid boolean, plain boolean, quoted boolean, closes boolean").collect()
    if not all(r["valid"] for r in found):
        raise ValueError(f"{path}: not UTF-8")
    known, broken = _numbered(found)
    sent = spark.sparkContext.broadcast(known)
    made, kind = _records(sent, bool(first and first["crlf"]), multiline), "place long, chain long, part long, value string"
    whole = lines.select("piece", "value").mapInPandas(made, kind)
    if broken:  # records that go over several pieces are put together
        parts = lines.where(F.col("piece").isin(broken)).select("piece", "value").mapInPandas(made, kind).where("chain is not null")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda x: x["value"]), "\n")
        again = parts.groupBy("chain").agg(F.max("place").alias("place"), joined.alias("value"))
        whole = whole.where("chain is null").select("place", "value").unionByName(again.select("place", "value"))
    records = whole.where(F.col("place").bitwiseAND(LAST) < LAST).select(F.col("place").alias("_place"), F.from_csv("value", schema, options | {"lineSep": "\n"}).alias("r"))
    return records.select("_place", "r.*")


def _inside(line: str, inside: bool) -> bool:
    """Whether a line ends within quotes, if it begins so or not.  As the CSV reader has
    it, only a quote at the start of a cell opens it, and what follows a closing quote
    goes on to the next comma."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        at = WITHIN.match(line).end()
        if at == len(line):
            return True
        rest = AFTER.match(line, at)
        if rest is None:
            return False
        at = rest.end()
    return OPEN.fullmatch(line, at) is not None


def _ends(multiline: bool):
    """Of each piece: does it end within quotes if it begins without, or within them,
    and does the latter close any.  Lines without quotes come as null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list] = {}
        for pdf in batches:
            for piece, part in pdf.groupby("piece", sort=False):
                if piece not in seen:
                    seen[piece] = [part["file_path"].iloc[0], int(part["file_block_start"].iloc[0]), True, False, multiline, False]
                s = seen[piece]
                s[2] &= bool(part["valid"].all())
                if multiline and s[2]:
                    for line in part["value"][part["value"].notna()]:
                        s[3], s[4] = _inside(line, s[3]), _inside(line, s[4])
                        s[5] |= not s[4]
        yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["piece", "path", "start", "valid", "plain", "quoted", "closes"])

    return run


def _numbered(found: list) -> tuple[dict[int, tuple[int, bool, int | None]], list[int]]:
    """By piece: its number, whether a file begins with it, and the piece (by number) in
    which the record began that it begins within; and the pieces with parts of records
    that go over several."""
    known: dict[int, tuple[int, bool, int | None]] = {}
    broken: list[int] = []
    path = before = chain = None
    for no, r in enumerate(sorted(found, key=lambda r: (r["path"], r["start"]))):
        if r["path"] != path:
            path, chain = r["path"], None
        known[r["piece"]] = (no, r["start"] == 0, chain)
        if chain is not None:
            broken += [before, r["piece"]]
        if r["plain"] if chain is None else r["quoted"]:
            chain = no if chain is None or r["closes"] else chain
        else:
            chain = None
        before = r["piece"]
    return known, list(dict.fromkeys(broken))


def _records(sent: Broadcast, crlf: bool, multiline: bool):
    """Lines as records: place and value; of parts of a record that goes over several
    pieces also chain, the piece in which it began, and part, the piece of this one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        continued = {chain for _, _, chain in sent.value.values()}
        piece, held, out = None, [], []

        def closed(end: bool) -> None:
            nonlocal held, place, within
            value = "\n".join(held)
            if within is not None:  # the end of a record of an earlier piece
                out.append((None, within, no, value))
            elif end and no in continued:
                out.append((no << BITS | place & LAST, no, no, value))
                place += 1
            elif value:  # blank lines are none
                out.append((no << BITS | place & LAST, None, None, value))
                place += 1
            held, within = [], None

        no, place, within, inside = 0, 0, None, False
        for pdf in batches:
            for p, line in zip(pdf["piece"].tolist(), pdf["value"].tolist(), strict=True):
                if p != piece:
                    if held:
                        closed(True)
                    if p not in sent.value:
                        raise RuntimeError("files were split otherwise than before: build again")
                    piece, (no, begins, within) = p, sent.value[p]
                    # The header is at the last place that there is: it is dropped.
                    place, inside = -1 if begins else 0, within is not None
                held.append(line.removesuffix("\r") if crlf else line)
                inside = multiline and _inside(line, inside)
                if not inside:
                    closed(False)
            yield pd.DataFrame(out, columns=["place", "chain", "part", "value"]).astype({"place": "Int64", "chain": "Int64", "part": "Int64"})
            out.clear()
        if held:
            closed(True)
            yield pd.DataFrame(out, columns=["place", "chain", "part", "value"]).astype({"place": "Int64", "chain": "Int64", "part": "Int64"})

    return run


def _width(record: Column) -> Column:
    """Cells of a raw record: separators outside quotes, and one."""
    plain = F.regexp_replace(record, r'(?s)"(?:[^"]|"")*"', "")
    return F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1


def read_source(spark: SparkSession, config: Config, ordinal: int, multiline: bool = True) -> DataFrame:
    """Rows of one source: _doc_id, the fields, _source (the file's name).

    A field takes the first column of its mapped name.  Its default is for rows
    that don't have the cell at all; a cell that is there but empty stays empty.
    _doc_id follows the order of sources, then of records."""
    source = config.sources[ordinal]
    mapping, names = source.resolved(config.mappings), header(spark, source.path)
    raw = cells(spark, source.path, max(1, len(names)), multiline)
    order = F.lit(ordinal << 56) + F.col("_place")

    def cell(f: Field) -> Column:
        default = F.lit(source.defaults.get(f.name)).cast("string")
        column = mapping.get(f.name)
        if column is None or column not in names:
            return default
        i = names.index(column)
        missing = F.col(BAD).isNotNull() & (_width(F.col(BAD)) <= i)
        return F.when(missing, default).otherwise(F.coalesce(F.col(f"c{i}"), F.lit("")))

    return raw.select(order.alias("_doc_id"), *[stored_value(f, cell(f)).alias(f.name) for f in config.fields], F.lit(source.path.rsplit("/", 1)[-1]).alias("_source"))


def read_sources(spark: SparkSession, config: Config, multiline: bool = True) -> DataFrame:
    """All sources in their order."""
    return reduce(DataFrame.unionByName, [read_source(spark, config, i, multiline) for i in range(len(config.sources))])


def from_table(df: DataFrame, key: str, fields: tuple[Field, ...], columns: dict[str, str] | None = None, source: str = "", defaults: dict[str, str] | None = None) -> DataFrame:
    """An existing table as rows of a collection: ``key`` is the _doc_id, each
    field the column of its name (or as ``columns`` has it), else its default."""
    columns, defaults = columns or {}, defaults or {}

    def value(f: Field) -> Column:
        name = columns.get(f.name, f.name)
        if name not in df.columns:
            return stored_value(f, F.lit(defaults.get(f.name)).cast("string"))
        c = F.col(name)
        return F.coalesce(c.cast("double"), F.lit(0.0)) if f.type == "number" and dict(df.dtypes)[name] != "string" else stored_value(f, c.cast("string"))

    return df.select(F.col(key).cast("long").alias("_doc_id"), *[value(f).alias(f.name) for f in fields], F.lit(source).alias("_source"))
