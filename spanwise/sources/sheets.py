"""Spreadsheet scans: rows of XLSX and ODS sheets as arrays of texts, header rows, sections."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, row int, cells array<string>"
#: Repeats of an empty cell or row beyond this are padding to the sheet's end.
_PADDING = 1000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t.tag) == "t")


def _xlsx(book: zipfile.ZipFile, sheet: str) -> Iterator[list[str | None]]:
    named = {_attribute(e, "name"): next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"}
    if sheet not in named:
        raise ValueError(f"no sheet named {sheet}")
    target = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}[named[sheet]]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(e.tag) == "si"]
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    for row in (e for e in ElementTree.fromstring(book.read(path)).iter() if _local(e.tag) == "row"):
        cells: list[str | None] = []
        for c in (e for e in row if _local(e.tag) == "c"):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [None] * (at - len(cells))
            value = next((v.text for v in c if _local(v.tag) == "v"), None)
            kind = c.get("t")
            cells.append(shared[int(value)] if kind == "s" and value is not None else _text(c) if kind == "inlineStr" else value)
        yield cells


def _ods(book: zipfile.ZipFile, sheet: str) -> Iterator[list[str | None]]:
    tables = [e for e in ElementTree.fromstring(book.read("content.xml")).iter() if _local(e.tag) == "table"]
    own = next((t for t in tables if _attribute(t, "name") == sheet), None)
    if own is None:
        raise ValueError(f"no sheet named {sheet}")
    for row in (e for e in own.iter() if _local(e.tag) == "table-row"):
        cells: list[str | None] = []
        for c in (e for e in row if _local(e.tag) in ("table-cell", "covered-table-cell")):
            text = " ".join("".join(p.itertext()) for p in c.iter() if _local(p.tag) == "p").strip() or None
            n = int(_attribute(c, "number-columns-repeated") or 1)
            cells += [text] * (n if text is not None or n < _PADDING else 0)
        n = int(_attribute(row, "number-rows-repeated") or 1)
        for _ in range(n if any(x is not None for x in cells) or n < _PADDING else 0):
            yield cells


def rows(spark: SparkSession, path: str, sheet: str, fmt: str | None = None) -> DataFrame:
    """(path, row, cells) of one sheet of each file that ``path`` names; a file is read whole by one task.

    ``fmt`` is xlsx or ods, by default what the path ends with. ValueError if a file has no such sheet.
    """
    read = {"xlsx": _xlsx, "ods": _ods}[fmt or path.rsplit(".", 1)[-1].lower()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    yield pd.DataFrame([(at, i, c) for i, c in enumerate(read(book, sheet))], columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _SCHEMA)


def with_header(sheet: DataFrame, sentinel: str, within: int = 15) -> DataFrame:
    """(path, row, record): rows below the header as maps; the header is the first of ``within`` rows with the sentinel among
    its cells. Rows without a value in that column are left out. Reading a file without a header raises an error."""
    trimmed = F.transform("cells", lambda c: F.trim(c))
    head = sheet.where((F.col("row") < within) & F.array_contains(F.transform(trimmed, lambda c: F.coalesce(c, F.lit(""))), sentinel)).groupBy("path").agg(F.min_by(F.struct(F.col("row").alias("at"), F.transform(trimmed, lambda c: F.coalesce(c, F.lit(""))).alias("names")), "row").alias("head"))
    j = sheet.join(F.broadcast(head), "path", "left")
    j = j.where(F.when(F.col("head").isNull(), F.raise_error(F.lit(f"no header row with {sentinel}")).cast("boolean")).otherwise(F.col("row") > F.col("head.at")))
    named = F.filter(F.arrays_zip(F.col("head.names").alias("k"), F.col("cells").alias("v")), lambda e: e["k"] != "")
    # Of repeated names the last stays.
    last = F.aggregate(named, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])))
    return j.select("path", "row", last.alias("record")).where(F.coalesce(F.try_element_at("record", F.lit(sentinel)), F.lit("")) != "")


def first_section(sheet: DataFrame, hours: int = 24, days: int = 7) -> DataFrame:
    """(path, hour, counts): the first rows that begin with a time HH:MM:SS, up to the first that repeats an hour, ``hours`` at most;
    cells that are no whole number count as 0."""
    clock = F.element_at("cells", 1)
    timed = sheet.where(F.size("cells") > 0).where(F.length(clock) - F.length(F.replace(clock, F.lit(":"), F.lit(""))) == 2).withColumn("hour", F.element_at(F.split(clock, ":"), 1).try_cast("int")).where("hour is not null")
    cell = lambda i: F.when(F.get("cells", F.lit(i)).rlike("^[0-9]+$"), F.get("cells", F.lit(i)).try_cast("long"))
    firsts = timed.groupBy("path", "hour").agg(F.array_sort(F.collect_list("row")).alias("_rows"))
    # The section ends where an hour comes a second time.
    ends = firsts.groupBy("path").agg(F.min(F.get("_rows", F.lit(1))).alias("_end"))
    own = timed.join(ends, "path").where(F.col("_end").isNull() | (F.col("row") < F.col("_end")))
    counts = own.select("path", "row", "hour", F.array(*(F.coalesce(cell(i), F.lit(0)) for i in range(1, days + 1))).alias("counts"))
    listed = counts.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("row", "hour", "counts"))), 1, hours).alias("_all"))
    return listed.select("path", F.explode("_all").alias("x")).select("path", "x.hour", "x.counts")
