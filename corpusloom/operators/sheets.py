"""Spreadsheets: cells of workbooks as rows, merged ranges, tables as Markdown or CSV, formulas.

Everything works on rows (book, sheet, position, row, col, value, formula); workbook_cells() reads them from .xlsx files with
the standard library.  A sheet's rows meet in one group at the end, as its text is one cell of the result.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.parsers import _rows

#: Columns from which a sheet is CSV, formulas that are listed, decimals of a number.
WIDEST, FORMULAS, DECIMALS = 30, 50, 9

_CELLS = "book string, sheet string, position int, row int, col int, value string, formula string"
_MERGES = "book string, sheet string, min_row int, max_row int, min_col int, max_col int"


def _number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, *names: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x.tag) in names)


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", reference).groups()
    return int(digits), _number(letters)


class Workbook:
    """The parts of an .xlsx archive that cells and merges come from."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.shared = ["".join(t.text or "" for t in _children(s, "t")) for s in _children(self._xml("xl/sharedStrings.xml"), "si")]
        targets = {r.get("Id"): r.get("Target") for r in _children(self._xml("xl/_rels/workbook.xml.rels"), "Relationship")}
        self.sheets = []
        for s in _children(self._xml("xl/workbook.xml"), "sheet"):
            target = next((targets.get(v) for k, v in s.attrib.items() if _local(k) == "id"), None) or ""
            self.sheets.append((s.get("name") or "", target[1:] if target.startswith("/") else f"xl/{target}"))

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name)) if name in self.zip.namelist() else ElementTree.Element("none")

    def cells(self) -> Iterator[tuple]:
        for position, (sheet, part) in enumerate(self.sheets):
            for c in _children(self._xml(part), "c"):
                row, col = _place(c.get("r"))
                held = {_local(x.tag): x for x in c}
                formula = held["f"].text if "f" in held else None
                kind, raw = c.get("t"), held["v"].text if "v" in held else None
                if kind == "s" and raw is not None:
                    value = self.shared[int(raw)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in _children(c, "t"))
                elif kind == "b" and raw is not None:
                    value = "True" if raw == "1" else "False"
                else:
                    value = raw
                yield sheet, position, row, col, value, formula

    def merges(self) -> Iterator[tuple]:
        for sheet, part in self.sheets:
            for m in _children(self._xml(part), "mergeCell"):
                (r0, c0), (r1, c1) = (_place(x) for x in (m.get("ref").split(":") * 2)[:2])
                yield sheet, r0, r1, c0, c1


def _opened(content: bytes | None) -> Workbook | None:
    try:
        return Workbook(content or b"")
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return None


def workbook_cells(files: DataFrame) -> DataFrame:
    """(book, sheet, position, row, col, value, formula) from files (path, content); what is no workbook has no cells."""

    def expand(path: str, content: bytes) -> Iterator[tuple]:
        book = _opened(content)
        if book:
            yield from ((path, *c) for c in book.cells())

    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    run, schema = _rows(_CELLS, ["book", "sheet", "position", "row", "col", "value", "formula"], expand, types)
    return files.select("path", "content").mapInArrow(run, schema)


def workbook_merges(files: DataFrame) -> DataFrame:
    """(book, sheet, min_row, max_row, min_col, max_col) from files (path, content)."""

    def expand(path: str, content: bytes) -> Iterator[tuple]:
        book = _opened(content)
        if book:
            yield from ((path, *m) for m in book.merges())

    run, schema = _rows(_MERGES, ["book", "sheet", "min_row", "max_row", "min_col", "max_col"], expand, [pa.string(), pa.string(), *[pa.int32()] * 4])
    return files.select("path", "content").mapInArrow(run, schema)


def with_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells with the value of a merged range's top left cell on every cell that it covers."""
    keys = ["book", "sheet"]
    corner = cells.select(*keys, F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("_corner"), F.col("position").alias("_position"))
    ranges = merges.join(corner, [*keys, "min_row", "min_col"], "left")
    over = ranges.select(*keys, "_corner", "_position", F.explode(F.sequence("min_row", "max_row")).alias("row"), "min_col", "max_col")
    over = over.select(*keys, "row", F.explode(F.sequence("min_col", "max_col")).alias("col"), "_corner", "_position", F.lit(True).alias("_covered"))
    met = cells.join(over.groupBy(*keys, "row", "col").agg(F.min("_corner").alias("_corner"), F.min("_position").alias("_position"), F.first("_covered").alias("_covered")), [*keys, "row", "col"], "full")
    value = F.when(F.col("_covered"), F.col("_corner")).otherwise(F.col("value"))
    return met.select(*keys, F.coalesce("position", "_position").alias("position"), "row", "col", value.alias("value"), "formula")


def cell_text(value: Column) -> Column:
    """A cell as text on one line."""
    return F.trim(F.replace(F.coalesce(value, F.lit("")), F.lit("\n"), F.lit(" ")))


def number_text(value: Column) -> Column:
    """A number without the noise of its storage: up to nine decimals, none for whole numbers."""
    rounded = F.bround(value.cast("double"), DECIMALS)
    return F.when(rounded == F.floor(rounded), F.floor(rounded).cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_number(rounded, DECIMALS), ",", ""), r"\.?0+$", ""))


def table_rows(cells: DataFrame) -> DataFrame:
    """(book, sheet, position, row, cells): every row of a sheet with something in it, as wide as the sheet, gaps filled.

    Of several values for one cell the last by code point counts.
    """
    keys = ["book", "sheet"]
    edge = Window.partitionBy(*keys)
    rows = cells.groupBy(*keys, "position", "row", "col").agg(F.max(cell_text(F.col("value"))).alias("_t"))
    rows = rows.withColumns({"_first": F.min("col").over(edge), "_last": F.max("col").over(edge)})
    listed = rows.groupBy(*keys, "position", "row", "_first", "_last").agg(F.map_from_entries(F.collect_list(F.struct("col", "_t"))).alias("_m"))
    wide = listed.withColumn("cells", F.transform(F.sequence("_first", "_last"), lambda c: F.coalesce(F.element_at("_m", c), F.lit(""))))
    return wide.filter(F.exists("cells", lambda c: c != "")).select(*keys, "position", "row", "cells")


def _piped(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a pipe table: rows as wide as the widest, a rule under the first."""
    width = F.array_max(F.transform(rows, F.size))
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r))))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    line = lambda r, i: F.concat(_piped(padded(r)), F.when(i == 0, F.concat(F.lit("\n"), rule)).otherwise(""))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, line), "\n")).otherwise("")


def csv_block(rows: Column) -> Column:
    """An array of rows of cells as fenced CSV: quotes where a cell needs them, lines ended by CR LF."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    lines = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, quoted), ",")), "\r\n")
    return F.concat(F.lit("```csv\n"), F.regexp_replace(lines, r"\s+\z", ""), F.lit("\n```"))


def real_tables(cells: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """(table_id, fill, populated) of cells (table_id, r, c, text) that make a table worth keeping.

    Two rows and two columns with two filled cells each, half of the cells filled, no cell that holds a paragraph, and, where
    areas (table_id, ratio) tells it, no more than four fifths of the page.
    """
    cols = cells.groupBy("table_id", "c").agg(F.count_if(F.col("text") != "").alias("filled"), F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    by = cols.groupBy("table_id").agg((F.sum("filled") / F.sum("n")).alias("fill"), F.count_if(F.col("filled") >= 2).alias("populated"), F.max("n").alias("rows"), F.max("longest").alias("longest"))
    good = by.filter((F.col("rows") >= 2) & (F.col("fill") >= 0.5) & (F.col("populated") >= 2) & (F.col("longest") <= 200))
    if areas is not None:
        good = good.join(areas.filter("ratio > 0.8"), "table_id", "left_anti")
    return good.select("table_id", "fill", "populated")


def column_letters(col: Column) -> Column:
    """A, B, ... Z, AA, ... for a column's number from 1; up to three letters, as sheets have."""
    letter = lambda n: F.char(F.lit(65) + n)
    n = col - 1
    second, third = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(third >= 0, letter(third % 26)).otherwise(""), F.when(second >= 0, letter(second % 26)).otherwise(""), letter(n % 26))


def formula_lines(cells: DataFrame) -> DataFrame:
    """(book, sheet, formulas): the first formulas of each sheet in reading order, and how many are left out."""
    some = cells.filter(F.coalesce("formula", F.lit("")) != "")
    entry = F.concat(F.lit("`"), column_letters(F.col("col")), F.col("row").cast("string"), F.lit(" = "), F.regexp_replace("formula", "^=", ""), F.lit("`"))
    listed = some.groupBy("book", "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "col", entry.alias("e")))).alias("l"))
    shown = F.array_join(F.transform(F.slice("l", 1, FORMULAS), lambda x: x["e"]), " · ")
    more = F.when(F.size("l") > FORMULAS, F.concat(F.lit(" · _(+"), (F.size("l") - FORMULAS).cast("string"), F.lit(" fórmulas más omitidas)_"))).otherwise("")
    return listed.select("book", "sheet", F.concat(F.lit("**Fórmulas:** "), shown, more).alias("formulas"))


def workbook_markdown(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(book, md): a section for each sheet with data, a table or CSV by its width, its formulas below."""
    flat = cells if merges is None else with_merges(cells, merges)
    rows = table_rows(flat).groupBy("book", "sheet", "position").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("r"))
    rows = rows.withColumn("r", F.transform("r", lambda x: x["cells"]))
    table = F.when(F.size(F.get("r", F.lit(0))) > WIDEST, csv_block(F.col("r"))).otherwise(markdown_table(F.col("r")))
    met = rows.join(formula_lines(cells), ["book", "sheet"], "left")
    section = F.concat(F.lit("## Sheet: "), F.col("sheet"), F.lit("\n"), table, F.when(F.col("formulas").isNotNull(), F.concat(F.lit("\n\n"), F.col("formulas"))).otherwise(""))
    listed = met.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("position", section.alias("s")))).alias("s"))
    return listed.select("book", F.array_join(F.transform("s", lambda x: x["s"]), "\n\n").alias("md"))
