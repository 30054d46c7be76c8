"""Holes in proof files, and what a change filled."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..batches import BATCH_BYTES, small_batches

#: Characters that end a line in a text; a last empty line doesn't count.
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def lines_of(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per line: keys, line (1-based) and text."""
    cut = F.regexp_replace(F.coalesce(content, F.lit("")), rf"(?:{_BREAKS})\z", "")
    rows = files.where(F.coalesce(content, F.lit("")) != "").select(*keys, F.posexplode(F.split(cut, _BREAKS)).alias("_i", "text"))
    return rows.select(*keys, (F.col("_i") + 1).alias("line"), "text")


def with_enclosing(lines: DataFrame, keys: list[str], declaration: str) -> DataFrame:
    """Adds enclosing_decl, the nearest declaration at or above a line ('' for none)."""
    name = F.regexp_extract("text", vocab.java(declaration), 1)
    above = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("enclosing_decl", F.coalesce(F.last(F.when(name != "", name), ignorenulls=True).over(above), F.lit("")))


def with_context(lines: DataFrame, keys: list[str], before: int = 3, after: int = 3) -> DataFrame:
    """Adds context: the lines around each line, joined."""
    around = Window.partitionBy(*keys).orderBy("line").rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("text").over(around), "\n"))


_PLACE = T.StructType([T.StructField("column", T.IntegerType()), T.StructField("kind", T.StringType())])
_LINE = [T.StructField("line", T.IntegerType()), T.StructField("context", T.StringType()), T.StructField("enclosing_decl", T.StringType()), T.StructField("_places", T.ArrayType(_PLACE))]


def holes_in(content: str, markers: Iterable[str], declaration: str, before: int = 3, after: int = 3) -> Iterator[tuple[int, str, str, list[tuple[int, str]]]]:
    """Each line with holes: its number, context, enclosing declaration, and column and kind of each hole, in one pass over the lines."""
    lines, name = content.splitlines(), ""
    declared = re.compile(declaration)
    marks = [(m.lower(), re.compile(rf"\b{m}\b")) for m in markers]
    for i, line in enumerate(lines):
        if (found := declared.search(line)) and found[1]:
            name = found[1]
        places = [(m.start(), kind) for kind, mark in marks for m in mark.finditer(line)]
        if places:
            yield i + 1, "\n".join(lines[max(0, i - before) : i + after + 1]), name, places


def found_holes(files: DataFrame, keys: list[str], markers: list[str] | tuple[str, ...], declaration: str, content: str = "content") -> DataFrame:
    """Every hole of files: keys, line, column (0-based), kind, context and enclosing_decl.

    The declaration above a line is carried on from line to line, which array expressions could only do at a
    cost that grows with the square of the lines; so a file, one row, is read in an Arrow batch. No line is shuffled.
    A line's context leaves Python once for all its holes, in batches of bounded bytes: where texts have few lines,
    contexts of all holes are many times the text."""
    small_batches(files.sparkSession)
    some = files.where(F.col(content).rlike(rf"(?U)\b(?:{'|'.join(markers)})\b")).select(*keys, F.col(content).alias("_content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("column", pa.int32()), ("kind", pa.string())])
        types = [pa.int32(), pa.string(), pa.string(), pa.list_(place)]

        def made(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(at)).columns, *columns], [*keys, *(f.name for f in _LINE)])

        for batch in batches:
            at, rows, held = [], [], 0
            for i, text in enumerate(batch.column("_content")):
                for row in holes_in(text.as_py(), markers, declaration):
                    at.append(i)
                    rows.append(row)
                    # A place takes some 200 bytes before it is in Arrow's form.
                    held += 4 * len(row[1]) + 200 * len(row[3])
                    if held > BATCH_BYTES:
                        yield made(batch, at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield made(batch, at, rows)

    lines = some.mapInArrow(run, T.StructType([*some.select(*keys).schema.fields, *_LINE]))
    return lines.select(*keys, "line", "context", "enclosing_decl", F.explode("_places").alias("h")).select(*keys, "line", "h.*", "context", "enclosing_decl")


def filled_holes(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    """Holes of the parent side whose (declaration, kind) has no hole on the child side."""
    return parent.join(child.select(*keys, "enclosing_decl", "kind").distinct(), [*keys, "enclosing_decl", "kind"], "left_anti")


def challenges(filled: DataFrame, keys: list[str]) -> DataFrame:
    """Per file with filled holes: them in order of line and column, as one array, with those of their fields that are there."""
    hole = F.struct(*[c for c in ("line", "column", "kind", "context", "enclosing_decl") if c in filled.columns])
    return filled.groupBy(*keys).agg(F.array_sort(F.collect_list(hole)).alias("holes_filled"), F.count(F.lit(1)).alias("n_holes"))


def line_slice(files: DataFrame, keys: list[str], start: int = 1, end: int = -1, most: int = 2000, content: str = "content") -> DataFrame:
    """Lines start to end (1-based, inclusive; -1: to the last), at most ``most``."""
    rows = F.split(F.col(content), "\n")
    n = F.when(F.lit(end) == -1, F.size(rows)).otherwise(F.least(F.lit(end), F.size(rows))) - (max(1, start) - 1)
    return files.select(*keys, F.array_join(F.slice(rows, F.lit(max(1, start)), F.greatest(F.lit(0), F.least(n, F.lit(most)))), "\n").alias("chunk"))
