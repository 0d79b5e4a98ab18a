"""Input files: pasted lines, delimited files of unknown dialect, compressed files, configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_LINES = 10
#: Words in a line beyond which it is a text to annotate, not a property.
TEXT_WORDS = 30


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    quote: str
    header: bool


def _number(cell: str) -> bool:
    try:
        float(cell or "0")
    except ValueError:
        return False
    return True


def split_line(line: str, delimiter: str, quote: str) -> list[str]:
    """Cells of a line, trimmed; a doubled quote inside quotes is one; quotes may begin and end anywhere."""
    if not quote:
        return [c.strip() for c in line.split(delimiter)]
    cells, cell, inside, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == quote and inside and line[i + 1 : i + 2] == quote:
            cell.append(quote)
            i += 1
        elif c == quote:
            inside = not inside
        elif c == delimiter and not inside:
            cells.append("".join(cell).strip())
            cell = []
        else:
            cell.append(c)
        i += 1
    return [*cells, "".join(cell).strip()]


def sniff(lines: list[str]) -> Dialect:
    """The dialect of a file's first lines: the commonest delimiter, a quote that occurs twice, a header of short words above other rows."""
    head = "\n".join(lines[:SAMPLE_LINES])
    delimiter = max("\t,;|", key=head.count)
    delimiter = delimiter if head.count(delimiter) else ","
    quote = next((q for q in "\"'" if head.count(q) >= 2), "")
    rows = [split_line(x, delimiter, quote) for x in lines if x.strip()]
    return Dialect(delimiter, quote, len(rows) > 1 and all(not _number(c) and len(c) < 50 for c in rows[0]))


def read_delimited(spark, path: str, dialect: Dialect | None = None) -> DataFrame:
    """A delimited file, plain or gzip, as string columns. Only the first lines reach the driver, for the dialect."""
    d = dialect or sniff([r[0] for r in spark.read.text(path).limit(SAMPLE_LINES).collect()])
    return spark.read.csv(path, sep=d.delimiter, quote=d.quote or "\0", escape=d.quote or "\0", header=d.header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_curated(spark, path: str) -> DataFrame:
    """A curated source in the older layout, with the engine's column names."""
    names = {"STUDY": "study", "BIOENTITY": "bioentity", "PROPERTY_TYPE": "property_type", "PROPERTY_VALUE": "text", "SEMANTIC_TAG": "term_id", "ANNOTATOR": "annotator", "ANNOTATION_DATE": "annotated_at"}
    return read_delimited(spark, path, Dialect("\t", "", True)).withColumnsRenamed(names)


def pasted(lines: DataFrame, value: str = "value") -> DataFrame:
    """Properties from lines ``text`` or ``text<tab>type``; blank lines are left out."""
    parts = F.split(F.col(value), "\t")
    rows = lines.filter(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")
    return rows.select(F.trim(parts[0]).alias("text"), F.nullif(F.trim(F.try_element_at(parts, F.lit(2))), F.lit("")).alias("property_type"))


def is_running_text(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: whether any line is a text rather than a property."""
    return lines.agg(F.coalesce(F.bool_or(F.size(F.split(F.trim(F.col(value)), r"\s+")) > TEXT_WORDS), F.lit(False)).alias("running"))


def load_config(path: str) -> dict:
    """A JSON configuration file; an unreadable one is an error."""
    return json.loads(Path(path).read_text())
