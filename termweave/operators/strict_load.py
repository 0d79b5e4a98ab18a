"""Problem 3: load the delimited lines that conform, and give the reason for every line that does not.

Strict load plus anti-join. Every line keeps its offset (``raw_id``); a strict parse admits only lines that satisfy
the whole contract of their format; the admitted offsets are subtracted from all offsets; only the remainder is diagnosed.

All of it is column expressions. The quoting grammar is decided from the parts between quote characters: parts at odd
places are inside quotes, a part at an even place must be empty (a doubled quote) or touch a delimiter on each side that
faces a quote. That needs no recursive pattern, so very long lines cannot overflow the matcher's stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.let import let
from termweave.session import table

REASONS = ("quoting", "column_count", "invalid_value", "unknown_format")
#: Formats and property types are configuration; more than this is a mistake.
MAX_FORMATS, MAX_TYPES = 1_000, 10_000
_ESC, _SEP = "\u0001a", "\u0001b"


@dataclass(frozen=True)
class Format:
    format_id: int
    delimiter: str
    quote: str
    columns: tuple[str, ...]


def read_formats(formats: DataFrame) -> list[Format]:
    """The format table as configuration (at most MAX_FORMATS rows, else an error). Rows with a null member are ignored."""
    rows = formats.select("format_id", "delimiter", "quote_char", "column_list").dropna().limit(MAX_FORMATS + 1).collect()
    if len(rows) > MAX_FORMATS:
        raise ValueError(f"more than {MAX_FORMATS} upload formats")
    return sorted((Format(r[0], r[1], r[2], tuple(r[3].split(","))) for r in rows), key=lambda f: f.format_id)


def read_types(types: DataFrame) -> list[str]:
    """The names of property types as configuration (at most MAX_TYPES, else an error)."""
    names = [r[0] for r in types.select("type_name").filter("type_name is not null").distinct().limit(MAX_TYPES + 1).collect()]
    if len(names) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} property types")
    return sorted(names)


def _literal_split(text: Column, mark: str) -> Column:
    return F.split(text, "\\Q" + mark + "\\E", -1)


def quoting_ok(line: Column, fmt: Format) -> Column:
    """Whether every field is bare or wholly quoted."""

    def judge(parts: Column) -> Column:
        last = F.size(parts) - 1

        def good(p: Column, i: Column) -> Column:
            ends, starts = F.endswith(p, F.lit(fmt.delimiter)), F.startswith(p, F.lit(fmt.delimiter))
            return (
                F.when((i % 2) == 1, True)
                .when(last == 0, True)
                .when(i == 0, (p == "") | ends)
                .when(i == last, (p == "") | starts)
                .otherwise((p == "") | (starts & ends))
            )

        return ((last % 2) == 0) & F.forall(F.transform(parts, good), lambda x: x)

    return let(_literal_split(line, fmt.quote), judge)


def fields_of(line: Column, fmt: Format) -> Column:
    """The unquoted fields of a line whose quoting is right. Escapes U+0001, so that any text survives."""

    def joined(parts: Column) -> Column:
        last = F.size(parts) - 1

        def text(p: Column, i: Column) -> Column:
            return (
                F.when((i % 2) == 1, p)
                .when((p == "") & (i > 0) & (i < last), F.lit(fmt.quote))
                .otherwise(F.replace(p, F.lit(fmt.delimiter), F.lit(_SEP)))
            )

        return F.array_join(F.transform(parts, text), "")

    escaped = F.replace(line, F.lit("\u0001"), F.lit(_ESC))
    whole = let(_literal_split(escaped, fmt.quote), joined)
    return F.transform(_literal_split(whole, _SEP), lambda x: F.replace(x, F.lit(_ESC), F.lit("\u0001")))


def _values_ok(field: dict[str, Column], types: Column) -> Column:
    when = field["submitted"]
    stamp = F.when(when.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"), F.try_to_timestamp(when, F.lit("yyyy-MM-dd HH:mm:ss")))
    value = field["propertyValue"]
    return F.coalesce(
        field["row_no"].rlike(r"\A[0-9]{1,12}\z")
        & value.rlike(r"[\p{L}\p{N}]")
        & ~value.rlike("[\\x00-\\x09\\x0B-\\x1F�]")
        & ((field["propertyType"] == "") | F.array_contains(types, field["propertyType"]))
        & stamp.isNotNull()
        & ~when.startswith("0000"),
        F.lit(False),
    )


def _parsed(raw: DataFrame, formats: list[Format], types: DataFrame) -> DataFrame:
    """raw_id, format_id, line, fields, n_want, quoted_ok, and by name the fields; types is attached as one array."""
    rows = raw.select("raw_id", "format_id", "line").withColumn("_types", F.lit(read_types(types)).cast("array<string>"))
    ok, fields, want = F.lit(None).cast("boolean"), F.lit(None).cast("array<string>"), F.lit(None).cast("int")
    names = sorted({c for f in formats for c in f.columns} | {"row_no", "propertyValue", "propertyType", "submitted", "note"})
    order: dict[str, Column] = {n: F.lit(None).cast("int") for n in names}
    for f in formats:
        here = F.col("format_id") == f.format_id
        ok = F.when(here, quoting_ok(F.col("line"), f)).otherwise(ok)
        fields = F.when(here, fields_of(F.col("line"), f)).otherwise(fields)
        want = F.when(here, F.lit(len(f.columns))).otherwise(want)
        for i, c in enumerate(f.columns):
            order[c] = F.when(here, F.lit(i)).otherwise(order[c])
    out = rows.withColumn("quoted_ok", ok).withColumn("n_want", want).withColumn("fields", F.when(F.col("quoted_ok"), fields))
    return out.select("*", *(F.try_element_at("fields", order[n] + 1).alias(n) for n in names))


def _conforms() -> Column:
    field = {n: F.col(n) for n in ("row_no", "propertyValue", "propertyType", "submitted")}
    return F.coalesce(F.col("quoted_ok") & (F.size("fields") == F.col("n_want")), F.lit(False)) & _values_ok(field, F.col("_types"))


def strict_load(raw: DataFrame, formats: DataFrame, types: DataFrame) -> DataFrame:
    """The conforming lines as typed rows: raw_id, row_no, propertyValue, propertyType, note, submitted.

    A null line, a null or unknown format never conforms. Extra columns of the inputs are ignored. Empty tables give no rows.
    """
    parsed = _parsed(raw, read_formats(formats), types)
    return parsed.filter(_conforms()).select(
        "raw_id",
        F.col("row_no").cast("long").alias("row_no"),
        "propertyValue",
        F.nullif("propertyType", F.lit("")).alias("propertyType"),
        "note",
        F.to_timestamp("submitted", "yyyy-MM-dd HH:mm:ss").alias("submitted"),
    )


def reject(raw: DataFrame, formats: DataFrame, types: DataFrame) -> DataFrame:
    """raw_id, format_id, line and the first reason for every line that strict_load does not admit.

    Reasons in order: quoting, column_count, invalid_value. A null line has no fields and gives column_count; a line whose
    format is null or unknown gives unknown_format. The admitted offsets are subtracted from all offsets by an anti-join on
    raw_id, and only the remainder is diagnosed. raw_id is the record offset and must be unique; a line without one is judged by itself, as nothing can be subtracted.
    """
    known = read_formats(formats)
    loaded = strict_load(raw, formats, types).select("raw_id")
    rest = raw.select("raw_id", "format_id", "line").join(loaded, "raw_id", "left_anti")
    why = (
        F.when(F.col("n_want").isNull(), "unknown_format")
        .when(F.col("line").isNull(), "column_count")
        .when(~F.col("quoted_ok"), "quoting")
        .when(F.size("fields") != F.col("n_want"), "column_count")
        .otherwise("invalid_value")
    )
    parsed = _parsed(rest, known, types).filter(F.col("raw_id").isNotNull() | ~_conforms())
    return parsed.select("raw_id", "format_id", "line", why.alias("reason"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return reject(t("raw_uploads"), t("upload_formats"), t("property_types")).select("raw_id", "reason")


def p3_loaded(spark, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return strict_load(t("raw_uploads"), t("upload_formats"), t("property_types"))
