"""CSV tables bound by header name, with every value checked, and CSV written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.functions.scalars import INTEGERS, empty_to_null, parse_number
from feedspark.registry import ColumnSpec, TableSpec

#: Name of the column that lists what is wrong with a row.
ERRORS = "_errors"
_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names in a file's first line, as they stand there."""
    first = spark.read.options(**_OPTIONS).option("header", False).csv(path).head(1)
    return ["" if v is None else v for v in first[0]] if first else []


def read_raw(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, list[str]]:
    """A CSV file or folder of equal files as text columns c0, c1, ... and the names in its header.

    Spark matches a given schema by position, so names are bound afterwards, by :func:`bind`.
    """
    names = header_of(spark, path)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(1, len(names)))])
    return spark.read.schema(schema).options(**_OPTIONS).option("header", True).option("multiLine", multi_line).csv(path), names


def _value(spec: ColumnSpec, raw: Column) -> Column:
    if spec.codes is not None:
        keys = list(spec.codes)
        if isinstance(keys[0], str):
            return F.when(raw.isin(keys), raw)
        code = parse_number(raw, "u8")
        return F.when(code.isin(keys), code.cast("tinyint"))
    if spec.kind == "s":
        return raw
    return parse_number(raw, spec.kind)


def spark_type(spec: ColumnSpec) -> str:
    if spec.codes is not None:
        return "string" if isinstance(next(iter(spec.codes)), str) else "tinyint"
    return {"s": "string", "f": "double"}.get(spec.kind) or INTEGERS[spec.kind]


def bind(raw: DataFrame, names: list[str], spec: TableSpec, keep: list[str] | None = None) -> DataFrame:
    """Rows of text as rows of a table: columns by exact header name, in the table's order, and :data:`ERRORS`.

    Of a name that the header repeats the last column counts; a name that it lacks gives nulls; other
    columns are left out, but for the columns of ``raw`` named in ``keep``. An empty value is null. :data:`ERRORS` names each required
    column without a value and each value that isn't of its column's type or code domain; such a value is null.
    """
    at = {n: c for n, c in zip(names, raw.columns, strict=False)}
    values, problems = [], []
    for c in spec.columns:
        text = empty_to_null(raw[at[c.name]]) if c.name in at else F.lit(None).cast("string")
        value = _value(c, text)
        values.append(value.cast(spark_type(c)).alias(c.name))
        if c.required:
            problems.append(F.when(text.isNull(), F.lit(f"{spec.name}.{c.name}: no value")))
        if c.kind != "s" and c.name in at:
            problems.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"{spec.name}.{c.name}: bad value")))
    found = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    return raw.select(*(raw[k] for k in keep or []), *values, found.alias(ERRORS))


def read_table(spark: SparkSession, path: str, spec: TableSpec, multi_line: bool = False) -> DataFrame:
    """The table in a CSV file, with :data:`ERRORS`."""
    raw, names = read_raw(spark, path, multi_line)
    return bind(raw, names, spec)


def valid(df: DataFrame) -> DataFrame:
    """The rows without errors."""
    return df.where(F.size(ERRORS) == 0).drop(ERRORS)


def strict(df: DataFrame) -> DataFrame:
    """All rows; reading one with errors fails the job. Every column depends on the check, so no plan prunes it."""
    first = F.when(F.size(ERRORS) > 0, F.raise_error(F.array_join(ERRORS, "; ")))
    return df.select(*[F.coalesce(first.cast(f.dataType), F.col(f.name)).alias(f.name) for f in df.schema.fields if f.name != ERRORS])


def check_counts(df: DataFrame) -> DataFrame:
    """One row (valid, invalid), by an aggregation that reads the errors and so every checked column."""
    bad = F.size(ERRORS) > 0
    return df.agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"))


def flat(df: DataFrame) -> DataFrame:
    """``df`` if it has no nested columns; CSV can't hold them."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))]
    if nested:
        raise ValueError(f"CSV has no form for the columns {', '.join(nested)}")
    return df


def with_header(df: DataFrame, header: list[str] | None = None) -> DataFrame:
    """The columns of a header in its order: those that ``df`` lacks are empty, its others are left out."""
    df = flat(df)
    return df.select(*[df[c].cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in header or df.columns])


def write_table(df: DataFrame, path: str, header: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A folder of CSV files, each with the header. Null is written as nothing, an empty text as ""."""
    with_header(df, header).write.mode(mode).options(quote='"', escape='"', header=True, nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def csv_row(values: list[Column]) -> Column:
    """A CSV line: a value with a quote, a comma or a line break stands in quotes, inner quotes doubled; null is empty."""
    texts = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in texts]
    return F.concat_ws(",", *quoted)


def to_csv_lines(df: DataFrame, header: list[str] | None = None) -> DataFrame:
    """One text column ``line``: each row as a CSV line of the header's columns."""
    out = with_header(df, header)
    return out.select(csv_row([out[c] for c in out.columns]).alias("line"))


def as_fields(df: DataFrame, header: list[str] | None = None) -> DataFrame:
    """One column ``fields``: each row as the array of its values as text, in the header's order; null is an empty text."""
    out = with_header(df, header)
    return out.select(F.array(*[F.coalesce(out[c], F.lit("")) for c in out.columns]).alias("fields"))


def fields_of(line: Column) -> Column:
    """The fields of one CSV line as an array of texts, quotes undone; a null line has none."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    inner = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda f: F.when(f.rlike(r'^"(?s:.*)"$'), inner(f)).otherwise(f))
