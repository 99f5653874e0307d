"""Delimited text with declared types, a report of values that did not parse, and table export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_date, year_date

HEADERS_AT_ONCE = 8
YEAR_ONLY = "%Y"   # format name for a date that is only a year


def typed(c: str, dtype: T.DataType, fmt: str | None = None) -> Column:
    """Text column as another type; what does not parse becomes NULL."""
    text = F.col(_quoted(c))
    if fmt == YEAR_ONLY:
        return year_date(text.try_cast("int"))
    if fmt is not None:
        return parse_date(text, fmt)
    return text if isinstance(dtype, T.StringType) else text.try_cast(dtype)


def _quoted(name: str) -> str:
    """Column names of the files contain dots."""
    return f"`{name}`"


def header_of(spark: SparkSession, path: str, **options) -> list[str]:
    """Column names in the header line of a file, or of the first file of a folder; only that line is read."""
    return spark.read.options(**{**options, "header": True}).csv(path).columns


def files_by_header(spark: SparkSession, path: str, **options) -> list[tuple[list[str], list[str]]]:
    """The files of a folder, put together by their header lines: (column names, files), in the order of the first files.

    One small job per file reads its first line; that is meant for files by year or month.
    """
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    if len(files) < 2:
        return [(header_of(spark, path, **options), [path])]
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda f: tuple(header_of(spark, f, **options)), files))
    groups: dict[tuple, list[str]] = {}
    for f, names in zip(files, headers):
        groups.setdefault(names, []).append(f)
    return [(list(names), found) for names, found in groups.items()]


def _text_of(spark: SparkSession, files: str | list[str], names: Sequence[str], header: bool, **options) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.options(header=header, enforceSchema=not header, **options).schema(schema).csv(files)


def read_text(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True, absent: str = "raise", **options) -> DataFrame:
    """The declared columns as text.

    With a header line, columns are taken by name in every file, so files of a folder may have others, and any order; files are read
    once per header and appended by name. A column that a file lacks raises, or is missing there with ``absent="null"``;
    one that all files lack always raises. Without a header line ``columns`` are all columns of the file, in order.
    """
    if absent not in ("raise", "null"):
        raise ValueError("absent must be 'raise' or 'null'")
    if not header:
        return _text_of(spark, path, columns, False, **options).select(*[F.col(_quoted(c)) for c in columns])
    groups, parts = files_by_header(spark, path, **options), []
    for names, files in groups:
        missing = [c for c in columns if c not in names]
        if missing and (absent == "raise" or any(all(c not in found for found, _ in groups) for c in missing)):
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        raw = _text_of(spark, files, names, True, **options)
        parts.append(raw.select(*[F.col(_quoted(c)) if c in names else F.lit(None).cast("string").alias(c) for c in columns]))
    return reduce(DataFrame.unionByName, parts)


def record_problems(spark: SparkSession, path: str, header: bool = True, columns: Sequence[str] = (), **options) -> DataFrame:
    """``record`` and ``read_as`` (JSON) for each line with fewer or more values than its file has columns."""
    parts = []
    for names, files in files_by_header(spark, path, **options) if header else [(list(columns), [path])]:
        whole = _text_of(spark, files, [*names, "_record"], header, columnNameOfCorruptRecord="_record", columnPruning=False, **options)
        # The columns go along: a reader that is asked for the record alone does not count values.
        parts.append(whole.filter(F.col("_record").isNotNull()).select(
            F.col("_record").alias("record"), F.to_json(F.struct(*[F.col(_quoted(c)) for c in names])).alias("read_as")))
    return reduce(DataFrame.unionByName, parts)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, date_formats: Mapping[str, str] | None = None,
             header: bool = True, absent: str = "raise", **options) -> DataFrame:
    """Delimited file, or folder of files, to a typed table. ``date_formats`` names the pattern of date columns."""
    raw = read_text(spark, path, schema.names, header, absent, **options)
    return apply_types(raw, schema, date_formats)


def apply_types(raw: DataFrame, schema: T.StructType, date_formats: Mapping[str, str] | None = None) -> DataFrame:
    formats = dict(date_formats or {})
    return raw.select(*[typed(f.name, f.dataType, formats.get(f.name)).alias(f.name) for f in schema])


def parse_problems(raw: DataFrame, schema: T.StructType, date_formats: Mapping[str, str] | None = None,
                   row_id: Sequence[str] = ()) -> DataFrame:
    """``(row_id, column, raw_value, expected)`` for each text that is there but did not parse. One pass."""
    formats = dict(date_formats or {})
    checks = []
    for f in schema:
        if isinstance(f.dataType, T.StringType):
            continue
        fmt = formats.get(f.name)
        expected = f"date {fmt}" if fmt else f.dataType.simpleString()
        bad = F.col(_quoted(f.name)).isNotNull() & typed(f.name, f.dataType, fmt).isNull()
        checks.append(F.when(bad, F.struct(F.lit(f.name).alias("column"), F.col(_quoted(f.name)).alias("raw_value"),
                                           F.lit(expected).alias("expected"))))
    found = raw.select(*row_id, F.explode(F.array_compact(F.array(*checks))).alias("_p"))
    return found.select(*row_id, "_p.*")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Final tables as Parquet, or as CSV with a header."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")
