"""Loading and saving tables in common file formats."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemill.functions.types import nan_to_null, quoted

_SUFFIXES = {".csv": "csv", ".json": "json", ".tsv": "tsv", ".parquet": "parquet", ".xlsx": "excel", ".xls": "excel"}


_PATTERN = re.compile(r"[\\{}\[\]*?]")


def detect_file_type(path: str) -> str:
    """csv / json / tsv / parquet / excel / unknown from the suffix, ignoring query and fragment."""
    bare = path.lower().split("?")[0].split("#")[0]
    return next((kind for suffix, kind in _SUFFIXES.items() if bare.endswith(suffix)), "unknown")


def load_table(
    spark: SparkSession, path: str, format: str = "auto", schema=None, normalise: bool = True,
    multiline: bool | None = None,
) -> DataFrame:
    """Read a table; an unknown suffix is read as CSV.

    Pass ``schema`` on large CSV/JSON inputs: inference reads them once more.  ``normalise``
    turns float NaN into NULL; switch it off for tables known to hold none, so that filters on
    float columns still reach the Parquet reader.

    ``multiline``: whether a record may span lines.  Left open, one distributed scan decides it for
    every file: a CSV file has such records if a line holds an odd number of quotes, a JSON file if
    its first line is no JSON value by itself.  Only such files are read one per task; all others are
    split, and a folder may hold both kinds.
    """
    kind = detect_file_type(path.rstrip("/")) if format == "auto" else format
    if kind == "excel":
        raise ValueError("Excel files have no distributed reader; convert them to CSV or Parquet")
    if kind == "parquet":
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    elif kind in ("json", "jsonl"):
        spanning = _incomplete if multiline is None and kind == "json" else bool(multiline)
        df = _by_file(spark, path, schema, spanning, lambda reader, files, whole: reader.json(files, multiLine=whole))
    else:
        separator = "\t" if kind == "tsv" else ","

        def read(reader, files, whole: bool) -> DataFrame:
            return reader.csv(files, sep=separator, header=True, inferSchema=schema is None, multiLine=whole, escape='"')

        df = _by_file(spark, path, schema, _odd_quotes if multiline is None else multiline, read)
    return nan_to_null(df) if normalise else df


def _odd_quotes(lines: DataFrame) -> Column:
    """Of a file's lines: whether one opens a quote that it does not close."""
    return F.bool_or(F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1)


def _incomplete(lines: DataFrame) -> Column:
    """Of a file's lines: whether the first that is not blank is no JSON value by itself."""
    parsed = F.try_parse_json("value").isNull()
    return F.coalesce(F.min_by(parsed, F.when((F.col("start") == 0) & (F.trim("value") != ""), F.col("row"))), F.lit(False))


def _by_file(spark: SparkSession, path: str, schema, spanning, read) -> DataFrame:
    """Files with records that span lines (``spanning``, or a function that tells) and the others, each read their way."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if isinstance(spanning, bool):
        return read(reader, path, spanning)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    # one row per file comes to the driver, which lists them for the readers anyway
    kinds = {r["file"]: r["whole"] for r in lines.groupBy("file").agg(spanning(lines).alias("whole")).collect()}
    if len(set(kinds.values())) < 2:
        return read(reader, path, any(kinds.values()))
    sides = [[_plain(file) for file, whole in kinds.items() if whole is wanted] for wanted in (False, True)]

    def side(files: list[str], whole: bool) -> DataFrame:
        start = spark.read if schema is None else spark.read.schema(schema)
        # columns named by folders; a pattern has no single folder to count them from
        return read(start if _PATTERN.search(path) else start.option("basePath", path), files, whole)

    split, whole = side(sides[0], False), side(sides[1], True)
    if schema is None and split.schema != whole.schema:
        split, whole = (_widened(df, split.schema, whole.schema) for df in (split, whole))
    return split.unionByName(whole, allowMissingColumns=True)


def _plain(file: str) -> str:
    """The path of a file as readers take it: decoded, and without patterns."""
    return _PATTERN.sub(r"\\\g<0>", unquote(file))


def _widened(df: DataFrame, *schemas: T.StructType) -> DataFrame:
    """Columns with one type in both schemas: the wider number, or text."""

    def common(name: str) -> T.DataType:
        kinds = [s[name].dataType for s in schemas if name in s.names]
        if all(k == kinds[0] for k in kinds):
            return kinds[0]
        if all(isinstance(k, T.NumericType) for k in kinds):
            whole = all(isinstance(k, T.IntegralType) for k in kinds)
            return T.LongType() if whole else T.DoubleType()
        return T.StringType()

    return df.select(*[F.col(quoted(c)).cast(common(c)).alias(c) for c in df.columns])


def _records(text: str) -> list[str]:
    """Lines of pasted text, joined while a quote is open."""
    out, held = [], ""
    for line in text.strip("\n").splitlines():
        held = f"{held}\n{line}" if held else line
        if held.count('"') % 2 == 0:
            out.append(held)
            held = ""
    return out + [held] if held else out


def load_file_flexible(spark: SparkSession, path: str | None) -> tuple[DataFrame | None, str | None]:
    """``(frame, error)``; reading problems and empty inputs are reported, not raised."""
    if not path:
        return None, "No file provided."
    try:
        df = load_table(spark, path)
        if not df.columns or df.isEmpty():
            return None, "File loaded but contains no data."
        return df, None
    except Exception as error:
        return None, f"Error reading file: {error}"


def parse_pasted_csv(spark: SparkSession, text: str | None) -> tuple[DataFrame | None, str | None]:
    """Pasted text as a table: tab-separated when any tab occurs, else comma-separated."""
    if not text or not text.strip():
        return None, "No data pasted."
    try:
        lines = spark.createDataFrame([(record,) for record in _records(text)], "value string")
        separator = "\t" if "\t" in text else ","
        df = spark.read.csv(lines.coalesce(1).rdd.map(lambda r: r[0]), sep=separator, header=True, inferSchema=True, escape='"')
        return (None, "Parsed data is empty.") if df.isEmpty() else (nan_to_null(df), None)
    except Exception as error:
        return None, f"Could not parse pasted data: {error}"


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line, ISO dates, nulls kept."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def save_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def save_dataframe(df: DataFrame, root: str, name: str) -> str:
    """Keep a table under a name; a later save replaces it."""
    path = f"{root.rstrip('/')}/{_safe(name)}"
    save_parquet(df, path, "overwrite")
    return path


def load_dataframe(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{_safe(name)}")


def _safe(name: str) -> str:
    if not name or any(ch in name for ch in "/\\") or name.startswith("."):
        raise ValueError(f"not a table name: {name!r}")
    return name
