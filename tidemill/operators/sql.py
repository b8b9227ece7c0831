"""Read-only SQL over registered tables; Spark SQL is the engine."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.session import materialize

_LITERALS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", re.DOTALL)
_COMMENTS = re.compile(r"--[^\n]*|/\*.*?\*/", re.DOTALL)
_LITERAL_OR_COMMENT = re.compile(f"({_LITERALS.pattern})|{_COMMENTS.pattern}", re.DOTALL)
_WRITES = re.compile(
    r"\binsert\s+(into|overwrite)\b|\bdelete\s+from\b|\bmerge\s+(with\s+schema\s+evolution\s+)?into\b|\bupdate\s+\S+(\s+(as\s+)?\S+)?\s+set\b",
    re.IGNORECASE,
)


def validate_query(query: str) -> str | None:
    """None for a single read-only SELECT / WITH statement, else the reason it is refused."""
    bare = _LITERAL_OR_COMMENT.sub(lambda m: m.group(1) or " ", query).strip()
    if not bare:
        return "Empty query."
    first = bare.split()[0].upper()
    if not re.match(r"^\(*(SELECT|WITH)\b", first):
        return f"Only SELECT and WITH (CTE) queries are allowed. Got: '{first}'."
    if _WRITES.search(_LITERALS.sub("x", bare)):
        return "Only read-only queries are allowed: the statement writes to a table."
    return None


def register_tables(tables: dict[str, DataFrame | None], skip_empty: bool = False) -> list[str]:
    """Expose frames under friendly names; missing (and, on request, empty) ones are hidden."""
    names = []
    for name, df in tables.items():
        if df is None or (skip_empty and df.isEmpty()):
            continue
        df.createOrReplaceTempView(name)
        names.append(name)
    return names


def run_sql_query(
    spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, execute: bool = False
) -> tuple[DataFrame | None, float, str | None]:
    """``(result, seconds, error)``; errors are returned, not raised.

    The result is lazy by default and the time covers analysis only.  With ``execute`` the
    query runs once into the shared folder, the time covers the run, and the result reads
    from there.
    """
    refused = validate_query(query)
    if refused:
        return None, 0.0, refused
    started = time.time()
    names = [name for name, df in (tables or {}).items() if df is not None]
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary} if names else set()
    hidden = {name: spark.table(name) for name in names if name.lower() in views}
    try:
        register_tables(tables or {})
        result = spark.sql(query)
        result = materialize(result) if execute else result
        return result, time.time() - started, None
    except Exception as error:
        return None, time.time() - started, str(error)
    finally:
        # the names were resolved above: the caller's own views come back
        for name in names:
            spark.catalog.dropTempView(name)
        register_tables(hidden)

