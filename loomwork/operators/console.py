"""The read-only SQL console: silver and gold as views, one SELECT per call."""

from __future__ import annotations

import re
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: rows of one console page.
PAGE = 500

_PLAIN = (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)


def register(tables: dict[str, DataFrame]) -> None:
    """Expose frames as temporary views. Views are plans: nothing is copied or read here."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def guard(query: str) -> str:
    """The bare query text; anything that is not a SELECT or WITH is refused."""
    text = (query or "").strip().rstrip(";").strip()
    if not text.lower().startswith(("select", "with")):
        raise ValueError("only SELECT and WITH queries are allowed")
    return text


# What a plan of a console query may not contain: programs, classes called by name, and relations that are
# neither a registered view nor literal rows.
_REFUSED = ("ScriptInputOutputSchema", "ScriptTransformation", "CallMethodViaReflection", "java_method(", "reflect(")


def check_plan(spark: SparkSession, sql: str) -> None:
    """Refuse queries that reach beyond the registered views. The parsed plan is read; nothing is run."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    plan = parsed.toString()
    named = {t.lower() for t in tables(spark)}
    lowered = plan.lower()
    if any(word.lower() in lowered for word in _REFUSED):
        raise ValueError("scripts and classes are not allowed")
    nested = {n.lower() for n in re.findall(r"CTE \[([^\]]*)\]", plan) for n in n.replace(" ", "").split(",")}
    for relation in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan):
        if relation.replace(" ", "").lower() not in named | nested:
            raise ValueError(f"not a registered view: {relation}")
    for function in re.findall(r"'?([a-z_]+)\(", lowered):
        if function in ("reflect", "try_reflect", "java_method"):
            raise ValueError("scripts and classes are not allowed")


def query(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """The query as a frame. It is always planned as a sub-query, where a command that hides
    behind WITH is a syntax error instead of being run."""
    page = "" if limit is None else f" LIMIT {int(limit)}"
    text = f"SELECT * FROM ({guard(sql)}){page}"
    check_plan(spark, text)
    return spark.sql(text)


def jsonable(df: DataFrame) -> DataFrame:
    """Values JSON has no type for (dates, times, decimals, arrays, ...) become strings."""
    return df.select(
        *[
            F.col(f"`{f.name}`") if isinstance(f.dataType, _PLAIN)
            else F.col(f"`{f.name}`").cast("string").alias(f.name)
            for f in df.schema
        ]
    )


def run_sql(spark: SparkSession, sql: str, limit: int = PAGE) -> dict[str, Any]:
    """One console page: column names, at most ``limit`` rows, and how many there are."""
    try:
        page = jsonable(query(spark, sql, limit))
        rows = [list(r) for r in page.collect()]
    except PySparkException as exc:
        raise ValueError(f"SQL error: {exc}") from exc
    return {"columns": page.columns, "rows": rows, "row_count": len(rows), "engine": "spark"}
