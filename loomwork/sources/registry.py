"""The list of sources that are kept ingested: path and kind, one row per resolved path."""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.schemas import empty
from loomwork.session import materialize

SOURCES = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())])
DEFAULT_KIND = "folder"


def load(spark: SparkSession, location: str) -> DataFrame:
    """Registered sources; a list that was never written is empty, malformed entries and those without a path go.

    Any other trouble is an error, as a list that seems empty would be overwritten by the next ``add``.
    """
    try:
        rows = spark.read.schema(SOURCES).option("mode", "DROPMALFORMED").json(location)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, SOURCES)
    return rows.filter(F.coalesce("path", F.lit("")) != "").select(
        "path", F.coalesce("kind", F.lit(DEFAULT_KIND)).alias("kind")
    )


def _store(rows: DataFrame, location: str) -> DataFrame:
    """The list is rewritten from a copy, since a table cannot be overwritten while read."""
    copy = materialize(rows, "sources")
    copy.coalesce(1).write.mode("overwrite").json(location)
    return load(rows.sparkSession, location)


def add(spark: SparkSession, location: str, path: str, kind: str) -> DataFrame:
    """Add a source; a path that is already listed keeps its kind."""
    current = load(spark, location)
    new = spark.createDataFrame([(posixpath.normpath(path), kind)], SOURCES)
    return _store(current.unionByName(new.join(current, "path", "left_anti")), location)


def remove(spark: SparkSession, location: str, path: str) -> DataFrame:
    return _store(load(spark, location).filter(F.col("path") != posixpath.normpath(path)), location)
