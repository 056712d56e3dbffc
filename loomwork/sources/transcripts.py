"""Transcript source: JSON-lines files of assistant sessions as record rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text

# Directories whose transcripts belong to other sessions.
NESTED = ("subagents", "workflows")


def _nested(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda p: p.isin(*NESTED))


def read_lines(spark: SparkSession, root: str, max_sessions: int | None = None) -> DataFrame:
    """file, block, seq, line of the transcripts at ``root`` and one level below it.

    Files are read split by split: ``block`` is the offset of the split in its file and ``seq``
    rises with the lines of a split, so together they are the order of the file, and a very
    long transcript is not held by one task.
    """
    frames = []
    patterns = [root] if root.endswith(".jsonl") else [f"{root}/*.jsonl", f"{root}/*/*.jsonl"]
    for pattern in patterns:
        try:
            frames.append(
                spark.read.text(pattern).select(
                    F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"),
                    F.col("value").alias("line"),
                )
            )
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
    if not frames:
        return spark.createDataFrame([], "file string, block long, seq long, line string")
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    lines = lines.filter(~_nested(F.col("file")))
    if max_sessions is not None:
        first = lines.select("file").distinct().orderBy("file").limit(max_sessions)
        lines = lines.join(first, "file", "left_semi")
    return lines


def parse(lines: DataFrame) -> DataFrame:
    """Record rows (see ``operators.sessions``); lines that are not JSON objects are skipped."""
    doc = F.col("doc")

    def string(path: str) -> Column:
        value = F.try_variant_get(doc, path, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, path, "string"))

    content = F.try_variant_get(doc, "$.message.content", "variant")
    result = F.try_variant_get(doc, "$.toolUseResult", "variant")
    objects = lines.withColumn("doc", F.try_parse_json("line")).filter(
        F.schema_of_variant(doc).startswith("OBJECT")
    )
    return objects.select(
        "file",
        "block",
        "seq",
        string("$.type").alias("rtype"),
        string("$.sessionId").alias("session_id"),
        string("$.cwd").alias("cwd"),
        string("$.gitBranch").alias("branch"),
        string("$.aiTitle").alias("ai_title"),
        text.parse_iso(string("$.timestamp")).alias("ts"),
        string("$.uuid").alias("uuid"),
        string("$.message.role").alias("role"),
        F.coalesce(text.block_text(content), F.lit("")).alias("text"),
        text.tool_paths(content).alias("paths"),
        (result.isNotNull() & ~F.is_variant_null(result)).alias("tool_result"),
    )


def records(spark: SparkSession, root: str, max_sessions: int | None = None) -> DataFrame:
    return parse(read_lines(spark, root, max_sessions))
