"""Aggregates behind the dashboard and the stats pages.

Each takes the table it reads and returns a small frame. Ties of every top-k are broken by name,
so the answer does not depend on how rows are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_AUTHORS, TOP_ROWS = 10, 12


def totals(artifacts: DataFrame) -> DataFrame:
    """Artifacts per kind, most first."""
    return artifacts.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def edges_total(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n"))


def top_authors(authors: DataFrame, n: int = TOP_AUTHORS) -> DataFrame:
    busy = F.col("commits") + F.col("files_touched") + F.col("ai_sessions")
    return (
        authors.orderBy(busy.desc(), "person_id").limit(n)
        .select("name", "commits", "ai_sessions", "files_touched")
    )


def top_topics(summary: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    return (
        summary.orderBy(F.desc("n_artifacts"), "topic").limit(n)
        .select("topic", "n_artifacts", "n_people", "n_sessions")
    )


def daily(activity: DataFrame) -> DataFrame:
    return activity.groupBy("day").agg(F.sum("count").alias("n")).orderBy("day")


def cross_silo(pairs: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """The first pairs of people as the panel shows them."""
    return (
        pairs.orderBy(F.desc("shared_topics"), "person_a", "person_b").limit(n)
        .select("person_a_name", "person_b_name", "shared_topics", "topics")
    )


def hotspots(files: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    return (
        files.orderBy(F.desc("ai_touches"), F.desc("times_modified"), "file_id").limit(n)
        .select("path", "modality", "times_modified", "ai_touches")
    )


def modality_mix(files: DataFrame) -> DataFrame:
    return files.groupBy("modality").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "modality")


def authors_by_commits(authors: DataFrame) -> DataFrame:
    return authors.select("name", "commits", "files_touched", "ai_sessions").orderBy(
        F.desc("commits"), "name"
    )


def counts(artifacts: DataFrame, edges: DataFrame, repo: str | None = None) -> DataFrame:
    """metric, value: all artifacts, artifacts per kind, and edges unless scoped to a repo.

    Messages carry no repo, so a scoped count has none.
    """
    scope = artifacts if repo is None else artifacts.filter(F.col("repo") == repo)
    per_kind = scope.groupBy("kind").agg(F.count("*").alias("value"))
    total = per_kind.agg(
        F.lit("artifacts_total").alias("metric"), F.coalesce(F.sum("value"), F.lit(0)).alias("value")
    )
    out = total.unionByName(
        per_kind.select(F.concat(F.lit("artifacts_"), "kind").alias("metric"), "value")
    )
    if repo is None:
        out = out.unionByName(
            edges.agg(F.lit("edges_total").alias("metric"), F.count("*").alias("value"))
        )
    return out


def repos(artifacts: DataFrame) -> DataFrame:
    """Commits, files and sessions per repo that has a commit or a file; biggest first."""
    one = [("commit", "commits"), ("file", "files"), ("ai_session", "ai_sessions")]
    return (
        artifacts.filter(F.col("repo").isNotNull())
        .groupBy("repo")
        .agg(*[F.count_if(F.col("kind") == kind).alias(name) for kind, name in one])
        .filter("commits > 0 OR files > 0")
        .orderBy((F.col("commits") + F.col("files")).desc(), "repo")
    )


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def platform_counts(**tables: DataFrame) -> DataFrame:
    """asset, rows of any set of tables, each counted where it lies."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("asset"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no tables to count")
    return out


def summary(
    artifacts: DataFrame, edges: DataFrame, gold: dict[str, DataFrame], pairs: DataFrame
) -> dict[str, DataFrame]:
    """All dashboard panels. ``gold`` holds the marts; an absent one is an empty frame of its
    schema (see ``sources.lake.Lake.gold``), so its panel is empty and the others still answer.
    ``pairs``: the first pairs of people, see ``plans.pipeline.cross_silo``."""
    return {
        "totals": totals(artifacts),
        "edges_total": edges_total(edges),
        "top_authors": top_authors(gold["gold_author_activity"]),
        "top_topics": top_topics(gold["gold_topic_summary"]),
        "daily": daily(gold["gold_daily_activity"]),
        "cross_silo": cross_silo(pairs),
        "hotspots": hotspots(gold["gold_file_hotspots"]),
        "modality_mix": modality_mix(gold["gold_file_hotspots"]),
    }
