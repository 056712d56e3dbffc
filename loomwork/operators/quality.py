"""Data-quality checks on silver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import ids
from loomwork.operators.incremental import EDGE_KEY
from loomwork.schemas import ARTIFACT_KINDS, ARTIFACT_SOURCES, EDGE_RELATIONS


class QualityError(ValueError):
    """Rows that the stored model does not allow."""


def enum_violations(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """field, value, rows for every value outside its enum (NULL counts as outside)."""

    def bad(df: DataFrame, field: str, allowed: tuple[str, ...]) -> DataFrame:
        ok = F.coalesce(F.col(field).isin(*allowed), F.lit(False))
        return (
            df.filter(~ok)
            .groupBy(F.col(field).alias("value")).agg(F.count("*").alias("rows"))
            .select(F.lit(field).alias("field"), "value", "rows")
        )

    return (
        bad(artifacts, "kind", ARTIFACT_KINDS)
        .unionByName(bad(artifacts, "source", ARTIFACT_SOURCES))
        .unionByName(bad(edges, "relation", EDGE_RELATIONS))
    )


def enum_counts(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many rows break each enum."""

    def n_bad(field: str, allowed: tuple[str, ...]):
        return F.count_if(~F.coalesce(F.col(field).isin(*allowed), F.lit(False)))

    left = artifacts.agg(
        n_bad("kind", ARTIFACT_KINDS).alias("bad_kinds"),
        n_bad("source", ARTIFACT_SOURCES).alias("bad_sources"),
    )
    return left.withColumn(
        "bad_relations", edges.agg(n_bad("relation", EDGE_RELATIONS)).scalar()
    )


def require_enums(artifacts: DataFrame, edges: DataFrame) -> None:
    """Fail loudly on any value outside its enum, naming a few of them."""
    found = enum_violations(artifacts, edges).orderBy(F.desc("rows")).limit(5).collect()
    if found:
        raise QualityError(
            "values outside their enum: "
            + ", ".join(f"{r['field']}={r['value']!r} ({r['rows']} rows)" for r in found)
        )


def reasons(artifacts: DataFrame) -> DataFrame:
    """Adds ``reason``: what the stored model does not allow about a row, NULL for a row it allows."""

    def outside(field: str, allowed: tuple[str, ...]) -> Column:
        known = F.coalesce(F.col(field).isin(*allowed), F.lit(False))
        return F.when(~known, F.concat(F.lit(f"{field} "), F.coalesce(F.col(field), F.lit("missing"))))

    found = F.concat_ws(
        "; ",
        F.when(F.coalesce("id", F.lit("")) == "", "no id"),
        outside("kind", ARTIFACT_KINDS), outside("source", ARTIFACT_SOURCES),
        F.when(F.col("created_at").isNull(), "no time"),
    )
    return artifacts.withColumn("reason", F.when(found != "", found))


def well_formed(artifacts: DataFrame) -> DataFrame:
    """Artifacts without an id, with an unknown kind, and all of them."""
    return artifacts.agg(
        F.count_if(F.coalesce("id", F.lit("")) == "").alias("null_ids"),
        F.count_if(~F.coalesce(F.col("kind").isin(*ARTIFACT_KINDS), F.lit(False))).alias("bad_kinds"),
        F.count("*").alias("rows"),
    )


def dangling_edges(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is neither an artifact nor a person or topic; each once.

    The ends are looked up one after the other. Equal keys meet at the second lookup, so what is left is
    made distinct there, without a shuffle of its own; an artifact that repeats adds nothing either.
    """
    looked_up = edges
    dangling = F.lit(False)
    for end in ("src_id", "dst_id"):
        known = artifacts.select(F.col("id").alias(f"_{end}"))
        looked_up = looked_up.join(known, F.col(end) == F.col(f"_{end}"), "left")
        named = ids.is_person(F.col(end)) | ids.is_topic(F.col(end))
        dangling = dangling | (F.col(end).isNotNull() & ~named & F.col(f"_{end}").isNull())
    return looked_up.filter(dangling).select(edges.columns).dropDuplicates(EDGE_KEY)


def referential_integrity(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: dangling edges and all edges."""
    return dangling_edges(artifacts, edges).agg(F.count("*").alias("dangling_edges")).withColumn(
        "edges", edges.agg(F.count("*")).scalar()
    )


def embedding_coverage(artifacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: artifacts, embedded, and whether every artifact can have a vector."""
    return (
        artifacts.agg(F.count("*").alias("artifacts"))
        .withColumn("embedded", vectors.agg(F.count("*")).scalar())
        .withColumn("passed", F.col("embedded") >= F.col("artifacts"))
    )
