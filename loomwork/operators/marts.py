"""The five gold marts."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import ids
from loomwork.operators import graph, topics
from loomwork.schemas import GOLD, conform
from loomwork.session import materialize

# Tasks that share the work of one topic when topic sets are paired.
PAIR_SALT = 32
# Topics up to which the holders of every set of topics are counted, and holders whose squares may be added as integers.
DENSE_BITS, SAFE_HOLDERS = 24, 1 << 21


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def daily_activity(artifacts: DataFrame) -> DataFrame:
    """Artifacts per UTC day, source and kind."""
    counted = artifacts.groupBy(F.to_date("created_at").alias("d"), "source", "kind").agg(
        F.count("*").alias("count")
    )
    return conform(counted.withColumn("day", day(F.col("d"))), GOLD["gold_daily_activity"])


def file_hotspots(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: commits that modified it, sessions that touched it, files edited with it.

    The three counts come from one pass over the edges: each edge contributes to its file end
    (both ends for co_edited), combined on the map side before one shuffle by file.
    """
    ends = F.when(F.col("relation") == "co_edited", F.array("src_id", "dst_id")).otherwise(
        F.array("dst_id")
    )
    counts = (
        edges.filter(F.col("relation").isin("modified", "ai_touched_file", "co_edited"))
        .select("relation", F.explode(ends).alias("file_id"))
        .groupBy("file_id")
        .agg(
            F.count_if(F.col("relation") == "modified").alias("times_modified"),
            F.count_if(F.col("relation") == "ai_touched_file").alias("ai_touches"),
            F.count_if(F.col("relation") == "co_edited").alias("coedit_degree"),
        )
    )
    return hotspot_rows(artifacts, counts)


def hotspot_rows(artifacts: DataFrame, counts: DataFrame) -> DataFrame:
    """Mart rows of file artifacts and the counts by file_id that exist."""
    files = artifacts.filter("kind = 'file'").select(
        F.col("id").alias("file_id"),
        "repo",
        F.col("title").alias("path"),
        F.coalesce(F.get_json_object("extra", "$.modality"), F.lit("unknown")).alias("modality"),
    )
    return conform(
        files.join(counts, "file_id", "left").fillna(
            0, ["times_modified", "ai_touches", "coedit_degree"]
        ),
        GOLD["gold_file_hotspots"],
    )


def author_activity(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per person with a commit or a session: how much, on how many files, from when to when."""
    targets = artifacts.select(F.col("id").alias("dst_id"), "kind", "created_at")
    authored = (
        edges.filter("relation = 'authored'")
        .select(F.col("src_id").alias("person_id"), "dst_id")
        .join(targets, "dst_id")
    )
    totals = author_totals(authored)
    own_commits = authored.filter("kind = 'commit'").select("person_id", F.col("dst_id").alias("src_id"))
    touched = (
        edges.filter("relation = 'modified'")
        .select("src_id", F.col("dst_id").alias("file_id"))
        .join(own_commits, "src_id")
        .groupBy("person_id", "file_id").agg(F.lit(1))
        .groupBy("person_id").agg(F.count("*").alias("files_touched"))
    )
    names = graph.person_names(artifacts, ids.name_part(F.col("actor"))).withColumnRenamed(
        "person", "person_id"
    )
    return author_rows(totals, touched, names)


def author_totals(authored: DataFrame) -> DataFrame:
    """Commits, sessions and times by person_id, from the kind and time of what each person authored."""
    return (
        authored.groupBy("person_id")
        .agg(
            F.count_if(F.col("kind") == "commit").alias("commits"),
            F.count_if(F.col("kind") == "ai_session").alias("ai_sessions"),
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("last_at"),
        )
        .filter("commits > 0 OR ai_sessions > 0")
    )


def author_rows(totals: DataFrame, touched: DataFrame, names: DataFrame) -> DataFrame:
    """Mart rows of the totals, the numbers of files and the names by person_id."""
    rows = totals.join(touched, "person_id", "left").join(names, "person_id", "left")
    return conform(
        rows.withColumn("name", F.coalesce("name", "person_id"))
        .withColumn("files_touched", F.coalesce("files_touched", F.lit(0)))
        .withColumn("first_activity", F.coalesce(day(F.col("first_at")), F.lit("")))
        .withColumn("last_activity", F.coalesce(day(F.col("last_at")), F.lit(""))),
        GOLD["gold_author_activity"],
    )


def topic_people(artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers) -> DataFrame:
    """Masks of the people who are graph nodes: those with an authored commit or session."""
    authors = graph.authored_targets(artifacts, edges).select(F.col("person").alias("node"))
    return m.people.join(authors, "node", "left_semi")


def topic_summary(
    artifacts: DataFrame,
    edges: DataFrame,
    m: topics.TopicMembers,
) -> DataFrame:
    """Per topic: artifacts that mention it, and the people, files and sessions it is about."""
    things = artifacts.filter(F.col("kind").isin("file", "ai_session")).select(F.col("id").alias("node"), "kind")
    people = graph.authored_targets(artifacts, edges).groupBy(F.col("person").alias("node")).agg(
        F.lit("person").alias("kind")
    )
    # Nodes are looked up with their masks, and masks counted, before a row becomes one per topic.
    masks = m.people.unionByName(m.sessions).unionByName(m.files)
    kinds = ("person", "file", "ai_session")
    counted = masks.join(things.unionByName(people), "node").groupBy("mask").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    )
    linked = (
        topics.explode_mask(counted, m.terms).groupBy(F.col("term").alias("topic"))
        .agg(*[F.sum(k).alias(n) for k, n in zip(kinds, ("n_people", "n_files", "n_sessions"))])
    )
    mentioned = (
        topics.explode_mask(m.artifacts.groupBy("mask").agg(F.count("*").alias("n")), m.terms)
        .groupBy(F.col("term").alias("topic"))
        .agg(F.sum("n").alias("n_artifacts"))
        .join(topics.connected_terms(m).withColumnRenamed("term", "topic"), "topic", "left_semi")
    )
    return conform(
        mentioned.join(linked, "topic", "left").fillna(0, ["n_people", "n_files", "n_sessions"]),
        GOLD["gold_topic_summary"],
    )


def _pairs(rows: DataFrame, min_shared: int, kept: Column) -> DataFrame:
    """Pairs of rows whose masks share ``min_shared`` topics: their columns, named _a and _b, and shared; those ``kept``.

    Bits are numbered from the most widespread topic up, so a mask's highest bits are its rarest
    topics. Two masks that share s topics meet among the ``size - s + 1`` rarest of each, and a
    pair is produced only on the rarest topic both hold: it appears once, and nothing is left to
    deduplicate. Each topic is salted over ``PAIR_SALT`` tasks, so a topic that everybody has
    does not end up in one of them.
    """
    held = "reverse(filter(sequence(0, 62), i -> mask & shiftleft(1L, i) <> 0))"
    rare = rows.filter(F.bit_count("mask") >= min_shared).withColumn(
        "bit", F.explode(F.expr(f"slice({held}, 1, bit_count(mask) - {int(min_shared) - 1})"))
    )
    left, right = (rare.withColumnsRenamed({c: f"{c}_{end}" for c in rows.columns}) for end in "ab")
    left = left.withColumn("salt", F.pmod(F.xxhash64(*[f"{c}_a" for c in rows.columns]), F.lit(PAIR_SALT)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALT - 1))))
    # The input is small and the work per row is not, so the number of tasks is set here instead
    # of following the size of the data.
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    # Copies and salts make the sides many times larger than estimated, so neither may be sent whole to the driver.
    left, right = (side.repartition(tasks, "bit", "salt").hint("merge") for side in (left, right))
    common = F.col("mask_a").bitwiseAND(F.col("mask_b"))
    rarest = F.call_function("shiftright", common, F.col("bit") + 1) == 0
    met = left.join(right, ["bit", "salt"]).filter(kept & rarest & (F.bit_count(common) >= min_shared))
    return met.withColumn("shared", common).drop("bit", "salt")


def _set_pairs(sets: DataFrame, min_shared: int = 1) -> DataFrame:
    """Unordered pairs of topic sets with ``min_shared`` common topics: mask_a <= mask_b, shared."""
    return _pairs(sets.select("mask"), min_shared, F.col("mask_a") <= F.col("mask_b"))


def _topic_list(df: DataFrame, terms: list[str]) -> DataFrame:
    """Adds shared_topics and topics (their names) of the mask ``shared``."""
    return df.withColumn("shared_topics", F.bit_count("shared").cast("long")).withColumn(
        "topics", F.array_join(topics.names(F.col("shared"), terms), ", ")
    )


def cross_silo(
    people: DataFrame, names: DataFrame, terms: list[str], min_shared: int = 1
) -> DataFrame:
    """Pairs of people (a < b) who share topics. ``people``: node, mask.

    The rows grow with the square of the people, so they are made by the last step: people meet on the rarest topic they
    share, and what is dealt before are copies of people, which grow with their number. No pair is dealt or stored.
    """
    named = people.join(names.withColumnRenamed("person", "node"), "node", "left").select(
        "mask", F.col("node").alias("person"), F.coalesce("name", "node").alias("name")
    )
    pairs = _topic_list(_pairs(named, min_shared, F.col("person_a") < F.col("person_b")), terms)
    return conform(
        pairs.withColumnsRenamed({"name_a": "person_a_name", "name_b": "person_b_name"}), GOLD["gold_cross_silo"]
    )


def set_sizes(people: DataFrame) -> DataFrame:
    """mask, n: how many people hold each topic set."""
    return people.groupBy("mask").agg(F.count("*").alias("n"))


def _superset_sums(table: np.ndarray) -> np.ndarray:
    """For each row number, the sum of the rows whose numbers hold all of its bits."""
    step = 1
    while step < len(table):
        halves = table.reshape(-1, 2, step, *table.shape[1:])
        halves[:, 0] += halves[:, 1]
        step *= 2
    return table


def shared_powers(sizes: DataFrame, bits: int) -> DataFrame:
    """size, total: over all sets of ``size`` topics out of ``bits``, the squared number of people who hold the set.

    So ``total`` counts each ordered pair of people once for every set of that size among the topics they
    share. The number of holders of all ``2 ** bits`` sets is summed over the low topics first, a task per
    choice of high ones, and then over the high topics: work and rows depend on the topics, not on the people.
    """
    low = bits // 2
    parts = 1 << min(low, 6)
    width = (1 << low) // parts

    def over_low(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(1 << low, np.int64)
        np.add.at(table, rows["cell"].to_numpy(), rows["n"].to_numpy())
        cells = _superset_sums(table).reshape(parts, width)
        return pd.DataFrame({"part": range(parts), "block": int(rows["block"].iloc[0]), "cells": [c.tobytes() for c in cells]})

    def over_high(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((1 << (bits - low), width), np.int64)
        table[rows["block"].to_numpy()] = [np.frombuffer(c, np.int64) for c in rows["cells"]]
        holders = _superset_sums(table)
        cell = int(rows["part"].iloc[0]) * width + np.arange(width)
        size = np.bitwise_count(np.arange(len(table)))[:, None].astype(int) + np.bitwise_count(cell)
        square = holders.astype(object) ** 2 if holders.max() >= SAFE_HOLDERS else holders**2
        totals = [int(square[size == k].sum()) for k in range(bits + 1)]
        return pd.DataFrame({"size": range(bits + 1), "total": [str(x) for x in totals]})

    block = F.shiftright("mask", low).alias("block")
    cells = sizes.select(block, F.col("mask").bitwiseAND(F.lit((1 << low) - 1)).alias("cell"), "n")
    summed = cells.groupBy("block").applyInPandas(over_low, "part int, block long, cells binary")
    squares = summed.groupBy("part").applyInPandas(over_high, "size int, total string")
    return squares.groupBy("size").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _pairs_sharing(powers: DataFrame, sizes: DataFrame, bits: int, min_shared: int) -> DataFrame:
    """rows: the pairs that share ``min_shared`` topics or more, by inclusion and exclusion over ``shared_powers``."""
    times = [sum((-1) ** (j - k) * comb(j, k) for k in range(min_shared, j + 1)) for j in range(bits + 1)]
    weight = F.element_at(F.array(*[F.lit(x).cast("decimal(20,0)") for x in times]), F.col("size") + 1)
    ordered = F.coalesce(F.sum(F.col("total").cast("decimal(27,0)") * weight), F.lit(0)).alias("ordered")
    own = sizes.agg(F.coalesce(F.sum(F.when(F.bit_count("mask") >= min_shared, F.col("n"))), F.lit(0)).alias("own"))
    return powers.agg(ordered).crossJoin(own).select(((F.col("ordered") - F.col("own")) / 2).cast("long").alias("rows"))


def cross_silo_size(sizes: DataFrame, min_shared: int = 1, bits: int | None = None) -> DataFrame:
    """How many rows ``cross_silo`` has, from the sizes of the topic sets alone.

    With ``bits`` topics or fewer, and these few enough, no pair of sets is formed (see ``shared_powers``).
    """
    if bits is not None and 0 < bits <= DENSE_BITS:
        return _pairs_sharing(shared_powers(sizes, bits), sizes, bits, min_shared)
    pairs = (
        _set_pairs(sizes.select("mask"), min_shared)
        .join(sizes.select(F.col("mask").alias("mask_a"), F.col("n").alias("na")), "mask_a")
        .join(sizes.select(F.col("mask").alias("mask_b"), F.col("n").alias("nb")), "mask_b")
    )
    rows = F.when(F.col("mask_a") == F.col("mask_b"), F.expr("na * (na - 1) div 2")).otherwise(
        F.col("na") * F.col("nb")
    )
    return pairs.agg(F.coalesce(F.sum(rows), F.lit(0).cast("long")).alias("rows"))


def partners(people: DataFrame, names: DataFrame, terms: list[str], person: str) -> DataFrame:
    """Everybody who shares a topic with one person; one scan of the people."""
    own = people.filter(F.col("node") == person).select(F.first("mask").alias("mask")).scalar()
    shared = F.col("mask").bitwiseAND(own)
    rows = people.withColumn("shared", shared).filter((F.col("node") != person) & (F.col("shared") != 0))
    named = rows.join(names.withColumnRenamed("person", "node"), "node", "left")
    return _topic_list(named, terms).select(
        F.col("node").alias("person"), F.coalesce("name", "node").alias("name"), "shared_topics", "topics"
    )


def gold_cross_silo(artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers) -> DataFrame:
    """The pairs read the people three times and their names twice, so these are stored: their joins are run once, and
    the tables that those broadcast are not held by the driver all at the same time."""
    people = materialize(topic_people(artifacts, edges, m), "topic_people")
    return cross_silo(people, materialize(graph.person_names(artifacts), "person_names"), m.terms)


def top_cross_silo(people: DataFrame, names: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of the pair mart by (shared_topics desc, person_a, person_b).

    Exact without building the mart. The number of shared topics is lowered from the largest set
    until enough pairs share that many; at a high number few sets are long enough and they meet
    on few topics. Between two sets only the ``k + 1`` smallest people of each can be in a pair
    that ranks among the first ``k``, because a later person is preceded by the ``k`` pairs its
    smaller set mates form with the same partner.
    """
    people = materialize(people, "topic_people")
    sizes = materialize(set_sizes(people), "topic_sets")
    bits = len(terms)
    if 0 < bits <= DENSE_BITS:
        powers = materialize(shared_powers(sizes, bits), "shared_powers")
        size = lambda shared: _pairs_sharing(powers, sizes, bits, shared)
    else:
        size = lambda shared: cross_silo_size(sizes, shared)
    least = max(sizes.agg(F.max(F.bit_count("mask"))).first()[0] or 1, 1)
    while least > 1 and size(least).first()["rows"] < k:
        least -= 1
    by_id = Window.partitionBy("mask").orderBy("node")
    few = (
        people.withColumn("_rn", F.row_number().over(by_id))
        .filter(F.col("_rn") <= k + 1)
        .select("node", "mask")
    )
    rows = cross_silo(few, names, terms, least)
    return rows.orderBy(F.desc("shared_topics"), "person_a", "person_b").limit(k)


def mart_builders(
    artifacts: DataFrame, edges: DataFrame, m: topics.TopicMembers | None
) -> dict[str, Callable[[], DataFrame]]:
    """The marts in build order, each as a deferred frame; only the marts of topics and of pairs read ``m``."""
    return {
        "gold_daily_activity": lambda: daily_activity(artifacts),
        "gold_file_hotspots": lambda: file_hotspots(artifacts, edges),
        "gold_author_activity": lambda: author_activity(artifacts, edges),
        "gold_topic_summary": lambda: topic_summary(artifacts, edges, m),
        "gold_cross_silo": lambda: gold_cross_silo(artifacts, edges, m),
    }
