"""Topics: the most widespread terms of the corpus, and who and what they concern.

Membership is carried as one bit mask per node (bit i = i-th topic) instead of one row per
(topic, node). Masks merge with ``bit_or``, so every shuffle is combined on the map side and a
term that half of the artifacts mention costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import ids, text
from loomwork.session import materialize

# How many topics there are, and in how many artifacts a term must occur.
MAX_TOPICS = 24
MIN_DF = 2
# A mask is one signed 64-bit integer.
MASK_BITS = 62

CORPUS_KINDS = ("commit", "ai_message", "ai_session")


def artifact_tokens(artifacts: DataFrame, extra_stopwords: Sequence[str] = ()) -> DataFrame:
    """Token sets of commits, messages and sessions: id, kind, actor, tokens."""
    return artifacts.filter(F.col("kind").isin(*CORPUS_KINDS)).select(
        "id",
        "kind",
        "actor",
        text.tokens(text.corpus_text(F.col("title"), F.col("text")), extra_stopwords).alias("tokens"),
    )


def topic_terms(tokens: DataFrame, n: int = MAX_TOPICS, min_df: int = MIN_DF) -> DataFrame:
    """The ``n`` terms found in most artifacts: term, df, bit. Ties go to the smaller term.

    Token sets are distinct and ids unique, so a plain count is the document frequency.
    """
    if not 0 < n <= MASK_BITS:
        raise ValueError(f"between 1 and {MASK_BITS} topics")
    chosen = (
        tokens.select(F.explode("tokens").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .filter(F.col("df") >= min_df)
        .orderBy(F.desc("df"), "term")
        .limit(n)
    )
    ranked = chosen.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("neg"), "term"))).alias("ranked")
    )
    return ranked.select(F.posexplode("ranked").alias("bit", "t")).select(
        F.col("t.term").alias("term"), (-F.col("t.neg")).alias("df"), "bit"
    )


def chosen(terms: DataFrame) -> list[str]:
    """The terms in bit order. There are at most ``MASK_BITS``, so they are fetched once and
    used as literals; plans over them stay flat."""
    rows = terms.orderBy("bit").limit(MASK_BITS).collect()
    return [r["term"] for r in rows]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def _array(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]).cast("array<string>")


def names(mask: Column, terms: Sequence[str]) -> Column:
    """The terms whose bit is set, in alphabetical order."""
    by_name = sorted(range(len(terms)), key=lambda i: terms[i])
    held = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(terms[i])) for i in by_name]
    return F.array_compact(F.array(*held).cast("array<string>"))


def artifact_masks(tokens: DataFrame, terms: Sequence[str]) -> DataFrame:
    """id, kind, actor, mask of the artifacts that mention any topic."""
    listed = _array(terms)
    mask = F.aggregate(
        F.array_intersect("tokens", listed),
        F.lit(0).cast("long"),
        lambda acc, t: acc.bitwiseOR(_bit(F.array_position(listed, t) - 1)),
    )
    return tokens.select("id", "kind", "actor", mask.alias("mask")).filter("mask <> 0")


@dataclass(frozen=True)
class TopicMembers:
    """``terms`` and the masks of artifacts, people, sessions and files (node, mask)."""

    terms: list[str]
    artifacts: DataFrame
    people: DataFrame
    sessions: DataFrame
    files: DataFrame


def members(
    artifacts: DataFrame,
    edges: DataFrame,
    tokens: DataFrame | None = None,
    terms: list[str] | None = None,
) -> TopicMembers:
    """Which people, sessions and files each topic concerns.

    A commit speaks for its author and the files it modified, a session for itself and its
    person, a message for its session and that session's person.
    """
    tokens = artifact_tokens(artifacts) if tokens is None else tokens
    terms = chosen(topic_terms(tokens)) if terms is None else terms
    masks = artifact_masks(tokens, terms)

    commits = masks.filter("kind = 'commit'")
    own = masks.filter("kind = 'ai_session'").select(F.col("id").alias("node"), "mask")
    of_session = edges.filter("relation = 'message_of_session'").select(
        F.col("src_id").alias("id"), F.col("dst_id").alias("node")
    )
    heard = masks.filter("kind = 'ai_message'").join(of_session, "id").select("node", "mask")
    sessions = own.unionByName(heard).groupBy("node").agg(F.bit_or("mask").alias("mask"))

    runners = artifacts.filter("kind = 'ai_session' AND actor <> ''").select(
        F.col("id").alias("node"), ids.known_person_id(F.col("actor")).alias("person")
    )
    people = (
        commits.filter("actor <> ''")
        .select(ids.known_person_id(F.col("actor")).alias("person"), "mask")
        .unionByName(sessions.join(runners, "node").select("person", "mask"))
        .groupBy(F.col("person").alias("node"))
        .agg(F.bit_or("mask").alias("mask"))
    )

    changed = edges.filter("relation = 'modified'").select(
        F.col("src_id").alias("id"), F.col("dst_id").alias("node")
    )
    files = (
        commits.select("id", "mask").join(changed, "id")
        .groupBy("node").agg(F.bit_or("mask").alias("mask"))
    )
    return TopicMembers(terms, masks, people, sessions, files)


def stored(m: TopicMembers) -> TopicMembers:
    """The same members from written tables, for callers that read them more than once."""
    return TopicMembers(
        m.terms, *[materialize(df, "members") for df in (m.artifacts, m.people, m.sessions, m.files)]
    )


def explode_mask(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row per (node, topic): adds ``term``."""
    return df.withColumn("term", F.explode(names(F.col("mask"), terms)))


def member_rows(m: TopicMembers) -> DataFrame:
    """The whole membership as rows: topic, member_kind, member."""

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return explode_mask(df, m.terms).select(
            F.col("term").alias("topic"), F.lit(kind).alias("member_kind"), F.col("node").alias("member")
        )

    return (
        rows(m.people, "person")
        .unionByName(rows(m.sessions, "ai_session"))
        .unionByName(rows(m.files, "file"))
    )


def connected_terms(m: TopicMembers) -> DataFrame:
    """Terms that concern at least one person, session or file."""
    reach = (
        m.people.select("mask")
        .unionByName(m.sessions.select("mask"))
        .unionByName(m.files.select("mask"))
        .agg(F.coalesce(F.bit_or("mask"), F.lit(0).cast("long")).alias("mask"))
    )
    return explode_mask(reach, m.terms).select("term")
