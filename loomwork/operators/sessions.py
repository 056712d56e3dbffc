"""Silver tables from assistant transcripts.

Input frame ``records``: one row per transcript line
  file, block, seq   the transcript, and where the line stands in it (block rises with seq)
  rtype, session_id, cwd, branch, ai_title, ts, uuid, role, text, paths, tool_result
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import ids, text
from loomwork.operators import ordered
from loomwork.schemas import ARTIFACTS, EDGES, conform


def headers(records: DataFrame) -> DataFrame:
    """One row per transcript: the first non-empty id, folder, branch and title, and its span.

    Transcripts without any time are dropped here; ``unusable`` counts them.
    """
    at = F.struct("block", "seq")

    def first(col: str, where: Column | None = None) -> Column:
        value = text.blank_to_null(F.col(col))
        if where is not None:
            value = F.when(where, value)
        return F.min_by(value, F.when(value.isNotNull(), at)).alias(col)

    return (
        records.groupBy("file")
        .agg(
            first("session_id"),
            first("cwd"),
            first("branch"),
            first("ai_title", F.col("rtype") == "ai-title"),
            F.min("ts").alias("created_at"),
            F.max("ts").alias("ended_at"),
        )
        .filter(F.col("created_at").isNotNull())
        .withColumn("session_id", F.coalesce("session_id", file_stem(F.col("file"))))
        .withColumn("session", ids.session_id(F.col("session_id")))
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), "\\.jsonl$", "")


def unusable(records: DataFrame) -> DataFrame:
    """Number of transcripts skipped because no line has a time."""
    return (
        records.groupBy("file").agg(F.max("ts").alias("ts"))
        .agg(F.count_if(F.col("ts").isNull()).alias("skipped_files"))
    )


def _turns(records: DataFrame) -> DataFrame:
    return records.filter(F.col("rtype").isin("user", "assistant"))


def kept_turns(records: DataFrame) -> DataFrame:
    """Turns that become messages, numbered in file order from 0."""
    said = F.col("text") != ""
    prompt = (F.col("rtype") == "user") & ~F.col("tool_result") & ~text.is_noise(F.col("text"))
    kept = _turns(records).filter(said & (prompt | (F.col("rtype") == "assistant")))
    return ordered.row_number(kept, ["file"], "block", ["seq"], "n")


def messages(
    turns: DataFrame, heads: DataFrame, local_actor: Column, chars: int | None = None,
    message_id: Callable[[Column, Column], Column] = ids.message_id,
) -> DataFrame:
    """Message artifacts plus their session: the artifact columns and ``session``, ``n``, ``file``."""
    wanted = ("file", "session", "session_id", "created_at", "actor")
    rows = turns.drop("session_id", "cwd", "branch", "ai_title").join(
        heads.select(*[c for c in wanted if c in heads.columns]), "file"
    )
    role = F.coalesce(text.blank_to_null(F.col("role")), F.col("rtype"))
    uuid = F.coalesce(
        text.blank_to_null(F.col("uuid")), F.concat("session_id", F.lit(":"), F.col("n").cast("string"))
    )
    extra = F.to_json(F.struct("session_id", role.alias("role"), uuid.alias("uuid")))
    return rows.select(
        message_id(F.col("session_id"), uuid).alias("id"),
        F.lit("ai_message").alias("kind"),
        F.lit("claude_code").alias("source"),
        F.lit(None).cast("string").alias("repo"),
        F.when(role == "assistant", "assistant").otherwise(local_actor).alias("actor"),
        F.coalesce("ts", "created_at").alias("created_at"),
        text.clip(F.col("text"), text.MESSAGE_TITLE).alias("title"),
        text.clip(F.col("text"), chars).alias("text"),
        extra.alias("extra"),
        "session",
        "file",
        "n",
        (F.col("rtype") == "user").alias("is_prompt"),
    )


def first_prompts(turns: DataFrame, chars: int | None = None) -> DataFrame:
    """The first kept user text of each transcript: file, first_prompt.

    The position is found on two narrow columns; only that one text per file is then fetched.
    """
    user = turns.filter(F.col("rtype") == "user")
    where = user.groupBy("file").agg(F.min("n").alias("n"))
    return user.join(where, ["file", "n"], "left_semi").select(
        "file", text.clip(F.col("text"), chars).alias("first_prompt")
    )


def session_artifacts(turns: DataFrame, heads: DataFrame, local_actor: Column) -> DataFrame:
    counts = turns.groupBy("file").agg(F.count("*").alias("n_messages"))
    rows = (
        heads.join(first_prompts(turns), "file", "left")
        .join(counts, "file", "left")
        .withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    )
    prompt = F.col("first_prompt")
    title = F.coalesce(
        F.col("ai_title"),
        text.clip(prompt, text.MESSAGE_TITLE),
        F.concat(F.lit("session "), text.clip(F.col("session_id"), 8)),
    )
    extra = F.to_json(
        F.struct(
            "session_id",
            "cwd",
            "branch",
            F.col("n_messages").alias("messages"),
            text.iso_utc(F.col("ended_at")).alias("ended_at"),
            F.col("file").alias("source_file"),
        ),
        {"ignoreNullFields": "false"},
    )
    uri = F.col("object_uri") if "object_uri" in heads.columns else F.lit(None).cast("string")
    return conform(
        rows.select(
            F.col("session").alias("id"),
            F.lit("ai_session").alias("kind"),
            F.lit("claude_code").alias("source"),
            text.blank_to_null(
                F.substring_index(F.regexp_replace("cwd", "/+$", ""), "/", -1)
            ).alias("repo"),
            local_actor.alias("actor"),
            "created_at",
            text.clip(title, text.SESSION_TITLE).alias("title"),
            text.compose(title, prompt).alias("text"),
            uri.alias("object_uri"),
            extra.alias("extra"),
        ),
        ARTIFACTS,
    )


def message_of_session(msgs: DataFrame) -> DataFrame:
    """message -> session."""
    return conform(
        msgs.select(
            F.col("id").alias("src_id"),
            F.col("session").alias("dst_id"),
            F.lit("message_of_session").alias("relation"),
            F.lit(1.0).alias("weight"),
            "created_at",
        ),
        EDGES,
    )


def authored_sessions(heads: DataFrame, local_actor: Column) -> DataFrame:
    """person -> session."""
    return conform(
        heads.filter(local_actor.isNotNull()).select(
            ids.person_id(local_actor).alias("src_id"),
            F.col("session").alias("dst_id"),
            F.lit("authored").alias("relation"),
            F.lit(1.0).alias("weight"),
            "created_at",
        ),
        EDGES,
    )


def ai_touched(records: DataFrame, heads: DataFrame, index: DataFrame) -> DataFrame:
    """session -> file named by its tool calls; weight = number of references.

    References are counted per (transcript, raw path) before the folder of the session and the
    file index are joined, so a path named a million times crosses the shuffle once per task.
    """
    named = (
        _turns(records)
        .select("file", F.explode("paths").alias("raw"))
        .groupBy("file", "raw")
        .agg(F.count("*").alias("n"))
    )
    resolved = (
        named.join(heads.select("file", "session", "cwd", "created_at"), "file")
        .withColumn("abspath", text.absolute_path(F.col("raw"), F.col("cwd")))
        .join(index, "abspath")
    )
    counted = resolved.groupBy("session", "file_id").agg(
        F.sum("n").alias("n"), F.min("created_at").alias("created_at")
    )
    return conform(
        counted.select(
            F.col("session").alias("src_id"),
            F.col("file_id").alias("dst_id"),
            F.lit("ai_touched_file").alias("relation"),
            F.col("n").cast("double").alias("weight"),
            "created_at",
        ),
        EDGES,
    )


@dataclass(frozen=True)
class SessionTables:
    artifacts: DataFrame
    edges: DataFrame


def build(records: DataFrame, index: DataFrame, local_actor: str) -> SessionTables:
    """Artifacts and edges of all transcripts of one local user."""
    actor = F.lit(local_actor)
    heads = headers(records)
    turns = kept_turns(records)
    msgs = messages(turns, heads, actor)
    artifacts = conform(msgs, ARTIFACTS).unionByName(session_artifacts(turns, heads, actor))
    edges = (
        message_of_session(msgs)
        .unionByName(authored_sessions(heads, actor))
        .unionByName(ai_touched(records, heads, index))
    )
    return SessionTables(artifacts, edges)
