"""Silver tables from a commit log and a file tree: artifacts and the edges between them.

Input frames
  commits  repo, sha, actor, authored_at, message[, branch, files_changed, insertions, deletions]
  touches  repo, sha, path, authored_at           one row per changed path of a commit
  tree     repo, path[, head_at, ...]             files that exist now
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import ids, text
from loomwork.schemas import ARTIFACTS, EDGES, conform

# Fixed value: commits that change more files make no co_edited edges.
MAX_COEDIT_FILES = 25


def _edges(df: DataFrame, src: Column, dst: Column, relation: str, weight: Column | None = None) -> DataFrame:
    return df.select(
        src.alias("src_id"),
        dst.alias("dst_id"),
        F.lit(relation).alias("relation"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"),
        text.to_utc(F.col("created_at")).alias("created_at"),
    )


def latest_commits(commits: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` commits of each repo."""
    newest = Window.partitionBy("repo").orderBy(F.desc("authored_at"), "sha")
    return commits.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def touches_of(commits: DataFrame) -> DataFrame:
    """One row per changed path, from commits that carry them as an array ``changed``."""
    return commits.select("repo", "sha", F.explode("changed").alias("path"), "authored_at")


def commit_artifacts(commits: DataFrame) -> DataFrame:
    message = text.strip(F.coalesce("message", F.lit("")))
    title = text.commit_title(message, F.col("sha"))
    details = [c for c in ("branch", "files_changed", "insertions", "deletions") if c in commits.columns]
    extra = F.to_json(
        F.struct(F.col("sha").alias("hexsha"), *details), {"ignoreNullFields": "false"}
    )
    return conform(
        commits.select(
            ids.commit_id(F.col("repo"), F.col("sha")).alias("id"),
            F.lit("commit").alias("kind"),
            F.lit("git").alias("source"),
            "repo",
            "actor",
            text.to_utc(F.col("authored_at")).alias("created_at"),
            title.alias("title"),
            F.when(message != "", message).otherwise(title).alias("text"),
            F.col("sha").alias("content_hash"),
            extra.alias("extra"),
        ),
        ARTIFACTS,
    )


def authored_commits(commits: DataFrame, commit_id: Callable[[Column, Column], Column] = ids.commit_id) -> DataFrame:
    """person -> commit; commits without an author have no such edge."""
    known = commits.filter(F.col("actor").isNotNull()).withColumnRenamed("authored_at", "created_at")
    return _edges(
        known, ids.person_id(F.col("actor")), commit_id(F.col("repo"), F.col("sha")), "authored"
    )


def present_keys(touches: DataFrame, tree: DataFrame) -> DataFrame:
    """Distinct (repo, sha, path) whose path still exists, and the newest time: what the ids are made from."""
    alive = touches.join(tree.select("repo", "path"), ["repo", "path"], "left_semi")
    return alive.groupBy("repo", "sha", "path").agg(F.max("authored_at").alias("created_at"))


def touch_ids(keys: DataFrame) -> DataFrame:
    """The ids of ``present_keys``. They are far wider than the keys, so tables hold the keys."""
    return keys.select(
        ids.commit_id(F.col("repo"), F.col("sha")).alias("commit_id"),
        ids.file_id(F.col("repo"), F.col("path")).alias("file_id"),
        "created_at",
    )


def present_touches(touches: DataFrame, tree: DataFrame) -> DataFrame:
    """Distinct (commit, path) whose path still exists, with both ids."""
    return touch_ids(present_keys(touches, tree))


def modified(present: DataFrame) -> DataFrame:
    """commit -> file."""
    return _edges(present, F.col("commit_id"), F.col("file_id"), "modified")


def _files_per_commit(present: DataFrame) -> DataFrame:
    return present.groupBy("commit_id").agg(F.count("*").alias("n_files"))


def co_edit_pairs(present: DataFrame, max_files: int = MAX_COEDIT_FILES) -> DataFrame:
    """a, b, commit_id, created_at: the pairs of files (a < b) that each commit of up to ``max_files`` files changed.

    Sprawling commits are left out by rule, so a commit yields at most
    ``max_files * (max_files - 1) / 2`` pairs. They are dropped by their count before any list
    of files is built.
    """
    small = _files_per_commit(present).filter(F.col("n_files").between(2, max_files))
    groups = (
        present.join(small, "commit_id", "left_semi")
        .groupBy("commit_id")
        .agg(F.array_sort(F.collect_list("file_id")).alias("files"), F.max("created_at").alias("created_at"))
    )
    return groups.select("commit_id", "files", "created_at", F.posexplode("files").alias("i", "a")).select(
        "a", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("b"), "commit_id", "created_at"
    )


def pair_edges(counted: DataFrame) -> DataFrame:
    """Edges of a, b, n, created_at."""
    return _edges(counted, F.col("a"), F.col("b"), "co_edited", F.col("n"))


def co_edit_counts(present: DataFrame, max_files: int = MAX_COEDIT_FILES) -> DataFrame:
    """a, b, n, created_at: in how many commits each pair of files occurs, and when last."""
    return co_edit_pairs(present, max_files).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.max("created_at").alias("created_at")
    )


def co_edited(present: DataFrame, max_files: int = MAX_COEDIT_FILES) -> DataFrame:
    """file -- file changed by the same commit; weight = number of such commits."""
    return pair_edges(co_edit_counts(present, max_files))


def co_edit_key_counts(keys: DataFrame, max_files: int = MAX_COEDIT_FILES) -> DataFrame:
    """``co_edit_counts`` of ``present_keys``, where a and b are the natural keys that the ids are digests of.

    There are several pairs for each touch, so the pairs are dealt and counted by the short keys.
    """
    named = keys.select(
        ids.natural_key(F.col("repo"), F.col("sha")).alias("commit_id"),
        ids.natural_key(F.col("repo"), F.col("path")).alias("file_id"),
        "created_at",
    )
    return co_edit_counts(named, max_files)


def key_pair_edges(counted: DataFrame) -> DataFrame:
    """The edges of ``co_edit_key_counts``; ends are in the order of their ids, as ``co_edited`` has them."""
    a, b = (ids.file_id_of_key(F.col(c)) for c in ("a", "b"))
    ends = counted.select(a.alias("x"), b.alias("y"), "n", "created_at")
    return pair_edges(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n", "created_at"))


def sprawling(present: DataFrame, max_files: int = MAX_COEDIT_FILES) -> DataFrame:
    """commit_id, n_files of the commits the fan-out bound leaves out."""
    return _files_per_commit(present).filter(F.col("n_files") > max_files)


def co_edit_skipped(present: DataFrame, max_files: int = MAX_COEDIT_FILES) -> DataFrame:
    """How many commits the fan-out bound leaves out."""
    return _files_per_commit(present).agg(F.count_if(F.col("n_files") > max_files).alias("skipped"))


def last_touch(touches: DataFrame, tree: DataFrame) -> DataFrame:
    """Newest commit time per current file, else the time of the head commit."""
    newest = touches.groupBy("repo", "path").agg(F.max("authored_at").alias("touched_at"))
    return tree.join(newest, ["repo", "path"], "left").withColumn(
        "last_touch", F.coalesce("touched_at", "head_at")
    ).drop("touched_at")


def recent_titles(
    present: DataFrame, commits: DataFrame, n: int | None = None, commit_id: Callable[[Column, Column], Column] = ids.commit_id
) -> DataFrame:
    """The distinct commit titles of each file, newest first, or the first ``n``: file_id, titles.

    ``commit_id``: how ``present`` names commits.
    """
    titled = commits.select(
        commit_id(F.col("repo"), F.col("sha")).alias("commit_id"),
        text.commit_title(text.strip(F.coalesce("message", F.lit(""))), F.col("sha")).alias("title"),
    )
    distinct = (
        present.join(titled, "commit_id")
        .groupBy("file_id", "title")
        .agg(F.max("created_at").alias("at"))
    )
    if n is not None:
        newest = Window.partitionBy("file_id").orderBy(F.desc("at"), "title")
        distinct = distinct.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)
    age = -F.unix_micros(F.col("at").cast("timestamp"))
    return distinct.groupBy("file_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(age.alias("age"), "title"))), lambda t: t["title"]).alias("titles")
    )


def file_artifacts(
    files: DataFrame, titles: DataFrame | None = None, file_id: Callable[[Column, Column], Column] = ids.file_id
) -> DataFrame:
    """File rows. ``files``: repo, path, created_at, said, content_hash, object_uri, extra.

    With ``titles``, which name files by ``file_id``, the text also lists the commits that touched the file.
    """
    rows = files.withColumn("id", file_id(F.col("repo"), F.col("path")))
    heard = F.lit(None).cast("string")
    if titles is not None:
        rows = rows.join(titles.withColumnRenamed("file_id", "id"), "id", "left")
        heard = F.when(
            F.size("titles") > 0,
            F.concat(F.lit("Commits that touched this file:\n- "), F.array_join("titles", "\n- ")),
        )
    return conform(
        rows.withColumn("kind", F.lit("file"))
        .withColumn("source", F.lit("git"))
        .withColumn("actor", F.lit(None).cast("string"))
        .withColumn("created_at", text.to_utc(F.col("created_at")))
        .withColumn("title", F.col("path"))
        .withColumn("text", text.compose(F.col("path"), F.col("said"), heard)),
        ARTIFACTS,
    )


def file_index(tree: DataFrame, file_id: Callable[[Column, Column], Column] = ids.file_id) -> DataFrame:
    """Absolute path -> file id. ``tree`` carries the ``root`` its paths are relative to."""
    return tree.select(
        text.absolute_path(F.col("path"), F.col("root")).alias("abspath"),
        file_id(F.col("repo"), F.col("path")).alias("file_id"),
    )


def union_edges(*frames: DataFrame) -> DataFrame:
    out = conform(frames[0], EDGES)
    for frame in frames[1:]:
        out = out.unionByName(conform(frame, EDGES))
    return out


def union_artifacts(*frames: DataFrame) -> DataFrame:
    out = conform(frames[0], ARTIFACTS)
    for frame in frames[1:]:
        out = out.unionByName(conform(frame, ARTIFACTS))
    return out
