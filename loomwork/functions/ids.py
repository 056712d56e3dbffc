"""Identity: stable ids of artifacts and people, and the names people are shown by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character the id rules treat as white space when trimming.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(col: Column) -> Column:
    """Trim white space on both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def digest40(*parts: Column) -> Column:
    """First 40 hex digits of the sha256 of the parts joined by '|'; NULL if any part is NULL."""
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("|"), part)
    return F.substring(F.sha2(joined, 256), 1, 40)


def artifact_id(source: str, kind: str, key: Column) -> Column:
    """``kind:digest`` of an artifact's natural key."""
    return F.concat(F.lit(f"{kind}:"), digest40(F.lit(source), F.lit(kind), key))


def natural_key(repo: Column, name: Column) -> Column:
    """What a file or commit is known by: its repo with its path or sha."""
    return F.concat(repo, F.lit(":"), name)


def file_id_of_key(key: Column) -> Column:
    return artifact_id("git", "file", key)


def file_id(repo: Column, path: Column) -> Column:
    return file_id_of_key(natural_key(repo, path))


def commit_id(repo: Column, sha: Column) -> Column:
    return artifact_id("git", "commit", natural_key(repo, sha))


def commit_key(repo: Column, sha: Column) -> Column:
    """``kind:natural key`` of a commit. Such names stand for ids where rows are joined and grouped: they are
    shorter than digests and pack better. ``id_of`` makes the id of one."""
    return F.concat(F.lit("commit:"), natural_key(repo, sha))


def file_key(repo: Column, path: Column) -> Column:
    return F.concat(F.lit("file:"), natural_key(repo, path))


def session_key(key: Column) -> Column:
    return F.concat(F.lit("ai_session:"), key)


def message_key(session: Column, uuid: Column) -> Column:
    return F.concat(F.lit("ai_message:"), session, F.lit(":"), uuid)


def id_of(name: Column) -> Column:
    """The id of an artifact named by its key; people and topics are named by their ids."""
    kind = F.substring_index(name, ":", 1)
    source = F.when(kind.isin("commit", "file"), "git").otherwise("claude_code")
    made = F.concat(kind, F.lit(":"), digest40(source, kind, F.substr(name, F.length(kind) + 2)))
    return F.when(kind.isin("commit", "file", "ai_session", "ai_message"), made).otherwise(name)


def with_ids(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with ids in the columns that hold names by key."""
    return df.withColumns({c: id_of(F.col(c)) for c in names})


def same(name: Column) -> Column:
    """For frames that hold ids already."""
    return name


def packed(name: Column) -> Column:
    """An id as bytes, for shuffles: 20 in place of the 40 digits of its digest, and any other name as it is.

    The first byte tells the two apart, so different names stay different. ``unpacked`` is the way back.
    """
    # Short expressions: the JVM interprets generated methods that are long.
    digest = F.substring(name, -40, 40)
    kind = F.substr(name, F.lit(1), F.length(name) - 40).cast("binary")
    return F.when(digest.rlike("\\A[0-9a-f]{40}\\z"), F.concat(F.lit(bytearray(b"\x01")), kind, F.unhex(digest))).otherwise(
        F.concat(F.lit(bytearray(b"\x00")), name.cast("binary"))
    )


def unpacked(name: Column) -> Column:
    size = F.octet_length(name)
    whole = F.concat(F.substr(name, F.lit(2), size - 21).cast("string"), F.lower(F.hex(F.substring(name, -20, 20))))
    return F.when(F.substring(name, 1, 1) == F.lit(bytearray(b"\x01")), whole).otherwise(
        F.substr(name, F.lit(2), size).cast("string")
    )


def pack(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with ids as bytes. No id is no bytes: a column that cannot be NULL needs no filter before a join, which
    would make every digest once more only to test it."""
    return df.withColumns({c: F.coalesce(packed(F.col(c)), F.lit(bytearray())) for c in names})


def unpack(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: unpacked(F.nullif(F.col(c), F.lit(bytearray()))) for c in names})


def session_id(key: Column) -> Column:
    return artifact_id("claude_code", "ai_session", key)


def message_id(session: Column, uuid: Column) -> Column:
    return artifact_id("claude_code", "ai_message", F.concat(session, F.lit(":"), uuid))


def normalize_actor(actor: Column) -> Column:
    """The e-mail in angle brackets if there is one, else the whole string; trimmed, lower case."""
    email = F.regexp_extract(actor, "<([^>]+)>", 1)
    return F.lower(strip(F.when(email != "", email).otherwise(actor)))


def person_id(actor: Column) -> Column:
    return F.concat(F.lit("person:"), digest40(F.lit("person"), normalize_actor(actor)))


def known_person_id(actor: Column) -> Column:
    """``person_id`` of an actor known to be there. Declared not NULL, so that a join on it does
    not make the optimizer test the digest of every row once more."""
    return F.coalesce(person_id(actor), F.lit(""))


def name_part(actor: Column) -> Column:
    """Text before the first '<', trimmed."""
    return strip(F.substring_index(actor, "<", 1))


def person_display(actor: Column) -> Column:
    """Shown name: the name part, else the whole actor, else 'unknown'."""
    return F.coalesce(F.nullif(name_part(actor), F.lit("")), F.nullif(actor, F.lit("")), F.lit("unknown"))


def is_person(node: Column) -> Column:
    return node.startswith("person:")


def is_topic(node: Column) -> Column:
    return node.startswith("topic:")
