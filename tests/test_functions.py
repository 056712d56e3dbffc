import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import files, ids, text


def h40(s):
    return hashlib.sha256(s.encode()).hexdigest()[:40]


def col_values(spark, values, fn, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {ddl}")
    return [r["v"] for r in df.select("i", fn(F.col("c")).alias("v")).orderBy("i").collect()]


def test_artifact_ids(spark):
    got = spark.range(1).select(
        ids.commit_id(F.lit("r"), F.lit("abc")), ids.file_id(F.lit("r"), F.lit("a/b.py")),
        ids.session_id(F.lit("s1")), ids.message_id(F.lit("s1"), F.lit("u")),
        ids.file_id(F.lit("r"), F.lit(None).cast("string")),
    ).first()
    assert list(got) == [
        "commit:" + h40("git|commit|r:abc"), "file:" + h40("git|file|r:a/b.py"),
        "ai_session:" + h40("claude_code|ai_session|s1"),
        "ai_message:" + h40("claude_code|ai_message|s1:u"), None,
    ]


def test_people_are_known_by_email(spark):
    actors = ["Ann <Ann@X.org>", "  ann <ann@x.org > ", "Ann Lee", " \tann lee\n", "< >"]
    keys = col_values(spark, actors, ids.normalize_actor)
    assert keys == ["ann@x.org", "ann@x.org", "ann lee", "ann lee", ""]
    assert col_values(spark, actors[:1], ids.person_id) == ["person:" + h40("person|ann@x.org")]


def test_display_names(spark):
    actors = ["Ann <a@x>", "<a@x>", "", None, "Bob"]
    assert col_values(spark, actors, ids.person_display) == ["Ann", "<a@x>", "unknown", "unknown", "Bob"]
    # The author mart uses the bare name part, without the fallback.
    assert col_values(spark, actors[:2], ids.name_part) == ["Ann", ""]


def test_tokens(spark):
    said = "The Parser-v2 parses C++ and F# in my_module; parser-v2! ab Émile x1y"
    assert sorted(col_values(spark, [said], text.tokens)[0]) == ["c++", "mile", "my_module", "parser-v2", "parses", "x1y"]
    assert col_values(spark, ["one two widget"], lambda c: text.tokens(c, ["widget"])) == [[]]


def test_commit_titles(spark):
    df = spark.createDataFrame(
        [("first\nsecond", "a" * 40), ("", "b" * 40), (None, "c" * 40), ("x" * 300, "d"), ("one\r\ntwo", "e")],
        "m string, sha string",
    )
    got = [r[0] for r in df.select(text.commit_title(F.col("m"), F.col("sha"))).collect()]
    assert got == ["first", "b" * 12, "c" * 12, "x" * 200, "one"]


def test_noise(spark):
    said = ["<system-reminder>x", "  \n<command-name>", "Caveat: y", "[Request interrupted by user]", "caveat: y", "hello"]
    assert col_values(spark, said, text.is_noise) == [True, True, True, True, False, False]


def test_iso_times(spark):
    got = col_values(
        spark,
        ["2024-05-01T10:00:00Z", "2024-05-01T12:00:00+02:00", "2024-05-01T10:00:00", "2024-05-01T10:00:00.5Z", "soon", None],
        lambda c: text.iso_utc(text.parse_iso(c)),
    )
    assert got == ["2024-05-01T10:00:00+00:00"] * 3 + ["2024-05-01T10:00:00.500000+00:00", None, None]


CONTENTS = [
    json.dumps("  plain [1,2] "),
    json.dumps([{"type": "text", "text": "a"}, {"type": "tool_use", "input": {"file_path": "/x", "path": "y", "notebook_path": ""}},
                {"type": "text", "text": 5}, {"type": "text", "text": "b"}, 7, {"type": "tool_use", "input": "no"}]),
    json.dumps({"type": "text", "text": "lost"}),
    json.dumps([{"type": "tool_use", "input": {"path": 3}}]),
    "null",
]


def test_block_text_and_tool_paths(spark):
    assert col_values(spark, CONTENTS, lambda c: text.block_text(F.parse_json(c))) == ["plain [1,2]", "a\nb", "", "", ""]
    assert col_values(spark, CONTENTS, lambda c: text.tool_paths(F.parse_json(c))) == [[], ["/x", "y"], [], [], []]


def test_absolute_path(spark):
    df = spark.createDataFrame(
        [("/a/./b/../c.py", "/w"), ("b//c", "/w/x/"), ("../../../z", "/w"), ("rel", None), ("rel", "")],
        "p string, cwd string",
    )
    got = [r[0] for r in df.select(text.absolute_path(F.col("p"), F.col("cwd"))).collect()]
    assert got == ["/a/c.py", "/w/x/b/c", "/z", None, None]


def test_compose_drops_blank_parts(one):
    assert one({"a": "x"}, lambda: text.compose(F.col("a"), F.lit(""), F.lit(None), F.lit("y"))) == "x\n\ny"


def test_extensions(spark):
    paths = ["a.PY", "a.tar.gz", ".bashrc", "x/.env", "x.y/plain", "a.", "..a.b", "__init__.py"]
    assert col_values(spark, paths, files.extension) == [".py", ".gz", "", "", "", ".", ".b", ".py"]


def test_ignored_paths(spark):
    paths = ["src/a.py", "node_modules/x/a.js", "a/.git/config", ".env", "build", "a/build/x.py", "x.lock", "a/b.PARQUET", "lib/.hidden/a.py"]
    assert col_values(spark, paths, files.is_ignored) == [False, True, True, False, False, True, True, True, True]


def test_size_bounds(spark):
    sizes = [0, 1, 10, 1 << 40]
    assert col_values(spark, sizes, files.size_in_bounds, "long") == [False, True, True, True]
    assert col_values(spark, sizes, lambda c: files.size_in_bounds(c, 9), "long") == [False, True, False, False]


NB = json.dumps({"cells": [{"source": ["a = 1\n", "b"]}, {"source": "# t"}, {}]}).encode()
BYTES = [
    ("a.py", b"x = 1\n", "code", False, "x = 1"),
    ("a.md", "é".encode() * 5000, "text", False, "é" * 5000),
    ("a.py", b"x\x00y", "binary", True, "[binary file py, 3 bytes]"),
    ("a.txt", b"\xff\xfe", "binary", True, "[binary file txt, 2 bytes]"),
    ("noext", b"x" * 9000 + b"\x00", "binary", True, "[binary file no-ext, 9001 bytes]"),
    ("LICENSE", b"\x00", "binary", True, "[binary file no-ext, 1 bytes]"),
    ("a.png", b"\x89PNG", "image", True, "[image file png]"),
    ("a.pdf", b"%PDF", "pdf", True, "[pdf document, 4 bytes]"),
    ("a.ipynb", NB, "notebook", False, "a = 1\nb\n# t"),
    ("b.ipynb", b"not json", "binary", True, "[ipynb document, 8 bytes]"),
    ("c.ipynb", b"[1]", "binary", True, "[ipynb document, 3 bytes]"),
]


@pytest.mark.parametrize("path,content,modality,binary,said", BYTES)
def test_files_speak(spark, path, content, modality, binary, said):
    df = spark.createDataFrame([(path, bytearray(content))], "p string, c binary")
    df = df.withColumn("m", files.classify(F.col("p"), F.col("c"))).withColumn("n", F.octet_length("c").cast("long"))
    got = df.select("m", files.is_binary(F.col("m")), files.file_text(F.col("p"), F.col("c"), F.col("n"), F.col("m"))).first()
    assert tuple(got) == (modality, binary, said)


def test_file_extra_keeps_key_order(one):
    got = one({"p": "a.py"}, lambda: files.file_extra(F.col("p"), F.lit(3), F.lit("code"), streamed=F.lit(True)))
    assert got == '{"path":"a.py","size":3,"modality":"code","binary":false,"streamed":true}'
