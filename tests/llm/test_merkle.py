"""Manifests against a plain recursive tree."""

import hashlib
import zlib
from collections import Counter

import pytest
from odd_documents import frame, rows
from pyspark.sql import functions as F

from loomwork.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row, text)))


def tree(nodes):
    """The root and for each node its siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = i // 8 * 8
            path.append((nodes[run:i], nodes[i + 1 : run + 8]))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def by_hand(docs):
    """docs: doc_id, source, lang, n_chars, text."""
    langs = {}
    for d in docs:
        own = leaf(d[:4], d[4])
        low = d[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[4])
        shown = leaf(d[:4], low) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 else own
        langs.setdefault(d[2], []).append((d[0], own, shown))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subroots, low_paths = {}, {}
    for name in names:
        langs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        subroots[name], low_paths[name] = tree([r[1] for r in langs[name]])
    root, high_paths = tree([subroots[n] for n in names])
    out = Counter()
    for name, high in zip(names, high_paths):
        for (i, own, shown), low in zip(langs[name], low_paths[name]):
            proof, folded = "", shown
            for left, right in [*low, *high]:
                proof += "".join(left + right)
                folded = h(*left, folded, *right)
            out[(i, own, subroots[name], root, h(proof), folded, folded == root)] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(spark, docs, depth=4):
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    return Counter(tuple(r) for r in merkle.checked(df, depth).select(*COLUMNS).collect())


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "ROWS_PER_TASK", 30)
    langs = [None, "", "en", "en", "en", "en", "é", "z", *[f"x{i}" for i in range(9)]]
    docs = [(i, "s" if k % 5 else None, langs[k * 7 % len(langs)], k % 3 or None, t) for k, (i, t) in enumerate(rows())]
    docs += [(10_000 + i, "s", "en", 1, f"Text {i}") for i in range(530)] + [(2**60 + i, "S", "z", 1, "AB") for i in range(8)]
    want = by_hand(docs)
    assert got(spark, docs, depth) == want
    assert {k[6] for k in want} == {True, False}


def test_single_rows_and_empty_tables(spark):
    one = [(1, None, None, None, None)]
    assert got(spark, one) == by_hand(one)
    (row,) = got(spark, one)
    assert row[1] == row[2] == row[3] == h("1:1----") and row[4] == h("") and row[6]
    assert merkle.checked(frame(spark).limit(0)).collect() == []
    assert merkle.checked(frame(spark)).count() == len(rows())


def test_any_changed_column_is_found_and_nothing_else(spark):
    docs = [(i, "s", "en", i, f"text {i}") for i in range(70)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    shown = F.when(F.col("doc_id") == 33, F.lit("text 34")).otherwise(F.col("text"))
    found = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], shown=shown)
    assert [r.doc_id for r in found.where("not verified").collect()] == [33]
