"""Packing by exact round trip; trained models by held-out accuracy on the given tables."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_documents import frame, rows
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from loomwork.llm import language_id, packing, quality
from loomwork.llm import textbytes as tb
from loomwork.llm.queries import REGISTRY

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


def laid_out(pieces):
    """Asserts that sequences are gapless and not too long; returns how many there are."""
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def test_words_encode_like_whole_texts(monkeypatch):
    rng = random.Random(1)
    parts = ["a", "B", "é", "1", " ", " ", " ", "\n", "\t", ".", "'s", "the", " ", "　", "日本", "\x1c", "!", "<|endoftext|>", "😀", "\r", "\x85", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    encoder = packing.Encoder(PATH)
    whole = encoder.whole(texts)
    for most in (600_000, 100):
        monkeypatch.setattr(packing, "KNOWN_WORDS", most)
        for a in range(0, len(texts), 500):
            got = encoder.encode(*tb.text_bytes(pa.array(texts[a : a + 500])))
            assert [x.tolist() for x in got] == [x.tolist() for x in whole[a : a + 500]]
        encoder = packing.Encoder(PATH)


def library(path, texts):
    """Token ids by the library's plain call, with nothing set on the tokenizer."""
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_encode_as_in_the_library(tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.add_tokens(["the cat", "aa", AddedToken(" é", lstrip=True)])
    tokenizer.save(more := str(tmp_path / "more.json"))
    rng = random.Random(3)
    parts = ["a", "aa", "the", "cat", "é", "dog", " ", " ", " ", "\n", "<|endoftext|>", "<|endof", "text|>", "日本"]
    texts = ["end <|endoftext|> start", "a", "aa", ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    for path in (PATH, more):
        encoder, want = packing.Encoder(path), library(path, texts)
        for a in range(0, len(texts), 500):
            got = encoder.encode(*tb.text_bytes(pa.array(texts[a : a + 500])))
            assert [x.tolist() for x in got] == want[a : a + 500]


def test_added_tokens_in_pieces(spark):
    docs = [(1, "end <|endoftext|> start"), (2, "<|endoftext|>" * 1500), (3, "end start")]
    want = Counter()
    for (i, _), ids in zip(docs, library(PATH, [t for _, t in docs])):
        ids = ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = packing.pack(frame(spark, docs), PATH).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_pieces_round_trip(spark):
    pieces = packing.pack(frame(spark), PATH).collect()
    encoder = packing.Encoder(PATH)
    want = Counter()
    for i, t in rows():
        ids = encoder.whole([t or ""])[0].tolist() + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    assert laid_out(pieces) <= -(-sum(r.length for r in pieces) // 1024) + 1
    assert packing.pack(frame(spark).limit(0), PATH).count() == 0


def test_hot_lengths_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_BLOCK", 10)
    laid_out(packing.pack(frame(spark, [(i, "same words") for i in range(500)]), PATH).collect())


def test_plans_place_everything_tightly():
    rng = random.Random(2)
    for _ in range(30):
        top = rng.choice([100, 341, 600, 1024])
        counts = Counter(rng.randint(1, top) for _ in range(rng.randint(0, 4000)))
        sequences, placed = defaultdict(list), Counter()
        for length, first, last, sequence, per, offset in packing.plan(counts).tolist():
            placed[length] += last - first
            for k in range(last - first):
                sequences[sequence + k // per].append((offset + k % per * length, length))
        assert placed == counts
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        large = sum(n for length, n in counts.items() if length > 512)
        assert len(sequences) <= max(large, 1.01 * sum(k * n for k, n in counts.items()) / 1024 + 1) + large * 0.2
    assert len(packing.plan({600: 3, 400: 3, 24: 3})) == 3


@needs_tables
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = REGISTRY["op6_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_languages_of_odd_texts(spark):
    english = [(i, f"the cat and the dog number {i} went to the house with that", "en") for i in range(60)]
    german = [(100 + i, f"der Hund und die Katze gehen nicht über die Straße {i}", "de") for i in range(60)]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !!", "xx"), (903, "the cat and the dog " * 4000, None), (None, "und die Katze", None), (3, english[3][1], "en")]
    docs = spark.createDataFrame([*english, *german, *odd], "doc_id long, text string, lang string").repartition(3)
    net = language_id.train(docs)
    assert net.languages == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    assert [(got[i].lang__pred, got[i].lang__score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang__pred == "en" and got[None].lang__pred == "de"
    kept = language_id.identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang__pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), net).count() == 0


@needs_tables
def test_texts_that_no_language_explains_go_and_others_stay(spark):
    """Learned from the given documents: gibberish and unseen scripts go; short, mixed and marked-up prose stays."""
    import random

    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prose = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.struct(F.length("text") < 3000, F.length("text"))).alias("text")).collect()}
    mixed = " ".join(p[:1100] for p in prose.values())
    go = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)), "これは日本語の文章です。機械学習のデータを整理します。" * 5,
          "Это русский текст, который никогда не встречался при обучении модели. " * 4, "".join(rng.choice("0123456789abcdef") for _ in range(900)), "12 !! 7", None]
    stay = [mixed, *prose.values(), "word", "Hello there, how are you?", prose["en"] + " password = k3jh5k2jh45kjh2k4 +1 415 555 2671", "été", "A"]
    pairs = [(10**9 + i, t, None) for i, t in enumerate(go + stay)]
    more = spark.createDataFrame(pairs, "doc_id long, text string, lang string")
    kept = language_id.identified(docs.select("doc_id", "text", "lang").unionByName(more).withColumn("lang__pred", F.lit(1)).withColumn("text__read", F.lit(2)))
    assert {r.doc_id - 10**9 for r in kept.where("doc_id >= 1000000000").collect()} == set(range(len(go), len(go + stay)))
    assert kept.columns == ["doc_id", "text", "lang", "lang__pred", "text__read"]


def test_pooled_filters_equal_a_plain_convolution():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, n).tolist()) for n in (1, 5, 700)]
    windows = np.zeros((40, language_id.WINDOW + language_id.TAPS - 1), np.uint8)
    windows[:, : language_id.WINDOW] = rng.integers(97, 123, (40, language_id.WINDOW))
    net = language_id.fit(windows, np.arange(40) % 3, ["a", "b", "c"])
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    cut, text, size = language_id.windows_of(data, offs)
    assert [bytes(w[:n].tobytes()) for w, n in zip(cut, size)] == [texts[0], texts[1], texts[2][:512], texts[2][512:]]
    for window, found in zip(cut, net.probabilities(cut)):
        padded = np.concatenate([net.embedding[window], np.zeros((language_id.TAPS, language_id.DIMS))])
        best = []
        for f, bias in zip(net.filters.reshape(len(net.filters), language_id.TAPS, language_id.DIMS), net.bias):
            best.append(max(0, bias + max((padded[i : i + language_id.TAPS] * f).sum() for i in range(language_id.WINDOW))))
        raw = np.array(best) @ net.weights + net.shift
        assert np.allclose(np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum(), found, atol=1e-4)


@needs_tables
def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = REGISTRY["op10_quality"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_without_labels_and_of_odd_texts(spark):
    docs = frame(spark)
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.score(docs, none).collect()} == {(0.5, 0)}
    ids = [i for i, _ in rows() if i is not None]
    ones = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    got = quality.score(docs, ones).collect()
    assert len(got) == len(rows()) and all(r.score > 0.7 for r in got)
    assert quality.score(docs.limit(0), ones).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, quality.FEATURES))
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0.5)).astype(float)
    forest = quality.fit(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


@needs_tables
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        after = docs.count()
        assert after <= before and after > 0.8 * before, name
        before = after
    from loomwork.llm import decontamination, minhash_dedup

    assert decontamination.decontaminate(docs, benchmark).count() == before
    assert minhash_dedup.near_duplicates(docs).where("not kept").count() <= 0.01 * before
    assert docs.where(F.col("text").contains("[EMAIL]")).count() > 0
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    laid_out(pieces)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in REGISTRY and [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontamination", "personal_data", "packing",
    ]
