"""Packed token files: blocks, random access, and the ids of whole tables against the library's plain calls."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from odd_documents import frame, rows
from tokenizers import Tokenizer

from loomwork.llm import textbytes as tb
from loomwork.llm import token_blocks

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32])
def test_blocks_unpack_to_their_ids(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 40 * token_blocks.BLOCK, np.uint64).astype(np.uint32)
    ids[:: 37] = top - 1
    ids[5 * 128 : 9 * 128] = rng.integers(0, min(top, 4), 4 * 128)
    assert (token_blocks.unpack(*token_blocks.pack(ids)) == ids).all()


def test_width_follows_the_percentile_and_outliers_are_exceptions():
    ids = np.full(128, 1000, np.uint32)
    ids[:100] += np.arange(100, dtype=np.uint32) % 16
    ids[[7, 70]] = 40_000
    words, places, values, index = token_blocks.pack(ids)
    assert index["width"][0] == 4 and index["low"][0] == 1000 and len(words) == 16
    assert places.tolist() == [7, 70] and values.tolist() == [39_000, 39_000]


def test_ranges_are_read_from_their_blocks(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 400, 900)
    ids = np.minimum(rng.pareto(0.5, lengths.sum()) * 20, 49_000).astype(np.uint32)
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    writer = token_blocks.Writer()
    for a in range(0, 900, 70):
        b = min(a + 70, 900)
        writer.add(pa.array([f"k{i}" for i in range(a, b)]), lengths[a:b], ids[cuts[a] : cuts[b]])
    writer.write(str(tmp_path / "x.pfor"))
    assert (tmp_path / "x.pfor").stat().st_size < 2.6 * len(ids)
    with token_blocks.Reader(f"file:{tmp_path}/x.pfor") as file:
        keys, found = file.documents()
        assert keys.to_pylist() == [f"k{i}" for i in range(900)] and (found == lengths).all()
        assert (file.ids() == ids).all()
        for a, b in [(0, 1), (127, 129), (128, 256), (len(ids) - 1, len(ids)), (5000, 5000), *rng.integers(0, len(ids), (40, 2)).tolist()]:
            assert (file.ids(a, b) == ids[a:b]).all()


TEXTS = [
    "Don't!'s 'tis IT'S 12345 a1b2 3.14 '' 'x", "é J̌ X≠ Å İI", "a b c\u0085d \x1c\x1d e", "<|endoftext|> x<|startoftext|>Y <|ENDOFTEXT|>",
    "<|'endoftext|>", "½²١ 9́ Ábc", "日本語text", "", " \t\r\n\x0b\x0c", "ΣΟΣ end", "á'S o'é '́s", "_'ll 'LL x'Re",
]


def test_pieces_encode_like_whole_texts():
    plain = Tokenizer.from_file(PATH)
    encoder = token_blocks.Encoder(PATH)
    rng = np.random.default_rng(2)
    marks = list("aZ '1.,-<|>é́ 日̌sStTlL\n")
    texts = TEXTS + [t or "" for _, t in rows() if len(t or "") < 5000] + ["".join(rng.choice(marks, rng.integers(1, 30))) for _ in range(3000)]
    for some in (texts, texts[::-1]):
        raw = [t.encode() for t in some]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, cuts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
        for text, a, b in zip(some, cuts[:-1], cuts[1:]):
            assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert tb.SLICE_BYTES


def by_hand(pairs):
    plain, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sizes", [{}, {"file_ids": 300, "task_bytes": 9000}])
def test_files_hold_all_ids_in_order_of_the_keys(spark, sizes):
    pairs = [(i, t) for i, t in rows() if i is not None] + [(9000 + i, t) for i, t in enumerate(TEXTS)]
    pairs = list({i: (i, t) for i, t in pairs}.values())
    got = [tuple(r) for r in token_blocks.digest(frame(spark, pairs), PATH, **sizes).collect()]
    assert sorted(got) == by_hand(pairs)


def test_equal_and_null_keys_stay_row_by_row(spark, tmp_path):
    pairs = [(5, f"word {i}") for i in range(300)] + [(None, None), (None, "a"), (1, "b"), (9, None)]
    files = token_blocks.write(frame(spark, pairs), PATH, str(tmp_path / "f"), file_ids=50, task_bytes=300)
    assert files.count() > 6
    got = token_blocks.read(files, key="doc_id").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, *[5] * 300, 9]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    want = sorted(np.array([*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in pairs)
    assert sorted(bytes(r.ids) for r in got) == want


def test_empty_tables_and_string_keys(spark):
    assert token_blocks.digest(frame(spark).limit(0), PATH).collect() == []
    docs = spark.createDataFrame([("b", "x y"), ("a", None)], "name string, said string")
    got = token_blocks.digest(docs, PATH, key="name", text="said").orderBy("start").collect()
    assert [(r.name, r.start, r.n_tokens) for r in got] == [("a", 0, 1), ("b", 1, 3)]
