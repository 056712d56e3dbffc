"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_documents import frame, rows

from loomwork.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), unique=True))
def test_partitions_find_each_pair_once(words):
    found = Counter()
    parts = {(m, 0, 0, "", ""): [w for w in words if len(w) in (m, m + 1)] for m in range(1, 8)}
    while parts:
        cut = {}
        for (m, pre, suf, head, tail), held in parts.items():
            rest = m - pre - suf
            if len(held) > 3 and rest > 1:
                half = rest // 2
                for w in held:
                    cut.setdefault((m, pre + half, suf, w[: pre + half], tail), []).append(w)
                    behind = suf + rest - half
                    cut.setdefault((m, pre, behind, head, w[len(w) - behind :]), []).append(w)
            elif held:
                found.update(tuple(sorted(p)) for p in spelling.pairs_of(held, m, pre, suf))
        parts = cut
    assert found == Counter((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_acceptor_shares_equal_right_languages():
    machine = spelling.Acceptors()
    start = machine.build(sorted(a + b + "ing" for a in "bcd" for b in "ou"))
    assert len(machine.arcs) == 6  # one state after each place
    assert sorted(machine.common(start, start)) == sorted(a + b + "ing" for a in "bcd" for b in "ou")
    assert machine.build([]) is None


def words_by_hand(pairs, least, drop):
    total = Counter()
    for i, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def variants_by_hand(total, ratio):
    form = {}
    near = {w: [v for v in total if one_edit(v, w)] for w in total}
    for w, n in total.items():
        best = min(near[w], key=lambda v: (-total[v], v), default=None)
        if best is not None and total[best] >= ratio * n:
            form[w] = best
    out = set()
    for w, n in total.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), total.get(form.get(w))))
    return out


def documents():
    rng = random.Random(5)
    base = ["responsible", "présidente", "ÀÉÎõüß", "straße×welt", "categories", "aaaaaaaa", "abababab", "L" * 300]
    text = []
    for k, word in enumerate(base):
        text += [word] * (400 >> k % 4) + [word[:3] + word[4:]] * 20 + [word + "s"] * 30 + [word + "ss"] * 3 + [word.upper()] * 2
        for _ in range(25):
            at = rng.randrange(len(word))
            text += [word[:at] + rng.choice("aéxyß") + word[at + rng.randrange(2) :]] * rng.randint(1, 3)
    rng.shuffle(text)
    return [*rows(), *((i, " ".join(text[i::40])) for i in range(40)), (None, "responsible; responsible,é x2y")]


@pytest.mark.parametrize("least,drop,group", [(7, 31, spelling.GROUP), (2, 3, 4), (1, None, 1)])
def test_variants_equal_brute_force(spark, least, drop, group):
    pairs = documents()
    vocabulary = spelling.count_words(frame(spark, pairs), least=least, drop=drop)
    want = words_by_hand(pairs, least, drop)
    got = spelling.variants(vocabulary, ratio=3 if least < 7 else 10, group=group).select("word", "form", "root", "n", "n_near", "form_n")
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == variants_by_hand(want, 3 if least < 7 else 10)
    assert any(form and root != form for _, form, root, *_ in found)


def test_no_partition_grows_with_words_that_share_their_start(spark):
    rng = random.Random(1)
    words = sorted({"documentation" + "".join(rng.choice("abcdefgh") for _ in range(13)) for _ in range(3000)})
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    words += [w[:20] + "z" + w[20:] for w in words[:50]] + [w[:2] + w[3:] for w in words[50:90]]
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    held = spelling._partitions(vocabulary, 200).groupBy(*spelling._KEY).count().agg({"count": "max"}).first()[0]
    assert 1 < held <= 200
    found = {(r.word, r.near) for r in spelling.near_pairs(vocabulary, group=200).collect()}
    known = set(words)
    spread = {(w, v) for w in words for v in (w[:k] + w[k + 1 :] for k in range(len(w))) if v in known}
    assert spread | {(v, w) for w, v in spread} == {p for p in found if len(p[0]) != len(p[1])} and len(spread) >= 90


def test_empty_tables(spark):
    assert spelling.variants(spelling.count_words(frame(spark).limit(0))).collect() == []
