import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brute import letter_words, space_words
from terraload.llm import letters, words
from terraload.llm.components import components
from terraload.llm.fm_index import FMIndex, suffix_order
from terraload.llm.scratch import Scratch
from terraload.llm.token_files import pack, unpack

TEXTS = ["Hello World  a", None, "", "x", "\tA b\n c", "é É z", "   ", "a b c d e f", "world hello", "x" * 200_000 + " y", "a-b 7up É1"]


@pytest.mark.parametrize("separators, plain", [(words.SPACES, space_words), (words.NOT_ALNUM, letter_words)])
def test_words_of_a_batch(separators, plain):
    found = words.split(pa.array(TEXTS).slice(1), separators)
    raw = found.data.tobytes()
    got = [[raw[found.starts[i]:found.ends[i]].decode() for i in range(a, b)] for a, b in zip(found.first, found.first[1:])]
    assert got == [plain(t) for t in TEXTS[1:]]


def test_hashes_and_shingles_name_their_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ab ba aab b a é".split(), k=rng.randint(0, 30))) for _ in range(300)]
    found = words.split(pa.array(texts))
    hashes = words.hashes(found)
    named = {}
    for word, h in zip([w for t in texts for w in space_words(t)], hashes.tolist()):
        assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)
    runs, bounds = words.shingles(hashes, found.first, 5)
    named = {}
    for t, a, b in zip(texts, bounds, bounds[1:]):
        w = space_words(t)
        expected = [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        assert len(expected) == b - a
        for s, h in zip(expected, runs[a:b].tolist()):
            assert named.setdefault(s, h) == h
    assert len(set(named.values())) == len(named)


def test_letter_words():
    found = letters.split(pa.array(["ab C-d1é", None, "", "ΣΑΣ x"]))
    text = "".join(map(chr, found.codes))
    assert [text[a:b] for a, b in zip(found.starts, found.ends)] == ["ab", "c", "d", "é", "σασ", "x"]
    assert found.first.tolist() == [0, 4, 4, 4, 6]


def test_groups_are_not_cut():
    table = pa.table({"k": [1, 1, 2, 2, 2, 3, 4, 4], "v": range(8)})
    for size in (1, 2, 3, 8):
        parts = list(words.grouped(iter(table.to_batches(max_chunksize=size)), ["k"]))
        assert [v for p in parts for v in p.column("v").to_pylist()] == list(range(8))
        keys = [set(p.column("k").to_pylist()) for p in parts]
        assert sum(len(k) for k in keys) == 4


def test_suffix_order_and_fm_index():
    rng = np.random.default_rng(1)
    for trial in range(150):
        symbols = np.append(rng.integers(0, rng.integers(2, 5), rng.integers(1, 120)), 0)
        if trial % 5 == 0:
            symbols = np.append(np.tile([1, 2, 1], 20), 0)
        if not symbols.any():
            continue

        def suffix(i):
            end = i + int(np.flatnonzero(symbols[i:] == 0)[0])
            return [(int(s), 0) for s in symbols[i:end]] + [(0, end)]

        assert suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=suffix)
        index = FMIndex(symbols, sample=4)
        patterns, lengths = rng.integers(1, 5, (20, 4)), rng.integers(1, 5, 20)
        for p, n, low, high in zip(patterns, lengths, *index.search(patterns, lengths)):
            expected = [i for i in range(len(symbols) - n + 1) if (symbols[i:i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(low, max(low, high))).tolist()) == expected


def test_packed_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (unpack(*pack(values), n) == values).all()


def test_components(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(200, i) for i in range(150, 250) if i != 200]
    loose = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = path + star + loose + [(7, 7), (100, 101)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    rows = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(rows, Scratch(spark, "test")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert components(rows.where("false"), Scratch(spark, "test")).count() == 0


def test_word_pattern_is_the_stated_one():
    every = "".join(chr(i) for i in range(1, 0x250))
    assert re.findall(r"[^\x20\x09-\x0D]+", every) == [w for w in re.split(r"[\t-\r ]+", every) if w]
