"""Quality cascade, Merkle manifest and periodic runs against plain versions, on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraload.llm import merkle, periods, quality, words
from terraload.llm.queries import with_planted_runs

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)
VOCABULARY = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


ROWS = [(i, t) for i, t in enumerate([
    prose(80), "", None, " \n ", "one", prose(49), prose(50), "a b c " * 40, "x " * 300, "line one here\n" * 30 + prose(60), "é É über " * 3 + prose(70),
    prose(60).upper(), "###" + prose(60) + " $$$ | & <" * 9, "- " + prose(30) + "\n- " + prose(30), prose(3000), ("ha " * 9 + "ho ") * 12 + prose(55),
    prose(40) + "\r\n" + prose(40) + "...\n" + prose(10) + "...", "w" * 2000 + " " + prose(80), prose(20) + " " + (prose(37) + " ") * 5, "same\n" * 3 + "\n\n same\n"])]
AWKWARD = [*ROWS, (None, prose(70)), (None, None), (5, prose(60)), (900, "same row"), (900, "same row")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, runs int, tree string, at string, n string, leaf int"


def row(i, t):
    return (i, t, ["en", None][(i or 0) % 2], ["b", None, "ä", "a"][(i or 0) % 4] if i is not None else "a", None if t is None else len(t), True, 1, "t", "a", "n", 2)


def frame(spark, rows):
    return spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, ROWS[:1]).where("false")


def plain_features(text):
    t = text or ""
    w, lines = SPACES.findall(t), [x for x in t.split("\n") if SPACES.search(x)]

    def repeats(size):
        seen, covered = {}, set()
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k:k + size]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                covered.update(p + j for p in places for j in range(size))
        return len(covered)

    letters = re.compile(r"[A-Za-z]|[^\x00-\x7f]")
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": repeats(3), "n_repeat_10": repeats(10), "n_lines": len(lines), "n_capitals": len(re.findall("[A-Z]", t)),
            "n_letters": len(re.findall("[A-Za-z]", t)), "n_lettered": sum(bool(letters.search(x)) for x in w), "n_exclaimed": sum(x.endswith("!!") for x in w),
            "longest_word": max(map(len, w), default=0), "n_bullets": sum(x[0] in "-*" for x in lines), "n_cut_lines": sum(x.endswith("...") for x in lines)}


def test_features():
    texts = [t for _, t in AWKWARD] + ["a!! b!! !! c!", "-x\n*y\n z-\n--", "a...\nb..\n....", "\n\na\n\n", "a"]
    held = quality.Texts.of(pa.array(texts))
    plain = [plain_features(t) for t in texts]
    assert set(plain[0]) == set(quality.FEATURES)
    for name, feature in quality.FEATURES.items():
        assert feature(held).tolist() == [p[name] for p in plain], name
    keep = np.arange(len(texts)) % 3 != 1
    for ready in (False, True):
        if ready:
            held.hashes()
        some = held.rows(keep)
        for name, feature in quality.FEATURES.items():
            assert feature(some).tolist() == [p[name] for p, k in zip(plain, keep) if k], name
    nothing = quality.Texts.of(pa.array([], pa.string()))
    assert all(feature(nothing).tolist() == [] for feature in quality.FEATURES.values())


def verdict(text):
    facts = {k: np.array([v]) for k, v in plain_features(text).items()}
    fails = lambda rules: any(r.rejects(*[facts[f] for f in r.features])[0] for r in rules)
    base = fails(quality.BASE_RULES)
    return base, not (base or fails(quality.RULES))


def test_judge_in_any_order(docs, none):
    expected = sorted((str(i), *[plain_features(t)[f] for f in quality.BASE_FEATURES], *verdict(t)) for i, t in AWKWARD)
    assert {v[-1] for v in expected} == {True, False}
    for rules in (quality.RULES, quality.RULES[::-1]):
        got = quality.judge(docs, rules).collect()
        assert sorted((str(r.doc_id), *[r[f] for f in quality.BASE_FEATURES], r.base_failed, r.kept) for r in got) == expected
        assert all((r.rejected_by is None) == r.kept and (r.n_judged == len(rules)) >= r.kept for r in got)
    assert quality.judge(none).count() == 0
    good = quality.good_documents(docs)
    assert good.schema == docs.schema
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(v[0] for v in expected if v[-1])


def test_order_goes_by_rejection_for_each_second():
    rule = lambda name, *features: quality.Rule(name, features, None)
    rules = [rule("slow", "s"), rule("cheap", "c"), rule("same", "c", "d"), rule("never", "e"), rule("free", "base")]
    seconds = {"s": 10.0, "c": 1.0, "d": 1.0, "e": 0.1}
    # bits: slow 1, cheap 2, same 4, never 8, free 16; the texts of "same" are those of "cheap".
    together = {0: 50, 1: 20, 6: 10, 17: 30, 7: 1}
    assert [r.name for r in quality.ordered(rules, ["base"], seconds, together)] == ["free", "cheap", "slow", "never", "same"]
    assert len(quality.ordered(rules, [], {}, {})) == 5


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root of a list of digests, and each one's siblings level by level."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 16 * 16:a // 16 * 16 + 16]
            paths[k].append((run[:a % 16], run[a % 16 + 1:]))
        at = [a // 16 for a in at]
        level = [sha("".join(level[k:k + 16])) for k in range(0, len(level), 16)]
    return level[0] if level else None, paths


def plain_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(field(v) for v in (r[0], r[3], r[2], r[4], text)))

    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, leaf(r, r[1])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, below = [], []
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        root, paths = plain_tree([h for _, h in groups[s]])
        subroots.append(root)
        below.append(paths)
    root, above = plain_tree(subroots)
    out = []
    for s, sub, paths, top in zip(order, subroots, below, above):
        for (r, h), path in zip(groups[s], paths):
            changed = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(r, r[1].translate(small)) if changed else h
            for before, behind in path + top:
                folded = sha("".join([*before, folded, *behind]))
            proof = sha("".join("".join(a + b) for a, b in path + top))
            out.append((str(r[0]), h, sub, root, proof, folded, folded == root))
    return sorted(out)


def changed():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def merkle_rows(df, **settings):
    got = merkle.manifest(df, changed(), **settings).proofs().drop("source").collect()
    return sorted((str(r.doc_id), *list(r)[1:]) for r in got)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(docs, none, height):
    assert merkle_rows(docs, height=height) == plain_manifest([row(i, t) for i, t in AWKWARD])
    assert merkle.manifest(none, height=height).proofs().count() == 0


def test_manifest_of_many_blocks_and_sources(spark):
    """Sources of 1, 16, 17, 256, 257 rows, one of a third of all, and more than 16 sources."""
    sizes = [1, 16, 17, 256, 257, 700, *[2] * 20]
    rows = [row(None, None)] + [(i, f"Text {i}", "en", f"s{k:02d}", i % 7, True, 1, "t", "a", "n", 2)
                                for i, k in enumerate(k for k, n in enumerate(sizes) for _ in range(n))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    expected = plain_manifest(rows)
    for height in (1, 2, 3):
        assert merkle_rows(df, height=height) == expected
    found = merkle.manifest(df, height=1)
    assert found.sources.count() == len(sizes) + 1 and found.blocks.count() > 16
    assert sum(not v[-1] for v in expected) > 100


def test_layout_is_a_permutation_with_subtrees_in_one_piece():
    for levels in range(1, 6):
        places = [merkle.positions(levels, d, np.arange(16 ** d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.subtree_size(levels)))
        if levels > 1:
            top = levels // 2
            assert max(p.max() for p in places[:top]) == merkle.subtree_size(top) - 1
            lower = merkle.subtree_size(levels - top)
            for k in range(16 ** top):
                own = np.concatenate([places[d][k * 16 ** (d - top):(k + 1) * 16 ** (d - top)] for d in range(top, levels)])
                assert own.min() == merkle.subtree_size(top) + k * lower and own.max() == own.min() + lower - 1


def plain_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(s for s in found if not any(s[2] % t[2] == 0 and t[2] < s[2] and t[0] <= s[0] and t[0] + t[1] >= s[0] + s[1] for t in found))


def repetitive(rng):
    w = []
    while len(w) < rng.choice([0, 5, 30, 200, 500]):
        kind = rng.random()
        if kind < 0.3:
            w += rng.choices("abc", k=rng.randint(1, 9)) * rng.randint(1, 9)
        elif kind < 0.6:
            w += rng.choices("abcdefghijk", k=rng.randint(1, 70)) * rng.randint(1, 6)
        elif kind < 0.8 and w:
            w += w[-rng.randint(1, len(w)):] * rng.randint(1, 5)
        else:
            w += rng.choices("ab", k=rng.randint(1, 30))
    return " ".join(w[:800])


def plain_periodic(text):
    w = SPACES.findall(text or "")
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_texts():
    texts = [repetitive(random.Random(seed)) for seed in range(250)]
    got = periods.text_runs(words.split(pa.array(texts), lower=False))
    assert got == [plain_runs(t.split()) for t in texts]
    assert sum(q >= periods.FIRST_SCALE for own in got for _, _, q in own) > 20


def test_transform_counts_exactly():
    for prime, generator in periods.PRIMES:
        values = np.random.default_rng(1).integers(0, prime, (3, 64)).astype(np.uint64)
        assert (periods.back(periods.transform(values, prime, generator), prime, generator) == values).all()
    ids = np.random.default_rng(2).integers(1, 3, 4000)
    ids[1000:1500] = np.tile(ids[1000:1020], 25)
    starts = np.arange(0, 3900, 16)
    block, distance = periods.occurrences(ids, starts, np.full(len(starts), 4000), 16)
    expected = [(k, d) for k, s in enumerate(starts) for d in range(16, 32) if s + d + 16 <= 4000 and (ids[s:s + 16] == ids[s + d:s + d + 16]).all()]
    assert list(zip(block.tolist(), distance.tolist())) == expected and expected
    big = ids * 10 ** 6
    assert list(zip(*(v.tolist() for v in periods.occurrences(big, starts, np.full(len(starts), 4000), 16)))) == expected


def test_periodic_runs(docs, none):
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect())
    assert got == sorted((str(i), *plain_periodic(t)) for i, t in AWKWARD)
    assert periods.periodic_runs(none).count() == 0


def test_one_word_many_times():
    assert periods.text_runs(words.split(pa.array(["x " * 30_000, ("a b " * 9 + "c ") * 500]), lower=False))[0] == [(0, 30_000, 1)]


def test_planted_runs(spark):
    rows = [(i, prose(40 + i)) for i in range(60)] + [(None, "a b"), (3, None), (10, ""), (11, " ")]
    got = {(r.doc_id, r.text) for r in with_planted_runs(frame(spark, rows)).collect()}
    expected = set()
    for i, t in rows:
        h, w = (zlib.crc32(str(i).encode()) if i is not None else 1), SPACES.findall(t or "")
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[:a] + [w[a + (k - a) % p] for k in range(a, n)])
        expected.add((i, t))
    assert got == expected and len(got - set(rows)) > 2
