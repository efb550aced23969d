"""Each operator on awkward rows: nulls, empty and very long texts, repeated rows and ids, other columns
whose names operators use themselves, and empty tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from terraload.llm import decontaminate, language, linking, mixing, neardup, paragraphs, rollup, toxicity
from terraload.llm.queries import vocabulary
from terraload.llm.scratch import Scratch
from terraload.llm.token_files import read_digests, read_tokens, token_digests, write_tokens

rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, signature string, rank int, "
          "part string, hash string, `key` string, toxic int, size string")


def prose(n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


BASE, LONG = prose(150), prose(60_000)
ROWS = [(i, t) for i, t in enumerate([
    BASE, edited(BASE, 1), edited(BASE, 3), edited(BASE, 30), BASE.upper(), "", None, "  \n ", "one two", "One\tTwo", "one two three four five",
    LONG, edited(LONG, 5), prose(40), "é É", *[edited(BASE, 2) for _ in range(40)], *[BASE + " " + prose(k) for k in range(60)]])]
AWKWARD = [*ROWS, (None, BASE), (None, None), (900, prose(50)), (900, prose(60)), (901, "same row"), (901, "same row")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ["en", "de", None][(i or 0) % 3], ["a", None, "ä", "b"][(i or 0) % 4], 1, None, "s", 1, "p", "h", "k", 1, "z")
                                  for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, ROWS[:1]).where("false")


def test_near_duplicates(docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    expected = brute.near_duplicates(ROWS)
    assert {i: by_id[i] for i, _ in ROWS} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sorted(r.component_id for r in got if r.doc_id in (900, 901)) == [900, 900, 901, 901]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert neardup.near_duplicates(none).count() == 0


def test_one_of_each(spark, none):
    x, y, z = prose(60), prose(60), prose(60)
    rows = [(1, x), (5, x), (5, y), (6, edited(y, 1)), (7, z), (7, edited(z, 1)), (8, "same row here"), (8, "same row here"), (8, ""), (8, None), (8, "!"),
            (None, x), (None, None), (9, z + " more")]
    stays = sorted((str(r.doc_id), r.text or "") for r in neardup.one_of_each(frame(spark, rows)).collect())
    sevens = [v for v in stays if v[0] == "7"]
    assert len(sevens) == 1 and sevens[0][1] in (rows[4][1], rows[5][1])
    assert [v for v in stays if v[0] != "7"] == sorted([("1", x), ("5", y), ("8", "same row here"), ("8", ""), ("8", ""), ("8", "!"), ("None", x), ("None", "")])
    assert neardup.one_of_each(none).count() == 0 and neardup.one_of_each(none).schema == none.schema


def hubless(n, changes=2):
    """Copies of one text, each with words of its own, hardly any two of which are linked."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        r, w = random.Random(i), list(base)
        for k in r.sample(range(60), changes):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


def test_long_lists_are_compared_through_files(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 100)
    monkeypatch.setattr(linking, "STRIPE", 3)
    rows = hubless(700)
    rows += [(1000 + i, edited(t, 1)) for i, t in rows[:40]] + [(5000 + i, t) for i, t in hubless(300, 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)
    assert len({c for _, c in got.values()}) > 200


def test_contamination(spark, docs, none):
    items = [(1, " ".join(BASE.split()[20:45])), (2, "One  two"), (3, ""), (4, None), (None, "one two three"), (1, prose(12)), (7, "one two"), (7, "one two")]
    bench = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, score double")
    got = decontaminate.contamination(docs, bench)
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(brute.contamination(AWKWARD, items), key=str)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in got.where("doc_id IN (0, 8)").collect()}
    assert spans[8] == [(0, 7)] and BASE[slice(*spans[0][0])] == " ".join(BASE.split()[20:45])
    clean = decontaminate.without_contamination(docs, bench)
    assert clean.schema == docs.schema
    bad = sorted(str(r[0]) for r in brute.contamination(AWKWARD, items) if not r[5])
    assert sorted(str(r.doc_id) for r in clean.collect()) == bad
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_blocks_of_phrases_and_shards_do_not_matter(monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq
    import tempfile

    items = [(k, " ".join(BASE.split()[k:k + 14])) for k in range(0, 120, 7)]
    table = pa.table({"item": [str(i) for i, _ in items], "text": [t for _, t in items]})
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    pq.write_table(pa.Table.from_batches(list(decontaminate._windows(10)(iter(table.to_batches())))), folder + "/a.parquet")
    monkeypatch.setattr(decontaminate, "PHRASES", 9)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    texts = pa.table({"doc_id": [i for i, _ in ROWS], "text": [t for _, t in ROWS]})
    got = pa.Table.from_batches(list(decontaminate._scan(folder)(iter(texts.to_batches(max_chunksize=5))))).to_pylist()
    assert [tuple(r.values())[:6] for r in got] == brute.contamination(ROWS, items)


def test_mix(docs, none):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = sorted((tuple(r) for r in mixing.mix(docs).collect()), key=str)
    expected = sorted(brute.mix(rows), key=str)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected])
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_documents(docs.where("doc_id < 900"))
    assert out.schema.simpleString() == docs.schema.simpleString()
    taken = {}
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(brute.space_words(r.text))
    assert {i: n for i, n in taken.items() if n} == {r[0]: r[4] for r in brute.mix([r for r in rows if r[0] is not None and r[0] < 900]) if r[4]}


def test_targets_share_the_excess_again():
    sizes, weights = {"a": 10, "b": 1000, "c": 500}, {"a": 3, "b": 1, "c": 2}
    got = brute.targets(sizes, weights, 1.5 * 1510, 2)
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(1.5 * 1510) and got["c"] == 1000


def test_tokens(spark, docs, none):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [(2000, "it's DON'T l'été <|endoftext|> <|ENDOFTEXT|> a\x00b \x1c ǅ 日本語 12 3.4 foo... bar!?"), (2001, "É ÀÇ ß á éx")]
    rows = [*AWKWARD, *odd]
    written = write_tokens(frame(spark, rows), path, 2, Scratch(spark, "test"))
    ids = {i: {tuple(library.encode(t or "", add_special_tokens=False).ids + [2]) for j, t in rows if j == i} for i, _ in rows}
    read = read_tokens(written).collect()
    assert len(read) == len(rows) and all(tuple(r.ids) in ids[r.doc_id] for r in read)
    digests = sorted(read_digests(written).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in digests] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r.start for r in digests] == [0, *np.cumsum([r.n_tokens for r in digests])[:-1].tolist()]
    known = {i: {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in s} for i, s in ids.items()}
    assert all((r.n_tokens, r.ids_crc32) in known[r.doc_id] for r in digests)
    assert token_digests(none, path).count() == 0


def test_language(spark, docs, none):
    train = [(i, t, s) for i, (t, s) in enumerate([("the cat and the dog run", "en"), ("der hund und die katze laufen", "de")] * 20)]
    model = language.train(spark.createDataFrame([*train, (99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"))
    rows = [(1, "The DOG"), (2, "und die hunde"), (3, None), (4, "12 !"), (5, ""), (6, "katz"), (None, "the the")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, rows), model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    kept = language.identified(frame(spark, rows), model, 0.5)
    assert kept.schema.simpleString() == docs.schema.simpleString() and {r.doc_id for r in kept.collect()} == {1, 2, 6, None}
    nobody = language.train(none)
    assert {r.lang_pred for r in language.identify(docs, nobody).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_toxicity(spark, docs, none):
    local = random.Random(2)
    bad = ["blorf", "zwick", "grumpfen"]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(local.choices(WORDS, k=8)) for _ in range(local.randint(1, 30))]
        toxic = i % 5 == 0
        if toxic:
            at = local.randrange(len(sentences))
            sentences[at] += f" {local.choice(bad)} {local.choice(bad)}"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame([*labels[:300], (5000, 1), (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), known)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), model).collect()}
    held_out = [(got[i].predicted, t) for i, t in labels[300:]]
    assert sum(p == t for p, t in held_out) >= 98
    texts = dict(rows)
    found = [texts[i][s.start:s.end] for i, t in labels if t for s in got[i].offending]
    assert len(found) >= 75 and all(any(b in s for b in bad) for s in found)
    every = toxicity.score(docs, model).collect()
    assert len(every) == len(AWKWARD) and all(0 <= r.score <= 1 for r in every)
    assert toxicity.score(none, model).count() == 0
    assert max(r.score for r in toxicity.score(docs, toxicity.train(docs, known.where("false"))).collect()) <= 1


def test_rollup(spark, docs, none):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    totals = rollup.TokenRollup(spark, Scratch(spark, "test").path("rollup"))
    assert totals.totals().count() == 0

    def expected(rows):
        sums = {}
        for r in rows:
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            d, t = sums.get((r.source, r.lang), (0, 0))
            sums[r.source, r.lang] = d + 1, t + n
        return sums

    def now():
        return {(r.source, r.lang): (r.docs, r.tokens) for r in totals.totals().collect()}

    rows = docs.collect()
    assert totals.insert("one", docs, "v1", path) and not totals.insert("one", docs, "v1", path)
    assert now() == expected(rows)
    assert totals.delete("two", docs.where("doc_id % 2 = 0")) and not totals.delete("two", docs)
    rows = [r for r in rows if r.doc_id is None or r.doc_id % 2]
    assert now() == expected(rows)
    assert totals.revise("three", docs.where("doc_id IN (1, 2, 3, 901)").withColumn("text", F.lit("a b c")), "v1", path)
    rows = [r if r.doc_id not in (1, 3, 901) else type(r)(**{**r.asDict(), "text": "a b c"}) for r in rows]
    assert now() == expected(rows)
    assert totals.insert("four", none, "v1", path) and totals.delete("five", none) and now() == expected(rows)


def test_repeated_passages(spark, none):
    line, other = prose(40), prose(60)
    passage = ". ".join(prose(9) for _ in range(7))
    rows = [(1, line + "\n" + prose(30)), (2, prose(25) + "\n" + edited(line, 1)), (3, prose(30) + " " + passage + ". " + prose(12)),
            (4, passage + "."), (5, prose(200)), (6, "short line\n" * 30), (7, "short line"), (8, other + "\n" + other), (9, None), (10, ""),
            (None, line), (11, LONG), (12, "x " + passage.upper() + ". " + prose(300))]
    docs = frame(spark, rows)
    spans = paragraphs.repeated_passages(docs)
    got = {(r.doc_id, r.removed) for r in spans.collect()}
    assert got == {(1, False), (2, True), (3, False), (4, True), (12, True)}
    texts = {r.doc_id: r.text for r in paragraphs.without_passages(docs, spans).collect()}
    assert len(texts) == len(rows) and passage in texts[3] and passage[20:-20] not in texts[4] and line in texts[1] and texts[5] == dict(rows)[5]
    assert paragraphs.repeated_passages(none).count() == 0
    assert paragraphs.tuned_bands(0.995, 0.75, 2) == 7


@pytest.mark.parametrize("size, between", [(200, "\n"), (30, "\n"), (200, ". "), (30, ". ")])
def test_each_passage_of_a_copied_document_stays_once(spark, size, between):
    own, shared = (". ".join(prose(10) for _ in range(n // 10)) if between == ". " else prose(n) for n in (size, 60))
    docs = frame(spark, [(1, prose(50) + between + shared), (2, own + between + shared), (3, own + between + shared)])
    spans = paragraphs.repeated_passages(docs)
    got = {(r.doc_id, r.kept_in, r.removed) for r in spans.collect()}
    assert got == {(1, 1, False), (2, 2, False), (2, 1, True), (3, 2, True), (3, 1, True)}
    clusters = {}
    for r in spans.collect():
        clusters.setdefault(r.kept_in, set()).add(r.cluster)
    assert all(len(c) == 1 for c in clusters.values()) and clusters[1] != clusters[2]
    texts = {r.doc_id: r.text for r in paragraphs.without_passages(docs, spans).collect()}
    assert shared in texts[1] and own in texts[2] and shared not in texts[2] and not texts[3].strip(" .\n")


def test_a_passage_that_stays_in_a_near_copy_is_not_lost(spark):
    line, new = prose(150), ", ".join(prose(10) for _ in range(3))
    docs = frame(spark, [(1, line), (2, line[:len(line) // 2] + ", " + new + ", " + line[len(line) // 2:]), (3, prose(60) + ", " + new + ".")])
    texts = {r.doc_id: r.text for r in paragraphs.without_passages(docs, paragraphs.repeated_passages(docs)).collect()}
    assert line in texts[1] and new in texts[2] and new not in texts[3] and len(texts[2].split()) < 40


def test_passages_without_stops(spark):
    passages = [prose(51), prose(38), " ".join(c + "。" for c in prose(60).split()), ", ".join(prose(3) for _ in range(17))]
    rows = [(10 * k + d, prose(rng.randrange(20, 90)) + " " + p + " " + prose(rng.randrange(20, 90))) for k, p in enumerate(passages) for d in range(3)]
    docs = frame(spark, rows)
    spans = paragraphs.repeated_passages(docs)
    got = {(r.doc_id, r.kept_in, r.removed) for r in spans.collect()}
    assert got == {(10 * k + d, 10 * k, d > 0) for k in range(4) for d in range(3)}
    texts = {r.doc_id: r.text for r in paragraphs.without_passages(docs, spans).collect()}
    for k, p in enumerate(passages):
        inner = " ".join(p.split()[9:-9])
        assert [inner in texts[10 * k + d] for d in range(3)] == [True, False, False]


def test_windows_do_not_depend_on_what_is_around():
    values = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    around = np.concatenate([values[100:160], values, values[:90]])
    alone, within = paragraphs._windows(values, np.array([0, 300])), paragraphs._windows(around, np.array([0, 450]))
    assert set(alone + 60) <= set(within) and np.diff(alone).max() <= paragraphs.WINDOW and alone[0] < paragraphs.WINDOW
    apart = paragraphs._windows(np.concatenate([values, values]), np.array([0, 300, 600]))
    assert apart.tolist() == [*alone, *(alone + 300)]
    assert not len(paragraphs._windows(values[:18], np.array([0, 18]))) and not len(paragraphs._windows(values[:0], np.array([0, 0])))


def made_up(seed, n_words=300):
    r = random.Random(seed)
    alphabet = r.sample("abcdefghijklmnopqrstuvwxyz", 12)
    return ["".join(r.choices(alphabet, k=r.randint(3, 8))) for _ in range(n_words)]


def test_a_rare_language_is_not_crowded_out(spark, monkeypatch):
    """Forty documents among six thousand; the model has few places, of which each language has its share."""
    monkeypatch.setattr(language, "WORDS", 600)
    monkeypatch.setattr(language, "GRAMS", 400)
    tongues, r = {f"l{k}": made_up(k) for k in range(4)}, random.Random(5)
    write = lambda lang: " ".join(r.choices(tongues[lang], k=30))
    rows = [(i, write(lang), lang) for i, lang in enumerate(["l0"] * 2000 + ["l1"] * 2000 + ["l2"] * 2000 + ["l3"] * 40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)
    asked = [(i, write(lang), lang) for i, lang in enumerate(["l0", "l1", "l2", "l3"] * 50)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i] == lang for i, _, lang in asked)


def test_toxic_words_of_a_small_language_are_learned(spark):
    big, small, r = made_up(1), made_up(2), random.Random(6)
    rows, labels = [], []
    for i in range(3000):
        tongue, bad = (small, "smallbad") if i % 30 == 0 else (big, f"bigbad{i % 7}")
        toxic = i % 11 in (0, 3)
        words_ = r.choices(tongue, k=40) + ([bad] if toxic else [])
        r.shuffle(words_)
        rows.append((i, " ".join(words_)))
        labels.append((i, int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    asked = [(0, " ".join(small[:40])), (1, " ".join(small[:40]) + ". It is smallbad here. " + " ".join(small[40:50])), (2, " ".join(big[:40])), (3, " ".join(big[:40] + ["bigbad4"]))]
    got = {x.doc_id: x for x in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i].predicted for i in range(4)] == [0, 1, 0, 1]
    [span] = got[1].offending
    assert asked[1][1][span.start:span.end].strip() == "It is smallbad here."
