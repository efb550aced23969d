"""Registered queries against their SQL, held-out accuracy, and the pipeline against a plain version."""

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import brute
import corpus_pipeline
from terraload.checks.runner import compare
from terraload.llm.catalog import ORACLES, QUERIES
from terraload.llm.queries import vocabulary
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    ok, note = compare(spark, SF_DIR, QUERIES[name], ORACLES[name])
    assert ok, note


def test_near_duplicates_of_the_table(spark, documents):
    query = next(q for n, q in QUERIES.items() if n.startswith("op10_"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in query(spark, SF_DIR).collect()}
    assert got == brute.near_duplicates([(r.doc_id, r.text) for r in documents])


def test_contamination_of_the_table(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    query = next(q for n, q in QUERIES.items() if n.startswith("op7_"))
    got = sorted(tuple(r) for r in query(spark, SF_DIR).collect())
    assert got == sorted(brute.contamination([(r.doc_id, r.text) for r in documents], items))


def test_repeated_passages_of_the_table(spark, documents):
    query = next(q for n, q in QUERIES.items() if n.startswith("op9_"))
    found = {r.doc_id for r in query(spark, SF_DIR).collect()}
    owners = {}
    for r in documents:
        w = r.text.split()
        for k in range(len(w) - 50):
            owners.setdefault(tuple(w[k:k + 51]), set()).add(r.doc_id)
    assert set().union(*[o for o in owners.values() if len(o) > 1]) <= found


def test_language_accuracy(spark, documents):
    query = next(q for n, q in QUERIES.items() if n.startswith("op5_"))
    got = {r.doc_id: r for r in query(spark, SF_DIR).collect()}
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in documents)
    held_out = [got[r.doc_id].lang_pred == r.lang for r in documents if got[r.doc_id].held_out]
    assert sum(held_out) >= 0.95 * len(held_out)


def test_toxicity_ranks_held_out_documents(spark):
    query = next(q for n, q in QUERIES.items() if n.startswith("op1_"))
    sf_dir = SF_DIR.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = query(spark, sf_dir).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    bad, good = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) >= 0.9 * len(bad) * len(good)


def test_pipeline_against_a_plain_version(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    known = stages["language_id"](spark, docs, SF_DIR)
    assert known.schema == docs.schema and known.count() == sum(any(c.isalpha() for c in r.text) for r in documents)
    left = {r.doc_id: r for r in documents}
    alike = brute.near_duplicates([(i, r.text) for i, r in left.items()])
    left = {i: r for i, r in left.items() if alike[i][1] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.contamination([(i, r.text) for i, r in left.items()], items) if r[5]}
    left = {i: r for i, r in left.items() if i not in dirty}
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    words = {i: r.text.split() for i, r in left.items()}
    sizes, start = [], 0
    for i, n, _, _, taken in sorted(brute.mix([(i, r.text, r.source) for i, r in left.items()])):
        for part in [n] * (taken // n) + [taken % n] * (taken % n > 0):
            text = left[i].text if part == n else " ".join(words[i][:part])
            sizes.append((i, len(library.encode(text, add_special_tokens=False).ids) + 1))
    got = sorted(corpus_pipeline.run(spark, SF_DIR).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted(sizes)
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("score", F.lit(1)).limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns, name
