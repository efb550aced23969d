"""Language identification, word first: known words by their frequency in each language, unseen
words by character n-grams that get shorter until one is known.

Training counts words and n-grams by language in tasks and adds the counts up in Spark. Each language has an equal
share of the sample, of the model's ``WORDS`` words and of its ``GRAMS`` n-grams of each length, and fills it with its own
most frequent ones, so a rare language is not crowded out and the model's size does not depend on the corpus. Words are runs of letters of the lower-cased text. Words and n-grams are
64-bit hashes throughout, and whole batches are scored at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terraload.llm import letters
from terraload.llm.scratch import Scratch, bounded_batches

#: Labelled documents to learn from, about; an equal share for each language, all of those that have fewer. Chosen by a
#: hash of their id and text.
SAMPLE = 20_000
#: Places of the model, shared equally by the languages.
WORDS = 200_000
GRAMS = 80_000
LONGEST = 4
SMOOTHING = 0.5
UNDEFINED = "und"

def _grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length, longest first, n-gram hashes of words with an edge mark on either side, and
    the word of each."""
    padded, bounds, word = letters.padded(codes, starts, ends)
    at = np.arange(len(padded))
    left = bounds[word + 1] - at
    for n in range(LONGEST, 0, -1):
        first = np.flatnonzero(left >= n) if n > 1 else np.flatnonzero((left > 1) & (at > bounds[word]))
        yield n, letters.gram_hashes(padded, first, n), word[first]


@dataclass
class Model:
    """Hashes in order and, beside each, log frequencies by language; length 0 is whole words."""

    languages: list[str]
    hashes: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def look_up(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.hashes[n]
        if not len(known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        return at, known[at] == h

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        found = letters.split(column)
        codes, starts, ends, first = found.codes, found.starts, found.ends, found.first
        n_words = np.diff(first)
        totals = np.zeros((len(n_words), len(self.languages)))
        if len(starts) and self.languages:
            code, distinct = pd.factorize(found.hashes())
            some = np.zeros(len(distinct), np.int64)
            some[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            at, known = self.look_up(0, distinct)
            scores = np.zeros((len(distinct), len(self.languages)))
            scores[known] = self.logs[0][at[known]]
            open_ = np.flatnonzero(~known)
            if len(open_):
                scores[open_] = self._back_off(codes, starts[some[open_]], ends[some[open_]])
            full = n_words > 0
            totals[full] = np.add.reduceat(scores[code], first[:-1][full])
        best = totals.argmax(1) if self.languages else np.zeros(len(n_words), np.int64)
        share = np.exp((totals - totals.max(1, keepdims=True, initial=-np.inf)) / np.sqrt(np.maximum(n_words, 1))[:, None])
        score = np.where(n_words > 0, 1 / np.maximum(share.sum(1), 1), 0.0) if self.languages else np.zeros(len(n_words))
        names = [self.languages[b] if n and self.languages else UNDEFINED for b, n in zip(best.tolist(), n_words.tolist())]
        return names, score

    def _back_off(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(self.languages)))
        done = np.zeros(len(starts), bool)
        for n, h, word in _grams(codes, starts, ends):
            open_ = ~done[word]
            h, word = h[open_], word[open_]
            at, known = self.look_up(n, h)
            at, word = at[known], word[known]
            met = np.bincount(word, minlength=len(starts))
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(word, self.logs[n][at, k], len(starts)) / np.maximum(met, 1)
            done |= met > 0
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            rows = batch.filter(pa.array([x == lang for x in langs]))
            found = letters.split(rows.column("text"))
            kinds = [(0, found.hashes())]
            kinds += [(n, h) for n, h, _ in _grams(found.codes, found.starts, found.ends)]
            for n, h in kinds:
                met, counts = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(met), n, np.int32)), "hash": pa.array(met.view(np.int64)),
                                                  "lang": pa.array([lang] * len(met), pa.string()), "n": pa.array(counts)})


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``doc_id, text, lang``; rows without text or language take no part.

    With more than ``sample / languages`` labelled rows of a language about so many are used. Without any rows, the model
    knows no language and calls every text undefined.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "language")
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = scratch.keep(docs.where("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("rows")), "rows")
    languages = sorted(r["lang"] for r in rows.select("lang").collect())
    share = sample / max(len(languages), 1)
    chosen = labelled.join(rows, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit((1 << 30) * share) / F.col("rows"))
    counts = scratch.keep(chosen.select("text", "lang").mapInArrow(_count, "kind int, hash long, lang string, n long")
                          .groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n")), "counts")
    rank = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "hash"))
    places = F.ceil(F.when(F.col("kind") == 0, F.lit(WORDS)).otherwise(F.lit(GRAMS)) / max(len(languages), 1))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= places).select("kind", "hash").distinct()
    table = counts.join(kept, ["kind", "hash"]).select("kind", "hash", "lang", "n").toArrow()
    kind, hashed, n = (table.column(c).to_numpy() for c in ("kind", "hash", "n"))
    place = np.searchsorted(np.array(languages), np.array(table.column("lang").to_pylist(), dtype=str)) if languages else np.zeros(0, np.int64)
    scratch.drop(rows, counts)
    hashes, logs = {}, {}
    for k in range(LONGEST + 1):
        own = kind == k
        hashes[k], at = np.unique(hashed[own].view(np.uint64), return_inverse=True)
        smooth = np.full((len(hashes[k]), len(languages)), SMOOTHING)
        np.add.at(smooth, (at, place[own]), n[own])
        logs[k] = np.log(smooth / smooth.sum(0, keepdims=True)) if len(smooth) else smooth
    return Model(languages, hashes, logs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs`` (``doc_id, text``).

    A null text, or one without letters, is ``und`` with score 0. Ties go to the language that
    sorts first. The score is the language's share among all, between 0 and 1. Other columns are
    ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is found with a score of ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = model.predict(batch.column("text"))
            yield batch.filter(pa.array([n != UNDEFINED and s >= least for n, s in zip(names, score.tolist())], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
