"""Toxic documents and the sentences that make them so, learned from document labels alone.

Multiple-instance learning: a sentence's probability is logistic in its features (words, and their
first three to six letters), a document is toxic if any sentence is: ``1 - prod(1 - p)``, the
noisy-or. The weights are fitted to document labels through that product, so they come to rest on
the sentences that explain the label, and these are located in any text.

Learning takes a bounded sample of labelled rows; scoring covers all of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraload.llm import letters
from terraload.llm.scratch import Scratch, bounded_batches

#: Labelled documents to learn from, about; chosen by a hash of their id.
SAMPLE = 20_000
#: Features kept: all whose document frequencies differ between the labels by more than chance, as a chi-square with
#: one degree of freedom (18 is met by chance once in 45 000 features). There is no bound on their number but the sample's.
CERTAIN = 18.0
#: A feature must stand in so many sampled documents, or it would explain single ones away.
LEAST_DOCUMENTS = 5
PREFIXES = range(3, 7)
STEPS = 400
RATE = 0.1
RIDGE = 2e-5
START = -6.0
THRESHOLD = 0.7
OFFENDING = 0.5
_ENDS = np.array([ord(c) for c in ".!?\n"], np.uint32)


def _features(found: letters.LetterWords) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of features and the word of each, for each kind of feature."""
    yield found.hashes(), np.arange(len(found.starts))
    padded, bounds, _ = letters.padded(found.codes, found.starts, found.ends)
    for n in PREFIXES:
        long = np.flatnonzero(found.ends - found.starts >= n)
        yield letters.gram_hashes(padded, bounds[long], n + 1), long


def _sentences(found: letters.LetterWords) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each code point, counted over the batch, and the first sentence of each text.

    A sentence ends behind a full stop, question or exclamation mark, or line end.
    """
    stop = (found.codes[:, None] == _ENDS).any(1) if len(found.codes) < 1 << 16 else np.isin(found.codes, _ENDS)
    number = np.cumsum(stop) - stop
    return number, np.append(number[found.bounds[:-1]], number[-1] + 1 if len(number) else 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        found = letters.split(batch.column("text"))
        text = np.repeat(np.arange(batch.num_rows), np.diff(found.first))
        for h, word in _features(found):
            order = np.lexsort((text[word], h))
            h, owner = h[order], text[word][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            met, index = np.unique(h[new], return_inverse=True)
            bad = np.bincount(index, toxic[owner[new]], len(met)).astype(np.int64)
            every = np.bincount(index, minlength=len(met))
            yield pa.RecordBatch.from_arrays([pa.array(met.view(np.int64)), pa.array(bad), pa.array(every)], names=["feature", "bad", "n"])


@dataclass
class Model:
    """Feature hashes in order, a weight for each, and the weight every sentence has."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def matches(self, found: letters.LetterWords) -> tuple[np.ndarray, np.ndarray]:
        """Places of known features in the model, and the sentence of each; each once in a sentence."""
        number, _ = _sentences(found)
        sentence, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.features):
            for h, word in _features(found):
                place = np.searchsorted(self.features, h)
                place[place == len(self.features)] = 0
                known = self.features[place] == h
                at.append(place[known])
                sentence.append(number[found.starts[word[known]]])
        pairs = np.unique(np.concatenate(sentence) * max(len(self.features), 1) + np.concatenate(at))
        return pairs % max(len(self.features), 1), pairs // max(len(self.features), 1)

    def score(self, column) -> tuple[np.ndarray, list[list[dict]]]:
        """The score of each text, and its offending sentences as ranges of characters."""
        found = letters.split(column)
        if not len(found.codes):
            return np.zeros(0), []
        number, first = _sentences(found)
        at, sentence = self.matches(found)
        logits = self.bias + np.bincount(sentence, self.weights[at], int(first[-1])) if len(at) else np.full(int(first[-1]), self.bias)
        soft = np.logaddexp(0, logits)
        sums = np.add.reduceat(soft, first[:-1]) if len(first) > 1 else np.zeros(0)
        worst = np.flatnonzero(logits >= np.log(OFFENDING / (1 - OFFENDING)))
        lows, highs = np.searchsorted(number, worst), np.searchsorted(number, worst, side="right")
        owner = np.searchsorted(first, worst, side="right") - 1
        places: list[list[dict]] = [[] for _ in range(len(sums))]
        chance = 1 / (1 + np.exp(-logits[worst]))
        for t, low, high, p in zip(owner.tolist(), lows.tolist(), highs.tolist(), chance.tolist()):
            base = int(found.bounds[t])
            places[t].append({"start": low - base, "end": min(high, int(found.bounds[t + 1]) - 1) - base, "score": p})
        return -np.expm1(-sums), places


def _bags(model: Model):
    """Per document its label, number of sentences, and the known features with their sentences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = letters.split(batch.column("text"))
            _, first = _sentences(found)
            at, sentence = model.matches(found)
            cuts = np.searchsorted(sentence, first)
            rows = [(at[a:b].astype(np.int32).tobytes(), (sentence[a:b] - base).astype(np.int32).tobytes())
                    for a, b, base in zip(cuts[:-1].tolist(), cuts[1:].tolist(), first[:-1].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(np.diff(first)), pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.binary())], names=["toxic", "n", "features", "sentences"])
    return run


def _fit(features: np.ndarray, rows: list) -> Model:
    """Gradient descent on the noisy-or likelihood of the sampled documents.

    Sentences without a known feature are alike, so only their number counts.
    """
    label = np.array([r["toxic"] for r in rows], np.float64)
    at = [np.frombuffer(r["features"], np.int32) for r in rows]
    within = [np.frombuffer(r["sentences"], np.int32) for r in rows]
    sizes = np.array([len(a) for a in at])
    document = np.repeat(np.arange(len(rows)), sizes)
    feature = np.concatenate(at) if at else np.zeros(0, np.int32)
    place = np.concatenate(within) if within else np.zeros(0, np.int32)
    new = np.ones(len(place), bool)
    new[1:] = (document[1:] != document[:-1]) | (place[1:] != place[:-1])
    sentence = np.cumsum(new) - 1
    owner = document[new]
    plain = np.array([r["n"] for r in rows], np.float64) - np.bincount(owner, minlength=len(rows))
    weights, bias = np.zeros(len(features)), START
    mean, square = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, STEPS + 1):
        logits = bias + np.bincount(sentence, weights[feature], len(owner))
        total = np.bincount(owner, np.logaddexp(0, logits), len(rows)) + plain * np.logaddexp(0, bias)
        pull = np.where(label > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / max(len(rows), 1)
        slope = pull[owner] / (1 + np.exp(-logits))
        gradient = np.append(np.bincount(feature, slope[sentence], len(features)) + RIDGE * weights,
                             slope.sum() + (pull * plain).sum() / (1 + np.exp(-bias)))
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        move = RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return Model(features, weights, bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, scratch: Scratch | None = None) -> Model:
    """Learn from ``docs`` (``doc_id, text``) that ``labels`` (``doc_id, toxic``) names.

    Null ids, texts and labels take no part; of several labels of one id the highest counts. With
    more than ``sample`` labels about so many are used. Without labels every score is near 0.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    bounded_batches(spark)
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.max("toxic") > 0).cast("double").alias("toxic")))
    known = scratch.keep(known, "labels")
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    # At most the sample's rows of 16 bytes.
    chosen = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = scratch.keep(chosen.join(F.broadcast(known), "doc_id").select("text", "toxic"), "sample")
    sums = chosen.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, every = sums["bad"] or 0.0, sums["n"]
    if not bad or bad == every:
        return Model(np.zeros(0, np.uint64), np.zeros(0), START if not bad else -START)
    counts = chosen.mapInArrow(_count, "feature long, bad long, n long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    # The usual statistic of a table of two by two.
    apart = (F.col("bad") - F.col("n") * (bad / every)) ** 2 * (every ** 3 / (bad * (every - bad)))
    certain = apart / (F.col("n") * F.greatest(every - F.col("n"), F.lit(1)))
    best = counts.where((F.col("n") >= LEAST_DOCUMENTS) & (certain >= CERTAIN)).select("feature").collect()
    features = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))
    empty = Model(features, np.zeros(len(features)), START)
    rows = chosen.mapInArrow(_bags(empty), "toxic double, n long, features binary, sentences binary").collect()
    rows.sort(key=lambda r: (r["toxic"], r["n"], r["features"], r["sentences"]))
    scratch.drop(chosen)
    return _fit(features, rows)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, offending`` for each row of ``docs`` (``doc_id, text``).

    ``offending`` lists ranges of characters of sentences that are toxic by themselves. A null or
    empty text scores as one empty sentence. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            values, places = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values), pa.array((values >= threshold).astype(np.int32)), pa.array(places, kind)],
                names=["doc_id", "score", "predicted", "offending"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start: long, end: long, score: double>>")
