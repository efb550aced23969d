"""Quality rules as a short-circuit cascade.

1. A rule judges a text by features: whole numbers that each take one pass over a batch of texts.
   Base features are computed for every text; base rules judge by these alone.
2. Sample: on a bounded sample all rules judge all texts that the base rules pass. This gives the seconds that each
   feature takes and, for every set of rules that reject together, the number of texts.
3. Order: the next rule is the one that rejects most of the sample's texts still standing for each second that its
   features add to those already there. Rules that reject nothing in the sample come last, the cheapest first.
4. Cascade: features of a rule are computed only for texts that all earlier rules passed. The order says how much
   work is done, never which texts stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraload.llm import words
from terraload.llm.scratch import pieces

#: About so many documents are judged to find the order.
SAMPLE = 4000


def _byte_set(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


SYMBOLS = _byte_set("#*$%&|<>")
CAPITALS = _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ASCII_LETTERS = CAPITALS | _byte_set("abcdefghijklmnopqrstuvwxyz")
LETTERS = ASCII_LETTERS.copy()
LETTERS[128:] = True
#: Bytes that begin a character.
CHARACTERS = (np.arange(256) & 0xC0) != 0x80


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more; those alone in their bucket are not sorted."""
    bits = max(len(keys), 1).bit_length() + 2
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    crowded = np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] > 1)
    order = crowded[np.argsort(keys[crowded])]
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Texts:
    """A batch of texts: words, their hashes and lines with a word, each found once."""

    def __init__(self, found: words.Words, offsets: np.ndarray):
        self.words, self.offsets = found, offsets
        self._hashes = self._lines = None

    @classmethod
    def of(cls, column) -> Texts:
        return cls(words.split(column, lower=False), words.texts_of(column)[1])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def rows(self, keep: np.ndarray) -> Texts:
        """The texts at the places where ``keep`` is true."""
        w, sizes = self.words, np.diff(self.offsets)
        counts, kept_words = np.diff(w.first), np.repeat(keep, np.diff(w.first))
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[keep])])
        shift = np.repeat(self.offsets[:-1][keep] - offsets[:-1], counts[keep])
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[keep])])
        found = words.Words(w.data[np.repeat(keep, sizes)], w.starts[kept_words] - shift, w.ends[kept_words] - shift, first)
        out = Texts(found, offsets)
        if self._hashes is not None:
            out._hashes = self._hashes[kept_words]
        return out

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = words.hashes(self.words)
        return self._hashes

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first byte and end of each line that holds a word."""
        if self._lines is None:
            cuts = np.flatnonzero(self.words.data == 10)
            text, before = self.words.texts(), np.searchsorted(cuts, self.words.starts)
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (before[1:] != before[:-1])
            text, before = text[new], before[new]
            fence = np.concatenate([[-1], cuts, [len(self.words.data)]])
            self._lines = text, np.maximum(fence[before] + 1, self.offsets[text]), np.minimum(fence[before + 1], self.offsets[text + 1])
        return self._lines

    def per_text(self, word_values: np.ndarray) -> np.ndarray:
        return _sums(word_values, self.words.first)

    def count(self, members: np.ndarray) -> np.ndarray:
        """Bytes of each text that belong to a byte set."""
        return _sums(members[self.words.data], self.offsets)

    def lines_where(self, held: np.ndarray) -> np.ndarray:
        return np.bincount(self.lines()[0][held], minlength=len(self))


def n_words(t: Texts) -> np.ndarray:
    return np.diff(t.words.first).astype(np.int64)


def word_chars(t: Texts) -> np.ndarray:
    return t.count(CHARACTERS & ~words.SPACES)


def n_symbols(t: Texts) -> np.ndarray:
    return t.count(SYMBOLS)


def n_dup_lines(t: Texts) -> np.ndarray:
    text, starts, ends = t.lines()
    h = words.range_hashes(lambda low, high: words.BYTE_VALUES[t.words.data[low:high]], len(t.words.data), starts, ends)
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order[1:][same]], minlength=len(t))


def repeat_words(size: int) -> Callable[[Texts], np.ndarray]:
    """Words inside windows of ``size`` words that their text holds twice or more."""
    def feature(t: Texts) -> np.ndarray:
        text, h, n = t.words.texts(), t.hashes(), len(t.words.starts)
        if n < size:
            return np.zeros(len(t), np.int64)
        at = np.flatnonzero(text[:n - size + 1] == text[size - 1:])
        keys = words.mix(text[at].astype(np.uint64))
        with np.errstate(over="ignore"):
            for k in range(size):
                keys = (keys ^ h[at + k]) * words.BASE
                keys ^= keys >> np.uint64(29)
            again = at[_repeated(words.mix(keys))]
        edge = np.zeros(n + 1, np.int64)
        edge[again] += 1
        edge[again + size] -= 1
        return t.per_text(np.cumsum(edge[:-1]) > 0)
    return feature


def n_lines(t: Texts) -> np.ndarray:
    return np.bincount(t.lines()[0], minlength=len(t))


def n_capitals(t: Texts) -> np.ndarray:
    return t.count(CAPITALS)


def n_letters(t: Texts) -> np.ndarray:
    return t.count(ASCII_LETTERS)


def n_lettered(t: Texts) -> np.ndarray:
    """Words with an ASCII letter or any character beyond ASCII."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(LETTERS[t.words.data])])
    return t.per_text(total[t.words.ends] > total[t.words.starts])


def n_exclaimed(t: Texts) -> np.ndarray:
    """Words that end in two exclamation marks."""
    w = t.words
    return t.per_text((w.ends - w.starts > 1) & (w.data[w.ends - 1] == 33) & (w.data[w.ends - 2] == 33))


def longest_word(t: Texts) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(CHARACTERS[t.words.data])])
    out = np.zeros(len(t), np.int64)
    np.maximum.at(out, t.words.texts(), total[t.words.ends] - total[t.words.starts])
    return out


def n_bullets(t: Texts) -> np.ndarray:
    """Lines whose first character is ``-`` or ``*``."""
    return t.lines_where(np.isin(t.words.data[t.lines()[1]], np.array([45, 42], np.uint8)))


def n_cut_lines(t: Texts) -> np.ndarray:
    """Lines that end in three stops."""
    _, starts, ends = t.lines()
    dots = np.concatenate([np.zeros(3, bool), t.words.data == 46])
    return t.lines_where((ends - starts > 2) & dots[ends] & dots[ends + 1] & dots[ends + 2])


FEATURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_repeat_words": repeat_words(3), "n_repeat_10": repeat_words(10), "n_lines": n_lines, "n_capitals": n_capitals,
    "n_letters": n_letters, "n_lettered": n_lettered, "n_exclaimed": n_exclaimed, "longest_word": longest_word,
    "n_bullets": n_bullets, "n_cut_lines": n_cut_lines}


@dataclass(frozen=True)
class Rule:
    """``rejects`` says of which texts, given arrays of the features by name, this rule thinks badly."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


BASE_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda n, repeats: 100 * repeats > 50 * n),
)

#: Shares that reject a text.
RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda n, symbols: 10 * symbols > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, chars: (chars < 2 * n) | (chars > 12 * n)),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda lines, copies: 10 * copies > 3 * lines),
    Rule("capitals", ("n_letters", "n_capitals"), lambda letters, capitals: 2 * capitals > letters),
    Rule("exclamations", ("n_words", "n_exclaimed"), lambda n, exclaimed: 10 * exclaimed > n),
    Rule("letters", ("n_words", "n_lettered"), lambda n, lettered: 10 * lettered < 7 * n),
    Rule("long_word", ("longest_word",), lambda longest: longest > 1000),
    Rule("bullets", ("n_lines", "n_bullets"), lambda lines, bullets: 10 * bullets > 9 * lines),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda lines, cut: 10 * cut > 3 * lines),
    Rule("long_repeats", ("n_words", "n_repeat_10"), lambda n, repeats: 10 * repeats > 3 * n),
)


class _Batch:
    """Texts still standing, their features, and where they were in the batch."""

    def __init__(self, column):
        self.texts, self.features = Texts.of(column), {}
        self.at, self.seconds = np.arange(len(column)), {}

    def feature(self, name: str) -> np.ndarray:
        if name not in self.features:
            started = time.perf_counter()
            self.features[name] = FEATURES[name](self.texts)
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - started
        return self.features[name]

    def rejected(self, rule: Rule) -> np.ndarray:
        return np.asarray(rule.rejects(*[self.feature(f) for f in rule.features]), bool)

    def drop(self, bad: np.ndarray) -> None:
        if bad.any():
            keep = ~bad
            self.texts = self.texts.rows(keep)
            self.features = {name: values[keep] for name, values in self.features.items()}
            self.at = self.at[keep]


def _measured(rules: Sequence[Rule], base_rules: Sequence[Rule], base_features: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, together = {}, {}
        for batch in pieces(batches):
            held = _Batch(batch.column("text"))
            for name in base_features:
                held.feature(name)
            for rule in base_rules:
                held.drop(held.rejected(rule))
            held.seconds = {}
            bits = np.zeros(len(held.at), np.int64)
            for k, rule in enumerate(rules):
                bits |= held.rejected(rule).astype(np.int64) << k
            for name, spent in held.seconds.items():
                seconds[name] = seconds.get(name, 0.0) + spent
            for value, n in zip(*np.unique(bits, return_counts=True)):
                together[int(value)] = together.get(int(value), 0) + int(n)
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([*seconds, *[None] * len(together)], pa.string()),
            "bits": pa.array([*[None] * len(seconds), *together], pa.int64()),
            "amount": pa.array([*seconds.values(), *map(float, together.values())], pa.float64())})
    return run


def ordered(rules: Sequence[Rule], known: Sequence[str], seconds: dict[str, float], together: dict[int, int]) -> list[Rule]:
    """Rules by rejection for each second, each judged by what the ones before it leave.

    ``seconds`` has each feature's cost, those ``known`` cost nothing; ``together`` has, for each set of
    rejecting rules (a bit for each rule), the number of texts.
    """
    open_, there, left, out = list(range(len(rules))), set(known), dict(together), []
    while open_:
        def price(k: int) -> float:
            return sum(seconds.get(f, 0.0) for f in rules[k].features if f not in there) + 1e-9

        def gain(k: int) -> int:
            return sum(n for bits, n in left.items() if bits >> k & 1)

        best = max(open_, key=lambda k: (gain(k) / price(k), -price(k), -k))
        open_.remove(best)
        there |= set(rules[best].features)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
        out.append(rules[best])
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, base_rules: Sequence[Rule] = BASE_RULES,
         base_features: Sequence[str] = BASE_FEATURES, sample: int = SAMPLE) -> list[Rule]:
    """The order of ``rules``, from about ``sample`` rows of ``docs`` (``text``). An empty sample leaves them as they are.

    Without bits and seconds of more than the sample's texts, what reaches the driver is bounded by it.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    n = docs.count()
    some = docs.select("text") if n <= sample else docs.select("text").sample(sample / n, seed=13)
    rows = (some.mapInArrow(_measured(rules, base_rules, base_features), "feature string, bits long, amount double")
            .groupBy("feature", "bits").agg(F.sum("amount").alias("amount")).collect())
    return ordered(rules, base_features, {r["feature"]: r["amount"] for r in rows if r["feature"] is not None},
                   {r["bits"]: int(r["amount"]) for r in rows if r["feature"] is None})


def _judged(cascade: Sequence[Rule], base_rules: Sequence[Rule], base_features: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held, n = _Batch(batch.column("text")), batch.num_rows
            base = [held.feature(name) for name in base_features]
            bad_base, rejected_by, judged = np.zeros(n, bool), np.full(n, None, object), np.zeros(n, np.int32)
            for rule in base_rules:
                bad = held.rejected(rule)
                rejected_by[held.at[bad]] = rule.name
                bad_base[held.at[bad]] = True
                held.drop(bad)
            for rule in cascade:
                if not len(held.at):
                    break
                bad = held.rejected(rule)
                judged[held.at] += 1
                rejected_by[held.at[bad]] = rule.name
                held.drop(bad)
            kept = np.zeros(n, bool)
            kept[held.at] = True
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["text"]).columns, *[pa.array(v, pa.int64()) for v in base], pa.array(bad_base), pa.array(kept),
                 pa.array(rejected_by, pa.string()), pa.array(judged)],
                names=[*(c for c in batch.schema.names if c != "text"), *base_features, "base_failed", "kept", "rejected_by", "n_judged"])
    return run


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base_rules: Sequence[Rule] = BASE_RULES,
          base_features: Sequence[str] = BASE_FEATURES, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the base features, ``base_failed, kept, rejected_by, n_judged`` for each row of ``docs`` (``doc_id, text``).

    ``rejected_by`` is the first rule that rejects a text, null for kept ones; ``n_judged`` counts the rules of the
    cascade that saw it. Both hang on the order, which is measured, so reruns may differ in them; all else is the same
    each time. A null or empty text has no words, fails the base rules and is not kept. Rows are judged one by one,
    so repeated ids and rows are no matter; other columns are ignored, and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cascade = plan(rows, rules, base_rules, base_features, sample)
    schema = ", ".join(["doc_id long", *(f"{name} long" for name in base_features), "base_failed boolean, kept boolean, rejected_by string, n_judged int"])
    return rows.mapInArrow(_judged(cascade, base_rules, base_features), schema)


def good_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept; texts pass through Arrow once and rows do not move.

    Rules, sample and treatment of odd rows are those of ``judge``.
    """
    cascade = plan(docs, **settings)
    fixed = {k: v for k, v in settings.items() if k in ("base_rules", "base_features")}
    keep = _judged(cascade, fixed.get("base_rules", BASE_RULES), fixed.get("base_features", BASE_FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            verdict = next(keep(iter([batch.select(["text"])])))
            yield batch.filter(verdict.column("kept"))

    return docs.mapInArrow(run, docs.schema)
