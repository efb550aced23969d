"""Token ids of whole texts by the ``tokenizers`` library, with a memory for words.

For vocabularies that lower-case, drop white space and mark word ends. Their splitter never lets a
piece reach over white space, so a text's ids are those of its chunks between white space, one
after the other. A chunk of plain characters (ASCII, lower- or upper-case Latin-1 letters, no apostrophe)
is cut further where letters, digits and other signs meet; each such unit is one piece. A unit met
before is looked up. New plain units go through the library's model a thousand at a time, and their
ids are told apart by the word-end tokens; all other chunks go through the whole library. The memory
is bounded and changes no id.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from terraload.llm import words

REMEMBERED = 250_000
AT_ONCE = 1000
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_open: dict[str, "WordTokenizer"] = {}


def _classes() -> np.ndarray:
    kinds = np.full(256, _ODD, np.uint8)
    kinds[0x21:0x7F] = _SIGN
    kinds[ord("a"):ord("z") + 1] = _LETTER
    kinds[ord("0"):ord("9") + 1] = _DIGIT
    kinds[[ord("'"), ord("<")]] = _ODD
    kinds[words.SPACES] = _SPACE
    return kinds


CLASSES = _classes()


def _byte_letters() -> dict[int, str]:
    """The usual letter for each byte: printable bytes stand for themselves, others for 256 and up."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in kept}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(kept)))
    del letters[0x20]
    return letters


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        suffix = json.loads(self.library.to_str())["model"]["end_of_word_suffix"]
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.is_end = np.array([(self.library.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.letters = _byte_letters()
        self._forget()

    @classmethod
    def open(cls, path: str) -> "WordTokenizer":
        """One per worker process."""
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.pool, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _add(self, units: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        while n + len(units) >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.known.update(zip(units, range(n, n + len(units))))
        self.first[n + 1:n + 1 + len(units)] = self.filled + np.cumsum(lengths)
        self.pool[self.filled:self.filled + len(ids)] = ids
        self.filled += len(ids)

    def _learn(self, plain: list[bytes], odd: list[bytes]) -> None:
        if plain:
            parts = [b" ".join(plain[i:i + AT_ONCE]).decode("latin-1").translate(self.letters)
                     for i in range(0, len(plain), AT_ONCE)]
            found = self.model.encode_batch_fast(parts, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            ends = np.flatnonzero(self.is_end[ids]) + 1
            self._add(plain, ids, np.diff(ends, prepend=0))
        if odd:
            each = [e.ids for e in self.library.encode_batch_fast([u.decode() for u in odd], add_special_tokens=False)]
            self._add(odd, np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each]))

    def _units(self, column) -> tuple[words.Words, np.ndarray]:
        """Units as words, and whether each goes through the whole library."""
        raw, offsets = words.texts_of(column)
        data = words.LOWER[raw]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        mark = data[lead + 1]
        data[lead + 1] += np.where((mark <= 0x9E) & (mark != 0x97), 0x20, 0).astype(np.uint8)
        kinds = CLASSES[data]
        lead = lead[(data[lead + 1] >= 0x9F) & (data[lead + 1] != 0xB7)]
        kinds[lead] = kinds[lead + 1] = _LETTER
        inside = kinds != _SPACE
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < len(data)]
        head[edges] = inside[edges]
        chunk = np.cumsum(head, dtype=np.int32) - 1
        odd = np.zeros(int(chunk[-1]) + 1 if len(chunk) else 0, bool)
        odd[chunk[kinds == _ODD]] = True
        odd_byte = odd[chunk] & inside if len(odd) else np.zeros(len(data), bool)
        data = np.where(odd_byte, raw, data)
        head[1:] |= (kinds[1:] != kinds[:-1]) & inside[1:] & ~odd_byte[1:]
        head |= (kinds == _DIGIT) & ~odd_byte
        starts = np.flatnonzero(head)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | head[1:]
        edges = edges[edges > 0]
        last[edges - 1] = inside[edges - 1]
        found = words.Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))
        return found, odd_byte[starts]

    def encode(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, each text's followed by ``end_id``, and the texts' bounds."""
        found, odd = self._units(column)
        codes, _ = pd.factorize(words.hashes(found))
        n = int(codes.max(initial=-1)) + 1
        sample = np.zeros(n, np.int64)
        sample[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        raw = found.data.tobytes()
        units = [raw[a:b] for a, b in zip(found.starts[sample].tolist(), found.ends[sample].tolist())]
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [(u, o) for u, o in zip(units, odd[sample].tolist()) if u not in self.known]
        self._learn([u for u, o in new if not o], [u for u, o in new if o])
        at = np.array(list(map(self.known.__getitem__, units)), np.int64)[codes]
        lengths = self.first[at + 1] - self.first[at]
        text_ends = np.arange(1, len(found.first))
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        bounds = before[found.first] + np.arange(len(found.first))
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        place = np.repeat(self.first[at] - before[:-1], lengths) + np.arange(int(before[-1]))
        shift = np.repeat(text_ends - 1, np.diff(before[found.first]))
        out[np.arange(int(before[-1])) + shift] = self.pool[place]
        return out, bounds
