"""Tokenizer files of the ``tokenizers`` library inside Spark tasks."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable

import numpy as np

#: words whose ids a worker remembers before it starts anew, besides those of one text; about 200 bytes each
REMEMBERED = 1_000_000


def vocabulary_path(name: str) -> str:
    """Place of an installed public vocabulary file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lengths[0]], flat[starts[1]:...], ... end to end."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)]


#: letters and signs whose kind, lower case and normal form are beyond doubt, all within one byte of Latin-1
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = bytes(b for b in range(256) if re.fullmatch(rf"[{LETTERS} \n\t\r!-~]", chr(b)))


def _plain(text: str) -> bool:
    """No character that could be taken in two ways, and no mark of a special token."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def _stand_ins() -> dict[int, str]:
    """Characters as byte-level vocabularies write their UTF-8, for ``str.translate``."""
    byte = byte_stand_ins()
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}


@functools.cache
def byte_stand_ins() -> list[str]:
    """The printable character that stands for each byte, as published for byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class _Numbered(dict):
    """Words with their numbers; one that is looked up for the first time gets the next number and is listed in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of texts from the ids of their words, which a worker remembers.

    A text of plain characters is cut by ``pattern``, the vocabulary's own, and each new word is merged by the tokenizer's model: much
    cheaper than the whole library. Other texts are cut by ``cut``, which must cut only where the tokenizer cuts whatever stands on both
    sides; pieces with unusual characters or marks of special tokens then go through the whole library.
    """

    def __init__(self, path: str, pattern: str, cut: Callable[[str], list[str]], lower: bool, remembered: int = REMEMBERED):
        self.tokenizer, self.cut, self.lower, self.remembered = load(path), cut, lower, remembered
        self.find, self.model, self.table = re.compile(pattern).findall, self.tokenizer.model, _stand_ins()
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbered()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _words(self, text: str) -> list[str]:
        if _plain(text):
            return self.find(text.lower() if self.lower else text)
        # no plain word begins with the sign of a piece that is not plain
        return [x for piece in self.cut(text) for x in (self._words(piece) if _plain(piece) else ["\0" + piece])]

    def _ids(self, word: str) -> list[int]:
        if word[0] == "\0":
            return self.tokenizer.encode(word[1:], add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(word if word.isalpha() and word.isascii() else word.translate(self.table))]

    def _learn(self) -> None:
        """Ids of the words that were looked up for the first time."""
        new, self.index.new = self.index.new, []
        encoded = [self._ids(word) for word in new]
        known, lengths = len(self.index) - len(new), np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.index) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, total)
        self.lengths[known : len(self.index)] = lengths
        self.starts[known : len(self.index)] = self.used + np.cumsum(lengths) - lengths
        self.used += total

    def encode(self, text: str) -> np.ndarray:
        """Ids as uint32."""
        if len(self.index) > self.remembered:
            self._clear()
        words = self._words(text)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self._learn()
        return gather(self.flat, self.starts[at], self.lengths[at])
