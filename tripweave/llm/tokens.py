"""Encoding of whole texts with a public byte-level BPE, one unit of text at a time."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .common import only_cache

#: Unicode White_Space, as the tokenizer's own pattern understands ``\s``. Fixed values.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that make a unit of their own where white space, an ASCII sign or the end follows.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
_SIGN = "!-@\\[-`{-~"
_UNIT = re.compile(
    f" ?[{_LETTER}]++(?=[{_SIGN}{_SPACE}]|\\Z)| ?[^{_SPACE}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORD = re.compile(f" ?[{_LETTER}]+")

#: Distinct units a worker remembers; beyond it, those not used since half as many were new go.
CACHE_UNITS = 600_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder(dict):
    """Ids of a unit as little-endian unsigned 32-bit integers, encoded when first seen.

    Texts are cut at the tokenizer's added tokens first, as the tokenizer does, and only the
    pieces between them into units. Units are right for byte-level BPE without a normalizer;
    with any other tokenizer, texts are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        cut, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        # Attributes, not the tokenizer as JSON: that holds the whole vocabulary and all merges.
        self.by_units = (
            plain and self.tokenizer.normalizer is None and isinstance(model, models.BPE)
            and not model.dropout and not model.continuing_subword_prefix
            and not model.end_of_word_suffix and isinstance(cut, pre_tokenizers.ByteLevel)
            and not cut.add_prefix_space and cut.use_regex
        )
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.model, self.letters = model, _byte_letters()
        self.before: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        made = self.before.get(unit)
        if made is None:
            if _WORD.fullmatch(unit):
                letters = unit.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(letters)]
            else:
                ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
            made = np.array(ids, "<u4").tobytes()
        if len(self) >= CACHE_UNITS // 2:
            self.before = dict(self)
            self.clear()
        self[unit] = made
        return made

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, 4 bytes each; null counts as empty.

        Between added tokens the byte-level pattern never joins characters across the end of a
        run of letters, or across the border before a space that is followed by a word, so the
        ids of a text are those of its units one after another.
        """
        if not text:
            return b""
        if not self.by_units:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.__getitem__, _UNIT.findall(text)))
        out = []
        for i, piece in enumerate(self.cut.split(text)):
            out += [self.added[piece]] if i % 2 else map(self.__getitem__, _UNIT.findall(piece))
        return b"".join(out)


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, with what it remembers of earlier tasks."""
    only_cache("units", _encoder.cache_clear)
    return _encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
