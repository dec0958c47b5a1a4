"""Token ids of whole texts by a public tokenizer that drops white space, each distinct word encoded once per worker."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

CACHE_WORDS = 800_000  # words and, apart from them, pre-tokens that a Python worker remembers before it starts afresh
SEGMENT = 1 << 20  # characters of a text that are split into words at a time

# The normaliser and the split of the tokenizers whose words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same for words of printable ASCII and the letters of Latin-1, which are in normal form, once lower-cased.
PLAIN_WORD = re.compile("[!-~À-ÖØ-öø-ÿ]*")
PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


LETTERS = {b: c for c, b in byte_letters().items()}


def segments(text: str) -> Iterator[str]:
    """The text in parts of about SEGMENT characters, cut at blanks; a longer stretch without a blank stays whole."""
    start = 0
    while len(text) - start > SEGMENT:
        cut = text.rfind(" ", start + 1, start + SEGMENT)
        cut = cut if cut >= 0 else text.find(" ", start + SEGMENT)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


class WordEncoder:
    """Ids as the tokenizers library gives them, without special tokens added.

    This split drops white space and joins nothing across it, so a text's ids
    are those of its words. Words of printable ASCII and Latin-1 letters go to the
    BPE model by their pre-tokens, others through the whole tokenizer. A tokenizer of
    another kind gets whole texts.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        parts = json.loads(definition)
        split = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = parts["normalizer"] == NORMALIZER and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed"
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if not PLAIN_WORD.fullmatch(word) or any(s in word for s in self.special):
            return self._whole(word)
        pieces = PLAIN.findall(word.lower())
        for p in pieces:
            if p not in self.pieces:
                letters = p if p.isascii() else "".join(map(LETTERS.__getitem__, p.encode()))
                self.pieces[p] = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], self.dtype).tobytes()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.frombuffer(self._whole(text), self.dtype)
        parts = []
        for segment in segments(text):
            words = segment.replace("\n", " ").split(" ")
            new = set(words).difference(self.words)
            if len(self.words) + len(new) > CACHE_WORDS:
                self.words, new = {}, set(words)
            if len(self.pieces) > CACHE_WORDS:
                self.pieces = {}
            for word in new:
                self.words[word] = self._word(word)
            parts.append(b"".join(map(self.words.__getitem__, words)))
        return np.frombuffer(b"".join(parts), self.dtype)


@lru_cache(1)
def word_encoder(definition: str) -> WordEncoder:
    """The encoder of this Python worker; what it has learned serves its later tasks too."""
    return WordEncoder(definition)
