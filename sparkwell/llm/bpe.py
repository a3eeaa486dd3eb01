"""Byte-level BPE ids of whole texts, by a public vocabulary.

Texts are cut at single spaces into chunks, chunks by the vocabulary's own pattern into words, and
the ids of each distinct chunk and word are looked up in bounded memories before the tokenizer is
asked. The pattern is written out for characters up to U+00FF; a text with any other character goes
to the tokenizer as a whole. Where white space meets a cut, the pattern is applied to the whole text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from sparkwell.llm.common import vocabulary_path

BYTE_BPE = "byte_bpe_50k.json"
#: Entries of the memories of chunks and of words, which are emptied when full, and code points of an entry at most: some 100 MB for each worker.
CHUNKS, WORDS, LONGEST = 400_000, 200_000, 40

# Letters and numbers (Unicode classes L and N) and white space up to U+00FF.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_PLAIN = bytes(i for i in range(256) if i in b"\t\n\r" or 32 <= i < 127 or i > 160 and i != 173)
_STOPS = {",", ".", ";", ":", "!", "?"}
#: White space on both sides of a cut.
_MEETS = re.compile("[\\t\\n\\r ] (?:[\\t\\n\\r ]|$)")


# Byte-level vocabularies write a byte as a printable character: itself if printable, else the next one from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class _Words(dict):
    """Ids of a word: one match of the pattern."""

    def __init__(self, tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(word)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, word: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(word.encode().decode("latin-1").translate(_BYTES))])


class _Chunks(dict):
    """Ids of a chunk with the space before it."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words = words

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = self.words.ids(f" {chunk}")
        elif chunk[-1:] in _STOPS and chunk[:-1].isalpha():
            ids = self[chunk[:-1]] + self.words[chunk[-1]]
        else:
            ids = b"".join(map(self.words.__getitem__, _WORD.findall(f" {chunk}")))
        if len(chunk) <= LONGEST:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """encode(text): the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = _Words(self.tokenizer)
        self.chunks = _Chunks(self.words)

    def encode(self, text: str) -> bytes:
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if (text[-2:].isspace() or "  " in text or " \n" in text or " \t" in text or " \r" in text) and _MEETS.search(text):
            return b"".join(map(self.words.__getitem__, _WORD.findall(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.words.__getitem__, _WORD.findall(first)), *map(self.chunks.__getitem__, rest)])


@lru_cache(maxsize=4)
def encoder(name: str = BYTE_BPE) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary_path(name))
