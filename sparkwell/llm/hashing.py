"""Hashes of the words of texts, by arithmetic over blocks of characters.

A word is a run of letters and digits of the lowered text. Its hash is a polynomial in its code
points, found for all words of a block at once from running sums; no dictionary of words is kept, so
that the memory of a worker doesn't depend on the texts it has seen. A text longer than a block is
cut between words.

Words that are what stands between blanks, and those of letters and digits where a block of texts is wanted at once, are
hashed from their bytes (blank_word_blocks, word_blocks).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import xxhash

#: Code points that are hashed at once.
BLOCK = 1 << 17

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BLOCK)


def _hashed(block: list[str]) -> Iterator[np.ndarray]:
    s = "\n".join([*block, ""])
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _alnum()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.append(0, edges)
    begin, end = edges[::2], edges[1::2]
    power, inverse = _usual_powers() if len(codes) <= BLOCK else _powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint32(1)) * power[: len(codes)], out=sums[1:])
    h = mixed((sums[end] - sums[begin]) * inverse[begin])
    cuts = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in block)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield h[a:b]


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of BLOCK - 1 code points at most, cut between words; a longer word is a part of its own."""
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + BLOCK - 1)
        if to < n:
            cut = to
            while cut > at and text[cut - 1].isalnum():
                cut -= 1
            while cut == at and to < n and text[to].isalnum():
                to += 1
            to = cut if cut > at else to
        yield text[at:to]
        at = to


def word_hashes(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order."""
    block: list[str] = []
    n = 0
    for t in texts:
        t = t.lower()
        if n + len(t) >= BLOCK:
            yield from _hashed(block)
            block, n = [], 0
        if len(t) >= BLOCK:
            yield np.concatenate([h for part in _parts(t) for h in _hashed([part])])
        else:
            block.append(t)
            n += len(t) + 1
    yield from _hashed(block)


#: Bytes of words: A to Z in lower case; only blanks (space and 0x09 to 0x0D) are 0, and 0 is a byte that UTF-8 doesn't have.
_LOWERED = bytes(0 if b in b" \t\n\x0b\x0c\r" else 255 if b == 0 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_EIGHTS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)


def _blank_hashed(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a block, and how many each text has."""
    return _run_hashes(b"\n".join([*block, b"\n" * 8]).translate(_LOWERED), block)


def _run_hashes(data: bytes, block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of bytes other than 0, and how many each text of the block has. They are read in eights, those beyond two of them one by one."""
    inside = np.frombuffer(data, np.uint8) != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    begin, end = edges[::2], edges[1::2]
    n = end - begin
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # those that begin at each byte
    h = (eights[begin] & _FIRST[np.minimum(n, 8)]) * _EIGHTS[0]
    more = np.flatnonzero(n > 8)
    h[more] += (eights[begin[more] + 8] & _FIRST[np.minimum(n[more] - 8, 8)]) * _EIGHTS[1]
    h = mixed(h)
    for k in more[n[more] > 16].tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[begin[k]:end[k]])
    return h, np.diff(np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in block)])))


def _blank_parts(data: bytes) -> Iterator[bytes]:
    """Long data in parts of about BLOCK bytes, cut at blanks; a longer word is a part of its own."""
    blank = np.flatnonzero(np.frombuffer(data.translate(_LOWERED), np.uint8) == 0)
    at = 0
    while at < len(data):
        k = int(np.searchsorted(blank, at + BLOCK - 1, "right"))
        before = int(blank[k - 1]) if k and blank[k - 1] >= at else None
        to = len(data) if at + BLOCK - 1 >= len(data) else before + 1 if before is not None else int(blank[k]) + 1 if k < len(blank) else len(data)
        yield data[at:to]
        at = to


def blank_word_blocks(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of the words of texts in order, block by block, and how many each text has; a word is what stands between blanks, A to Z in lower case."""
    block: list[bytes] = []
    n = 0
    for t in texts:
        data = t.encode()
        if n + len(data) >= BLOCK:
            if block:
                yield _blank_hashed(block)
            block, n = [], 0
        if len(data) >= BLOCK:
            h = np.concatenate([_blank_hashed([part])[0] for part in _blank_parts(data)])
            yield h, np.array([len(h)])
        else:
            block.append(data)
            n += len(data) + 1
    if block:
        yield _blank_hashed(block)


def blank_word_hashes(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order, as blank_word_blocks() says."""
    for h, counts in blank_word_blocks(texts):
        yield from np.split(h, np.cumsum(counts)[:-1])


#: Bytes of words of letters and digits: A to Z in lower case, other ASCII 0, what isn't ASCII as it is.
_LETTERS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 0 for b in range(256))


def _letters_hashed(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As _blank_hashed(), for words of letters and digits; of characters beyond ASCII their code points tell."""
    data = b"\n".join([*block, b"\n" * 8]).translate(_LETTERS)
    codes = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero(codes >= 0xC0)
    begun = codes[lead]
    blank = []  # bytes of other characters than letters and digits
    for n, least, most in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        at = lead[(begun >= least) & (begun < most)]
        if len(at):
            point = codes[at].astype(np.int64) & (0xFF >> n + 1)
            for k in range(1, n):
                point = point << 6 | codes[at + k] & 63
            at = at[~_alnum()[point]]
            blank += [at + k for k in range(n)]
    if sum(map(len, blank)):
        changed = bytearray(data)
        np.frombuffer(changed, np.uint8)[np.concatenate(blank)] = 0
        data = bytes(changed)
    return _run_hashes(data, block)


def word_blocks(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of the words of texts in order, block by block, and how many each text has; a word is a run of letters and digits of the lowered text. Other hashes than those of word_hashes()."""
    block: list[bytes] = []
    n = 0
    for t in texts:
        t = t if t.isascii() else t.lower()  # ASCII is lowered with its block
        data = t.encode("utf-8", "surrogatepass")
        if n + len(data) >= BLOCK:
            if block:
                yield _letters_hashed(block)
            block, n = [], 0
        if len(data) >= BLOCK:
            h = np.concatenate([_letters_hashed([part.encode("utf-8", "surrogatepass")])[0] for part in _parts(t)])
            yield h, np.array([len(h)])
        else:
            block.append(data)
            n += len(data) + 1
    if block:
        yield _letters_hashed(block)
