"""Vectorised hashing of words and word n-grams.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are
lower-cased.  Words of a batch of texts are hashed together: every byte is
mapped to a random 64-bit value, a running sum of ``value * P**position``
(mod 2**64) is taken once, and the hash of a word is the difference of two
running sums, brought back to position zero.  No Python object is made for a
word.  Hashes have 64 bits; two different words or n-grams are taken as equal
with a chance of about 2**-64 for each pair.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: ASCII letters and digits, and all bytes over 127, make words; the rest stands between them.
_NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_COEF = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: np.ndarray = np.ones(1, dtype=np.uint64)
_inverse: np.ndarray = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    """Powers of P and of its inverse mod 2**64, for n positions."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _P, np.uint64))])
            _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, np.uint64(pow(int(_P), -1, 2**64))))])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None], letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the offsets of each text's words.

    With letters, punctuation stands between words too.  A null text counts as empty.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_LOWER) + b" ", dtype=np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    space = (_NO_LETTER if letters else _SPACE)[data]
    before = np.concatenate([[True], space[:-1]])
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    _grow(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[data] * _powers[: len(data)])
        first = np.where(start > 0, total[start - 1], np.uint64(0))
        h = mix((total[end - 1] - first) * _inverse[start] + (end - start).astype(np.uint64))
    offsets = np.concatenate([[0], np.searchsorted(start, ends_of_text)]) if len(raw) else np.zeros(1, np.int64)
    return h, offsets.astype(np.int64)


def batches(texts: list, limit: int = 1 << 20):
    """Ranges of rows whose texts hold about limit characters (one text at least)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for every n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(n))
        for k in range(n):
            h = h + words[k : k + m] * _COEF[k]
        return mix(h)


def shingle_sets(texts: list[str | None], n: int = 5):
    """For each text the sorted distinct hashes of its n-word shingles.

    With fewer than n words the whole sequence is one shingle; without words the set is empty.
    """
    for lo, hi in batches(texts):
        words, off = word_hashes(texts[lo:hi])
        grams = ngram_hashes(words, n)
        for i in range(hi - lo):
            a, b = off[i], off[i + 1]
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield ngram_hashes(words[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
