"""Hashes of the words and word shingles of many texts at a time, in numpy.

A word is a run of bytes other than blank and control white space
(`[^\\x20\\x09-\\x0D]+`) of the UTF-8 text, A-Z lowered. Its 64-bit hash is a
polynomial over the bytes, so one cumulative sum gives the hashes of all words
of a batch without a loop over words. The same text has the same hashes in
every process.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: What a byte belongs to: 0 for what parts words, and a number for each kind of word.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0
_LETTER = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
LETTERS = np.where(_LETTER, WORDS, 0).astype(np.uint8)
LETTERS_AND_SIGNS = np.where(_LETTER, WORDS, 2 * WORDS).astype(np.uint8)
#: A random number for each byte.
_BYTE = np.random.Generator(np.random.PCG64(20_24)).integers(1, 1 << 63, 256, np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(1 << n.bit_length(), (_BASE, _INVERSE)[which], np.uint64)
        step[0] = 1
        _powers[which] = np.multiply.accumulate(step)
    return _powers[which][:n]


def hashed_words(texts, kinds: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and for each text where its words begin (one more entry than texts). None counts as ''.

    A word is a run of bytes of one kind.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    joined = b"\n".join([*raw, b""])
    data = np.frombuffer(joined.lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    kind = kinds[data]
    edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]])
    word = kind[edge[:-1]] != 0
    begin, end = edge[:-1][word], edge[1:][word]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(0, len(data)), out=sums[1:])
        hashes = (sums[end] - sums[begin]) * _power(1, len(data))[begin]
        hashes = mix(hashes + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))


def batches(texts, most: int = 1 << 19):
    """Index ranges of about `most` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingled(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of `width` words, in place, and where each text's runs begin.

    A text with fewer words gives one hash of them all; without words, none.
    """
    counts = np.diff(starts)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(bounds[-1]) + np.repeat(starts[:-1] - bounds[:-1], runs)
    last = np.repeat(starts[1:], runs) - at
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for i in range(width):
            step = (out ^ padded[at + i]) * np.uint64(0xD6E8FEB86659FD93)
            out = np.where(last > i, step ^ (step >> np.uint64(32)), out)
    return mix(out), bounds


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for a, b in batches(texts):
        hashes, bounds = shingled(*hashed_words(texts[a:b]), width)
        out += [np.unique(hashes[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
    return out
