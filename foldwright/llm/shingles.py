"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy.

A word is a run of ASCII letters and digits, underscores and other than ASCII characters, lower-cased. A shingle is SHINGLE
words in a row; a text of fewer words (but one at least) has one shingle, of all its words.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BLOCK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_WORD = np.zeros(256, dtype=np.int8)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and its inverse modulo 2**64, for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, _BLOCK), b, dtype=np.uint64)]))
                      for b in (_ODD, inverse)]
    return _POWERS[0], _POWERS[1]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one entry more than texts)."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    change = np.flatnonzero(np.diff(_WORD[joined], prepend=np.int8(0)))
    starts, ends = change[0::2], change[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            # As many words as lie within a block of bytes, one at least.
            upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
            low, high = starts[at], ends[upto - 1]
            power, inverse = _powers(int(high - low))
            terms = (joined[low:high].astype(np.uint64) + np.uint64(1)) * power[:high - low]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            part = (sums[ends[at:upto] - low] - sums[starts[at:upto] - low]) * inverse[starts[at:upto] - low]
            out[at:upto] = mixed(part)
            at = upto
    begins = np.cumsum([0] + [len(d) + 1 for d in data])
    return out, np.searchsorted(starts, begins)


def shingles(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the shingles of every text, in text order, with repeats."""
    word, begin = words(texts)
    with np.errstate(over="ignore"):
        joined = np.zeros(max(len(word) - n + 1, 0), dtype=np.uint64)
        for k in range(n):
            joined = joined * _ODD + word[k:k + len(joined)]
        joined = mixed(joined)
        out = []
        for b, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if e - b >= n:
                out.append(joined[b:e - n + 1])
            else:
                value = np.zeros(min(e - b, 1), dtype=np.uint64)
                for k in range(b, e):
                    value = value * _ODD + word[k]
                out.append(mixed(value + np.uint64(1)))
    return out


def batches_of(texts: list[str], most_chars: int = 500_000):
    """(begin, end) of consecutive texts of at most most_chars characters together, one text at least."""
    begin = 0
    while begin < len(texts):
        end, chars = begin, 0
        while end < len(texts) and (end == begin or chars + len(texts[end]) <= most_chars):
            chars += len(texts[end])
            end += 1
        yield begin, end
        begin = end
