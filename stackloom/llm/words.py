"""Words of Arrow text columns as numpy arrays: bounds and 64-bit hashes, without a Python object per word.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return
(``[^\\x20\\x09-\\x0D]+``). Hashes are polynomials over the field of integers modulo 2**61 - 1, taken as differences of one
running sum, so a batch costs a few array passes whatever its words are. In a field two different words of n bytes agree in
n of 2**61 bases at most; modulo a power of two some pairs would agree in every base.
"""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
import pyarrow as pa

PRIME = np.uint64(2**61 - 1)
_random = np.random.Generator(np.random.PCG64(20240607))
BASE = int(_random.integers(2**32, 2**61 - 2, dtype=np.uint64))
SHINGLE_BASE = int(_random.integers(2**32, 2**61 - 2, dtype=np.uint64))
CHECK_BASE = np.uint64(_random.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
CHECK_SIGN = np.uint64(_random.integers(1, 2**63, dtype=np.uint64))
#: What each byte counts; never zero, so that leading bytes matter.
BYTE_VALUES = np.arange(1, 257, dtype=np.uint64)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 1 << 19
#: Running sums of longer words could pass 64 bits; such words are hashed one by one.
LONG_WORD = 1 << 23
BLOCK = 1 << 16

_powers: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def times(a: np.ndarray, b) -> np.ndarray:
    """Products modulo ``PRIME`` of values below it (``b``: array or number), from halves of 30 and 31 bits."""
    b = np.asarray(b, dtype=np.uint64)
    half, low30, low31 = np.uint64(31), np.uint64(2**30 - 1), np.uint64(2**31 - 1)
    a1, a0, b1, b0 = a >> half, a & low31, b >> half, b & low31
    middle = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & low30) << half) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo ``PRIME``."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _power_table(base: int, size: int) -> np.ndarray:
    table = np.ones(1, dtype=np.uint64)
    while len(table) < size:
        table = np.concatenate([table, times(table, pow(base, len(table), int(PRIME)))])
    return table[:size]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, their lower 31 bits and the bits above, and powers of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < size:
        size = max(size, CHUNK_BYTES + 1)
        powers = _power_table(BASE, size)
        _powers = powers & np.uint64(2**31 - 1), powers >> np.uint64(31), _power_table(pow(BASE, -1, int(PRIME)), size)
    return _powers


class _Running:
    """Hashes of any stretch of ``data`` from one pass over it."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        self.data, self.values = data, values
        low, high, self.inverses = _power_tables(len(data) + 1)
        worth = values[data]
        self.low, self.high = np.zeros(len(data) + 1, dtype=np.uint64), np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(worth * low[:len(data)], out=self.low[1:])
        np.cumsum(worth * high[:len(data)], out=self.high[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = reduced(self.low[end] - self.low[begin]), reduced(self.high[end] - self.high[begin])
        found = times(reduced(low + times(high, 2**31)), self.inverses[begin])
        for i in np.flatnonzero(end - begin > LONG_WORD):
            word = self.values[self.data[begin[i]:end[i]]].astype("<u2").tobytes()
            found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") % int(PRIME)
        return mix(found)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


IS_MARK = np.ones(256, dtype=bool)  # separators of plain words: all of ASCII but letters and digits
IS_MARK[128:] = IS_MARK[48:58] = IS_MARK[65:91] = IS_MARK[97:123] = False


@dataclasses.dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of text ``d``; ``hash`` has one value per word.

    ``begin`` and ``end`` are byte places in all texts together, ``heads`` has the hash of each word's first bytes; both only
    where asked for.
    """

    first: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    heads: list[np.ndarray]

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def flat_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the offset of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(texts, lower: bool = False, separators: np.ndarray = IS_SPACE, heads: tuple[int, ...] = (),
             places: bool = False) -> Words:
    """Words of each text; ``lower`` makes A-Z equal to a-z, ``heads`` asks for hashes of so many first bytes."""
    data, offsets = flat_bytes(texts)
    values = LOWER_VALUES if lower else BYTE_VALUES
    counts, hashes, begins, closed, leads = [], [], [], [], [[] for _ in heads]
    begin, last = 0, len(offsets) - 1
    while begin < last:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, side="right")) - 1)
        part, bounds = data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]
        inside = ~separators[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[bounds] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        running = _Running(part, values)
        hashes.append(running.of(starts, ends))
        if places:
            begins.append(starts + offsets[begin])
            closed.append(ends + offsets[begin])
        for lead, length in zip(leads, heads):
            lead.append(running.of(starts, np.minimum(starts + length, ends)))
        counts.append(np.diff(np.searchsorted(starts, bounds)))
        begin = end
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(last + 1, np.int64)
    whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Words(first.astype(np.int64), whole(hashes, np.uint64), whole(begins, np.int64), whole(closed, np.int64),
                 [whole(lead, np.uint64) for lead in leads])


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``length`` hashes (runs may cross texts)."""
    return _in_blocks(_rolling, hashes, length, np.uint64)


def rolling_check(hashes: np.ndarray, length: int) -> np.ndarray:
    """A second hash of every run, of 32 bits and by another rule, for runs whose first hashes agree."""
    return _in_blocks(_rolling_check, hashes, length, np.uint32)


def _in_blocks(rule, hashes: np.ndarray, length: int, kind) -> np.ndarray:
    """A rule over runs, a block at a time: what it computes on the way stays small."""
    out = np.empty(max(0, len(hashes) - length + 1), kind)
    for a in range(0, len(out), BLOCK):
        out[a:a + BLOCK] = rule(hashes[a:a + BLOCK + length - 1], length)
    return out


def _rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """From runs of powers of two; the longer run stands in front of what has been put together so far."""
    done, result, have, size = 0, None, reduced(hashes), 1
    while True:
        if length & size:
            if result is None:
                result = have
            else:
                n = min(len(have), len(result) - size)
                result = reduced(times(have[:n], pow(SHINGLE_BASE, done, int(PRIME))) + result[size:size + n])
            done += size
        if done == length:
            return mix(result[:len(hashes) - length + 1])
        have = reduced(times(have[:-size], pow(SHINGLE_BASE, size, int(PRIME))) + have[size:])
        size *= 2


def _rolling_check(hashes: np.ndarray, length: int) -> np.ndarray:
    done, result, have, size = 0, None, mix(hashes ^ CHECK_SIGN), 1
    while True:
        if length & size:
            if result is None:
                result = have
            else:
                n = min(len(have), len(result) - size)
                result = have[:n] * np.uint64(pow(int(CHECK_BASE), done, 2**64)) + result[size:size + n]
            done += size
        if done == length:
            return (mix(result[:len(hashes) - length + 1]) >> np.uint64(32)).astype(np.uint32)
        have = have[:-size] * np.uint64(pow(int(CHECK_BASE), size, 2**64)) + have[size:]
        size *= 2


def runs_within(words: Words, length: int) -> np.ndarray:
    """Whether the run of ``length`` words that begins at each word stays inside its text."""
    text = words.text_of_word()
    return text[:len(text) - length + 1] == text[length - 1:] if len(text) >= length else np.zeros(0, bool)
