"""Hashes of the words of many texts at once, from the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
# Among ``heads``: the first eight bytes themselves, A-Z lower-cased, zeros after the end of the word.
BYTES = -8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64


def separators(also: bytes = b"") -> np.ndarray:
    """Which bytes end a word: ASCII white space and what is given."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E), *also]] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _letters() -> np.ndarray:
    """A fixed random value per byte; A-Z have the values of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    table[65:91] = table[97:123]
    return table


_LETTERS = _letters()
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] = _LOWER[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < size:
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]))
    return _POWERS["up"], _POWERS["down"]


def _first_bytes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for i in range(8):
        letters = _LOWER[data[np.minimum(starts + i, len(data) - 1)]]
        out |= np.where(starts + i < stops, letters, np.uint64(0)) << np.uint64(56 - 8 * i)
    return out


def hash_of_bytes(first: np.ndarray, head: int) -> np.ndarray:
    """The hash that ``word_hashes`` gives the first ``head`` of eight bytes, for words without zero bytes."""
    total = np.zeros(len(first), np.uint64)
    for i in range(head):
        letter = (first >> np.uint64(56 - 8 * i)) & np.uint64(255)
        total += np.where(letter > 0, _LETTERS[letter] * np.uint64(pow(int(_MULTIPLIER), i, 1 << 64)), np.uint64(0))
    return mix(total)


def _hash(data: np.ndarray, edges: np.ndarray, ends: np.ndarray, heads: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of joined texts and, for each of ``edges``, the number of words that start before it."""
    size = len(data)
    if not size:
        return np.zeros((len(heads), 0) if heads else 0, np.uint64), np.zeros(len(edges), np.int64)
    inside = ~ends[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = edges[(edges > 0) & (edges < size)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(max(size, CHUNK))
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[:size], out=sums[1:])
    words = [
        _first_bytes(data, starts, stops) if h == BYTES
        else mix((sums[np.minimum(stops, starts + h) if h else stops] - sums[starts]) * down[starts]) for h in heads or [None]]
    return np.stack(words) if heads else words[0], np.searchsorted(starts, edges)


def word_hashes(
    texts: pa.Array, ends: np.ndarray, heads: tuple | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows of a string column without nulls: first row, word hashes, places of the rows in them.

    ``heads`` asks for several hashes of each word, one row each: of so many
    first bytes, or with None of the whole word, or with BYTES the bytes.

    A run has at most CHUNK bytes or one row. A longer text is hashed in
    pieces that end between words, so only its word hashes are held whole.
    """
    texts = texts.cast(pa.large_binary())
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        begin, stop = int(offsets[at]), int(offsets[to])
        if stop - begin <= CHUNK:
            hashes, places = _hash(data[begin:stop], offsets[at:to + 1] - begin, ends, heads)
        else:
            parts = []
            while begin < stop:
                cut = min(stop, begin + CHUNK)
                while cut < stop and not ends[data[cut]]:
                    cut += 1
                parts.append(_hash(data[begin:cut], np.zeros(0, np.int64), ends, heads)[0])
                begin = cut
            hashes = np.concatenate(parts, axis=-1)
            places = np.array([0, hashes.shape[-1]])
        yield at, hashes, places
        at = to


def runs_of(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words; fewer words are one run, none are none."""
    if not len(words):
        return words
    length_used = min(length, len(words))
    total = np.zeros(len(words) - length_used + 1, np.uint64)
    factors = mix(np.arange(1, length_used + 1, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)
    for i in range(length_used):
        total += words[i:i + len(total)] * factors[i]
    return mix(total)
