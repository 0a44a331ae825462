"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy.

A hash of a word is a polynomial over random values of its bytes, taken from running sums over the bytes
of a whole batch, so no Python step is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U8, U64 = np.uint8, np.uint64
_RNG = np.random.default_rng(20240711)
#: A random odd value for each byte, and the base of the polynomial with its inverse modulo 2^64.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = int(_RNG.integers(1, 2**62, dtype=np.int64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes worked on at once; longer words are taken whole.
SEGMENT = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=U8)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: For words of letters: everything in ASCII that is none ends a word; bytes of other scripts are letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[128:] = False
NO_LETTER[65:91] = False
NO_LETTER[97:123] = False

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, SEGMENT + 1)
        table = np.empty(size, U64)
        table[0] = 1
        done = 1
        while done < size:
            more = min(done, size - done)
            table[done : done + more] = table[:more] * U64(pow(base, done, 1 << 64))
            done += more
        if size <= SEGMENT + 1:
            _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ends of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], U8) if column.buffers()[2] else np.empty(0, U8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """The column in parts of about ``most`` bytes each, or of one longer text, so that what is made of a part
    stays small."""
    ends = text_bytes(column)[1]
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield column.slice(at, stop - at)
        at = stop


def parts(batch: pa.RecordBatch, texts: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts, as :func:`slices` cuts its column of texts. After each, Arrow's pool gives back
    what is free in it, which a worker that is used again would keep."""
    at = 0
    for column in slices(batch.column(texts), most):
        yield batch.slice(at, len(column))
        at += len(column)
        pa.default_memory_pool().release_unused()


def word_hashes(data: np.ndarray, letter: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, in order: runs of bytes that ``breaks`` does not mark, each byte
    read as ``letter`` says."""
    return np.concatenate([h for h, _ in _runs(data, letter, breaks, np.array([len(data)]), ())] or [np.empty(0, U64)])


def _runs(data, letter, breaks, ends, heads) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, starts) of words, a segment at a time; no word spans two texts. With ``heads`` there is a row
    of hashes for each, of the words' first so many bytes, 0 for words that are not longer."""
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + SEGMENT)
        if stop < n:
            broken = breaks[data[stop - 1 : at : -1]] if stop - at > 1 else np.empty(0, bool)
            back = int(np.argmax(broken)) if broken.any() else -1
            text_end = int(np.searchsorted(ends, stop, "right")) - 1
            last_end = int(ends[text_end]) if text_end >= 0 and ends[text_end] > at else -1
            cut = max(stop - back if back >= 0 else -1, last_end)
            if cut > at:
                stop = cut
            else:  # one word fills the segment: go on to its end
                following = breaks[data[stop:]]
                far = stop + int(np.argmax(following)) if following.any() else n
                k = int(np.searchsorted(ends, stop, "left"))
                stop = min(far, int(ends[k])) if k < len(ends) else far
        part = data[at:stop]
        inside = ~breaks[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(ends, [at, stop])
        cuts = ends[lo:hi] - at
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        first[cuts] |= inside[cuts]
        last = np.zeros(len(part) + 1, bool)
        last[1:] = inside
        last[1:-1] &= first[1:] | ~inside[1:]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last)
        running = np.empty(len(part) + 1, U64)
        running[0] = 0
        values = _BYTE[letter[part]] if letter is not SAME else _BYTE[part]
        values *= _power_table(_BASE, len(part))
        np.cumsum(values, out=running[1:])
        back_to_one = _power_table(_INVERSE, len(part))[starts]
        sizes = stops - starts
        hashes = mix((running[stops] - running[starts]) * back_to_one + sizes.astype(U64))
        if heads:
            rows = [hashes]
            for k in heads:
                head = (running[starts + np.minimum(k, sizes)] - running[starts]) * back_to_one
                rows.append(np.where(sizes > k, mix(head + U64(k + (1 << 32))), U64(0)))
            hashes = np.stack(rows)
        yield hashes, starts + at
        at = stop


def words(
    column: pa.Array, letter: np.ndarray = SAME, breaks: np.ndarray = WHITE, heads: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and how many words each text has. With ``heads`` there is a
    row of hashes for whole words and one for each number of first bytes (0 where a word is not longer)."""
    data, ends = text_bytes(column)
    hashes, starts = [], []
    for h, s in _runs(data, letter, breaks, ends, heads):
        hashes.append(h)
        starts.append(s)
    if not hashes:
        return np.empty((1 + len(heads), 0) if heads else 0, U64), np.zeros(len(column), np.int64)
    counts = np.diff(np.searchsorted(np.concatenate(starts), ends, "left"), prepend=0)
    return np.concatenate(hashes, axis=-1), counts


_SLOT = [int(x) * 2 + 1 for x in _RNG.integers(1, 2**62, 16, dtype=np.int64)]


def _join(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; runs of other lengths have other hashes."""
    size = len(hashes) - n + 1
    total = np.full(size, n * 0x9E3779B97F4A7C15 % 2**64, U64)
    for i in range(n):
        total += mix(hashes[i : i + size] + U64(i)) * U64(_SLOT[i % 16])
    return mix(total)


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``n`` words, A-Z as a-z, sorted; with fewer words one for the
    whole; none for a text without words."""
    for part in slices(column, 1 << 20):
        hashes, counts = words(part, LOWER)
        runs = _join(hashes, n) if len(hashes) >= n else np.empty(0, U64)
        at = 0
        for c in counts.tolist():
            if c >= n:
                yield np.unique(runs[at : at + c - n + 1])
            elif c:
                yield _join(hashes[at : at + c], c)
            else:
                yield np.empty(0, U64)
            at += c
