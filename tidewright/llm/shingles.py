"""Word shingles of whole Arrow columns as 64-bit hashes, without a Python loop over words.

Word hashes come from one prefix sum of a polynomial over the bytes (modulo 2^64, base odd and so invertible); a shingle's
hash is a mixed linear form of its words' hashes. Texts are taken in slices of about SLICE_BYTES, and their bytes are hashed
CHUNK_BYTES at once, so what is held besides a slice's words does not grow with a text; a text longer than a slice takes about
ten times its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 500_000
CHUNK_BYTES = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FORM = [np.uint64(x) for x in (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def _powers(x: np.uint64) -> np.ndarray:
    out = np.full(CHUNK_BYTES + 1, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_BACK)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, row after the last, bytes, and row offsets into them (rows + 1)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES)))
        end = min(end, n)
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_bounds(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes that are not ASCII white space, inside one row."""
    n = len(b)
    inside = np.zeros(n + 2, np.bool_)
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    starts_here = inside[1:] & ~inside[:-1]
    ends_here = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    joined = cuts[inside[cuts] & inside[cuts + 1]]  # two rows' words that touch
    starts_here[joined] = True
    ends_here[joined] = True
    return np.flatnonzero(starts_here), np.flatnonzero(ends_here)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word: the mixed sum of (byte + 1) * BASE^place. Words are taken as many as end within CHUNK_BYTES."""
    out = np.zeros(len(starts), np.uint64)
    total = np.zeros(CHUNK_BYTES + 1, np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        after = int(np.searchsorted(ends, origin + CHUNK_BYTES, side="right"))
        if after == first:  # one word longer than a chunk
            out[first] = _long_word(b[origin : ends[first]])
            first += 1
            continue
        n = int(ends[after - 1] - origin)
        np.cumsum((b[origin : origin + n].astype(np.uint64) + np.uint64(1)) * _UP[:n], out=total[1 : n + 1])
        begin = starts[first:after] - origin
        out[first:after] = (total[ends[first:after] - origin] - total[begin]) * _DOWN[begin]
        first = after
    return mixed(out)


def _long_word(b: np.ndarray) -> np.uint64:
    total, lift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for k in range(0, len(b), CHUNK_BYTES):
        part = b[k : k + CHUNK_BYTES].astype(np.uint64) + np.uint64(1)
        total += lift * (part * _UP[: len(part)]).sum(dtype=np.uint64)
        lift *= _UP[CHUNK_BYTES]
    return total[0]


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + 32, b)


def shingle_lists(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row and the hashes of its shingles in order of place, repeats included: every run of `width` words of the text with
    A-Z lower-cased; with fewer words the whole sequence as one; without words none."""
    for first, last, b, offsets in slices(texts):
        starts, ends = word_bounds(b, offsets)
        words = word_hashes(lower_ascii(b), starts, ends)
        bounds = np.searchsorted(starts, offsets)
        if len(words) >= width:
            form = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                form += words[k : len(words) - width + 1 + k] * _FORM[k]
            runs = mixed(form)
        else:
            runs = np.zeros(0, np.uint64)
        for row in range(last - first):
            s, e = bounds[row], bounds[row + 1]
            if e - s >= width:
                yield first + row, runs[s : e - width + 1]
            elif e > s:
                whole = np.array([e - s], np.uint64)
                for k in range(s, e):
                    whole = mixed(whole * _FORM[1] + words[k])
                yield first + row, whole
            else:
                yield first + row, runs[:0]
