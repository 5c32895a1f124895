"""Words of whole texts as numpy arrays over the UTF-8 bytes, without a Python object for each word.

A word is a run of bytes other than space and the ASCII controls 9 to 13; as those are single bytes in UTF-8, bytes and
code points give the same words. Hashes are 64-bit polynomials (wrapping), mixed; equal words have equal hashes anywhere.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
PIECE = 1 << 17
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < size."""
    inverse = pow(base, -1, 2**64)
    return tuple(np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, inverse))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each run, mixed."""
    size = 1 << max(10, int(len(values) + 1).bit_length())
    up, down = powers(base, size)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each run, for runs in order; by pieces of about PIECE bytes, as a hash takes 40 bytes a byte."""
    out = np.empty(len(starts), np.uint64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(starts // PIECE)) + 1, [len(starts)]]) if len(starts) else [0]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        a = starts[i]
        out[i:j] = run_hashes(BYTE_VALUE[data[a : ends[j - 1]]], starts[i:j] - a, ends[i:j] - a, BYTE_BASE)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def to_strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


class Words:
    """starts, ends: byte places of each word; of_doc: where each text's words begin (one more entry than texts)."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        data, self.offsets = text_buffers(texts)
        self.data = LOWER[data] if lower else data
        inside = ~IS_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] |= inside[edges]
        stops[edges - 1] |= inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.of_doc = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.of_doc)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Each text's kept words joined by one space."""
        return join_runs(self.data, self.offsets, self.starts, self.ends, self.of_doc, kept, 32)


def join_runs(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_doc: np.ndarray, kept: np.ndarray, separator: int) -> pa.Array:
    """Each text's kept runs of bytes joined by a separator, which takes the place of the byte after a run."""
    mask = np.zeros(len(data) + 1, np.int32)
    np.add.at(mask, starts[kept], 1)
    np.subtract.at(mask, ends[kept], 1)
    mask = np.cumsum(mask[:-1], dtype=np.int32) > 0
    data = data.copy()
    places = np.flatnonzero(kept)
    owner = np.searchsorted(of_doc, places, "right") - 1
    gap = ends[places[:-1][owner[:-1] == owner[1:]]] if len(places) else places
    data[gap] = separator
    mask[gap] = True
    return to_strings(data[mask], np.concatenate([[0], np.cumsum(mask)])[offsets])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size consecutive entries."""
    n = max(0, len(hashes) - size + 1)
    starts = np.arange(n)
    return run_hashes(hashes, starts, starts + size, WORD_BASE)


def sliding(op: np.ufunc, values: np.ndarray, size: int) -> np.ndarray:
    """op (minimum or maximum) over every run of size values, by doubling."""
    if len(values) < size:
        return values[:0]
    done = 1
    out = values
    while 2 * done <= size:
        out = op(out[:-done], out[done:])
        done *= 2
    if done < size:
        out = op(out[: len(values) - size + 1], out[size - done :][: len(values) - size + 1])
    return out
