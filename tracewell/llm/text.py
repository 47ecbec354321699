"""Words and their hashes for whole Arrow batches of texts, without a loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_B = np.arange(256)
_WORD = ~((_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)))
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_STEP = U(0x9FB21C651E98DF25)
LONG_WORD = 64


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), off


def pieces(data: np.ndarray, off: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: first row, last row, bytes, offsets from zero."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes `inside`, else those that are no white space), and each text's first word."""
    w = inside[data]
    if not len(w):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    inner = off[(off > 0) & (off < len(w))]
    s[inner] = w[inner]
    e[inner - 1] = w[inner - 1]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, A-Z folded to a-z if asked; one pass for each character position."""
    data = _LOWER[data] if lower else data
    lens = ends - starts
    h = lens.astype(U) * U(0x9E3779B97F4A7C15)
    rows, at, k = np.arange(len(lens)), starts, 0
    left = lens
    while rows.size:
        if k == LONG_WORD:
            for i in rows:
                h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            break
        h[rows] = (h[rows] ^ _CODE[data[at + k]]) * _STEP
        k += 1
        more = left > k
        if not more.all():
            rows, at, left = rows[more], at[more], left[more]
    return mix(h)


def _token(h: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return (h >> U(8)) | ((255 - np.minimum(letters, 255)).astype(U) << U(56))


def shingle_hashes(h: np.ndarray, lens: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct tokens of its runs of `width` words; a shorter text is one run.

    A token is 8 bits that fall with the letters in the run and 56 bits of hash, so that runs of
    long words, which few texts share by chance, come first.
    """
    run = np.zeros(len(h), U)
    scale = mix(np.arange(1, width + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
    if len(h) >= width:
        n = len(h) - width + 1
        acc = np.zeros(n, U)
        for k in range(width):
            acc = mix(acc + h[k : k + n] * scale[k])
        size = np.cumsum(np.r_[0, lens])
        run[:n] = _token(acc, size[width:] - size[:-width])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            acc = np.full(1, b - a, U)
            for k in range(a, b):
                acc = mix(acc + h[k : k + 1] * scale[k - a])
            yield _token(acc, lens[a:b].sum(keepdims=True))
        else:
            yield np.empty(0, U)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """`shingle_hashes` of every text of an Arrow string column, in order."""
    data, off = text_buffer(column)
    for _, _, part, o in pieces(data, off):
        starts, ends, first = words(part, o)
        yield from shingle_hashes(word_hashes(part, starts, ends), ends - starts, first, width)
