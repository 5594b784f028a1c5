"""Word fingerprints of Arrow text columns, computed on whole byte buffers with numpy.

A batch is worked on in chunks of a quarter MB, so memory does not grow with the batch; a text longer
than a chunk is a chunk of its own. Workers stay for the next tasks, so they give memory back after
each (``tidy``).
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

CHUNK_BYTES, SLICE_ROWS = 1 << 18, 256
U = np.uint64
#: An odd multiplier that is 3 modulo 4, so that differences of powers lose one bit at most.
P_WORD = 0xD6E8FEB86659FD97
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_kept: dict = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below ``size``."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers; they are kept for the next chunk unless a text is very long."""
    n = 1 << max(16, int(size).bit_length())
    if n > 4 * CHUNK_BYTES:
        p, q = _powers(base, size)
    else:
        if (base, n) not in _kept:
            _kept[base, n] = _powers(base, n)
        p, q = _kept[base, n]
    return p[:size], q[:size]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class Chunk:
    lo: int  #: first row of the batch
    hi: int
    texts: list[bytes]
    words: np.ndarray  #: a fingerprint for each word of all texts
    at: np.ndarray  #: words of text k are words[at[k]:at[k + 1]]


def slices(col: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The column's texts as bytes, some rows at a time: first row, texts."""
    for lo in range(0, len(col), SLICE_ROWS):
        yield lo, [x or b"" for x in col.slice(lo, SLICE_ROWS).cast(pa.binary()).to_pylist()]


def chunks(col: pa.Array, lower: bool = False, seed: int = 0) -> Iterator[Chunk]:
    for start, texts in slices(col):
        lo = size = 0
        for hi, t in enumerate(texts):
            if hi > lo and size + len(t) > CHUNK_BYTES:
                yield _chunk(start + lo, start + hi, texts[lo:hi], lower, seed)
                lo, size = hi, 0
            size += len(t) + 1
        yield _chunk(start + lo, start + len(texts), texts[lo:], lower, seed)


def tidy() -> None:
    """Give unused memory back to the system."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def _chunk(lo: int, hi: int, texts: list[bytes], lower: bool, seed: int) -> Chunk:
    raw = b"\n".join(texts) + b"\n" + bytes(8)
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = ~_SPACE[data[:-8]]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, stops = edge[0::2], edge[1::2]
    at = np.concatenate([[0], np.searchsorted(starts, ends)])
    return Chunk(lo, hi, texts, _word_names(data, starts, stops, seed), at)


def _word_names(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    """Each word eight bytes at a time: the name so far and the next bytes are mixed, from the seed and
    the length on. No sum of powers, which patterned words of 2,048 bytes cancel whatever the base."""
    n = stops - starts
    names = mix(n.astype(U) + mix(np.full(1, seed + 1, dtype=U)))
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    left = np.flatnonzero(n <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        left = left[n[left] > k]
        if not len(left):
            break
        names[left] = mix(names[left] ^ (eight[starts[left] + k] & _FIRST[np.minimum(n[left] - k, 8)]))
    for i in np.flatnonzero(n > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        names[i] = np.frombuffer(digest, dtype="<u8")[0]
    return names


class Spans:
    """Fingerprints of word spans from one prefix sum."""

    def __init__(self, words: np.ndarray):
        p, self.inv = powers(P_WORD, len(words) + 1)
        self.acc = np.zeros(len(words) + 1, dtype=U)
        np.cumsum(words * p[:-1], out=self.acc[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.acc[stop] - self.acc[start]) * self.inv[start] + (stop - start).astype(U))


def shipped(module: str) -> None:
    """Send the module's functions to Python workers by value: workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


shipped(__name__)
