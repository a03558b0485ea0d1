"""Numpy helpers on Arrow text columns: words, hashes and runs of whole batches at once.

Texts stay UTF-8 bytes. All separators that the operators use are ASCII, so byte positions and
code points agree about where a word ends. Hashes are 64-bit; sums and products wrap on purpose.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend only on the seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BYTE_CODE = random_words(256, 11)
LANE = random_words(64, 12)
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=U64)
        if size <= 1 << 21:
            _powers[base] = known
    return known[:n]


#: \x20 and \x09-\x0D
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: \x00-\x2F, \x3A-\x60 and \x7B-\x7F
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text starts (one more entry than texts). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text has a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (one more entry than texts)."""
    inside = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.append(inside, False)
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * powers(BASE_INV, len(data) + 1)[starts])


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of tokens[i : i + k] for every i; the caller drops those that cross a text's end."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    acc = tokens[:n] * LANE[0]
    for j in range(1, k):
        acc += mix64(tokens[j : j + n] ^ LANE[j]) if j & 1 else tokens[j : j + n] * LANE[j]
    return mix64(acc)


def byte_gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of data[i : i + k] for every i, by doubling."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    piece, size = BYTE_CODE[data], 1
    acc, done = None, 0
    while True:
        if k & size:
            part = piece[done : done + n]
            acc = part.copy() if acc is None else acc * U64(pow(BASE, size, 1 << 64)) + part
            done += size
        if done == k:
            return mix64(acc)
        piece = piece[: len(piece) - size] * U64(pow(BASE, size, 1 << 64)) + piece[size:]
        size *= 2


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """min(values[i : i + w]) for every i, by doubling."""
    size = 1
    while size * 2 <= w:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = w - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def inside_texts(offsets: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of k tokens: the starts that stay inside one text, and each one's text."""
    counts = np.maximum(0, np.diff(offsets) - k + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    skipped = offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.arange(len(text)) + skipped[text], text


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers for each i."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, first all lowest bytes, then all next ones: it compresses well."""
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)


def cut_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column of data[offsets[i] : offsets[i + 1]]."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def trimmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; afterwards the worker's freed memory goes back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that leaves a small worker behind: workers live on, and their freed memory adds up."""
    return lambda batches: trimmed(run(batches))


def packed(column: pa.Array) -> pa.Array:
    """Texts compressed one by one, for a shuffle: less than half of what Spark's block compression leaves. Null: empty."""
    squeeze = zstandard.ZstdCompressor(level=1)
    return pa.array([squeeze.compress(t.as_buffer()) if t.is_valid else b"" for t in column], pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of packed texts one after another, and where each starts, as ``text_buffers``."""
    expand = zstandard.ZstdDecompressor()
    texts = [expand.decompress(b) if b else b"" for b in column.to_pylist()]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets
