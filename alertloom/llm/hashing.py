"""Vectorised 64-bit hashing of words and byte ranges in an Arrow string column.

All values are fixed functions of the bytes, the same in every process. Work arrays with eight bytes per
text byte are built for slices of ``SLICE`` bytes only, so memory follows the Arrow batch, not the hashing.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C55 | 1
U64 = np.uint64


def mix(x):
    """Finaliser that spreads every input bit over the 64 bits of the result."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n, salt):
    """``n`` odd 64-bit multipliers."""
    start = U64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + start) | U64(1)


def _powers(base, n):
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = seeds(256, 1)
_POWER = _powers(BASE, SLICE + 1024)
_INVERSE = _powers(pow(BASE, -1, 2**64), SLICE + 1024)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def space_table():
    """True for the bytes that separate words of non-blank characters."""
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def non_alnum_table():
    """True for ASCII bytes that are neither digits nor (lower-cased) letters."""
    sep = np.zeros(256, bool)
    sep[:0x80] = True
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
        sep[lo : hi + 1] = False
    return sep


def column_bytes(column):
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix(data):
    """Prefix sums P with hash(data[s:e]) = range_hash(P, s, e); for at most SLICE + 1023 bytes."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=out[1:])
    return out


def range_hash(sums, start, end):
    return mix((sums[end] - sums[start]) * _INVERSE[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def words(data, offsets, sep):
    """(start, end, first word of each text) of the words in concatenated texts."""
    inside = ~sep[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    starts = inside & ~before[:-1]
    starts[cuts] = inside[cuts]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    inner = cuts[cuts > 0]
    after[inner - 1] = False
    ends = inside & ~after
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data, start, end):
    """64-bit hash of each word with A-Z lower-cased."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        if end[i] - start[i] > SLICE:
            whole = LOWER[data[start[i] : end[i]]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
            i += 1
            continue
        j = int(np.searchsorted(end, start[i] + SLICE, side="right"))
        sums = prefix(LOWER[data[start[i] : end[j - 1]]])
        out[i:j] = range_hash(sums, start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return out


def batches(batch, max_bytes=8 << 20):
    """Zero-copy slices of an Arrow batch whose first string column stays near ``max_bytes``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        floor = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, floor + max_bytes, side="right")))
        yield batch.slice(i, j - i)
        i = j
