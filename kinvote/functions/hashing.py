"""Token hashes, MinHash signatures and Bloom indices."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SEED

PRIME = (1 << 31) - 1  # Mersenne prime: a remainder is two shifts and adds
_CHUNK_VALUES = 1 << 14  # working set of a chunk stays in the CPU cache


def coefficients(count: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """``count`` pairs (a, b) of the hash family, the same for a seed on every machine."""

    def draw(kind: str, j: int) -> int:
        return int(hashlib.md5(f"{seed}:{kind}:{j}".encode()).hexdigest()[:8], 16)

    a = [1 + draw("a", j) % (PRIME - 1) for j in range(count)]
    b = [draw("b", j) % PRIME for j in range(count)]
    return a, b


def hash32(col: Column) -> Column:
    """First 32 bits of the md5 as a bigint: stable over engines, runs and partitions."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def seeded_hash(key: Column, seed: int = SEED) -> Column:
    """``md5(seed:key)``: a stable pseudo-random order of the rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, hash32)


def _minima(values: np.ndarray, starts: np.ndarray, a: list[int], b: list[int]) -> np.ndarray:
    out = np.empty((len(starts), len(a)), dtype=np.int32)
    x = values.astype(np.uint64) + np.uint64(1)
    v, high = np.empty_like(x), np.empty_like(x)
    prime, bits = np.uint64(PRIME), np.uint64(31)
    for j, (aj, bj) in enumerate(zip(a, b)):
        np.multiply(x, np.uint64(aj), out=v)
        np.add(v, np.uint64(bj), out=v)
        for _ in range(2):  # below 2^63 -> below 2^33 -> at most p + 3
            np.right_shift(v, bits, out=high)
            np.bitwise_and(v, prime, out=v)
            np.add(v, high, out=v)
        np.subtract(v, prime, out=high)  # wraps to a huge value where v < p
        np.minimum(v, high, out=v)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def _as_lists(flat: np.ndarray, sizes: np.ndarray, mask, type_) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=type_), mask=mask)


def list_sizes(lists: pa.ListArray) -> np.ndarray:
    """Lengths of the lists; 0 for a null."""
    return np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)


def signature_udf(num_hashes: int, seed: int = SEED):
    """Vectorised MinHash: ``min((1 + x) * a_j + b_j mod p)`` over a row's token hashes.

    Built-in forms of this (nested array lambdas, or one aggregate per hash over exploded
    tokens) are interpreted or overflow code generation; on Arrow batches it is a few
    array operations per hash. An empty token list gives an empty signature.
    """
    a, b = coefficients(num_hashes, seed)

    @F.arrow_udf("array<int>")
    def signature(hashes: pa.Array) -> pa.Array:
        sizes = list_sizes(hashes)
        values = np.asarray(hashes.flatten(), dtype=np.int64)
        full = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[full])
        starts = ends - sizes[full]
        parts, row = [], 0
        while row < len(full):
            # rows whose values fit one chunk (a single long row may exceed it)
            stop = int(np.searchsorted(ends, starts[row] + _CHUNK_VALUES, side="right"))
            stop = max(stop, row + 1)
            lo, hi = starts[row], ends[stop - 1]
            parts.append(_minima(values[lo:hi], starts[row:stop] - lo, a, b))
            row = stop
        flat = np.concatenate(parts).ravel() if parts else np.empty(0, dtype=np.int32)
        out_sizes = np.where(sizes > 0, num_hashes, 0)
        return _as_lists(flat, out_sizes, hashes.is_null(), pa.int32())

    return signature


def minhash_signature(tokens: Column, num_hashes: int, seed: int = SEED) -> Column:
    return signature_udf(num_hashes, seed)(token_hashes(tokens))


_ADLER_MOD = 65521


def _adler32(strings: pa.Array) -> np.ndarray:
    """Adler-32 of the UTF-8 bytes of each string, from the Arrow buffers."""
    wide = strings.cast(pa.large_string())
    _, offset_buf, data_buf = wide.buffers()
    offsets = np.frombuffer(offset_buf, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    first = offsets[0] if len(offsets) else 0
    octets = np.frombuffer(data_buf or b"", dtype=np.uint8)[first : offsets[-1] if len(offsets) else 0]
    octets = octets.astype(np.int64)
    bounds = offsets - first
    # running sums; differences stay right even where the position-weighted sum wraps
    plain = np.concatenate([[0], np.cumsum(octets)])
    weighted = np.concatenate([[0], np.cumsum(octets * np.arange(len(octets)))])
    start, end = bounds[:-1], bounds[1:]
    total = plain[end] - plain[start]
    low = (1 + total) % _ADLER_MOD
    high = ((end - start) + end * total - (weighted[end] - weighted[start])) % _ADLER_MOD
    return high * 65536 + low


def bloom_udf(size: int, num_hashes: int):
    """Bit positions of a row's words and their crc32, some thousand words at a time."""

    @F.arrow_udf("array<int>")
    def positions(words: pa.Array, crcs: pa.Array) -> pa.Array:
        sizes = list_sizes(words)
        flat, crc = words.flatten(), np.asarray(crcs.flatten(), dtype=np.int64)
        steps = np.arange(num_hashes, dtype=np.int64)
        ends = np.cumsum(sizes)
        parts, counts, row = [], [], 0
        while row < len(sizes):
            # rows whose words fit one chunk (a single long row may exceed it)
            first = ends[row] - sizes[row]
            stop = max(int(np.searchsorted(ends, first + _CHUNK_VALUES, side="right")), row + 1)
            some = slice(first, ends[stop - 1])
            bits = (crc[some, None] + steps * _adler32(flat[some])[:, None]) % size
            rows = np.repeat(np.arange(stop - row), sizes[row:stop] * num_hashes)
            # one sorted run of distinct (row, bit) pairs
            pairs = np.unique(rows * size + bits.ravel())
            parts.append((pairs % size).astype(np.int32))
            counts.append(np.bincount(pairs // size, minlength=stop - row))
            row = stop
        bits = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return _as_lists(bits, np.concatenate(counts) if counts else sizes, words.is_null(), pa.int32())

    return positions


def bloom_indices(tokens: Column, size: int, num_hashes: int) -> Column:
    """Sorted distinct bit positions ``(crc32 + i * adler32) mod size`` of all tokens.

    Spark has no Adler-32; it is computed on Arrow batches next to the built-in crc32.
    """
    distinct = F.array_distinct(tokens)
    return bloom_udf(size, num_hashes)(distinct, F.transform(distinct, lambda t: F.crc32(F.encode(t, "UTF-8"))))
