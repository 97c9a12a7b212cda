"""Words of many texts at once, as numpy arrays.

A batch of UTF-8 texts is one byte buffer.  Word bounds come from a 256-entry
byte table; word hashes come from one prefix sum of a polynomial hash, so the
cost is a few array passes per byte and nothing runs per word in Python.
Hashes are 64 bit and equal in every process.  A polynomial over the 64-bit
ring has fixed collisions in long regular strings (a Thue-Morse word of 1024
letters and its complement), so words and lines above LONG bytes are hashed by
a cryptographic digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
LONG = 512

#: Word bytes of the pattern [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z, all non-ASCII)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply): spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, U64(base))
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _powers[base] = have
    return have[:n]


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the polynomial hash of bytes i..j-1, times base**i."""
    out = np.zeros(len(a) + 1, U64)
    np.cumsum(BYTE_VALUE[a] * powers(BASE, len(a)), dtype=U64, out=out[1:])
    return out


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges start..end-1 of the buffer that ``s`` is of."""
    inverse = powers(BASE_INVERSE, len(s))
    return mix((s[end] - s[start]) * inverse[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def bytes_hash(a: np.ndarray, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of any length of the buffer ``a``, of which ``s`` is the prefix hash."""
    h = range_hash(s, start, end)
    for i in np.flatnonzero(end - start > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(a[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """Words of a chunk of texts; ``doc`` is the text's place in the chunk."""

    data: np.ndarray
    n_docs: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(self.combined(at, k) + U64(salt))

    def combined(self, at: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(at), U64)
        for j in range(k):
            h = h * U64(BASE) + self.hash[at + j]
        return h


def words_of(texts: list[bytes], table: np.ndarray, lower: bool) -> Words:
    """lower: A-Z only, as bytes.lower() does."""
    joined = b"\n".join(texts) + b"\n"
    if lower:
        joined = joined.lower()
    a = np.frombuffer(joined, np.uint8)
    inside = table[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    doc = np.searchsorted(ends, start, side="right")
    return Words(a, len(texts), doc, start, end, bytes_hash(a, prefix_hash(a), start, end))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of a batch with about ``most`` bytes of text (one text at least): (first row, texts); null is empty."""
    column = batch.column(batch.schema.get_field_index(column))
    texts = [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= most):
            size += len(texts[last])
            last += 1
        yield first, texts[first:last]
        first = last


def hex_free(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs that Spark holds."""
    return x.view(np.int64)
