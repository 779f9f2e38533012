"""Words and hashes of Arrow text columns, computed over whole byte buffers with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

# ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_TABLE = LOWER.tobytes()

#: Lower-cases A-Z and turns every byte outside ALNUM into a space.
ALNUM_TABLE = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; kept up to the size of a chunk."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n + 1:
        size = max(n, CHUNK_BYTES) + 1
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size > 16 * CHUNK_BYTES:
            return up, down
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, null as empty, and the offsets of its rows."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str, size: int = CHUNK_BYTES):
    """Slices of record batches with about ``size`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """Words of every row of a text column: byte spans, and the first word of each row."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool = False):
        data, offsets = buffers(texts)
        self.raw = data
        self.data = LOWER[data] if lower else data
        inside = kind[self.data] if kind is ALNUM else ~kind[self.data]
        n = len(inside)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.offsets = offsets
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.heads = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.heads)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.heads) - 1), self.counts)

    def hashes(self, *prefixes: int) -> np.ndarray | list[np.ndarray]:
        """A 64-bit hash of each word's bytes; with ``prefixes``, also of the words' first so many bytes."""
        n = len(self.data)
        up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])

        def upto(ends: np.ndarray) -> np.ndarray:
            return mix((sums[ends] - sums[self.starts]) * down[self.starts] + (ends - self.starts).astype(np.uint64))

        whole = upto(self.ends)
        return [whole, *(upto(np.minimum(self.ends, self.starts + k)) for k in prefixes)] if prefixes else whole


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbouring word hashes; they may cross rows."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i : i + count]
    return mix(out)
