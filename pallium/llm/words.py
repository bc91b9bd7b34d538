"""Words of whole texts as NumPy arrays over UTF-8 bytes, and hashes of word windows.

A word is a maximal run of bytes outside x20 and x09-x0D. These are ASCII, so cutting bytes cuts
code points nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Fixed seed: hashes must be equal on all executors.
_rng = np.random.default_rng(20_240_117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = _rng.integers(1, 1 << 62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_hashes(data: np.ndarray, length: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each of the words, at least one and none empty, whose bytes lie one behind the other."""
    begin = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(begin, length)
    x = _BYTE[data] * powers(_ODD[which], int(length.max()))[place]
    return mix(np.add.reduceat(x, begin) + length.astype(np.uint64) * _ODD[3])


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts joined by a line feed each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    values = [b"" if t is None else t for t in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
    offsets = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) + 1 for v in values], out=offsets[1:])
    return np.frombuffer(b"\n".join([*values, b""]), dtype=np.uint8), offsets


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """Slices of a batch whose rows' sizes add up to at most `most` each; a larger row gets its own slice."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with at most about `most` bytes of text each; a longer text gets its own slice."""
    return slices(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), most)


class Words:
    """Words of a batch of texts: byte spans [start, end) and the range [first[i], first[i+1]) of text i."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        self.data, self.offsets = text_bytes(texts)
        inside = ~_SPACE[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        # every text ends with a line feed, so each start has its end
        self.start, self.end = edge[0::2], edge[1::2]
        self.inside = inside
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        return byte_hashes(self.data[self.inside], self.end - self.start, which)

    def windows(self, word_hash: np.ndarray, size: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of all windows of `size` words that lie within one text."""
        n = len(word_hash)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        power, back = powers(_ODD[which], n), powers(_inverse(_ODD[which]), n)
        total = np.concatenate([[np.uint64(0)], np.cumsum(word_hash * power, dtype=np.uint64)])
        at = np.arange(n - size + 1)
        text = self.text_of_word()
        at = at[text[at] == text[at + size - 1]]
        return at, mix((total[at + size] - total[at]) * back[at])

    def without(self, drop: np.ndarray) -> list[bytes]:
        """Per text, its bytes without the dropped words and the white space behind each of them."""
        behind = np.minimum(np.append(self.start[1:], len(self.data)), self.offsets[1:][self.text_of_word()] - 1) if len(self) else self.start
        change = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.add.at(change, self.start[drop], 1)
        np.add.at(change, behind[drop], -1)
        chosen = np.cumsum(change[:-1]) == 0
        chosen[self.offsets[1:] - 1] = False
        before = np.concatenate([[0], np.cumsum(chosen)])
        packed, cut = self.data[chosen].tobytes(), before[self.offsets].tolist()
        return [packed[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def join_kept(self, keep: np.ndarray) -> list[bytes]:
        """Per text, the kept words joined by one space."""
        size = len(self.data)
        change = np.zeros(size + 1, dtype=np.int8)
        np.add.at(change, self.start[keep], 1)
        np.add.at(change, self.end[keep] + 1, -1)
        chosen = np.cumsum(change[:-1], dtype=np.int8) > 0  # a word and the byte behind it
        out = self.data.copy()
        out[self.end[keep]] = 0x20
        before = np.concatenate([[0], np.cumsum(chosen)])
        packed = out[chosen].tobytes()
        cut = before[self.offsets].tolist()
        return [packed[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)]
