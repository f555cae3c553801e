"""Vectorised word splitting and hashing of Arrow string columns.

Texts are handled as UTF-8 bytes.  Both word definitions in use only name ASCII
separators, and every byte of a non-ASCII character is above 0x7F, so byte classes
and character classes agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one step handles; bounds the memory of a task.
STEP_BYTES = 1 << 21

_byte = np.arange(256)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)
#: Words [^\x20\x09-\x0D]+
SPACED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = np.isin(LOWER, np.r_[0x30:0x3A, 0x61:0x7B]) | (_byte >= 0x80)

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


class Words(NamedTuple):
    first: np.ndarray  # of each text, its first word; one more entry at the end
    hash: np.ndarray  # uint64 of each word
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    data: np.ndarray  # lower-cased bytes
    offsets: np.ndarray  # of the texts in data

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offset of each."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, is_word: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words of each text and a 64-bit hash of each word's bytes."""
    raw, offsets = buffers(texts)
    data = LOWER[raw] if lower else raw
    inside = is_word[raw]
    opens = np.zeros(len(raw) + 1, bool)
    opens[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | opens[1:])) + 1
    first = np.searchsorted(start, offsets)
    return Words(first, _hash(data, inside, start, end), start, end, data, offsets)


def _hash(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    longest = int((end - start).max())
    power = np.full(longest + 1, _BASE)
    power[0] = U64(1)
    power = np.multiply.accumulate(power)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + (1 << 20))))
        lo, hi = start[at], end[to - 1]
        begins = start[at:to] - lo
        code = _BYTE_CODE[data[lo:hi]]
        code[~inside[lo:hi]] = 0
        place = np.arange(hi - lo) - np.repeat(begins, np.diff(np.append(begins, hi - lo)))
        code *= power[np.minimum(place, longest)]
        out[at:to] = np.add.reduceat(code, begins)
        at = to
    return mix(out + (end - start).astype(np.uint64))


def grams(hash_: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that start at each word, over text borders too (see inside_text)."""
    if len(hash_) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hash_) - n + 1, np.uint64)
    for i in range(n):
        total += hash_[i : len(hash_) - n + 1 + i] * _GRAM[i]
    return mix(total + U64(n))


def inside_text(text: np.ndarray, n: int) -> np.ndarray:
    """Of each window of n words, whether one text holds all of it."""
    return text[: len(text) - n + 1] == text[n - 1 :] if len(text) >= n else np.zeros(0, bool)


def steps(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about STEP_BYTES of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + STEP_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def lists(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)


def longs(values: np.ndarray) -> pa.Array:
    """uint64 hashes as the int64 that Spark knows."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
