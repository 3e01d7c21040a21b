"""Vectorised word splitting and hashing over Arrow string columns.

Every helper works on the column's own buffers: the UTF-8 bytes of all rows lie back to back, so
one numpy expression covers a whole record batch and no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch; texts may be long, so a batch is kept small.
ARROW_ROWS = 256
#: UTF-8 bytes, and words, handled by one numpy expression; one longer text is handled whole.
CHUNK_BYTES = 1 << 18
CHUNK_WORDS = 1 << 16

_MASK = (1 << 64) - 1
_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WMUL = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: The bytes that end a word `[^\x20\x09-\x0D]+`.
SPACE = separators(b" \t\n\x0b\x0c\r")
#: The bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, A-Z being lower-cased first.
NOT_ALNUM = separators(bytes(b for b in range(128) if not chr(b).isalnum()))
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Texts can be very long: ask for small Arrow batches unless the session already has some."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in _MUL]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(mul: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mul**i and mul**-i modulo 2**64 for i < n.  A worker keeps them for a chunk, not for a longer text."""
    have = _POWERS.get(mul)
    if have is not None and len(have[0]) >= n:
        return have
    up = np.full(max(n, CHUNK_WORDS), mul, np.uint64)
    down = np.full(len(up), pow(mul, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
    if n <= CHUNK_BYTES + 2:
        _POWERS[mul] = up, down
    return up, down


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) over runs of rows; a null row has no bytes.

    A run holds at most `limit` bytes unless one row alone is longer.
    """
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for a in arrays:
        wide = pa.types.is_large_string(a.type)
        if not (wide or pa.types.is_string(a.type)):
            a, wide = a.cast(pa.large_string()), True
        n = len(a)
        if not n:
            continue
        _, offs, data = a.buffers()
        off = np.frombuffer(offs, np.int64 if wide else np.int32)[a.offset : a.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), n)
            yield first + at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
        first += n


def split_words(raw: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row index bounds (`words of row r` are `bounds[r]:bounds[r+1]`)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~sep[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begin[edge] |= word[edge]
    end[edge - 1] |= word[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal bytes have equal hashes in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(_MUL[which], len(raw) + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[which][raw] * up[: len(raw)], out=acc[1:])
        return mix((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes, over row ends too: mask those yourself."""
    n = len(words) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for a in range(0, n, CHUNK_WORDS):
        part = words[a : a + CHUNK_WORDS + size - 1]
        k = len(part) - size + 1
        up, down = _powers(_WMUL[which], len(part) + 1)
        with np.errstate(over="ignore"):
            acc = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=acc[1:])
            out[a : a + k] = mix((acc[size : size + k] - acc[:k]) * down[:k] + np.uint64(size))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
