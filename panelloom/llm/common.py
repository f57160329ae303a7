"""Shared parts of the training-data operators: scratch tables and vectorised text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelloom.sources import scratch

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    return scratch.stored(df, tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE))), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse))), dtype=np.uint64)
        return self.up, self.down


POWERS = _Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; see span_hash."""
    up, _ = POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many spans at once; equal spans have equal hashes anywhere."""
    _, down = POWERS.get(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of the two-byte letters À to Þ."""
    out = LOWER[data]
    if len(out) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 32
    return out


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of alphanumeric words: every ASCII byte that is no letter or digit.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = True
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = False


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows, about ``size`` bytes each; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1 + col.offset)[col.offset :]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each row's first word's index (one more entry at the end)."""
    inside = ~separator[data]
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    starts_at[edges] = inside[edges]
    starts = np.flatnonzero(starts_at)
    stop = ~inside
    stop[edges] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, "right")]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of A-Z lower-cased words, and each row's first word's index."""
    starts, ends, firsts = word_spans(data, offsets, separator)
    return span_hash(prefix_hash(LOWER[data].astype(np.uint64) + np.uint64(1)), starts, ends), firsts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; a shorter non-empty sequence counts as one."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        width = min(size, len(words))
        h = np.full(len(words) - width + 1, np.uint64(width) * _BASE)
        for k in range(width):
            h = mix64(h * _BASE + words[k : len(words) - width + 1 + k])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
