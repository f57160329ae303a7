"""Document fingerprints by locally consistent parsing.

Code points are parsed into phrases, phrases into longer phrases, and so on. At each level runs of one
symbol become one name, deterministic coin tossing against the left neighbour shrinks symbols to labels
below six, and phrases begin at local maxima of the labels; a phrase's name is the hash of its symbols.
Where a phrase begins depends on a few symbols around it, so equal substrings share all interior phrase
names at every level, wherever they stand. A fingerprint is a one-permutation sketch of a document's
phrase names of levels 3 and 4 (about 30 and 100 characters).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import mix64, prefix_hash, span_hash, table, text_slices
from panelloom.llm.near_dedup import _probe_table, one_permutation

LEVELS = (3, 4)
BINS = 64


def _toss_table(size: int) -> np.ndarray:
    """Labels of (symbol, left neighbour) pairs of small symbols: twice the lowest differing bit, plus its value."""
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    x = a ^ b
    low = np.zeros_like(x)
    for bit in range(size.bit_length() - 1, -1, -1):
        low[(x >> bit) & 1 == 1] = bit
    return (2 * low + ((a >> low) & 1)).astype(np.uint8)


_TOSS = [_toss_table(128), _toss_table(16), _toss_table(8)]


def parse(symbols: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of several sequences laid end to end, and each one's first phrase.

    firsts has an entry for each sequence and one for the end; sequences may be empty.
    """
    n = len(symbols)
    if not n:
        return symbols, np.zeros(len(firsts), np.int64)
    opens = np.zeros(n, bool)
    opens[firsts[:-1][np.diff(firsts) > 0]] = True
    head = opens.copy()
    head[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, n)).astype(np.uint64)
    s = symbols[at]
    long = runs > 1
    s[long] = mix64(s[long] * np.uint64(0x9E3779B97F4A7C15) + runs[long])
    opens, firsts = opens[at], np.searchsorted(at, firsts)
    left = np.empty_like(s)
    left[1:] = s[:-1]
    left[opens] = ~s[opens]
    x = s ^ left
    low = x & (~x + np.uint64(1))
    bit = np.where(x == 0, 0, (low.astype(np.float64).view(np.int64) >> 52) - 1023).astype(np.uint64)
    label = (np.uint64(2) * bit + ((s >> bit) & np.uint64(1))).astype(np.uint8)
    for toss in _TOSS:
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[opens] = label[opens] ^ 1
        label = toss[label, before]
    label = label.astype(np.int8)
    before, after = np.full(len(s), -1, np.int8), np.full(len(s), -1, np.int8)
    before[1:] = label[:-1]
    before[opens] = -1
    after[:-1] = label[1:]
    after[:-1][opens[1:]] = -1
    begins = np.flatnonzero(opens | ((label > before) & (label > after)))
    names = span_hash(prefix_hash(s), begins, np.append(begins[1:], len(s)))
    return names, np.searchsorted(begins, firsts)


def phrase_names(codes: np.ndarray, firsts: np.ndarray, levels: tuple[int, ...] = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, firsts) of each wanted level."""
    symbols, out = mix64(codes.astype(np.uint64) + np.uint64(1)), []
    for level in range(1, max(levels) + 1):
        symbols, firsts = parse(symbols, firsts)
        if level in levels:
            out.append((mix64(symbols + np.uint64(level)), firsts))
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows and their offsets."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return codes, begins[offsets]


class Printer:
    """Fingerprints of rows of UTF-8 text, as bytes (empty for an empty text)."""

    def __init__(self, bins: int = BINS) -> None:
        self.bins, self.probes = bins, _probe_table(bins)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        levels = phrase_names(*code_points(data, offsets))
        out = []
        for i in range(len(offsets) - 1):
            names = np.unique(np.concatenate([n[f[i] : f[i + 1]] for n, f in levels]))
            out.append(one_permutation(names, self.bins, self.probes).astype("<u2").tobytes() if len(names) else b"")
        return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of sketch bins in which two fingerprints agree; two empty ones are alike."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def _marker(bounds: np.ndarray, firsts: np.ndarray):
    """Rows to (range, guest, at, doc_id, text, print); each range's first row also goes to the range before."""
    least = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            at = ids.fill_null(least).to_numpy()
            place = np.searchsorted(bounds, at, "right")
            for row, data, offsets in text_slices(batch):
                n = len(offsets) - 1
                own, key = place[row : row + n], at[row : row + n]
                prints = pa.array(printer(data, offsets), pa.binary())
                base = [pa.array(key), ids.slice(row, n), texts.slice(row, n), prints]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.zeros(n, np.int32)), *base], names=NAMES)
                guest = np.flatnonzero(key == firsts[own])
                if len(guest):
                    # firsts of empty ranges are the next range's, so the range before is the last smaller one that holds rows
                    before = np.searchsorted(firsts, firsts[own[guest]], "left") - 1
                    wraps = before < 0
                    held = np.flatnonzero(np.append(firsts[1:], np.iinfo(np.int64).max) > firsts)
                    to = np.where(wraps, held[-1], held[np.maximum(0, np.searchsorted(held, before, "right") - 1)])
                    yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.where(wraps, 2, 1).astype(np.int32)), *(c.take(pa.array(guest)) for c in base)], names=NAMES)

    return run


NAMES = ["range", "guest", "at", "doc_id", "text", "print"]


def _pairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to results: each row with the one after it in its range; guests only come after."""
    printer, held = Printer(), None
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for _, t, _, nxt, _ in rows]
        raw = [e.encode("utf-8", "replace") for e in edited]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        prints = printer(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()), "edited_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
            "fingerprint": pa.array([r[2].hex() for r in rows]), "edited_fingerprint": pa.array([p.hex() for p in prints]),
            "near_edited": pa.array([likeness(r[2], p) for r, p in zip(rows, prints, strict=True)], pa.float64()), "near_next": pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
        })

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            for row in zip(*(part.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text", "print")), strict=True):
                if held is not None and held[0] == row[0] and not held[1]:
                    rows.append((held[2], held[3], held[4], row[3], row[4]))
                    size += len(held[3])
                    if size > 1 << 20:
                        yield flush()
                        rows.clear()
                        size = 0
                held = row
    if rows:
        yield flush()


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print binary) of every row's whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer()
        for batch in batches:
            for row, data, offsets in text_slices(batch):
                prints = printer(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(prints)), pa.array(prints, pa.binary())], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, print binary")


def compared(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """RESULT of every row of ``docs`` (doc_id, text, ...) against its edited text and the next document.

    Rows are in ascending doc_id order, nulls first, ties by text; null texts are empty; the last row's
    next one is the first; an empty table gives no rows. Ranges of doc_id, as many as four times the
    shuffle partitions, are cut at quantiles; texts are shuffled once, sorted within ranges and streamed,
    and each range gets a copy of the row that begins the next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(key.alias("at"))
    ends = ids.agg(F.expr(f"approx_percentile(at, array({', '.join(str(k / parts) for k in range(1, parts))}), {4 * parts})")).first()[0] if parts > 1 else []
    bounds = np.unique(np.array(ends or [], np.int64))
    # the least id of each range: as many numbers as there are ranges
    cut = F.pandas_udf(lambda at: at.__class__(np.searchsorted(bounds, at.to_numpy(), "right")), "int")
    least = {r[0]: r[1] for r in ids.groupBy(cut("at").alias("range")).agg(F.min("at")).collect()}
    firsts = np.full(len(bounds) + 1, np.iinfo(np.int64).max, np.int64)
    for k, v in least.items():
        firsts[k] = v
    firsts = np.minimum.accumulate(firsts[::-1])[::-1]
    schema = "range int, guest int, at long, doc_id long, text string, print binary"
    marked = rows.mapInArrow(_marker(bounds, firsts), schema).repartition("range")
    return marked.sortWithinPartitions("range", "guest", "at", "text").mapInArrow(_pairer, RESULT)


def op8_lcp_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return compared(spark, table(spark, sf_dir, "documents"))
