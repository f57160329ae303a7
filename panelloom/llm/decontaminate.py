"""Benchmark decontamination by template canonicalisation.

Words become typed placeholders where they are numbers, units after a number, or names (capitalised,
but not all in capitals, inside a sentence); windows of the canonical words of benchmark items and documents are joined by hash.
All windows of their words in lower case are joined beside them, so that copies are found whatever their words are.
A document matches an item through runs of windows at one offset, and a run counts as a whole if its slots are
consistent: each value of the item's slots maps to one value in the document and back, as it does in a
re-parameterised question and doesn't in unrelated text of the same shape. Of a run in conflict its
longest consistent part counts, and what is literally equal.

Items that differ by the values of their slots alone are one template: they share its windows, so that a
thousand questions made from one template cost what one does.

Both sides are tables and meet in a join on the window's hash; neither is collected. A bit map of the benchmark's
hashes, of a fixed size, spares the join most windows of the documents; what it lets pass is decided by the join.

A document is contaminated by a template if consistent runs cover at least ``share`` of its words
or hold ``run`` words in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import NOT_WORD, lowered, mix64, prefix_hash, span_hash, stored, table, text_slices, word_spans

WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Fixed lists: number words and units of measure.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars usd eur euro euros percent kmh mph km2 m2 m3 degree degrees kwh watt watts volt volts".split()
_PLACEHOLDER = np.array([0, 0xA1B2C3D4E5F60701, 0xA1B2C3D4E5F60702, 0xA1B2C3D4E5F60703], np.uint64)


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), NOT_WORD)
    return np.sort(span_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), starts, ends))


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


_NUMBERS, _UNITS = _hash_words(NUMBERS), _hash_words(UNITS)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical hashes, literal hashes and kinds of words, and each row's first word's index."""
    starts, ends, firsts = word_spans(data, offsets, NOT_WORD)
    lower = lowered(data)
    literal = span_hash(prefix_hash(lower.astype(np.uint64) + np.uint64(1)), starts, ends)
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    kind = np.zeros(len(starts), np.int8)
    if len(starts):
        capital = (data[starts] >= 65) & (data[starts] <= 90)
        two = np.minimum(starts + 1, len(data) - 1)
        capital |= (data[starts] == 0xC3) & (data[two] >= 0x80) & (data[two] <= 0x9E)
        # a word all in capitals is no name: its second letter tells
        after = np.minimum(starts + np.where(data[starts] == 0xC3, 2, 1), len(data) - 1)
        deep = np.minimum(after + 1, len(data) - 1)
        capital &= (after < ends) & np.where(data[after] == 0xC3, data[deep] == lower[deep], data[after] == lower[after])
        ending = np.isin(data, np.frombuffer(b".!?:;\n\r\"", np.uint8))
        marks = np.concatenate(([0], np.cumsum(ending)))
        before = np.concatenate(([0], ends[:-1]))
        opens = marks[starts] > marks[before]
        opens[firsts[:-1][firsts[:-1] < len(starts)]] = True
        kind[capital & ~opens] = NAME
        number = (digits[ends] > digits[starts]) | _member(literal, _NUMBERS)
        kind[number] = NUMBER
        unit = _member(literal, _UNITS)
        unit[1:] &= number[:-1]
        unit[0] = False
        kind[unit & ~number] = UNIT
    return np.where(kind > 0, _PLACEHOLDER[kind], literal), literal, kind, firsts


def windows(canon: np.ndarray, kind: np.ndarray, firsts: np.ndarray, width: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of all windows inside rows with enough words that are no placeholder."""
    if len(canon) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(canon) - width + 1)
    row_end = firsts[np.searchsorted(firsts, at, "right")]
    plain = np.concatenate(([0], np.cumsum(kind == WORD)))
    at = at[(at + width <= row_end) & (plain[at + width] - plain[at] >= min(least_words, width))]
    return span_hash(prefix_hash(canon), at, at + width), at


def _consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether values map one to one."""
    pairs = len(np.unique(np.stack((a, b), 1), axis=0)) if len(a) else 0
    return pairs == len(np.unique(a)) == len(np.unique(b))


#: Bits of the map of the benchmark's hashes.
BITS = 1 << 24
TEMPLATE, COPY = 0, 1


def window_key(hashes: np.ndarray, width: int, way: int) -> np.ndarray:
    """What windows are joined by: one way of comparing words and one width never meet another."""
    return mix64(hashes ^ np.uint64(2 * width + way + 1)).view(np.int64)


def both_ways(canon: np.ndarray, literal: np.ndarray, kind: np.ndarray, firsts: np.ndarray, width: int, least_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(way, keys, starts) of the windows of templates, which need words that are no placeholder, and of copies."""
    for way, words, least in ((TEMPLATE, canon, least_words), (COPY, literal, 0)):
        h, at = windows(words, kind, firsts, width, least)
        yield way, window_key(h, width, way), at


def slot_names(literal: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each word the place of the first slot with its value, -1 where it is no slot: alike for all items of a template."""
    out = np.full(len(literal), -1, np.int32)
    slots = np.flatnonzero(kind > 0)
    if len(slots):
        _, first, of = np.unique(literal[slots], return_index=True, return_inverse=True)
        out[slots] = slots[first[of]]
    return out


ITEM_WINDOWS = "template binary, item_id long, item_words int, key long, at int, width int, way int, names array<int>"


def _item_windows(window: int, least_words: int):
    """Windows of items (item_id, text); an item without windows of its own gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in text_slices(batch):
                out: list[tuple] = []
                canon, literal, kind, firsts = canonical(data, offsets)
                for i in range(len(offsets) - 1):
                    a, b = int(firsts[i]), int(firsts[i + 1])
                    if a == b:
                        continue
                    c, w, k = canon[a:b], literal[a:b], kind[a:b]
                    names, width = slot_names(w, k), min(window, b - a)
                    template = hashlib.md5(c.tobytes() + names.tobytes()).digest()
                    for way, keys, at in both_ways(c, w, k, np.array([0, b - a]), width, least_words):
                        out += [(template, ids[first + i], b - a, key, s, width, way, names[s : s + width].tolist()) for key, s in zip(keys.tolist(), at.tolist(), strict=True)]
                if out:
                    names_of = [x.split()[0] for x in ITEM_WINDOWS.split(", ")]
                    types = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names_of)

    return run


def bit_map(windows_: DataFrame) -> np.ndarray:
    """A map of BITS bits with those of the windows' keys set; BITS / 64 numbers come to the driver, whatever the benchmark."""
    place = F.pmod("key", F.lit(BITS))
    one = F.expr("shiftleft(1L, cast(bit as int))")
    words = windows_.select(F.shiftright(place, 6).cast("int").alias("word"), place.bitwiseAND(63).alias("bit")).withColumn("one", one).groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


DOC_WINDOWS = "row long, doc_id long, key long, pos int, theirs array<long>"


def _doc_windows(shared, widths: list[int], least_words: int):
    """Windows of documents (row, doc_id, text) whose keys may be in the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for first, data, offsets in text_slices(batch):
                canon, literal, kind, firsts = canonical(data, offsets)
                for width in widths:
                    for _, keys, at in both_ways(canon, literal, kind, firsts, width, least_words):
                        place = keys.view(np.uint64) % np.uint64(BITS)
                        hit = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
                        keys, at = keys[hit], at[hit]
                        if not len(at):
                            continue
                        row = np.searchsorted(firsts, at, "right") - 1
                        flat = literal[(at[:, None] + np.arange(width)).ravel()].view(np.int64)
                        of = pa.array(first + row)
                        theirs = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(flat))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(keys), pa.array((at - firsts[row]).astype(np.int32)), theirs], names=["row", "doc_id", "key", "pos", "theirs"])

    return run


def _parts(starts: np.ndarray, width: int, names: np.ndarray, theirs: np.ndarray, copied: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a run that count, from the starts of its windows, its slots' names, the document's words and
    the starts of its literally equal windows: all of it if its slots are consistent, else its longest
    consistent part and what is literally equal."""
    slot = names >= 0
    if _consistent(names[slot], theirs[slot]):
        return [(0, len(names))]
    parts: list[tuple[int, int]] = []
    for s in copied.tolist():
        if parts and s <= parts[-1][1]:
            parts[-1] = (parts[-1][0], s + width)
        else:
            parts.append((s, s + width))
    # the first word from which all is consistent up to each word
    since, here, there, left = np.zeros(len(names), np.int64), {}, {}, 0
    for p, (x, y) in enumerate(zip(names.tolist(), theirs.tolist(), strict=True)):
        if x >= 0:
            for seen, value, other in ((here, x, y), (there, y, x)):
                if value in seen and seen[value][0] != other:
                    left = max(left, seen[value][1] + 1)
            here[x], there[y] = (y, p), (x, p)
        since[p] = left
    begin = np.searchsorted(starts, since[starts + width - 1])
    long = np.where(begin <= np.arange(len(starts)), starts + width - starts[np.minimum(begin, len(starts) - 1)], 0)
    best = int(long.argmax())
    if long[best]:
        parts.append((int(starts[begin[best]]), int(starts[best]) + width))
    return parts


def judged(item_words: int, width: int, pos: np.ndarray, at: np.ndarray, way: np.ndarray, names: np.ndarray, theirs: np.ndarray, share: float, run: int) -> tuple[int, int, bool, int] | None:
    """(words covered, longest run, literally equal, first word) of one document and template, or None.

    pos, at, way: places of the windows that met in the document and in the item, and how they met; names
    and theirs: a row of slots' names and of the document's words for each.
    """
    shift = pos - at
    order = np.lexsort((way, at, shift))
    shift, at, way, names, theirs = shift[order], at[order], way[order], names[order], theirs[order]
    covered, longest, exact, first = np.zeros(item_words, bool), 0, True, None
    # runs: windows of one shift that overlap or touch
    cut = np.flatnonzero((shift[1:] != shift[:-1]) | (at[1:] > at[:-1] + width)) + 1
    for part in np.split(np.arange(len(at)), cut):
        lo, hi = int(at[part[0]]), int(at[part[-1]]) + width
        own, words, equal = np.full(hi - lo, -1, np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
        cells = (at[part, None] - lo + np.arange(width)).ravel()
        own[cells], words[cells] = names[part].ravel(), theirs[part].ravel()
        copied = np.unique(at[part][way[part] == COPY]) - lo
        equal[(copied[:, None] + np.arange(width)).ravel()] = True
        for i, j in _parts(np.unique(at[part]) - lo, width, own, words, copied):
            covered[lo + i : lo + j] = True
            longest = max(longest, j - i)
            exact &= bool(equal[i:j].all())
            place = lo + i + int(shift[part[0]])
            first = place if first is None else min(first, place)
    if first is None or (covered.sum() < share * item_words and longest < run):
        return None
    return int(covered.sum()), longest, exact, first


RESULT = "doc_id long, item_id long, n_items long, covered long, item_words long, longest_run long, literal boolean, first_word long"


def _judge(share: float, run: int):
    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc_id, item_id, n_items, item_words, width, met in zip(f["doc_id"], f["item_id"], f["n_items"], f["item_words"], f["width"], f["met"], strict=True):
                pos, at, way = (np.array([m[k] for m in met], np.int64) for k in ("pos", "at", "way"))
                names, theirs = np.array([m["names"] for m in met], np.int64), np.array([m["theirs"] for m in met], np.int64)
                got = judged(int(item_words), int(width), pos, at, way, names, theirs, share, run)
                if got:
                    out.append((doc_id, item_id, n_items, got[0], item_words, *got[1:]))
            columns = [x.split()[0] for x in RESULT.split(", ")]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64", "item_id": "Int64"})

    return judge


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 8, least_words: int = 4, share: float = 0.5, run: int = 13) -> DataFrame:
    """One row for each row of ``docs`` and template of items it repeats or re-parameterises.

    item_id is the least of the ``n_items`` items of the template (items without item_id take part; it is
    null where all are so). Whole texts of all rows are searched; null or empty texts and items match
    nothing, repeated rows give repeated results, rows without doc_id have a null one. Items shorter than
    ``window`` words are searched as one window. Windows whose words are mostly placeholders are compared
    literally alone (``least_words``). An empty table on either side gives no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    found = stored(spark, items.mapInArrow(_item_windows(window, least_words), ITEM_WINDOWS), "item-windows")
    members = found.select("template", "item_id").distinct().groupBy("template").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    own = stored(spark, found.select("template", "key", "at", "width", "way", "names", "item_words").distinct().join(members, "template"), "template-windows")
    widths = sorted(r[0] for r in own.select("width").distinct().collect())  # at most ``window`` numbers
    shared = spark.sparkContext.broadcast(bit_map(own))  # BITS bits
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    theirs = stored(spark, rows.mapInArrow(_doc_windows(shared, widths, least_words), DOC_WINDOWS), "doc-windows")
    met = theirs.join(own, "key").groupBy("row", "template").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "item_id", "n_items", "item_words", "width")), F.collect_list(F.struct("pos", "at", "way", "names", "theirs")).alias("met")
    )
    return met.select("doc_id", "item_id", "n_items", "item_words", "width", "met").mapInPandas(_judge(share, run), RESULT)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
